import hashlib
import math

import numpy as np

from corpusloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, x string"


def brute(rows, k=8, rounds=10, size=64):
    """id, cluster, distance and so on of plain rounds over all vectors, in whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v):
            x = [math.floor(1024 * float(np.float32(c))) for c in v]
            if max(map(abs, x)) <= 1 << 27:
                kept.append((i, x))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in order[:k]]
    x = np.array([v for _, v in kept], np.int64).reshape(len(kept), size)

    def assign():
        return np.stack([((x - np.array(p)) ** 2).sum(axis=1) for p in c], axis=1)

    for _ in range(rounds):
        best = assign().argmin(axis=1)
        c = [[int(s) // int((best == j).sum()) for s in x[best == j].sum(axis=0)] if (best == j).any() else p for j, p in enumerate(c)]
    d = assign()
    best, far = d.argmin(axis=1), d.min(axis=1)
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in c]
    return sorted(((i, int(b), int(f), int(far[best == b].sum()), int(far.sum()), sha[b]) for (i, _), b, f in zip(kept, best, far, strict=True)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((5, 64))
    x = middle[rng.integers(0, 5, 400)] * 0.4 + rng.standard_normal((400, 64)) * 0.2
    x[:130] = x[0]  # a hot vector, equal starting centroids among its copies
    rows = [(i if i != 7 else None, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [1.0]), (902, [float("nan")] * 64), (903, [None, *[0.0] * 63]), (904, [math.inf] * 64), (905, [1e30] * 64), (906, [])]
    df = spark.createDataFrame([(*r, "c", "x") for r in [*rows, *odd, rows[9]]], SCHEMA)
    want = brute([*rows, *odd, rows[9]])
    assert rows_of(centroids.cluster(df.repartition(6))) == want
    assert rows_of(centroids.cluster(df.coalesce(1))) == want


def test_only_expired_gaps_are_read_again(spark, tmp_path):
    """Clusters far apart: after the first moves nobody's gap expires, and nothing is popped any more."""
    rng = np.random.default_rng(4)
    x = np.repeat(np.eye(8, 64) * 50, 20, axis=0) + rng.standard_normal((160, 64)) * 0.01
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    popped, scan = [], centroids._scan

    def counted(some, state, size):
        popped.append(some.count())
        scan(some, state, size)

    centroids._scan = counted
    try:
        got = rows_of(centroids.cluster(df))
    finally:
        centroids._scan = scan
    assert got == brute(rows)
    assert popped[0] == 160 and popped[-1] == 0 and sum(popped) < 11 * 160 / 2


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(v), *[0.0] * 63]) for i, v in enumerate([0, 2, 1, 1, 1, 4, 3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (1, 2, 3):
        assert rows_of(centroids.cluster(df, k=k, rounds=3)) == brute(rows, k=k, rounds=3)


def test_large_entries_few_vectors_and_none(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(64) * 20000).astype(np.float32).tolist()) for i in range(5)]
    assert rows_of(centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == brute(rows)
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(centroids.op12_heap_clusters(spark, sf_dir)) == brute(rows)
