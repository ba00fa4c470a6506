"""Centroid clustering with heap-ordered bounds.

Every vector has a gap: a lower bound of its distance to the second nearest centroid minus an upper bound of that to
its own. When centroids move, a gap of cluster j shrinks by at most j's own move plus the largest move of the others.
That sum is kept once a cluster (`drift`), and a vector enters its cluster's heap under the key gap + drift at that time:
it has to be looked at again only when the cluster's drift has reached its key.

A heap lies in the shared folder as runs of rows sorted by (cluster, key), one a task and round: its pops are their
prefixes. A round reads, of all runs so far, the rows whose key lies between the cluster's drift of the
last round and that of this one (a filter that the Parquet scan takes, so that blocks of rows that don't expire are
skipped), finds their two nearest centroids by exact integer distances, and writes them to the round's own runs with
new clusters and keys. Rows with lower keys have been popped before and live on in a later run; so runs are never
rewritten, no vector is shuffled, and a cluster with a third of all rows is spread over all tasks. Sums and sizes of the
clusters change by the rows that moved, in whole numbers, so that they don't depend on how rows are dealt.

The driver holds centroids, sums, sizes and drifts: a few numbers for each of k clusters.

Defined cases: vectors that are null, of another length, hold null or non-finite entries, or scaled entries beyond
2 ** 27 (whose squared distances leave a long) go; rows that repeat a vec_id are vectors of their own, and where they
have equal hashes the lesser vector starts first; a null vec_id hashes as empty; with fewer vectors than k each starts
a cluster; equal starting vectors leave the later cluster empty, and it stays where it is; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import shared_dir, staged
from corpusloom.llm.vectors import packed, scaled, unpacked

SIZE, FACTOR, MOST = 64, 1024, 1 << 27
#: Rounding of bounds and drifts, of which each is below 2 ** 31 and so right to 2 ** -21.
SLACK = 1e-5
BLOCK = 1 << 14


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 22:  # products of doubles are exact below 2 ** 53
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the lesser number of equals, and the gap to the second."""
    d = distances(x, centroids)
    best = d.argmin(axis=1)
    if d.shape[1] == 1:
        return best, np.full(len(x), np.inf)
    two = np.partition(d, 1, axis=1)
    return best, np.sqrt(two[:, 1].astype(np.float64)) - np.sqrt(two[:, 0].astype(np.float64))


@dataclass
class State:
    """What the driver knows of the clusters after a round."""

    centroids: list[list[int]]
    sums: list[list[int]]
    sizes: list[int]
    drift: list[float]
    before: list[float]
    folder: str
    runs: int = 0

    def moved(self) -> None:
        """New centroids from sums and sizes; drifts grow by the moves."""
        new = [[s // n for s in total] if n else old for total, n, old in zip(self.sums, self.sizes, self.centroids, strict=True)]
        move = [float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) ** 0.5 for x, y in zip(new, self.centroids, strict=True)]
        others = [max((m for i, m in enumerate(move) if i != j), default=0.0) for j in range(len(move))]
        self.before = self.drift
        self.drift = [d + m + o for d, m, o in zip(self.drift, move, others, strict=True)]
        self.centroids = new


def _past(drift: list[float]) -> Column:
    """Rows whose key the drift of their cluster has reached."""
    out = F.lit(False)
    for j, d in enumerate(drift):
        out = out | ((F.col("cluster") == j) & (F.col("key") <= d + SLACK))
    return out


def _alive(spark, state: State, kind: str, popped: list[float]) -> DataFrame:
    """All runs without what was popped from them: the last one is whole."""
    runs = spark.read.schema(f"id {kind}, x binary, was int, cluster int, key double, run int").parquet(state.folder)
    return runs.where((F.col("run") == state.runs - 1) | ~_past(popped))


def _scan(rows: DataFrame, state: State, size: int) -> None:
    """Assign rows (id, x, was) anew, write them as the next run, and bring sums and sizes up to date."""
    c, drift, k = np.array(state.centroids, np.int64), np.array(state.drift), len(state.centroids)

    def assign(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                best, gap = nearest(unpacked(part.column(1), size), c)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best.astype(np.int32)), pa.array(gap + drift[best])], names=["id", "x", "was", "cluster", "key"])

    kind = dict(rows.dtypes)["id"]
    made = rows.select("id", "x", "was").mapInArrow(assign, f"id {kind}, x binary, was int, cluster int, key double")
    path = f"{state.folder}/run={state.runs}"
    made.sortWithinPartitions("cluster", "key").write.parquet(path)
    state.runs += 1
    run = rows.sparkSession.read.schema(made.schema).parquet(path)

    def change(batches):
        total, sizes = np.zeros((k, size), object), np.zeros(k, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x, was, now = unpacked(part.column(0), size), part.column(1).to_numpy(), part.column(2).to_numpy()
                for j in range(k):
                    total[j] += x[now == j].sum(axis=0) - x[was == j].sum(axis=0)
                    sizes[j] += (now == j).sum() - (was == j).sum()
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(k), pa.int32()), "dim": pa.array([size] * k, pa.int32()), "v": list(map(str, sizes.tolist()))})
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.repeat(np.arange(k, dtype=np.int32), size)), "dim": pa.array(np.tile(np.arange(size, dtype=np.int32), k)), "v": [str(v) for v in total.ravel()]})

    went = run.where("was <> cluster").select("x", "was", "cluster").mapInArrow(change, "cluster int, dim int, v string")
    for r in went.groupBy("cluster", "dim").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # k * (size + 1) rows
        if r.dim == size:
            state.sizes[r.cluster] += int(r.v)
        else:
            state.sums[r.cluster][r.dim] += int(r.v)


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = SIZE, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that is kept."""
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    schema = f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                rows, x = scaled(part.column(1), size, FACTOR, MOST)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(packed(x), pa.binary()), pa.array(np.full(len(x), -1, np.int32))], names=["id", "x", "was"])

    rows = staged(df.select(key, vector).mapInArrow(pack, f"id {kind}, x binary, was int"), "cluster-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [r.x for r in rows.select("x", order.alias("h")).orderBy("h", "x").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], schema)
    start = unpacked(pa.array(map(bytes, first), pa.binary()), size).tolist()
    k = len(start)
    state = State(start, [[0] * size for _ in range(k)], [0] * k, [0.0] * k, [0.0] * k, shared_dir(spark, "cluster-heaps"))
    _scan(rows, state, size)
    for _ in range(rounds):
        state.moved()
        expired = _alive(spark, state, kind, state.before).where(_past(state.drift))
        _scan(expired.withColumn("was", F.col("cluster")), state, size)
    c = np.array(state.centroids, np.int64)

    def measure(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                own = part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(((unpacked(part.column(1), size) - c[own]) ** 2).sum(axis=1))], names=["id", "cluster", "distance"])

    done = staged(_alive(spark, state, kind, state.drift).select("id", "x", "cluster").mapInArrow(measure, f"id {kind}, cluster int, distance long"), "cluster-distances")
    per = {r.cluster: r.s for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in state.centroids]
    table = spark.createDataFrame([(j, per.get(j, 0), sum(per.values()), sha[j]) for j in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(table), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_heap_clusters(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
