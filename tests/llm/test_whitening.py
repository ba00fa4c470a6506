import math

import numpy as np
import pytest

from corpusloom.llm import whitening
from corpusloom.llm.vectors import packed, unpacked

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def test_packed_rows_come_back():
    import pyarrow as pa

    x = np.array([[0, 127, -128], [128, 0, 0], [-129, 5, 5], [1 << 40, -1, 0], [-(1 << 31), 0, 1]], np.int64)
    raw = packed(x)
    assert [r[0] for r in raw] == [1, 2, 2, 8, 4] and len(set(raw)) == 5
    assert (unpacked(pa.array(raw, pa.binary()), 3) == x).all()
    assert (unpacked(pa.array(raw, pa.binary()).slice(1, 3), 3) == x[1:4]).all()


@pytest.mark.parametrize("seed", range(6))
def test_spectrum(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    e = [rng.uniform(1, 2, n), np.repeat(3.0, n), np.r_[1e9, np.ones(n - 1)], 10.0 ** rng.uniform(-6, 6, n), np.r_[np.zeros(n // 2), np.ones(n - n // 2)], 5 + 1e-13 * rng.standard_normal(n)][seed]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.spectrum(a)
    assert np.allclose(values, np.sort(e)[::-1], atol=1e-11 * e.max())
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-11
    assert np.abs(a @ vectors - vectors * values).max() < 1e-10 * e.max()


def test_polar_factor_of_a_nearly_singular_matrix():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    e = np.r_[1e-14, -1e-9, 3, -2, rng.uniform(-1, 1, 8)]
    u = whitening.polar((q * e) @ q.T)
    assert np.abs(u @ u - np.eye(12)).max() < 1e-10
    assert np.abs((q.T @ u @ q).diagonal()[1:] - np.sign(e[1:])).max() < 1e-4


def brute(rows, k=16):
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in good})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[a - s / n for a, s in zip(x, total, strict=True)] for x in fit])
    cov = z.T @ z / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        w = np.abs(np.array([a - s / n for a, s in zip(x, total, strict=True)]) @ vectors) / np.sqrt(values)
        out.setdefault(i, []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)), w, values / np.trace(cov)))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 20)) * np.linspace(0.3, 2, 20)
    x[:100] = x[0]  # a hot vector
    rows = [(i if i else None, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [float("nan")] * 20), (1002, [None, *[0.0] * 19]), (1003, [math.inf, *[0.0] * 19]), (1004, [1.0]), (1005, []), (1006, [3e38, *[0.0] * 19])]
    df = spark.createDataFrame([(*r, "c", "n") for r in [*rows, *odd, rows[5]]], SCHEMA).repartition(5)
    got = whitening.whiten(df).collect()
    want = brute([*rows, rows[5]])
    assert len(got) == 301 * 16
    seen = {}
    for r in got:
        n, deviation, w, share = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, deviation) and n == 201
        assert abs(abs(r.whitened) - w[r.component - 1]) < 1e-8 and abs(r.explained - share[r.component - 1]) < 1e-12
        assert r.identity_error < 1e-10
        seen.setdefault((r.vec_id, r.component), set()).add(r.whitened)
    assert all(len(s) == 1 for s in seen.values())  # equal rows get equal figures
    other = {(r.vec_id, r.component): r.deviation for r in whitening.whiten(df.repartition(2)).collect()}
    assert other == {(r.vec_id, r.component): r.deviation for r in got}


def test_large_entries_are_exact(spark):
    rows = [(i, [float(np.float32(10.0**i)), float(-(3**i)), 0.5]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(df).collect()}
    want = {i: v[0][1] for i, v in brute(rows).items()}
    assert got == {i: d if d < 1 << 63 else None for i, d in want.items()} and None in got.values()


def test_without_variance(spark):
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.5, 0.25])], "vec_id long, embedding array<float>")).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True}
    assert all(r.identity_error < 1e-12 for r in line)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_query(spark, sf_dir):
    got = whitening.op11_whitening(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([tuple(r) for r in rows])
    seen = got.collect()
    assert len(seen) == 16 * len(rows)
    assert all(abs(abs(r.whitened) - want[r.vec_id][0][2][r.component - 1]) < 1e-6 and r.deviation == want[r.vec_id][0][1] and r.identity_error < 1e-9 for r in seen)
