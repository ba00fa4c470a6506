"""Embedding whitening: principal components by QDWH spectral divide and conquer, one matrix for all tasks.

Vectors become integers, so that every sum over the fit list is exact and no figure depends on how rows are dealt. The
covariance has dimensions x dimensions entries whatever the table holds; it is summed in the tasks, entry by entry in
the shuffle, and split on the driver: the polar factor of the covariance minus a shift, found by the dynamically
weighted Halley iteration, gives the projector on the components above the shift; both invariant subspaces are split
in the same way until single components, or ones of equal size, are left. The tasks get the components as one small
matrix (dimensions x at most 16).

The fit list, each distinct vector once, comes from one shuffle of packed rows (a byte an entry for unit vectors), which
meet in the map tasks first; a hot vector is one row a task.

Defined cases: a null vector, one with null or non-finite entries, and one whose scaled entries leave 2 ** 62 go;
vectors of another length than the commonest (the greater of two as common) go too, as do empty ones; rows that repeat
a vec_id, or have none, stay as they are; equal eigenvalues have some orthonormal basis of their space, the same for
all rows; a component without variance (up to rounding) has a null `whitened` and is left out of identity_error, which
is null where no component is left; `deviation` is null where it exceeds a long; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import staged
from corpusloom.llm.vectors import commonest_size, packed, scaled, unpacked

FACTOR, MOST = 64, 1 << 62
COMPONENTS = 16
#: Rows whose products a task sums in longs before it hands them on, and the entries up to which that is exact.
FLUSH, EXACT = 1 << 20, 1 << 19
#: Rows of one matrix product: EXACT ** 2 * BLOCK stays below 2 ** 53.
BLOCK = 1 << 14
EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray, least: float = EPS) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QDWH iteration; least: bound below its singular values over its norm."""
    n = len(a)
    x, low = a / np.linalg.norm(a), least
    for _ in range(40):
        s = low * low
        d = np.cbrt(4 * (1 - s) / (s * s)) if s < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - s) / (s * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        before = x
        if wc > 100:  # by a QR decomposition while the weights are large, then by the cheaper Cholesky form
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            w = np.linalg.cholesky(np.eye(n) + wc * (x.T @ x))
            y = np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
            x = wb / wc * x + (wa - wb / wc) * y
        low = min(1.0, low * (wa + wb * s) / (1 + wc * s))
        x = (x + x.T) / 2
        if 1 - low < 10 * EPS and np.linalg.norm(x - before) < 1e-5:  # the iteration is cubic: the next step would change nothing
            break
    return x


def split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of a's invariant subspaces above and below the shift; None where the shift does not part them."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = round(float(np.trace(projector)))
    if not 0 < k < n:
        return None
    basis = projector @ rng.standard_normal((n, k))
    for _ in range(2):
        basis = projector @ np.linalg.qr(basis)[0]
    q = np.linalg.qr(basis, mode="complete")[0]
    above, below = q[:, :k], q[:, k:]
    if np.linalg.norm(above.T @ a @ below) > 1e-12 * np.sqrt(n) * np.linalg.norm(a):
        return None  # the shift lies on an eigenvalue
    return above, below


def spectrum(a: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    rng = np.random.default_rng(seed)
    whole = np.linalg.norm(a)
    pairs: list[tuple[float, np.ndarray]] = []
    left = [np.eye(len(a))]  # bases of the subspaces that are not split yet
    while left:
        basis = left.pop()
        own = basis.T @ a @ basis
        own = (own + own.T) / 2
        n, mean = len(own), float(np.trace(own)) / max(1, len(own))
        if n <= 1 or np.linalg.norm(own - mean * np.eye(n)) <= 8 * EPS * n * whole:
            pairs.extend((float(own[i, i]), basis[:, i]) for i in range(n))
            continue
        # the median of the diagonal halves the work; the mean parts any spectrum; others where those lie on an eigenvalue
        spread = float(np.linalg.norm(own - mean * np.eye(n))) / np.sqrt(n)
        shifts = [float(np.median(np.diag(own))), mean, *(mean + spread * rng.uniform(-0.5, 0.5) for _ in range(30))]
        two = next((x for x in (split(own, s, rng) for s in shifts) if x is not None), None)
        if two is None:  # eigenvalues too close for any shift: turn them by Jacobi's rotations, which need no gap
            values, vectors = jacobi(own)
            pairs.extend((float(e), basis @ v) for e, v in zip(values, vectors.T, strict=True))
            continue
        left.extend(np.linalg.qr(basis @ part)[0] for part in two)
    vectors = np.array([v / np.linalg.norm(v) for _, v in pairs]).T.reshape(len(a), len(pairs))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] if len(values) else np.zeros(0)
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, v = a.copy(), np.eye(len(a))
    for _ in range(60):
        off = a - np.diag(np.diag(a))
        if np.linalg.norm(off) <= EPS * np.linalg.norm(a):
            break
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if a[p, q]:
                    t = np.arctan2(2 * a[p, q], a[q, q] - a[p, p]) / 2
                    turn = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
                    a[:, [p, q]] = a[:, [p, q]] @ turn
                    a[[p, q]] = turn.T @ a[[p, q]]
                    v[:, [p, q]] = v[:, [p, q]] @ turn
    return np.diag(a), v


def _rows(keys, size: int):
    """Blocks of the matrix of a column of packed rows."""
    for b in keys:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            yield part, unpacked(part.column(part.num_columns - 1), size)


def _summed(df: DataFrame, size: int, cells: int, add, kind: str) -> list:
    """Sums of `cells` figures over the packed rows of df, made by add(matrix); the driver gets one row a figure."""

    def run(batches):
        total, rows = None, 0
        for _, y in _rows(batches, size):
            part = add(y)
            total, rows = part if total is None else total + part, rows + len(y)
            if rows >= FLUSH:
                yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(cells), pa.int32()), "v": list(map(str, total.tolist()))})
                total, rows = None, 0
        if total is not None:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(cells), pa.int32()), "v": list(map(str, total.tolist()))})

    got = df.mapInArrow(run, "cell int, v string").groupBy("cell").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()
    out = [0] * cells
    for r in got:
        out[r.cell] = int(r.v) if kind.startswith("decimal") else float(r.v)
    return out


def sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Rows of the fit list and their sums by dimension, exact."""
    def add(y):
        return np.append(y.sum(axis=0) if np.abs(y).max(initial=0) < 1 << 40 else y.astype(object).sum(axis=0), len(y))

    got = _summed(fit, size, size + 1, add, "decimal(38,0)")
    return got[size], got[:size]


def products(fit: DataFrame, size: int, middle: list[int]) -> dict[tuple[int, int], int]:
    """Sums of (x - middle) (x - middle) over the fit list, exact, above the diagonal and on it."""
    low, high = np.triu_indices(size)
    shift = np.array(middle, np.int64)

    def add(y):
        y = y - shift
        if np.abs(y).max(initial=0) < EXACT:
            z = y.astype(np.float64)
            return (z.T @ z).astype(np.int64)[low, high]
        z = y.astype(object)
        return (z.T @ z)[low, high]

    got = _summed(fit, size, len(low), add, "decimal(38,0)")
    return {(int(i), int(j)): v for i, j, v in zip(low, high, got, strict=True)}


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for every row whose vector is whole."""
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = commonest_size(df, vector)
    if not size:
        return spark.createDataFrame([], schema)

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                rows, x = scaled(part.column(1), size, FACTOR, MOST)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(packed(x), pa.binary())], names=[key, "_x"])

    rows = staged(df.select(key, vector).mapInArrow(pack, f"{key} {kind}, _x binary"), "whitening-rows")
    fit = staged(rows.select("_x").distinct(), "whitening-fit")
    n, total = sums(fit, size)
    if not n:
        return spark.createDataFrame([], schema)
    middle = [s // n for s in total]  # the mean, rounded down; what is left of it is below 1 in every dimension
    rest = [s - n * m for s, m in zip(total, middle, strict=True)]
    cells = products(fit, size, middle)
    covariance = np.zeros((size, size))
    for (i, j), v in cells.items():
        covariance[i, j] = covariance[j, i] = (n * v - rest[i] * rest[j]) / (n * n)
    values, vectors = spectrum(covariance)
    k = min(components, size)
    trace = float(np.trace(covariance))
    alive = values[:k] > size * EPS * max(trace, 0.0)
    weights = np.where(alive, vectors[:, :k] / np.sqrt(np.where(alive, values[:k], 1.0)), 0.0)
    shift, mean = np.array(middle, np.int64), np.array([r / n for r in rest])
    error = identity_error(fit, size, n, shift, mean, weights[:, alive])
    explained = [float(e) / trace if trace else None for e in values[:k]]
    square = sum(r * r for r in rest)
    exact_rest = np.array(rest, object)

    def project(batches):
        small = n < 1 << 37
        for part, x in _rows(batches, size):
            y = x - shift
            m = len(y)
            wide = not small or np.abs(y).max(initial=0) >= EXACT
            z = y.astype(object) if wide else y
            ones, twos = (z * z).sum(axis=1), (z * (exact_rest if wide else exact_rest.astype(np.int64))).sum(axis=1)
            far = [n * n * int(a) - 2 * n * int(b) + square for a, b in zip(ones.tolist(), twos.tolist(), strict=True)]
            far = [f if f < 1 << 63 else None for f in far]
            w = np.einsum("ij,jk->ik", y - mean, weights)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel(), mask=np.tile(~alive, m)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)


def identity_error(fit: DataFrame, size: int, n: int, shift: np.ndarray, mean: np.ndarray, weights: np.ndarray) -> float | None:
    """Largest entry by size of the whitened fit list's covariance minus the identity."""
    k = weights.shape[1]
    if not k:
        return None

    def add(y):
        w = (y - shift - mean) @ weights
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    got = np.array(_summed(fit, size, k * k + k, add, "double"))
    centre = got[k * k :] / n
    return float(np.abs(got[: k * k].reshape(k, k) / n - np.outer(centre, centre) - np.eye(k)).max())


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
