"""Shared folder, range layout, bounded joins and Arrow slices used by the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that attach() broadcasts.
BROADCAST_ROWS = 100_000
#: Salt values dealt to each row of a table that is too large to broadcast.
SALTS = 32
#: A key with at least one in so many rows counts as hot.
HOT = 1000
#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing, local mode takes a temporary folder and a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
    return f"{root.rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and lost executors lose nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """df with its columns of these names under others, and the columns that give it back as it was."""
    other = {c: f"_own_{c}" for c in df.columns if c in names}
    return df.withColumnsRenamed(other), [F.col(other.get(c, c)).alias(c) for c in df.columns]


def let(value: Column, body) -> Column:
    """body of a value that is computed once, where a lambda would compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def attach(df: DataFrame, small: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join on a null-safe key. small has one row a key and is read twice, so stage it first.

    Up to BROADCAST_ROWS rows it is broadcast. Beyond, it is repeated for SALTS values and df's rows are dealt
    to them by the hash of `spread`, so that a key with a third of all rows is split.
    """
    other = small.withColumnRenamed(key, "_key")
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(other), df[key].eqNullSafe(other["_key"]), "left").drop("_key")
    salted = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = df.withColumn("_at", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return left.join(salted, left[key].eqNullSafe(salted["_key"]) & (left["_at"] == salted["_salt"]), "left").drop("_key", "_salt", "_at")


def attach_counted(df: DataFrame, table: DataFrame, key: str, rows: str) -> DataFrame:
    """Left join of a large table with one row a key, whose column `rows` tells how many rows of df have that key.

    Keys with at least one of HOT rows are broadcast, HOT of them at most; all others meet by a shuffle. A null key
    matches nothing and is not shuffled. df and table are read several times, so stage them first.
    """
    total = df.count()
    other = table.drop(rows).columns
    named = table.withColumnsRenamed({c: f"_t_{c}" for c in other})
    heavy = F.col(rows) * HOT >= total
    hot = named.where(heavy).drop(rows).withColumn("_hot", F.lit(True))
    few = df.join(F.broadcast(hot), df[key] == F.col(f"_t_{key}"), "left")
    done = few.where(F.col("_hot") | F.col(key).isNull()).drop("_hot")
    rest = few.where(F.col("_hot").isNull() & F.col(key).isNotNull()).select(*df.columns)
    both = done.unionByName(rest.join(named.where(~heavy).drop(rows), rest[key] == F.col(f"_t_{key}"), "left"))
    return both.drop(f"_t_{key}").withColumnsRenamed({f"_t_{c}": c for c in other if c != key})


def ranges(df: DataFrame, key: Column, parts: int) -> list[tuple[int, int, int]]:
    """(least, greatest, rows) of at most `parts` ascending ranges of a long key, near equal in rows.

    Only the key is shuffled; the driver gets one row a range. Null counts as the least key.
    """
    ids = df.select(F.coalesce(key, F.lit(NULL_ID)).alias("k")).repartitionByRange(parts, "k")

    def span(batches):
        least, most, rows = None, None, 0
        for b in batches:
            if b.num_rows:
                lo, hi = pc.min_max(b.column(0)).as_py().values()
                least, most, rows = lo if least is None else min(least, lo), hi if most is None else max(most, hi), rows + b.num_rows
        if rows:
            yield pa.RecordBatch.from_pydict({"least": [least], "most": [most], "n": [rows]})

    return sorted(tuple(r) for r in ids.mapInArrow(span, "least long, most long, n long").collect())


def range_number(bounds: list[tuple[int, int, int]], key: Column) -> Column:
    """Number of the range that holds the key."""
    lows = np.array([b[0] for b in bounds[1:]], np.int64)

    @F.pandas_udf("int")
    def number(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(lows, k.to_numpy(np.int64), side="right").astype(np.int32))

    return number(F.coalesce(key, F.lit(NULL_ID)))


def small_batches(spark: SparkSession) -> None:
    """Have this session send at most BATCH_BYTES to Python at once. Each batch is held by the JVM and by the worker, in every task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: Python workers stay for later tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, column: int, most: int = SLICE_BYTES):
    """The batches in slices of about `most` bytes of a string column; a longer value comes alone. Freed memory is given back after each batch."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
            yield b.slice(at, to - at)
            at = to
        give_back()


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i] .. starts[i] + lengths[i] - 1 for every i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
#: Powers are kept up to so many; those for a longer text are made anew.
POWERS = 2 << 20
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, i below n: with them a hash of any run comes from one running sum."""

    def made(size: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            out.append(np.cumprod(step))
        return out[0], out[1]

    if n > POWERS:
        return made(n)
    if not _POWERS:
        _POWERS.append(made(POWERS))
    return _POWERS[0][0][:n], _POWERS[0][1][:n]
