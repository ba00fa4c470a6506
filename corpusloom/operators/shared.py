"""Tables in the folder that driver and executors share, and joins whose small side is measured first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows of a few numbers, that bounded() broadcasts.
BROADCAST_ROWS = 100_000


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
    return f"{root.rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: it is computed once, and its lineage ends here. codec: of its files, else the session's."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has no more rows than that; stage it first, it is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of the session hold at most that many bytes, however long texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > size:
        spark.conf.set(name, str(size))
