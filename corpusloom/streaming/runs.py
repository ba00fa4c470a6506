"""Streams over the given tables, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.shared import folder


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's Parquet files as a stream; a file source takes a folder, so a single file is picked from its folder by name."""
    name = f"{table}.parquet"
    whole = spark.read.parquet(f"{sf_dir}/{name}")
    single = whole.inputFiles()[0].endswith(f"/{name}")
    return spark.readStream.schema(whole.schema).option("pathGlobFilter", name if single else "*.parquet").parquet(sf_dir if single else f"{sf_dir}/{name}")


def to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Everything there is now, through checkpointed micro-batches, as a table of the last (complete) or all (append) batches."""
    spark = stream.sparkSession
    out = folder(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch_id={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    return rows
