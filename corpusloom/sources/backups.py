"""SRC6-SRC7, SNK1-SNK4: backups of conversations and their chunks, vectors as bytes, index tables, audit lines."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.shared import bounded, staged

VERSIONS = ("1.0", "2.0")
_CHUNK = "struct<chunkId:string,docId:string,docName:string,content:string,ord:int,headingPath:array<string>,pageStart:int,pageEnd:int,tokenCount:int,parentId:string,prevId:string,nextId:string,contentHash:string,vector:string>"
_MESSAGE = "struct<id:string,role:string,content:string,cloudContent:string,status:string,createdAt:bigint>"
BACKUP = f"struct<version:string,conversations:array<struct<id:string,title:string,docName:string,messages:array<{_MESSAGE}>,historySummary:string,summaryUpToId:string>>,vectorIndexes:array<struct<convId:string,chunks:array<{_CHUNK}>>>>"


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(texts: pd.Series) -> pd.Series:
    """SRC7: little-endian 32-bit floats from base64; null where it is empty, broken or of a wrong length."""

    def one(text):
        try:
            raw = base64.b64decode(text or "", validate=True)
        except ValueError:
            return None
        return np.frombuffer(raw, "<f4").tolist() if raw and len(raw) % 4 == 0 else None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: "" if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


def read_backup(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC6: conversations and chunks of one backup a file, or (lines) a line; defaults filled, links of version 1.0 made from the order. Other versions are refused."""
    schema = T._parse_datatype_string(BACKUP)
    raw = spark.read.schema(schema).json(path, multiLine=not lines)
    wrong = raw.where(~F.coalesce(F.col("version").isin(*VERSIONS), F.lit(False))).limit(1).collect()
    if wrong:
        raise ValueError(f"backup version {wrong[0].version} is not supported")
    conversations = raw.select(F.explode("conversations").alias("c")).select(F.col("c.id").alias("conv_id"), F.coalesce("c.title", F.lit("")).alias("title"), F.coalesce("c.docName", F.lit("")).alias("doc_name"), F.coalesce("c.messages", F.array().cast(f"array<{_MESSAGE}>")).alias("messages"), F.col("c.historySummary").alias("summary"), F.col("c.summaryUpToId").alias("summary_upto"))
    c = lambda name, default: F.coalesce(F.col(f"k.{name}"), default)
    # the list has a column of its own: a part of i beside it would have each chunk's row carry the whole list
    listed = raw.select("version", F.explode("vectorIndexes").alias("i")).select("version", F.col("i.convId").alias("conv_id"), F.col("i.chunks").alias("_list"))
    chunks = listed.select("version", "conv_id", F.posexplode("_list").alias("n", "k"))
    flat = chunks.select("version", "conv_id", F.col("k.chunkId").alias("chunk_id"), c("docId", F.col("conv_id")).alias("doc_id"), c("docName", F.lit("")).alias("doc_name"), F.col("k.content").alias("content"), c("ord", F.col("n")).alias("ord"), c("headingPath", F.array().cast("array<string>")).alias("heading_path"), c("pageStart", F.lit(1)).alias("page_start"), c("pageEnd", c("pageStart", F.lit(1))).alias("page_end"), F.col("k.tokenCount").alias("token_count"), F.col("k.parentId").alias("parent_id"), F.col("k.contentHash").alias("content_hash"), F.col("k.prevId").alias("prev_id"), F.col("k.nextId").alias("next_id"), decode_vector("k.vector").alias("vector"))
    order = Window.partitionBy("conv_id", "doc_id").orderBy("ord")
    link = lambda own, made: F.when(F.col("version") == "1.0", F.coalesce(made, F.lit(""))).otherwise(F.coalesce(own, F.lit("")))
    linked = flat.withColumn("prev_id", link(F.col("prev_id"), F.lag("chunk_id").over(order))).withColumn("next_id", link(F.col("next_id"), F.lead("chunk_id").over(order)))
    return conversations, linked.drop("version")


#: Chunk columns and their names in a backup, in its order; vector is base64 there.
FIELDS = {
    "chunk_id": "chunkId", "doc_id": "docId", "doc_name": "docName", "content": "content", "ord": "ord", "heading_path": "headingPath", "page_start": "pageStart", "page_end": "pageEnd",
    "token_count": "tokenCount", "parent_id": "parentId", "prev_id": "prevId", "next_id": "nextId", "content_hash": "contentHash", "vector": "vector",
}


#: About as many chunks are in one object of a backup; a conversation with more of them goes into several.
PART_CHUNKS = 1024


def _nested(chunks: DataFrame, by: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """The chunks of each key as a list in order."""
    kind = {f.name: f.dataType for f in T._parse_datatype_string(_CHUNK).fields}
    value = lambda c: encode_vector(c) if c == "vector" else F.col(c)
    coded = chunks.select(*by, "ord", F.struct(*[(value(c) if c in chunks.columns else F.lit(None)).cast(kind[n]).alias(n) for c, n in FIELDS.items()]).alias("c"))
    return coded.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col("c.chunkId").alias("i"), "c"))), lambda x: x["c"]).alias("chunks"))


def _filled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunks", F.coalesce("chunks", F.array().cast(f"array<{_CHUNK}>")))


def backup_rows(conversations: DataFrame, chunks: DataFrame) -> DataFrame:
    """SNK1: one row a conversation, with its whole chunks in order; conversations without chunks have an empty list, missing chunk columns are null."""
    return _filled(conversations.join(_nested(chunks), "conv_id", "left"))


def backup_parts(conversations: DataFrame, chunks: DataFrame) -> DataFrame:
    """SNK1: backup_rows() with about PART_CHUNKS chunks a row. Rows of part 0 hold the conversation, others its further chunks alone.

    Chunks are dealt by hash, so no task holds a conversation whole; those without a place stay in part 0, where reading counts them.
    """
    sizes = chunks.groupBy("conv_id").agg(F.count("*").alias("_n")).join(conversations.select("conv_id").distinct(), "conv_id")
    sizes = bounded(staged(sizes, "backup-sizes"))
    part = F.when(F.col("ord").isNull(), 0).otherwise(F.pmod(F.xxhash64("ord", "chunk_id"), F.ceil(F.col("_n") / PART_CHUNKS)))
    dealt = chunks.join(sizes, "conv_id").withColumn("part", part.cast("int")).drop("_n")
    return _filled(conversations.withColumn("part", F.lit(0)).join(_nested(dealt, ("conv_id", "part")), ["conv_id", "part"], "full"))


def write_backup(conversations: DataFrame, chunks: DataFrame, path: str) -> None:
    """SNK1: one JSON object a conversation, or several where it has many chunks, each of them a whole backup that read_backup takes. conversations: conv_id and any of title, doc_name, messages, summary, summary_upto."""
    has = lambda c, kind: (F.col(c) if c in conversations.columns else F.lit(None)).cast(kind)
    messages = F.coalesce(has("messages", f"array<{_MESSAGE}>"), F.array().cast(f"array<{_MESSAGE}>"))
    one = F.struct(F.col("conv_id").cast("string").alias("id"), has("title", "string").alias("title"), has("doc_name", "string").alias("docName"), messages.alias("messages"), has("summary", "string").alias("historySummary"), has("summary_upto", "string").alias("summaryUpToId"))
    own = F.struct(F.col("conv_id").cast("string").alias("convId"), "chunks")
    first = F.when(F.col("part") == 0, F.array(one)).otherwise(F.filter(F.array(one), lambda _: F.lit(False)))
    backup_parts(conversations, chunks).select(F.lit(VERSIONS[-1]).alias("version"), first.alias("conversations"), F.array(own).alias("vectorIndexes")).write.mode("overwrite").json(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """SNK2: chunks in a folder for each version."""
    chunks.write.mode("append").partitionBy("index_version").parquet(path)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """SNK2: the table with the rows in place of those of equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


#: Parts of a version that are replaced one by one.
INDEX_BUCKETS = 32


def _live(spark: SparkSession, path: str) -> DataFrame | None:
    """index_version, bucket, generation of what counts: the last manifest that is whole. None for a new index."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    every = spark.read.schema("index_version string, bucket int, generation int, written int").parquet(f"{path}/manifest")
    last = every.agg(F.max("written")).first()[0]
    return every.where(F.col("written") == last).drop("written") if last is not None else None


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SNK2: the rows that count of an index that replace_index() wrote."""
    live = _live(spark, path)
    if live is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _version string, bucket int, generation int").parquet(f"{path}/data")
    live = F.broadcast(live.withColumnRenamed("index_version", "_version"))  # a row for each version and bucket
    return rows.join(live, ["_version", "bucket", "generation"], "left_semi").drop("_version", "bucket", "generation")


def replace_index(fresh: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), buckets: int = INDEX_BUCKETS) -> None:
    """SNK2, IDX3: rows (keys, index_version, ...) take the place of all rows of equal keys and version on disk.

    Only the parts (version, bucket of the keys) that hold such keys are written anew, in a generation of their own;
    the manifest that names each part's generation comes last. A write that stops half-way leaves the old manifest and
    so the old rows, and what it left behind is overwritten by the next one.
    """
    spark = fresh.sparkSession
    placed = staged(fresh.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "fresh-rows")
    parts = F.broadcast(staged(placed.select("index_version", "bucket").distinct(), "fresh-parts"))  # a row for each version and bucket
    schema = ", ".join(f"`{n}` {t}" for n, t in fresh.dtypes)
    live = _live(spark, path)
    old = read_index(spark, path, schema).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).join(parts, ["index_version", "bucket"], "left_semi")
    kept = old.join(placed.select(*keys, "index_version").distinct(), [*keys, "index_version"], "left_anti")
    generation = (live.agg(F.max("generation")).first()[0] if live is not None else -1) + 1
    rows = kept.select(*placed.columns).unionByName(placed).withColumn("_version", F.col("index_version"))
    rows.repartition("_version", "bucket").write.mode("overwrite").partitionBy("_version", "bucket").parquet(f"{path}/data/generation={generation}")
    made = parts.withColumn("generation", F.lit(generation))
    whole = made if live is None else live.join(parts, ["index_version", "bucket"], "left_anti").unionByName(made)
    whole.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/written={generation}")


def append_audit(events: DataFrame, path: str) -> None:
    """SNK3: one JSON line an event."""
    events.write.mode("append").json(path)


def write_answers(answers: DataFrame, traces: DataFrame, folder: str) -> None:
    """SNK4: answers with their evidence snapshot, and traces that repeat it, so that each can be read alone."""
    answers.write.mode("append").parquet(f"{folder}/answers")
    traces.join(answers.select("answer_id", "snapshot"), "answer_id", "left").write.mode("append").parquet(f"{folder}/traces")


def vector_bytes(v: Column) -> Column:
    return F.unbase64(encode_vector(v))
