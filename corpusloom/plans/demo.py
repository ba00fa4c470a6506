"""The given tables as this library's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # a table of one small file is one task: deal it out; a large one has more tasks than cores and stays as it is
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("doc_id").alias("ord"), F.col("text").alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line that isn't blank as a chunk of its document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "content")).where(F.trim("content") != "")
    return rows.select((F.col("doc_id") * 100_000 + F.col("ord")).alias("chunk_id"), "doc_id", "ord", "content")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines() as one array a document."""
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("ord"), x.alias("content")))
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(every, lambda c: F.trim(c["content"]) != "").alias("chunks")).where(F.size("chunks") > 0)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant is the text itself; the key points are its lines; groups q, s, m, n go by the id."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array("text").alias("relevant"), F.split("text", "\n", -1).alias("key_points"), (F.col("item_id") % 4 == 3).alias("negative"), F.element_at(F.array(*[F.lit(g) for g in "qsmn"]), (F.col("item_id") % 4 + 1).cast("int")).alias("grp"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return queries(spark, sf_dir).select("query_id").join(e, "query_id")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of corpus(): the vector whose id is the document's modulo the number of vectors."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")).crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("chunk_id") % F.col("n"))
    return ids.join(e, "vec_id").select("chunk_id", F.col("embedding").alias("vector"))


def line_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of lines(): the vector whose id is the line's modulo the number of vectors."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    ids = lines(spark, sf_dir).select("chunk_id").crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("chunk_id") % F.col("n"))
    return ids.join(e, "vec_id").select("chunk_id", F.col("embedding").alias("vector"))


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with rights."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lit("default").alias("tenant_id"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("department"), (F.col("doc_id") % 3).cast("int").alias("classification"), F.col("text").alias("content"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns, their context being the turn before."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumn("context", F.coalesce(F.lag("text").over(w), F.lit(""))).where("role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", F.col("text").alias("answer"), "context", F.array(F.lit(1), F.lit(2)).alias("passages"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled samples with scores made from the documents' ids and sizes."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("supported"), ((F.col("n_chars") % 100) / 100.0).alias("semantic"), ((F.col("doc_id") % 97) / 97.0).alias("lexical"), (F.col("toxic") == 1).alias("fabricated"))


def signal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").where(F.col("quality").isNotNull())
    return rows.select(F.col("doc_id").alias("query_id"), (F.col("quality") == 0).alias("negative"), F.expr("stack(2, 'size', (n_chars % 1000) / 1000.0D, 'place', (doc_id % 89) / 89.0D) AS (signal, value)"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry: stage, duration, run, order, tokens."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("duration"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned, chunked and linked."""
    from corpusloom.operators import chunking

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.link_chunks(chunking.chunk_documents(chunking.text_blocks(docs)), "v1")
