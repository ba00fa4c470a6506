"""SRC1-SRC5: documents and evaluation sets from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = ("md", "markdown", "txt", "text", "log", "csv", "json")
MOST_BYTES = 50 << 20


def read_directory(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, most: int = MOST_BYTES) -> DataFrame:
    """SRC1, SRC2: doc_name, suffix, size_bytes, text, status, error. A file that is too large or no UTF-8 is an `error` row, the rest go on."""
    # suffixes of any case, chosen by the listing: no other file is opened
    any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(any_case) + "}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    head = [name.alias("doc_name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"), F.col("length").alias("size_bytes")]
    # the bound on length reaches the source, which then opens no larger file; those are listed without their content
    text = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.when(text.isNull(), "not UTF-8")
    good = found.where(F.col("length") <= most).select(*head, text.alias("text"), F.when(error.isNull(), "ok").otherwise("error").alias("status"), error.alias("error"))
    large = found.where(F.col("length") > most).select(*head, F.lit(None).cast("string").alias("text"), F.lit("error").alias("status"), F.concat(F.lit("larger than "), F.lit(most), F.lit(" bytes")).alias("error"))
    return good.unionByName(large)


def split_quarantine(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC2: good rows and those set aside."""
    return documents.where("status = 'ok'"), documents.where("status <> 'ok'")


GOLDEN = T.StructType([T.StructField("queries", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("relevant", T.ArrayType(T.StringType())),
    T.StructField("keyPoints", T.ArrayType(T.StringType())), T.StructField("negative", T.BooleanType()), T.StructField("type", T.StringType()),
]))), T.StructField("retrievalTopK", T.IntegerType()), T.StructField("corpusDir", T.StringType())])


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: query_id, text, relevant, key_points, negative, grp; missing fields take their defaults."""
    q = spark.read.schema(GOLDEN).json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")
    none = F.array().cast("array<string>")
    return q.select(F.col("id").alias("query_id"), F.col("question").alias("text"), F.coalesce("relevant", none).alias("relevant"), F.coalesce("keyPoints", none).alias("key_points"), F.coalesce("negative", F.lit(False)).alias("negative"), F.substring("id", 1, 1).alias("grp"), F.col("type").alias("type"))


def read_vectors(spark: SparkSession, path: str, field: str) -> DataFrame:
    """SRC4: id, vector of one JSON object that maps ids to numbers."""
    schema = T.StructType([T.StructField(field, T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(field).alias("id", "v")).select("id", F.col("v").cast("array<float>").alias("vector"))


def read_rewrites(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: query_id, variant_no (from 1), text."""
    schema = T.StructType([T.StructField("expansions", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("expansions").alias("query_id", "texts"))
    return rows.select("query_id", F.posexplode("texts").alias("n", "text")).select("query_id", (F.col("n") + 1).alias("variant_no"), "text")
