"""Mixing sources to target weights, with DataFrame functions only.

The budget (epochs times all words) is shared among sources by weight; a source gets at most `most` times its own
words and what it can't take goes to the others by weight. A document appears floor(rate) times, and once more if a
hash of its id, as a number in [0, 1), lies below the fraction of the rate, where rate = target / words of the source.

Defined cases: a null text has 0 words; a null source is a source of its own, last in order; a source without words
has rate 0; a null id hashes as the word null; rows that repeat an id share its draw; an empty table gives an empty
one. with_copies replaces columns named like the added ones, mix_sources keeps them. The source table has one row a source: its rank and running sums
are one small window over it, and attach() broadcasts it only up to its stated number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import attach, set_aside, staged, text_of

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MOST = 2.0
SEED = "mix"


def words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(docs: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """source, source_size, target. The level below which sources are full is found from running sums by capacity a weight."""
    sums = docs.groupBy("source").agg(F.sum(words()).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place - 1, F.lit(len(weights))) + 1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    full = F.col("_ratio") <= F.col("_level")
    return (
        sums.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(every) * F.lit(float(epochs)))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_before")) / F.col("_open"))
        .withColumn("_flat", F.first(F.when(~full, F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "source_size", F.when(full, F.col("_cap")).otherwise(F.col("_flat") * F.col("_weight")).alias("target"))
    )


def draw(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the id's MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, most: float = MOST, seed: str = SEED) -> DataFrame:
    """docs with source_size, target, rate and copies."""
    targets = staged(source_targets(docs, weights, epochs, most), "mix-targets")
    docs = docs.drop("source_size", "target", "rate", "copies")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (draw("doc_id", seed) < F.col("rate") - F.floor("rate")).cast("long")
    return attach(docs, targets, "source", F.col("doc_id")).withColumn("rate", rate).withColumn("copies", F.floor("rate") + extra)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixture: docs' columns, each row as often as it is taken."""
    docs, own = set_aside(docs, ("source_size", "target", "rate", "copies"))
    return with_copies(docs, **options).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*own)


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = with_copies(docs).withColumn("size", words())
    return sized.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM sums
), run AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM ranked
), levels AS (
  SELECT *, (budget - before) / open AS level FROM run
), flat AS (
  SELECT *, arg_min(level, ratio) FILTER (ratio > level) OVER () AS even FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE even * weight END AS target FROM flat
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets
), taken AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
         (floor(r.rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, rate, copies FROM taken
"""
