"""BM2, BM4 over a standing index: packed postings with bounds for blocks of chunks, grown by batches.

A batch is two tables below the index folder, each in a sub-folder of its own: `postings` (a row for each block of chunks
and term: the chunks that hold it, their lengths and counts, and as bounds the greatest tf and the least length: no
chunk of the block scores more for the term), and `totals` (chunks and words), which is written last and makes the batch
count. A block is made by the task that reads its chunks, so nothing is shuffled to build an index. A batch that stops
half-way has no totals and is not read; written again, it replaces itself.

The best k of a query are exact. Summed bounds say what the chunks of a block can reach at most; the blocks that promise
most are scored first, and of all others only those that can still reach the k-th score found so far. A block's postings
of the queries' terms meet in one task, which hands on its best rows; no pair of query and chunk is shuffled. Statistics
(documents with a term, chunks, words) are sums over batches, so old batches need no change when new ones come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.operators import bm25
from corpusloom.operators.shared import bounded, small_batches, staged

#: Most chunks of a block; Arrow batches bound its bytes.
BLOCK = 2048
#: Blocks of a query that are scored before any is left out, and the slack for rounded scores.
FIRST, SLACK = 8, 1e-5
BOUNDS = "block long, term string, df long, top_tf long, least_length int, batch int"


def add_batch(corpus: DataFrame, folder: str, batch: int, blocks: int | None = None) -> None:
    """Write the chunks (chunk_id, content) as one batch. A chunk is in one batch only. blocks: cut the batch in so many at least."""
    target = lambda name: f"{folder}/{name}/batch={batch}"
    size = BLOCK if blocks is None else max(1, corpus.count() // blocks)
    kind = dict(corpus.dtypes)["chunk_id"]

    def pack(batches):
        block = (batch << 24 | TaskContext.get().partitionId()) << 24
        for b in batches:
            for s in range(0, b.num_rows, size):
                part = b.slice(s, size)
                n, length = part.num_rows, pc.list_value_length(part.column(1)).to_numpy()
                coded = part.column(1).flatten().dictionary_encode()
                if not len(coded):
                    continue
                code = coded.indices.to_numpy().astype(np.int64)
                posted, tf = np.unique(code * n + np.repeat(np.arange(n), length), return_counts=True)
                term, chunk = posted // n, posted % n
                at = np.flatnonzero(np.r_[True, np.diff(term) != 0])
                ends = pa.array(np.r_[at, len(term)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (part.column(0).take(pa.array(chunk)), pa.array(length[chunk]), pa.array(tf))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), coded.dictionary, pa.array(np.diff(np.r_[at, len(term)])), pa.array(np.maximum.reduceat(tf, at)), pa.array(np.minimum.reduceat(length[chunk], at)), *lists], names=["block", "term", "df", "top_tf", "least_length", "chunks", "lengths", "tfs"])
                block += 1

    small_batches(corpus.sparkSession)
    words = corpus.select("chunk_id", F.coalesce(bm25.tokens("content"), F.array().cast("array<string>")).alias("_t"))
    words.mapInArrow(pack, f"block long, term string, df long, top_tf long, least_length int, chunks array<{kind}>, lengths array<int>, tfs array<long>").write.mode("overwrite").parquet(target("postings"))
    bm25.lengths(corpus).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).write.mode("overwrite").parquet(target("totals"))


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Batches that are whole: one number each."""
    totals = spark.read.schema("n long, words long, batch int").parquet(f"{folder}/totals")
    return sorted(r.batch for r in totals.select("batch").distinct().collect())


def _whole(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/postings").where(F.col("batch").isin(batches(spark, folder)))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """BM1: n and avg_length."""
    return spark.read.schema("n long, words long, batch int").parquet(f"{folder}/totals").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avg_length"))


def frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """BM1: term, df."""
    return _whole(spark, folder, BOUNDS).groupBy("term").agg(F.sum("df").alias("df"))


def part(tf: str, length: str) -> Column:
    return bm25.idf(F.col("n"), F.col("df")) * F.col(tf) * (bm25.K1 + 1) / (F.col(tf) + bm25.K1 * (1 - bm25.B + bm25.B * F.col(length) / F.col("avg_length")))


def _best(known: bm25.Batch, k: int, digits: int | None, kind: pa.DataType):
    """For a block's postings and the places of the queries that want it: its rows that can be among their best k."""
    many, slack = len(known.ids), 2 * 10.0**-digits if digits is not None else 0.0

    def score(postings: pa.Table, wanted: pa.Table) -> pa.Table:
        found = [pa.table({"query": pa.array([], pa.int64()), "chunk_id": pa.array([], kind), "bm25": pa.array([], pa.float64())})]
        if postings.num_rows and wanted.num_rows:
            asks = np.zeros(many, bool)
            asks[wanted["query"].to_numpy()] = True
            lists = [postings[c].combine_chunks() for c in ("chunks", "lengths", "tfs")]
            term = np.repeat(pc.index_in(postings["term"].combine_chunks(), known.terms).to_numpy(), pc.list_value_length(lists[0]).to_numpy())
            coded = lists[0].flatten().dictionary_encode()
            ids, chunk = coded.dictionary, coded.indices.to_numpy()
            order = np.lexsort((term, chunk))
            term, chunk, tf = term[order], chunk[order].astype(np.int64), lists[2].flatten().to_numpy()[order]
            length = np.zeros(len(ids), np.int64)
            length[chunk] = lists[1].flatten().to_numpy()[order]
            step = max(1, bm25.PAIRS // many)
            for first in range(0, len(ids), step):
                s, e = np.searchsorted(chunk, [first, first + step])
                place, query, total = known.summed(chunk[s:e] - first, term[s:e], tf[s:e], length[first : first + step])
                keep = asks[query]
                if keep.any():
                    own = pa.table({"query": pa.array(query[keep]), "chunk_id": ids.take(pa.array(first + place[keep])).cast(kind), "bm25": pa.array(total[keep])})
                    found.append(bm25.leading(own, many, k, slack)[0])
            if len(found) > 1:
                found = [bm25.leading(pa.concat_tables(found).combine_chunks(), many, k, slack)[0]]
        held = found[0].combine_chunks()
        return pa.table({"query_id": known.ids.take(held["query"].combine_chunks()) if held.num_rows else known.ids.slice(0, 0), "chunk_id": held["chunk_id"], "bm25": held["bm25"]})

    return score


def top_k(spark: SparkSession, folder: str, queries: DataFrame, k: int, digits: int | None = None, chunk_kind: str = "long") -> DataFrame:
    """BM2: query_id, chunk_id, bm25, rank of each query's best k chunks; ties go by chunk_id. No text is read."""
    terms = staged(bm25.query_terms(queries), "index-terms")
    few = bounded(staged(terms.select("term").distinct(), "index-term-set"))
    bounds = staged(_whole(spark, folder, BOUNDS).join(few, "term"), "index-bounds")
    weights = staged(bounds.groupBy("term").agg(F.sum("df").alias("df")).crossJoin(F.broadcast(totals(spark, folder))), "index-weights")  # one row
    able = bounds.join(weights.withColumnRenamed("df", "_df").select("term", "_df", "n", "avg_length"), "term").drop("df").withColumnRenamed("_df", "df").join(terms, "term").groupBy("query_id", "block").agg(F.sum(part("top_tf", "least_length")).alias("most"))
    place = Window.partitionBy("query_id").orderBy(F.desc("most"), "block")
    able = staged(able.withColumn("place", F.row_number().over(place)), "index-blocks")
    posted = _whole(spark, folder, f"block long, term string, chunks array<{chunk_kind}>, lengths array<int>, tfs array<long>, batch int").join(few, "term", "left_semi")
    asked = terms.select("query_id", "term").limit(bm25.BATCH_TERMS + 1).toArrow()
    known = None
    if 0 < asked.num_rows <= bm25.BATCH_TERMS:
        got = weights.toArrow()
        stands = got.slice(0, 1).to_pylist() or [{"n": 0, "avg_length": 1.0}]
        known = bm25.weighed(asked, dict(zip(got["term"].to_pylist(), got["df"].to_pylist(), strict=True)), stands[0]["n"], stands[0]["avg_length"])
        places = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(known.ids))), "query_id": known.ids}))
    total = F.sum(part("tf", "length"))
    cut = lambda c: F.round(c, digits) if digits is not None else c

    def scored(wanted: DataFrame) -> DataFrame:
        own = posted.join(bounded(staged(wanted.select("block").distinct(), "index-wanted")), "block", "left_semi")
        if known is not None:
            asks = wanted.join(F.broadcast(places), "query_id").select("block", "query")
            kind = to_arrow_type(own.schema["chunks"].dataType.elementType)
            rows = own.select("block", "term", "chunks", "lengths", "tfs").groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(_best(known, k, digits, kind), f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {chunk_kind}, bm25 double")
            return rows.withColumn("bm25", cut("bm25"))
        rows = own.select("block", "term", F.explode(F.arrays_zip("chunks", "lengths", "tfs")).alias("p")).select("block", "term", F.col("p.chunks").alias("chunk_id"), F.col("p.lengths").alias("length"), F.col("p.tfs").alias("tf"))
        return rows.join(terms, "term").join(bounded(wanted), ["query_id", "block"], "left_semi").join(weights, "term").groupBy("query_id", "chunk_id").agg(cut(total).alias("bm25"))

    best = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "chunk_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = staged(top(scored(able.where(F.col("place") <= FIRST).select("query_id", "block"))), "index-first")
    least = first.where(F.col("rank") == k).select("query_id", F.col("bm25").alias("least"))
    rest = staged(able.where(F.col("place") > FIRST).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - SLACK)).select("query_id", "block"), "index-rest")
    return top(first.drop("rank").unionByName(scored(rest)))
