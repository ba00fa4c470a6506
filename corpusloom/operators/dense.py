"""VEC1-VEC4, SIG1-SIG3, UDF2: cosine scores and the signals made of them. Elements are 32-bit, sums 64-bit."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions.text import WORD
from corpusloom.operators.shared import staged


def dot(a: Column, b: Column) -> Column:
    """VEC1: product of unit vectors; 0 where one is missing or their sizes differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), 0.0).otherwise(product)


def normalise(v: Column) -> Column:
    """VEC2: a vector of unit length; a zero vector stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length == 0, v).otherwise(F.transform(v, lambda x: (x / length).cast("float")))


def cosine_scores(chunks: DataFrame, queries: DataFrame, digits: int | None = None) -> DataFrame:
    """VEC1: query_id, chunk_id, cosine of every pair. Both sides: an id and vector; the queries are the small side."""
    pairs = chunks.select("chunk_id", F.col("vector").alias("_c")).crossJoin(queries.select("query_id", F.col("vector").alias("_q")))
    d = dot(F.col("_c"), F.col("_q"))
    return pairs.select("query_id", "chunk_id", (F.round(d, digits) if digits is not None else d).alias("cosine"))


#: Query vectors that travel to the tasks at once.
QUERY_BLOCK = 4096


class QueryMatrix:
    """Query vectors by their size; a query without a vector has none of them."""

    def __init__(self, rows: pd.DataFrame, kind: pa.DataType):
        self.ids = pa.array(rows.query_id.tolist(), kind)
        sizes = np.array([-1 if v is None else len(v) for v in rows.vector])
        self.by_size = {int(d): (np.flatnonzero(sizes == d), np.array(rows.vector[sizes == d].tolist(), np.float64).reshape(-1, d)) for d in np.unique(sizes[sizes >= 0])}

    def parts(self, col: pa.Array):
        """For each size: the queries of it, their matrix, the rows of the column that have it, and the rows' matrix."""
        lengths = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
        flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.maximum(lengths, 0))
        for d, (own, q) in self.by_size.items():
            rows = np.flatnonzero(lengths == d)
            yield own, q, rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK):
    """The queries in blocks of about that many, dealt by the hash of their id: what the driver holds is bounded."""
    rows = staged(queries.select("query_id", "vector"), "query-vectors")
    n, kind = max(1, -(-rows.count() // block)), to_arrow_type(rows.schema["query_id"].dataType)
    for i in range(n):
        yield QueryMatrix(rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toPandas(), kind)


def cosine_blocks(chunks: DataFrame, queries: DataFrame, top: int | None = None) -> DataFrame:
    """VEC1 at scale: one matrix product for each Arrow batch and block of queries. With top, each batch keeps that many a query: the tail is left out."""
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(chunks.dtypes)['chunk_id']}, cosine double"

    def scorer(asked: QueryMatrix):
        def run(batches):
            for b in batches:
                s = np.zeros((b.num_rows, len(asked.ids)))
                for own, q, rows, x in asked.parts(b.column(1)):
                    s[np.ix_(rows, own)] = x @ q.T
                for i in range(len(asked.ids)):
                    keep = np.argsort(-s[:, i], kind="stable")[:top] if top else np.arange(b.num_rows)
                    yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(np.full(len(keep), i))), b.column(0).take(pa.array(keep)), pa.array(s[keep, i])], names=["query_id", "chunk_id", "cosine"])

        return run

    parts = [chunks.select("chunk_id", "vector").mapInArrow(scorer(asked), kinds) for asked in query_blocks(queries)]
    return reduce(DataFrame.unionByName, parts)


def signals(chunks: DataFrame, queries: DataFrame, bm25: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """SIG1 without a row a pair: query_id, max_cosine, cos_gap, max_bm25 over all visible chunks.

    The mean cosine of a query is its product with the sum of all vectors, so a task hands on one sum, one maximum and
    one count a query. A missing vector, or one of another size, has cosine 0 and counts. bm25: query_id, chunk_id, bm25.
    """
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, most double, total double, n long"

    def folder(asked: QueryMatrix):
        def run(batches):
            n, most, total = 0, np.full(len(asked.ids), -np.inf), np.zeros(len(asked.ids))
            for b in batches:
                if not b.num_rows:
                    continue
                n += b.num_rows
                least = np.zeros(len(asked.ids))
                for own, q, rows, x in asked.parts(b.column(0)):
                    if len(rows):
                        best = (x @ q.T).max(axis=0)
                        least[own] = np.maximum(best, 0) if len(rows) < b.num_rows else best
                        total[own] += x.sum(axis=0) @ q.T
                most = np.maximum(most, least)
            if n:
                yield pa.RecordBatch.from_arrays([asked.ids, pa.array(most), pa.array(total), pa.array([n] * len(most))], names=["query_id", "most", "total", "n"])

        return run

    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    parts = [chunks.select("vector").mapInArrow(folder(asked), kinds) for asked in query_blocks(queries)]
    out = reduce(DataFrame.unionByName, parts).groupBy("query_id").agg(cut(F.max("most")).alias("max_cosine"), cut(F.max("most") - F.sum("total") / F.sum("n")).alias("cos_gap"))
    if bm25 is None:
        return out.withColumn("max_bm25", F.lit(0.0))
    words = bm25.groupBy("query_id").agg(cut(F.max("bm25")).alias("max_bm25"))
    return out.join(words, "query_id", "left").withColumn("max_bm25", F.coalesce("max_bm25", F.lit(0.0)))


def best_in_scope(sentences: DataFrame, scopes: DataFrame, chunks: DataFrame) -> DataFrame:
    """VEC3: sentence_id and the best cosine over its scope's chunks, 0 for an empty scope."""
    pairs = sentences.select("sentence_id", F.col("vector").alias("_s")).join(scopes, "sentence_id", "left").join(chunks.select("chunk_id", F.col("vector").alias("_c")), "chunk_id", "left")
    return pairs.groupBy("sentence_id").agg(F.coalesce(F.max(F.when(F.col("_c").isNotNull(), dot(F.col("_s"), F.col("_c")))), F.lit(0.0)).alias("semantic"))


def refusal_signals(scored: DataFrame, by: tuple[str, ...] = ("query_id",), digits: int | None = None) -> DataFrame:
    """SIG1: best cosine, its distance from the mean over all visible chunks, best keyword score. scored: cosine, bm25."""
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return scored.groupBy(*by).agg(cut(F.max("cosine")).alias("max_cosine"), cut(F.max("cosine") - F.avg("cosine")).alias("cos_gap"), cut(F.max(F.coalesce("bm25", F.lit(0.0)))).alias("max_bm25"))


def best_signals(signals: DataFrame) -> DataFrame:
    """SIG2: the best of each signal over a query's variants."""
    return signals.groupBy("query_id").agg(*[F.max(c).alias(c) for c in ("max_cosine", "cos_gap", "max_bm25")])


def fired_signals(max_cosine: float = 0.53, cos_gap: float = 0.0776) -> Column:
    """SIG3: which refusal signals fired, with their values."""
    say = lambda c, least: F.when(F.col(c) < least, F.concat(F.lit(f"{c}="), F.format_number(F.col(c), 4)))
    return F.array_compact(F.array(say("max_cosine", max_cosine), say("cos_gap", cos_gap)))


def hashed_embedder(size: int = 64, instruction: str = "query: "):
    """UDF2: a deterministic stand-in for a model: signed hashed words, unit length. kind `query` gets the instruction."""
    import re

    word = re.compile(WORD)

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for text, kind in zip(texts, kinds, strict=True):
            v = np.zeros(size)
            for w in word.findall(((instruction if kind == "query" else "") + (text or "")).lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out)

    return embed
