"""RNK, WIN, GAT, MMR, CTX, TOP and RRK: from scores to cited context.

Legs rank apart and fuse by reciprocal ranks; neighbouring chunks become windows; equal windows count once; a gate
admits by cosine (or keyword rank where there are no vectors) and by share of the best score; what is left is selected
and widened by its neighbours. Every "best" is the first in a stated order, so results don't depend on partitions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import joined, utf16_length
from corpusloom.operators import bm25
from corpusloom.operators.ranks import ranked
from corpusloom.operators.shared import bounded, staged


@dataclass(frozen=True)
class Options:
    """Fixed values of the retrieval defaults."""

    top_k: int = 5
    min_vec_score: float = 0.5
    bm25_exempt_rank: int = 3
    min_max_cosine: float = 0.53
    min_cos_gap: float = 0.0776
    relative_cut_ratio: float = 0.4
    max_window_chars: int = 1200
    window_radius: int = 1
    mmr_lambda: float = 1.0
    mmr_pool_size: int = 20
    rrf_k: int = 60
    vec_weight: float = 1.0
    bm25_weight: float = 1.0


def with_overrides(options: Options, **changes) -> Options:
    """UDF4: changed options; an unknown name is an error."""
    unknown = set(changes) - {f.name for f in fields(options)}
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    return replace(options, **changes)


def leg_ranks(scored: DataFrame, score: str, rank: str, by: tuple[str, ...] = ("query_id",), keep_zero: bool = False) -> DataFrame:
    """RNK1: competition rank by descending score. The keyword leg leaves out what is not above 0, the vector leg keeps it."""
    return ranked(scored if keep_zero else scored.where(F.col(score) > 0), by, score, rank)


def reciprocal(rank: str, weight, k: int) -> Column:
    return F.coalesce(F.lit(weight) / (F.lit(k) + F.col(rank)), F.lit(0.0))


def fuse(vec: DataFrame | None, bm25: DataFrame, options: Options = Options(), by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """RNK2: rrf of each chunk from a cosine leg (None: keyword only, VEC4) and a keyword leg."""
    key = [*by, "chunk_id"]
    words = leg_ranks(bm25, "bm25", "bm25_rank", by)
    if vec is None:
        both = words.withColumn("cosine", F.lit(None).cast("double")).withColumn("vec_rank", F.lit(None).cast("int"))
    else:
        both = leg_ranks(vec, "cosine", "vec_rank", by, keep_zero=True).join(words, key, "full")
    return both.select(*key, "cosine", "vec_rank", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"), (reciprocal("vec_rank", options.vec_weight, options.rrf_k) + reciprocal("bm25_rank", options.bm25_weight, options.rrf_k)).alias("rrf"))


def fuse_variants(vec: DataFrame | None, bm25: DataFrame, variants: DataFrame, options: Options = Options()) -> DataFrame:
    """RNK3: legs carry variant_no; each variant's part is weighted, scores and ranks are those of variant 0."""
    parts = fuse(vec, bm25, options, ("query_id", "variant_no")).join(variants.select("query_id", "variant_no", "weight"), ["query_id", "variant_no"])
    own = lambda c: F.max(F.when(F.col("variant_no") == 0, F.col(c))).alias(c)
    return parts.groupBy("query_id", "chunk_id").agg(own("cosine"), own("vec_rank"), F.coalesce(F.max(F.when(F.col("variant_no") == 0, F.col("bm25"))), F.lit(0.0)).alias("bm25"), F.coalesce(F.max(F.when(F.col("variant_no") == 0, F.col("bm25_rank"))), F.lit(0)).alias("bm25_rank"), F.sum(F.col("rrf") * F.col("weight")).alias("rrf"))


def bare_windows(fused: DataFrame, corpus: DataFrame, options: Options = Options()) -> DataFrame:
    """WIN1, WIN2 without texts: one row a window. corpus: chunk_id, doc_id, ord, content.

    A window takes the next ord of its document while its characters fit: a greedy restart over the hits of one query in
    one document, which stream through Arrow in their order, so that no group is held at once. _key tells windows of
    equal chunk texts apart from others; doc_rrf is the best rrf of the window's document.
    """
    most = options.max_window_chars
    light = corpus.select("chunk_id", "doc_id", F.col("ord").cast("long").alias("ord"), F.coalesce(utf16_length("content"), F.lit(0)).cast("long").alias("_chars"), F.unhex(F.md5(F.coalesce("content", F.lit("")))).alias("_digest"))
    hits = fused.where("rrf > 0").join(light, "chunk_id")
    rows = hits.select("query_id", "doc_id", "ord", "chunk_id", "_chars", "_digest", F.col("cosine").cast("double").alias("cosine"), F.col("vec_rank").cast("int").alias("vec_rank"), F.col("bm25").cast("double").alias("bm25"), F.col("bm25_rank").cast("int").alias("bm25_rank"), "rrf", F.max("rrf").over(Window.partitionBy("query_id", "doc_id")).alias("doc_rrf"))
    kinds = dict(rows.dtypes)

    def starts_of(b: pa.RecordBatch) -> np.ndarray:
        """Where a window starts."""
        ids = [c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in (b.column(0), b.column(1))]
        place, total = b.column(2).to_numpy(), np.r_[0, np.cumsum(b.column(4).to_numpy())]
        new = np.ones(b.num_rows, bool)
        new[1:] = (np.diff(ids[0]) != 0) | (np.diff(ids[1]) != 0) | (np.diff(place) != 1)
        runs = np.flatnonzero(new)
        for s, e in zip(runs.tolist(), [*runs[1:].tolist(), b.num_rows], strict=True):
            while e - s > 1:
                s = min(e, max(s + 1, int(np.searchsorted(total, total[s] + most, "right")) - 1))
                if s < e:
                    new[s] = True
        return np.flatnonzero(new)

    def made(b: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        ends = np.r_[at[1:], b.num_rows]
        rrf, where = b.column(10).to_numpy(), np.arange(b.num_rows)
        best = np.minimum.reduceat(np.where(rrf == np.repeat(np.maximum.reduceat(rrf, at), ends - at), where, b.num_rows), at)
        cosine = np.maximum.reduceat(pc.fill_null(b.column(6), -np.inf).to_numpy(), at)
        rank = b.column(9).to_numpy()
        least = np.minimum.reduceat(np.where(rank > 0, rank, np.iinfo(np.int32).max), at)
        digests = b.column(5).take(pa.array(at)).to_pylist()
        for i in np.flatnonzero(ends - at > 1).tolist():
            digests[i] = hashlib.md5(b"".join(b.column(5).slice(at[i], ends[i] - at[i]).to_pylist()), usedforsecurity=False).digest()
        first, top = pa.array(at), pa.array(best)
        return pa.RecordBatch.from_arrays(
            [
                b.column(0).take(first), b.column(1).take(first), b.column(2).take(first), pa.array(b.column(2).to_numpy()[ends - 1]), b.column(10).take(top), b.column(7).take(top), b.column(3).take(top),
                pa.array(cosine, mask=np.isneginf(cosine)), pa.array(np.maximum.reduceat(b.column(8).to_numpy(), at)), pa.array(np.where(least == np.iinfo(np.int32).max, 0, least).astype(np.int32)),
                b.column(11).take(first), pa.ListArray.from_arrays(pa.array(np.r_[at, b.num_rows].astype(np.int32)), b.column(3)), pa.array(digests, pa.binary()),
            ],
            names=["query_id", "doc_id", "ord_start", "ord_end", "rrf", "vec_rank", "best_chunk", "cosine", "bm25", "bm25_rank", "doc_rrf", "chunk_ids", "_key"],
        )

    def merge(batches):
        kept = None  # the last window of what came so far, which may go on
        for b in batches:
            if b.num_rows:
                b = b if kept is None else pa.concat_batches([kept, b])
                at = starts_of(b)
                if len(at) > 1:
                    yield made(b.slice(0, at[-1]), at[:-1])
                kept = b.slice(at[-1])
        if kept is not None:
            yield made(kept, np.zeros(1, np.int64))

    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, ord_start long, ord_end long, rrf double, vec_rank int, best_chunk {kinds['chunk_id']}, cosine double, bm25 double, bm25_rank int, doc_rrf double, chunk_ids array<{kinds['chunk_id']}>, _key binary"
    return rows.sortWithinPartitions("query_id", "doc_id", "ord", "chunk_id").mapInArrow(merge, schema)


def with_texts(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """found with `matched`: the texts of chunk_ids joined. Each different window's text is made once, however many queries found it.

    Stage found first: it is read several times. The chunks of few windows are picked by a broadcast of their ids.
    """
    kinds = found.select("chunk_ids").distinct()
    parts = kinds.select("chunk_ids", F.posexplode("chunk_ids").alias("_pos", "chunk_id"))
    own = corpus.select("chunk_id", F.coalesce("content", F.lit("")).alias("content"))
    texts = own.join(bounded(parts), "chunk_id")
    many = texts.where(F.size("chunk_ids") > 1).groupBy("chunk_ids").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "content"))), lambda x: x["content"]).alias("_c"))
    made = texts.where(F.size("chunk_ids") == 1).select("chunk_ids", F.col("content").alias("matched")).unionByName(many.select("chunk_ids", joined("_c").alias("matched")))
    return found.join(made, "chunk_ids")


def windows(fused: DataFrame, corpus: DataFrame, options: Options = Options()) -> DataFrame:
    """WIN1, WIN2: all windows with their texts. Where only the best are wanted, take candidates()."""
    return with_texts(staged(bare_windows(fused, corpus, options), "windows"), corpus).drop("_key")


def _order(columns: list[str]) -> list:
    """Order of windows within a query: by rrf, then by their documents' first appearance, which is that of its best chunk."""
    return [F.desc("rrf"), *([F.desc("doc_rrf")] if "doc_rrf" in columns else []), "doc_id", "ord_start"]


def dedupe(found: DataFrame) -> DataFrame:
    """WIN3: of a query's windows with equal text the first in order; pos: place among the rest."""
    order = _order(found.columns)
    best = Window.partitionBy("query_id", "_hash").orderBy(*order)
    return found.withColumn("_hash", F.md5("matched")).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_hash").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def candidates(fused: DataFrame, corpus: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """WIN1-WIN4: each query's first `mmr_pool_size` distinct windows with text and pos, and the number of its windows.

    Windows are ranked before they have texts. Those of equal chunk texts count once; the first ones of each query get
    their texts, and four times as many where so few of them differ that the pool isn't full.
    """
    bare, size = staged(bare_windows(fused, corpus, options), "windows"), options.mmr_pool_size
    counts = bare.groupBy("query_id").agg(F.count("*").alias("windows"))
    rest = [c for c in bare.columns if c not in ("query_id", "_key", "rrf", "doc_rrf", "doc_id", "ord_start")]
    first = F.min(F.struct((-F.col("rrf")).alias("_r"), (-F.col("doc_rrf")).alias("_d"), "doc_id", "ord_start", *rest)).alias("w")
    unique = bare.groupBy("query_id", "_key").agg(first).select("query_id", (-F.col("w._r")).alias("rrf"), (-F.col("w._d")).alias("doc_rrf"), "w.doc_id", "w.ord_start", *[f"w.{c}" for c in rest])
    block = 2 * size
    while True:
        best = unique.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order(unique.columns)))).where(F.col("_n") <= block).drop("_n")
        found = staged(with_texts(staged(best, "first-windows"), corpus), "window-texts")
        short = found.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("matched").alias("kinds")).where((F.col("n") >= block) & (F.col("kinds") < size))
        if short.isEmpty():
            return dedupe(found).where(F.col("pos") <= size), counts
        block *= 4


#: rrf of hits that are below all leading ones: above 0, as any hit's.
BELOW = 1e-12


def keyword_candidates(corpus: DataFrame, queries: DataFrame, options: Options = Options(), digits: int = 6, rrf_digits: int = 9) -> DataFrame:
    """The pool of candidates() of the keyword leg alone, without all hits of a query: from the documents that hold its leading ones.

    A window goes by its best hit, and reaches no other document. The hits of a query's best scores have exact ranks;
    all other hits of their documents only widen windows. If the windows of leading hits don't fill the pool, four times
    as many scores lead, until all do.
    """
    known = bm25.batch(corpus, queries)
    reached = lambda rank: F.round(F.lit(options.bm25_weight) / (F.lit(options.rrf_k) + rank), rrf_digits)
    if known is None:
        return candidates(fuse(None, bm25.scores(corpus, queries, digits=digits), options).withColumn("rrf", F.round("rrf", rrf_digits)), corpus, options)[0]
    kinds, size = 2 * options.mmr_pool_size, options.mmr_pool_size
    down = Window.partitionBy("query_id").orderBy(F.desc("bm25"))
    while True:
        best = staged(bm25.best(corpus, queries, kinds, digits, kinds=True, known=known), "best-hits")
        lead = staged(best.select("query_id", "chunk_id", F.rank().over(down).cast("int").alias("bm25_rank"), F.dense_rank().over(down).alias("_kind"), "bm25").where(F.col("_kind") <= kinds), "leading-hits")
        ends = staged(lead.groupBy("query_id").agg(F.max("_kind").alias("_kinds"), F.count("*").cast("int").alias("_n"), F.max("bm25_rank").alias("_last"), F.min("bm25").alias("_least")), "leading-ends")
        docs = staged(corpus.select("chunk_id", "doc_id").join(bounded(lead.select("query_id", "chunk_id")), "chunk_id").select("query_id", "doc_id").distinct(), "leading-documents")
        own = corpus.join(bounded(docs.select("doc_id").distinct()), "doc_id", "left_semi").select(F.struct("chunk_id", "doc_id").alias("chunk_id"), "content")
        near = bm25.scores(own, queries, digits=digits, known=known).select("query_id", "chunk_id.chunk_id", "chunk_id.doc_id", "bm25").join(bounded(docs), ["query_id", "doc_id"], "left_semi")
        hits = near.join(lead.select("query_id", "chunk_id", F.col("bm25_rank").alias("_rank")), ["query_id", "chunk_id"], "left").join(ends, "query_id")
        fused = hits.select("query_id", "chunk_id", F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("int").alias("vec_rank"), "bm25", F.coalesce("_rank", F.col("_n") + 1).alias("bm25_rank"), F.when(F.col("_rank").isNull(), BELOW).otherwise(reached(F.col("_rank"))).alias("rrf"))
        pool = staged(candidates(staged(fused, "leading-fused"), corpus, options)[0], "keyword-pool")
        full = pool.join(ends, "query_id").where(F.col("bm25") >= F.col("_least")).groupBy("query_id").agg(F.count("*").alias("_full"))
        blurred = reached(F.col("_n") + 1) >= reached(F.col("_last"))  # a next hit would reach the same rrf
        short = ends.where(F.col("_kinds") == kinds).join(full, "query_id", "left").where((F.coalesce("_full", F.lit(0)) < size) | blurred)
        if short.isEmpty():
            return pool
        kinds *= 4


def hybrid_candidates(found, corpus: DataFrame, options: Options = Options(), rrf_digits: int = 9, lead: int | None = None) -> tuple[DataFrame, DataFrame]:
    """candidates() of both legs, from the documents that hold a query's leading hits. found: legs.legs() that keeps doc_id.

    A window goes by its best hit, and reaches no other document; leading hits have their exact ranks, and all others of
    their documents only widen windows. If not enough windows lie above the last leading hit, four times as many lead,
    until all do. The keyword ranks of what is in the pool are counted at the end. Windows of a query that all chunks hit
    are the same for each such query, and are counted once, when their number is asked for.
    """
    from corpusloom.operators import legs

    config, size = [(options.vec_weight, options.bm25_weight, options.rrf_k)], options.mmr_pool_size
    place = staged(legs.places(found), "query-places")
    totals = staged(legs.pairs(found), "query-pairs")
    lead = lead or 4 * size
    while True:
        best = legs.fused(found, config, rrf_digits, lead).where("rrf > 0").withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id"))).where(F.col("_n") <= lead)
        best = staged(best.select("query_id", "chunk_id", "rrf", "vec_rank"), "leading-hits")
        docs = found.rows.select("chunk_id", "doc_id").join(bounded(best.select("query_id", "chunk_id")), "chunk_id").join(F.broadcast(place), "query_id").groupBy("doc_id").agg(F.collect_set("query").alias("_for"))
        rows = found.rows.join(bounded(staged(docs, "leading-documents")), "doc_id")
        hits = legs.scored(found, rows).join(best, ["query_id", "chunk_id"], "left").withColumn("rrf", F.coalesce("rrf", F.lit(BELOW)))
        near = staged(hits.withColumn("bm25_rank", F.when(F.col("bm25") > 0, 1).otherwise(0)), "leading-fused")  # the pool's are counted below
        pool = staged(candidates(near, corpus, options)[0], "hybrid-pool")
        ends = best.groupBy("query_id").agg(F.count("*").alias("_led"), F.min("rrf").alias("_least")).join(totals, "query_id").where(F.col("_led") < F.col("pairs"))
        full = pool.join(ends, "query_id").where(F.col("rrf") > F.col("_least")).groupBy("query_id").agg(F.count("*").alias("_full"))
        if ends.join(full, "query_id", "left").where(F.coalesce("_full", F.lit(0)) < size).isEmpty():
            break
        lead *= 4
    pool = staged(legs.keyword_ranks(found, pool), "hybrid-ranks")
    every = found.rows.count()
    whole, other = totals.where(F.col("pairs") == every).select("query_id"), totals.where(F.col("pairs") < every).select("query_id")
    count = lambda hits: bare_windows(hits, corpus, options).groupBy("query_id").agg(F.count("*").alias("windows"))
    one = found.rows.select(F.lit(0).alias("query_id"), "chunk_id", F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("int").alias("vec_rank"), F.lit(0.0).alias("bm25"), F.lit(0).alias("bm25_rank"), F.lit(1.0).alias("rrf"))
    windows = whole.crossJoin(F.broadcast(count(one).select("windows")))  # one row
    if not other.isEmpty():
        every_hit = legs.scored(found).join(F.broadcast(other), "query_id", "left_semi").select("*", F.lit(None).cast("int").alias("vec_rank"), F.lit(0).alias("bm25_rank"), F.lit(1.0).alias("rrf"))
        windows = windows.unionByName(count(every_hit))
    return pool, windows


def relevance(vec_available: bool) -> Column:
    """GAT2."""
    by_rank = F.when(F.col("bm25_rank") > 0, F.greatest(F.lit(0.0), F.lit(0.6) - (F.col("bm25_rank") - 1) * 0.05)).otherwise(0.0)
    by_cosine = F.least(F.lit(1.0), F.col("cosine") + F.when(F.col("bm25_rank") > 0, 0.05).otherwise(0.0))
    return F.when(F.col("cosine").isNotNull(), by_cosine).otherwise(by_rank) if vec_available else by_rank


def gate(pool: DataFrame, queries: DataFrame, signals: DataFrame | None, options: Options = Options(), windows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """GAT1, GAT3: admitted rows with relevance, and one row a query: hits, dropped, no_relevant_hit. signals None: no vectors.

    windows: query_id and the number of all its windows, which are what a query without admitted rows drops; else the pool's rows are.
    """
    vec = signals is not None
    rows = pool.withColumn("relevance", relevance(vec))
    if vec:
        refused = signals.where((F.col("max_cosine") < options.min_max_cosine) | (F.col("cos_gap") < options.min_cos_gap)).select("query_id")
        passed = rows.join(refused, "query_id", "left_anti").where(F.coalesce("cosine", F.lit(0.0)) >= options.min_vec_score)
    else:
        passed = rows.where(F.col("bm25_rank").between(1, options.bm25_exempt_rank))
    best = F.max("rrf").over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    kept = passed.withColumn("_best", best).where(F.col("rrf") >= F.col("_best") * options.relative_cut_ratio).drop("_best").withColumn("place", place).where(F.col("place") <= options.mmr_pool_size)
    counts = queries.select("query_id").join(pool.groupBy("query_id").agg(F.count("*").alias("_all")), "query_id", "left").join(kept.groupBy("query_id").agg(F.count("*").alias("_kept")), "query_id", "left")
    counts = counts.withColumn("_seen", F.col("_all")) if windows is None else counts.join(windows.select("query_id", F.col("windows").alias("_seen")), "query_id", "left")
    dropped = F.when(F.col("_kept").isNull(), F.coalesce("_seen", F.lit(0))).otherwise(F.col("_all") - F.col("_kept"))
    report = counts.select("query_id", F.coalesce("_kept", F.lit(0)).alias("hits"), dropped.alias("dropped"), F.col("_kept").isNull().alias("no_relevant_hit"))
    return kept, report


def mmr(hits: DataFrame, limit: int, lam: float, vectors: DataFrame | None = None) -> DataFrame:
    """MMR1: at most `limit` rows a query, picked by lam * relevance - (1 - lam) * likeness to what is picked; column pick."""
    place = Window.partitionBy("query_id").orderBy("place")
    if lam >= 1 or vectors is None:
        return hits.withColumn("pick", F.row_number().over(place)).where(F.col("pick") <= limit)
    rows = hits.join(vectors.select(F.col("chunk_id").alias("best_chunk"), "vector"), "best_chunk", "left")
    schema = ", ".join(f"`{n}` {t}" for n, t in hits.dtypes) + ", pick int"
    columns = [*hits.columns, "pick"]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:  # at most the pool's rows
        pdf = pdf.sort_values("place", kind="stable").reset_index(drop=True)
        size = max((len(v) for v in pdf.vector if v is not None), default=1)
        v = np.array([np.asarray(x, np.float64) if x is not None and len(x) == size else np.zeros(size) for x in pdf.vector])
        near, left, picked = np.zeros(len(pdf)), list(range(len(pdf))), []
        while left and len(picked) < limit:
            score = lam * pdf.relevance.to_numpy()[left] - (1 - lam) * near[left]
            i = left.pop(int(np.argmax(score)))
            picked.append(i)
            near = np.maximum(near, np.cumsum(v * v[i], axis=1)[:, -1])  # added in order, so that equal vectors give equal sums
        return pdf.iloc[picked].assign(pick=range(1, len(picked) + 1))[columns]

    return rows.groupBy("query_id").applyInPandas(choose, schema)


def expand(hits: DataFrame, corpus: DataFrame, options: Options = Options()) -> DataFrame:
    """CTX1: each hit with its neighbours of `radius` chunks, given up from the left, then from the right, while too long.

    The range join is one of equal (doc_id, ord): a hit names the few places that it may reach, and only their chunks are
    taken from the corpus, by a broadcast of the places where they are few.
    """
    r, most = options.window_radius, options.max_window_chars
    hits = staged(hits, "hits")
    place = F.explode(F.sequence((F.col("ord_start") - r).cast("long"), (F.col("ord_end") + r).cast("long"))).alias("ord")
    wanted = hits.select("doc_id", place).distinct()
    own = corpus.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("chunk_id").alias("_id"), F.col("content").alias("_text"), utf16_length("content").alias("_chars"))
    near = own.join(bounded(wanted), ["doc_id", "ord"])
    pairs = hits.select("*", place).join(near, ["doc_id", "ord"])
    one = F.struct("ord", "_id", "_text", "_chars")
    got = pairs.groupBy(*hits.columns).agg(F.sort_array(F.collect_list(one)).alias("_w"))
    total = lambda w: F.aggregate(w, F.lit(0), lambda s, x: s + x["_chars"])

    def cut(w: Column, outside, drop) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(max(r, 1))), w, lambda acc, _: F.when((F.size(acc) > 1) & outside(acc) & (total(acc) > most), drop(acc)).otherwise(acc))

    left = cut(F.col("_w"), lambda w: F.element_at(w, 1)["ord"] < F.col("ord_start"), lambda w: F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))))
    got = got.withColumn("_l", left)
    right = cut(F.col("_l"), lambda w: F.element_at(w, -1)["ord"] > F.col("ord_end"), lambda w: F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1))))
    got = got.withColumn("_r", right)
    return got.select(*hits.columns, F.col("_r._id").alias("window_chunk_ids"), F.element_at("_r", 1)["ord"].alias("window_start"), F.element_at("_r", -1)["ord"].alias("window_end"), joined("_r._text").alias("content"))


def retrieve(corpus: DataFrame, queries: DataFrame, fused: DataFrame, signals: DataFrame | None, options: Options = Options(), vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """TOP1: merge what fuse() or fuse_variants() gives, dedupe, pool, gate, select, expand. Rows of context, and the report of gate(). signals None: no vectors."""
    return retrieve_pool(corpus, queries, *candidates(fused, corpus, options), signals, options, vectors)


def retrieve_pool(corpus: DataFrame, queries: DataFrame, pool: DataFrame, seen: DataFrame | None, signals: DataFrame | None, options: Options = Options(), vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """TOP1 from what candidates() gives."""
    kept, report = gate(pool, queries, signals, options, seen)
    return expand(mmr(kept, options.top_k, options.mmr_lambda, vectors), corpus, options), report


def search(corpus: DataFrame, fused: DataFrame, top_k: int = 5, vec_available: bool = False) -> DataFrame:
    """TOP2: TOP1 with the corpus-dependent gates off, top_k within 1..10, texts of at most 1200 characters, scores to 4 digits."""
    return search_pool(corpus, candidates(fused, corpus)[0], top_k, vec_available)


def search_pool(corpus: DataFrame, pool: DataFrame, top_k: int = 5, vec_available: bool = False) -> DataFrame:
    """TOP2 from the pool that candidates() gives."""
    k = min(10, max(1, top_k))
    options = Options(top_k=k, min_vec_score=-2.0, bm25_exempt_rank=1 << 30, relative_cut_ratio=0.0)
    pool = pool.withColumn("relevance", relevance(vec_available)).withColumn("place", F.col("pos"))
    rows = expand(mmr(pool, k, 1.0), corpus, options)
    return rows.select("query_id", "pick", "doc_id", "ord_start", "ord_end", F.substring("content", 1, 1200).alias("content"), *[F.round(c, 4).alias(c) for c in ("rrf", "cosine", "bm25", "relevance")])


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def degenerate(scored: DataFrame, score: str = "score") -> DataFrame:
    """FLT5: queries whose scores are not finite or, being two or more, lie within 1e-6."""
    bad = F.isnan(score) | F.col(score).isin(float("inf"), float("-inf"))
    return scored.groupBy("query_id").agg((F.bool_or(F.coalesce(bad, F.lit(False))) | ((F.count(score) > 1) & (F.max(score) - F.min(score) < 1e-6))).alias("degenerate"))


def degenerate_ends(ends: DataFrame) -> DataFrame:
    """degenerate() of what bm25.extremes() gives."""
    bad = F.isnan("most") | F.isnan("least") | (F.abs("most") == float("inf")) | (F.abs("least") == float("inf"))
    return ends.select("query_id", (bad | ((F.col("n") > 1) & (F.col("most") - F.col("least") < 1e-6))).alias("degenerate"))


def rerank(hits: DataFrame, scores: DataFrame, candidates: int = 10) -> DataFrame:
    """RRK1, RRK3: the first candidates of each query in order of their best chunk's score; missing ones count and go last; where all are missing the order stays.

    hits: query_id, pos, chunk_ids; scores: query_id, chunk_id, logit.
    """
    first = hits.where(F.col("pos") <= candidates)
    parts = first.select("query_id", "pos", F.explode("chunk_ids").alias("chunk_id")).join(scores, ["query_id", "chunk_id"], "left").groupBy("query_id", "pos").agg(F.max(sigmoid(F.col("logit"))).alias("rerank_score"), F.count_if(F.col("logit").isNull()).alias("missing"))
    place = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "pos")
    return first.join(parts, ["query_id", "pos"]).withColumn("rerank_pos", F.row_number().over(place))


def rerank_by(hits: DataFrame, passages: DataFrame, queries: DataFrame, scorer, candidates: int = 10) -> DataFrame:
    """UDF5: rerank() by a callback over (query text, passage) columns that gives a logit; queries whose scores are degenerate keep their order (FLT5).

    passages: chunk_id, content; queries: query_id, text.
    """
    pairs = hits.where(F.col("pos") <= candidates).select("query_id", F.explode("chunk_ids").alias("chunk_id")).join(passages, "chunk_id").join(queries, "query_id")
    scored = pairs.select("query_id", "chunk_id", scorer(F.col("text"), F.col("content")).cast("double").alias("logit"))
    bad = degenerate(scored, "logit").where("degenerate").select("query_id")
    return rerank(hits, scored.join(bad, "query_id", "left_anti"), candidates)


def rerank_effect(ranked: DataFrame, k: int = 5) -> DataFrame:
    """RRK2: whether the first changed, and how many of the first k stayed among them."""
    before, after = F.sort_array(F.collect_list(F.when(F.col("pos") <= k, F.col("pos")))), F.collect_set(F.when(F.col("rerank_pos") <= k, F.col("pos")))
    return ranked.groupBy("query_id").agg((F.max(F.when(F.col("rerank_pos") == 1, F.col("pos"))) != 1).alias("top_changed"), F.size(F.array_intersect(before, after)).alias("overlap"))
