"""EVL1-EVL19 and CON1-CON2: golden sets, redundancy, reports, gates, agreement and consistency.

Ranked windows have query_id, rank (from 1), doc_id, ord_start, ord_end, content; golden rows have query_id, relevant,
key_points (arrays of string), negative, grp (group letter).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import fnv1a32
from corpusloom.functions.text import bigram_set, jaccard
from corpusloom.operators.ranks import nearest_ranks
from corpusloom.operators.shared import BROADCAST_ROWS, small_batches, staged
from corpusloom.operators.verify import numbers

NEAR = 0.8
#: Parts of the classes whose pairs are compared by a task of their own, and what a part holds at most.
PARTS, PART_BYTES = 8, 32 << 20
#: Rows of a block of sets, cells of a matrix, and sets by which like ones are brought together.
ROWS, CELLS, PIVOTS = 512, 1 << 22, 32


def coverage_at(windows: DataFrame, golden: DataFrame, k: int, name: str = "coverage") -> DataFrame:
    """EVL1: share of a query's relevant strings that one of the first k windows contains."""
    wanted = golden.select("query_id", F.size("relevant").alias("n"), F.explode("relevant").alias("r"))
    found = wanted.join(windows.where(F.col("rank") <= k), "query_id").where(F.contains("content", F.col("r"))).select("query_id", "r").distinct().groupBy("query_id").agg(F.count("*").alias("hit"))
    return golden.where(F.size("relevant") > 0).select("query_id", F.size("relevant").alias("n")).join(found, "query_id", "left").select("query_id", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias(name))


def first_relevant(windows: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """EVL2: query_id, first_rank (null if none) and its reciprocal."""
    wanted = golden.select("query_id", F.explode("relevant").alias("r"))
    best = windows.where(F.col("rank") <= k).join(wanted, "query_id").where(F.contains("content", F.col("r"))).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return golden.where(F.size("relevant") > 0).select("query_id").join(best, "query_id", "left").withColumn("reciprocal", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))


def key_point_hits(windows: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """EVL3: query_id, points, hit, over the joined text of the first k windows."""
    text = windows.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("text"))
    points = golden.select("query_id", F.explode("key_points").alias("p")).join(text, "query_id", "left")
    return points.groupBy("query_id").agg(F.count("*").alias("points"), F.count_if(F.contains(F.coalesce("text", F.lit("")), F.col("p"))).alias("hit"))


def redundant_pairs(windows: DataFrame, k: int = 3, near: float = NEAR) -> DataFrame:
    """EVL4, EVL5: pairs of the first k windows that touch in one document (adjacent) or are alike in bigrams (near_duplicate)."""
    w = windows.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "ord_start", "ord_end", bigram_set("content").alias("b"))
    x, y = w.select("query_id", *[F.col(c).alias(f"{c}_1") for c in w.columns[1:]]), w.select("query_id", *[F.col(c).alias(f"{c}_2") for c in w.columns[1:]])
    touch = (F.col("doc_id_1") == F.col("doc_id_2")) & (F.col("ord_start_1") <= F.col("ord_end_2") + 1) & (F.col("ord_start_2") <= F.col("ord_end_1") + 1)
    pairs = x.join(y, "query_id").where("rank_1 < rank_2").withColumn("jaccard", jaccard(F.col("b_1"), F.col("b_2")))
    return pairs.select("query_id", "rank_1", "rank_2", touch.alias("adjacent"), "jaccard", (F.col("jaccard") >= near).alias("near_duplicate"))


@dataclass
class Sets:
    """Sets of bigrams, numbered: those of row i are code[at[i]:at[i + 1]]."""

    ids: pa.Array
    code: np.ndarray
    at: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def take(self, rows: np.ndarray) -> Sets:
        n = self.sizes[rows]
        at = np.r_[0, np.cumsum(n)]
        return Sets(self.ids.take(pa.array(rows)), self.code[np.arange(at[-1]) + np.repeat(self.at[rows] - at[:-1], n)], at)

    def within(self, known: np.ndarray) -> np.ndarray:
        """How many bigrams of each row are known."""
        return np.add.reduceat(known[self.code].astype(np.int64), self.at[:-1])

    def blocks(self, kinds: int, rows: int) -> list[tuple[Sets, np.ndarray]]:
        """Rows of like sets together, each block with the bigrams it has. Pivots only decide the order."""
        alike = np.zeros((min(PIVOTS, len(self.ids)), len(self.ids)))
        for p, i in enumerate(np.linspace(0, len(self.ids) - 1, len(alike)).astype(int)):
            known = np.zeros(kinds, bool)
            known[self.code[self.at[i] : self.at[i + 1]]] = True
            both = self.within(known)
            alike[p] = both / (self.sizes + self.sizes[i] - both)
        order = np.lexsort((self.sizes, alike.argmax(axis=0)))
        out = []
        for s in range(0, len(order), rows):
            own = self.take(order[s : s + rows])
            out.append((own, np.bincount(own.code, minlength=kinds) > 0))
        return out


def _common(x: Sets, y: Sets, columns: np.ndarray, kinds: int) -> np.ndarray:
    """Sizes of all intersections, by products of 0-1 matrices over some columns at a time: exact in single precision."""
    both = np.zeros((len(x.ids), len(y.ids)), np.float32)
    width = max(1, CELLS // max(both.shape))
    for s in range(0, len(columns), width):
        place = np.full(kinds, -1)
        place[columns[s : s + width]] = np.arange(len(columns[s : s + width]))
        m = []
        for z in (x, y):
            m.append(np.zeros((len(z.ids), len(columns[s : s + width])), np.float32))
            own, row = place[z.code], np.repeat(np.arange(len(z.ids)), z.sizes)
            m[-1][row[own >= 0], own[own >= 0]] = 1
        both += m[0] @ m[1].T
    return both.astype(np.int64)


def _alike(left: Sets, right: Sets | None, kinds: int, near: float):
    """ids of all pairs at `near` or more, and their jaccard; right None: pairs of left's own."""
    ones = left.blocks(kinds, ROWS)
    others = ones if right is None else right.blocks(kinds, ROWS)
    for i, (a, in_a) in enumerate(ones):
        for j, (b, in_b) in enumerate(others):
            if right is None and j < i or not min(a.sizes.max(), b.sizes.max()) >= near * max(a.sizes.min(), b.sizes.min()) - 1e-6:
                continue
            # a set whose share in all of the other block's bigrams is below `near` is alike to none of them
            rows = np.flatnonzero(a.within(in_b) >= near * a.sizes - 1e-6)
            columns = np.flatnonzero(b.within(in_a) >= near * b.sizes - 1e-6)
            if not len(rows) or not len(columns):
                continue
            x, y = a.take(rows), b.take(columns)
            both = _common(x, y, np.flatnonzero(in_a & in_b), kinds)
            share = both / (x.sizes[:, None] + y.sizes[None, :] - both)
            found = share >= near
            if a is b:
                found &= rows[:, None] < columns[None, :]
            r, c = np.nonzero(found)
            if len(r):
                yield x.ids.take(pa.array(r)), y.ids.take(pa.array(c)), pa.array(share[r, c])


def near_duplicate_chunks(chunks: DataFrame, near: float = NEAR) -> DataFrame:
    """EVL6: chunk_1, chunk_2, jaccard of all texts at bigram Jaccard of `near` or more.

    Chunks of one bigram set, copies of one text among them, are one class, known by its least chunk id; it is paired
    with each other chunk of the class (membership, jaccard 1), and classes with classes. The classes are dealt over
    parts, and a task compares two parts: like sets stand together in blocks, a pair of blocks is left out where sizes or
    bigrams rule out every pair, and the others are counted exactly. Pairs are handed on as they are found; nothing
    but the sets, once for each part, is shuffled. Work grows with the square of the number of classes, as the
    result does. A text without two characters in a row has no bigram and no row.
    """
    own = chunks.select("chunk_id", F.array_sort(bigram_set(F.coalesce("content", F.lit("")))).alias("b"))
    keyed = staged(own.where(F.size("b") > 0).select("chunk_id", F.unhex(F.md5(F.array_join("b", "\0"))).alias("set_key"), F.array_join("b", "").alias("b")), "bigram-sets")
    reps = staged(keyed.groupBy("set_key").agg(F.min("chunk_id").alias("rep"), F.count("*").alias("n")), "bigram-classes")
    same = keyed.select("chunk_id", "set_key").join(reps.where("n > 1"), "set_key").where("chunk_id <> rep").select(F.col("rep").alias("chunk_1"), F.col("chunk_id").alias("chunk_2"), F.lit(1.0).alias("jaccard"))
    classes = staged(keyed.join(reps, (keyed.set_key == reps.set_key) & (keyed.chunk_id == reps.rep), "left_semi").select(F.col("chunk_id").alias("rep"), "b").dropDuplicates(["rep"]), "class-sets")
    n, size = classes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("b")), F.lit(0))).first()
    parts = max(min(PARTS, -(-n // ROWS)), -(-size // PART_BYTES), 1)
    small_batches(chunks.sparkSession)
    part, other = F.pmod(F.xxhash64("rep"), F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = classes.select("rep", "b", part.cast("int").alias("part"), other.alias("_o")).select((F.least("part", "_o") * parts + F.greatest("part", "_o")).alias("task"), "part", "rep", "b")
    dealt = dealt.repartitionByRange(parts * (parts + 1) // 2, "task").sortWithinPartitions("task", "part")

    def pairs(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        part, texts = t["part"].to_numpy(), t["b"].to_pylist()
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        kinds, code = np.unique(flat[::2] << 21 | flat[1::2], return_inverse=True)  # two code points a bigram
        every = Sets(t["rep"].combine_chunks(), code, np.r_[0, np.cumsum([len(x) // 2 for x in texts])])
        task = t["task"][0].as_py()
        sides = [every.take(np.flatnonzero(part == p)) for p in sorted({task // parts, task % parts})]
        if all(len(s.ids) for s in sides):
            for x, y, share in _alike(sides[0], sides[1] if len(sides) > 1 else None, len(kinds), near):
                yield pa.RecordBatch.from_arrays([x, y, share], names=["a", "b", "jaccard"])

    def run(batches):
        held, task = [], None
        for b in batches:
            own = b.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, np.diff(own) != 0]).tolist() if len(own) else []
            for s, e in zip(starts, [*starts[1:], len(own)], strict=True) if starts else ():
                if held and own[s] != task:
                    yield from pairs(held)
                    held = []
                task = own[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from pairs(held)

    kind = dict(chunks.dtypes)["chunk_id"]
    exact = dealt.mapInArrow(run, f"a {kind}, b {kind}, jaccard double").select(F.least("a", "b").alias("chunk_1"), F.greatest("a", "b").alias("chunk_2"), "jaccard")
    return exact.unionByName(same)


def query_figures(windows: DataFrame, golden: DataFrame) -> DataFrame:
    """EVL7: query_id, recall3, recall5, no_hit (none of the first ten) of every query with relevant strings, from one comparison of texts."""
    asked = golden.where(F.size("relevant") > 0).select("query_id", F.array_distinct("relevant").alias("rs"))
    met = windows.where(F.col("rank") <= 10).join(asked, "query_id").select("query_id", "rank", F.posexplode(F.transform("rs", lambda r: F.contains(F.col("content"), r))).alias("r", "held"))
    first = met.where("held").groupBy("query_id", "r").agg(F.min("rank").alias("first"))
    hits = first.groupBy("query_id").agg(F.count_if(F.col("first") <= 3).alias("h3"), F.count_if(F.col("first") <= 5).alias("h5"))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.size("rs")
    return asked.join(hits, "query_id", "left").select("query_id", share("h3").alias("recall3"), share("h5").alias("recall5"), F.col("h3").isNull().alias("no_hit"))


def ranked_metrics(windows: DataFrame, golden: DataFrame, by: list[str], gold: DataFrame | None = None) -> DataFrame:
    """SWP1, CHK3, EVL11: recall3, recall5, mrr (of the first ten) and document top-1 of every setting at once.

    windows: by, query_id, rank, doc_id, content; each text is compared with a query's strings once, and all figures are
    sums over what was found. Queries without rows count as misses; those without relevant strings don't count. gold
    (gold_documents): the share of queries whose first window is of a gold document.
    """
    asked = staged(golden.where(F.size("relevant") > 0).select("query_id", F.size(F.array_distinct("relevant")).alias("n"), F.array_distinct("relevant").alias("rs")), "asked")
    total = asked.count()
    met = windows.where(F.col("rank") <= 10).join(F.broadcast(asked) if total <= BROADCAST_ROWS else asked, "query_id")
    met = met.select(*by, "query_id", "rank", "doc_id", "n", F.posexplode(F.transform("rs", lambda r: F.contains(F.col("content"), r))).alias("r", "held"))
    first = met.groupBy(*by, "query_id", "n", "r").agg(F.min(F.when(F.col("held"), F.col("rank"))).alias("first"), F.min_by("doc_id", "rank").alias("top_doc"))
    per = first.groupBy(*by, "query_id", "n").agg(F.count_if(F.col("first") <= 3).alias("h3"), F.count_if(F.col("first") <= 5).alias("h5"), F.min("first").alias("best"), F.first("top_doc").alias("doc_id"))
    share = lambda c: F.sum(c) / F.lit(float(max(total, 1)))
    figures = [F.count("*").alias("queries"), share(F.col("h3") / F.col("n")).alias("recall3"), share(F.col("h5") / F.col("n")).alias("recall5"), share(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr")]
    if gold is not None:
        per = per.join(gold.select("query_id", "doc_id").distinct().withColumn("_gold", F.lit(1.0)), ["query_id", "doc_id"], "left")
        figures.append(share(F.coalesce("_gold", F.lit(0.0))).alias("doc_top1"))
    return per.groupBy(*by).agg(*figures)


def rerank_metrics(ranked: DataFrame, passages: DataFrame, golden: DataFrame) -> DataFrame:
    """EVL11: recall, MRR by stage, `before` and `after` reranking. ranked: rerank() rows with doc_id; passages: query_id, pos, content."""
    both = ranked.join(passages.select("query_id", "pos", "content"), ["query_id", "pos"]).withColumn("stage", F.explode(F.array(F.lit("before"), F.lit("after"))))
    return ranked_metrics(both.withColumn("rank", F.when(F.col("stage") == "before", F.col("pos")).otherwise(F.col("rerank_pos"))), golden, ["stage"])


def grouped_report(per_query: DataFrame) -> DataFrame:
    """EVL7: recall and no-hit counts by group, of all (grp `all`) and of the protected groups q and m. per_query: grp, recall3, recall5, no_hit."""
    values = [F.count("*").alias("queries"), F.avg("recall3").alias("recall3"), F.avg("recall5").alias("recall5"), F.count_if("no_hit").alias("no_hit")]
    by = per_query.rollup("grp").agg(*values).withColumn("grp", F.coalesce("grp", F.lit("all")))
    return by.unionByName(per_query.where(F.col("grp").isin("q", "m")).agg(F.lit("protected").alias("grp"), *values))


def negatives_report(per_query: DataFrame) -> DataFrame:
    """EVL8: per_query: negative, refused."""
    return per_query.agg(F.count_if("negative").alias("negatives"), F.count_if(F.col("negative") & F.col("refused")).alias("negatives_refused"), F.count_if(~F.col("negative") & F.col("refused")).alias("false_refusals"), (F.count_if(F.col("negative") & F.col("refused")) / F.count_if("negative")).alias("refusal_rate"))


def against_baseline(run: DataFrame, baseline: DataFrame, metric: str, floor: float = 0.95) -> DataFrame:
    """EVL9: both runs' means of a metric and whether the run holds the floor."""
    both = run.select("query_id", F.col(metric).alias("a")).join(baseline.select("query_id", F.col(metric).alias("b")), "query_id", "full")
    return both.agg(F.avg(F.coalesce("a", F.lit(0.0))).alias("run"), F.avg(F.coalesce("b", F.lit(0.0))).alias("baseline")).withColumn("holds", F.col("run") >= F.col("baseline") * floor - 1e-12)


def check_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """EVL10: failed gates. metrics: metric, value; gates: metric, kind (min, max or relative), bound, other (metric it is relative to)."""
    m = metrics.select("metric", "value")
    rows = gates.join(m, "metric", "left").join(m.select(F.col("metric").alias("other"), F.col("value").alias("base")), "other", "left")
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("bound")).when(F.col("kind") == "max", F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound") * F.col("base"))
    return rows.where(~F.coalesce(ok, F.lit(False))).select("metric", "kind", "bound", "value")


def rerank_report(ranked: DataFrame) -> DataFrame:
    """EVL11: share of changed firsts, missing scores, upper median of the best score. ranked: rerank() rows."""
    top = ranked.groupBy("query_id").agg(F.max(F.when(F.col("rerank_pos") == 1, F.col("rerank_score"))).alias("best"), F.max(F.when(F.col("rerank_pos") == 1, F.col("pos"))).alias("was"), F.sum("missing").alias("missing"))
    return top.agg(F.avg((F.col("was") != 1).cast("int")).alias("top_change_rate"), F.sum("missing").alias("missing"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY best DESC)").alias("median_top_score"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """EVL12: shares of queries that two runs agree on. Both: query_id, covered (array), top_doc, hits."""
    same = lambda c: F.avg((~F.col(f"{c}_differs")).cast("int")).alias(c)
    return _compared(a, b).agg(F.count("*").alias("queries"), same("covered"), same("top_doc"), same("hits"))


def mismatches(a: DataFrame, b: DataFrame, most: int = 10) -> DataFrame:
    """EVL12: the first queries on which the runs differ, with what differs."""
    rows = _compared(a, b).where("covered_differs OR top_doc_differs OR hits_differs")
    return rows.orderBy("query_id").limit(most).select("query_id", "covered_differs", "top_doc", "top_doc_b", "hits", "hits_b")


def _compared(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = a.join(b.select("query_id", *[F.col(c).alias(f"{c}_b") for c in ("covered", "top_doc", "hits")]), "query_id")
    return rows.withColumns({"covered_differs": F.sort_array("covered") != F.sort_array("covered_b"), "top_doc_differs": ~F.col("top_doc").eqNullSafe(F.col("top_doc_b")), "hits_differs": F.col("hits") != F.col("hits_b")})


def query_medians(samples: DataFrame, by: list[str]) -> DataFrame:
    """EVL13: repeated timings of one query become their median (the upper of two): `by`, query_id, ms."""
    return samples.groupBy(*by, "query_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms DESC)").alias("ms"))


def latency_summary(samples: DataFrame, by: list[str]) -> DataFrame:
    """EVL13: nearest-rank p50 and p95, mean and max of ms."""
    whole = samples.groupBy(*by).agg(F.avg("ms").alias("mean"), F.max("ms").alias("max"))
    return nearest_ranks(samples, by, "ms", {"p50": 0.5, "p95": 0.95}).join(whole, by)


def answer_metrics(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """EVL14: key points found in the answer without white space, share of cited answers, refusals. answers: query_id, answer, cited, refused."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    rows = golden.join(answers, "query_id").withColumn("hit", F.size(F.filter("key_points", lambda p: F.contains(bare(F.col("answer")), bare(p)))))
    positive = ~F.col("negative")
    return rows.agg((F.sum(F.when(positive, F.col("hit"))) / F.sum(F.when(positive, F.size("key_points")))).alias("key_point_rate"), F.avg(F.when(positive, F.col("cited").cast("int"))).alias("citation_rate"), F.avg(F.when(F.col("negative"), F.col("refused").cast("int"))).alias("refusal_rate"))


def citation_shares(verdicts: DataFrame) -> DataFrame:
    """EVL14: share of claims without a citation, and of answers that cite a passage out of range. verdicts: verify.verdicts() rows."""
    return verdicts.agg(F.sum("claims").alias("claims"), (F.sum("uncited_claims") / F.sum("claims")).alias("uncited_share"), F.avg((F.col("out_of_range_claims") > 0).cast("int")).alias("out_of_range_share"))


def refusal_confusion(rows: DataFrame) -> DataFrame:
    """EVL15: tp, fp, fn, tn of refusals and the model's own. rows: expect_refuse, refused, model_refused."""
    e, r = F.col("expect_refuse"), F.col("refused")
    return rows.agg(F.count_if(e & r).alias("tp"), F.count_if(~e & r & ~F.col("model_refused")).alias("fp"), F.count_if(e & ~r).alias("fn"), F.count_if(~e & ~r).alias("tn"), F.count_if(~e & F.col("model_refused")).alias("self_refused"))


#: Golden strings that one automaton holds.
PATTERNS = 50_000


class Patterns:
    """Which of many strings a text holds: an Aho-Corasick automaton where its library is there, else one by one."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        try:
            from ahocorasick import Automaton
        except ImportError:
            self.machine = None
            return
        self.machine = Automaton()
        for i, s in enumerate(strings):
            if s:
                self.machine.add_word(s, i)
        if len(self.machine):
            self.machine.make_automaton()

    def found(self, text: str) -> list[int]:
        if self.machine is None:
            return [i for i, s in enumerate(self.strings) if s in text]
        every = [i for i, s in enumerate(self.strings) if not s]  # each text holds the empty string
        return every + (sorted({i for _, i in self.machine.iter(text)}) if len(self.machine) else [])


def gold_documents(documents: DataFrame, golden: DataFrame) -> DataFrame:
    """EVL16: query_id and doc_id of documents that contain a relevant string.

    One pass of an automaton of all strings over each text, whatever their number; more than PATTERNS distinct ones are
    dealt to several passes. What a text holds is a number a string; queries join them after that. documents: doc_id,
    content.
    """
    wanted = staged(golden.select("query_id", F.explode("relevant").alias("r")).distinct(), "golden-strings")
    strings = staged(wanted.select("r").distinct(), "golden-patterns")
    n = max(1, -(-strings.count() // PATTERNS))
    kind, out = dict(documents.dtypes)["doc_id"], None

    def scan(own: list[str]):
        def run(batches):
            patterns = Patterns(own)
            for b in batches:
                ids, texts = b.column(0), b.column(1).to_pylist()
                hits = [patterns.found(t) if t is not None else [] for t in texts]
                at = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([own[i] for h in hits for i in h], pa.string())], names=["doc_id", "r"])

        return run

    for i in range(n):
        own = [r.r for r in strings.where(F.pmod(F.xxhash64("r"), F.lit(n)) == i).collect()]
        part = documents.select("doc_id", "content").mapInArrow(scan(own), f"doc_id {kind}, r string")
        out = part if out is None else out.unionByName(part)
    return out.join(wanted, "r").select("query_id", "doc_id").distinct()


def document_top1(windows: DataFrame, gold: DataFrame) -> DataFrame:
    hit = windows.where("rank = 1").join(gold.withColumn("gold", F.lit(1)), ["query_id", "doc_id"], "left")
    return hit.agg(F.avg(F.coalesce("gold", F.lit(0))).alias("doc_top1"))


def admission_audit(windows: DataFrame, golden: DataFrame, min_vec: float = 0.5, k: int = 3) -> DataFrame:
    """EVL17: mean coverage with all hits, those by cosine, those by cosine or keyword. windows also have cosine, bm25_rank."""
    out = None
    for name, ok in (("all", F.lit(True)), ("cosine", F.col("cosine") >= min_vec), ("either", (F.col("cosine") >= min_vec) | (F.col("bm25_rank") > 0))):
        own = windows.where(ok).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        part = coverage_at(own, golden, k).agg(F.lit(name).alias("admission"), F.avg("coverage").alias("coverage"))
        out = part if out is None else out.unionByName(part)
    return out


def query_detail(windows: DataFrame, golden: DataFrame, k: int = 3) -> DataFrame:
    """EVL18: hits, refused (no hit), coverage, first relevant rank, key points and how many were hit, ranks of the first adjacent and the first near-duplicate pair, start of the first text."""
    pairs = redundant_pairs(windows, k)
    at = F.struct("rank_1", "rank_2")
    first = pairs.groupBy("query_id").agg(F.min(F.when(F.col("adjacent"), at)).alias("a"), F.min(F.when(F.col("near_duplicate"), at)).alias("d"))
    first = first.select("query_id", *[F.col(f"{c}.rank_{i}").alias(f"{name}_{i}") for c, name in (("a", "adjacent"), ("d", "near_duplicate")) for i in (1, 2)])
    counts = windows.groupBy("query_id").agg(F.count("*").alias("hits"), F.substring(F.min_by("content", "rank"), 1, 40).alias("top_text"))
    out = golden.select("query_id", "negative").join(counts, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("refused", F.col("hits") == 0)
    for part in (coverage_at(windows, golden, k), first_relevant(windows, golden).select("query_id", "first_rank"), key_point_hits(windows, golden), first):
        out = out.join(part, "query_id", "left")
    return out


def golden_version(files: DataFrame) -> DataFrame:
    """EVL19: hash of each whole file. files: value."""
    return files.select(fnv1a32("value").alias("version"))


def consistency(samples: DataFrame) -> DataFrame:
    """CON1: agreement of repeated answers to one question. samples: question_id, sample_no, verdict, answer, citations."""
    s = samples.select("question_id", "sample_no", "citations", bigram_set("answer").alias("b"), F.array_distinct(numbers(F.col("answer"))).alias("n"))
    x, y = (s.select("question_id", *[F.col(c).alias(f"{c}_{i}") for c in s.columns[1:]]) for i in (1, 2))
    mean = lambda c, name: F.avg(jaccard(F.col(f"{c}_1"), F.col(f"{c}_2"))).alias(name)
    pairs = x.join(y, "question_id").where("sample_no_1 < sample_no_2").groupBy("question_id").agg(mean("b", "answer_jaccard"), mean("n", "number_jaccard"), mean("citations", "citation_jaccard"))
    whole = samples.groupBy("question_id").agg(F.count("*").alias("samples"), (F.count_distinct("verdict") == 1).cast("double").alias("verdict_agreement"), (F.count_distinct(F.col("verdict") == "refused") > 1).alias("refusal_flip"))
    one = lambda c: F.coalesce(c, F.lit(1.0)).alias(c)
    return whole.join(pairs, "question_id", "left").select("question_id", "samples", "verdict_agreement", one("answer_jaccard"), one("number_jaccard"), one("citation_jaccard"), "refusal_flip")


def consistency_gate(report: DataFrame, least: float = 0.75) -> DataFrame:
    """CON2."""
    return report.agg(F.avg("verdict_agreement").alias("agreement"), F.count_if("refusal_flip").alias("flips")).withColumn("passed", (F.col("agreement") >= least) & (F.col("flips") == 0))
