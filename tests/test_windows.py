"""Windows before texts: greedy merging, reference order, growing blocks, overlaps in linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import common_end, joined
from corpusloom.operators import bm25, fusion, legs

CORPUS = "chunk_id long, doc_id string, ord int, content string"
FUSED = "query_id int, chunk_id long, cosine double, vec_rank int, bm25 double, bm25_rank int, rrf double"


def slow_end(a, b):
    return next((n for n in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:n])), 0)


def slow_joined(parts):
    out = ""
    for p in parts:
        out += p[slow_end(out, p) :]
    return out


def test_common_end():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab🎉", k=rng.randint(0, 200))) for _ in range(2))
        if rng.random() < 0.5 and a:
            b = a[rng.randrange(len(a)) :] + b
        assert common_end(a, b) == slow_end(a, b)
    # words whose hashes agree modulo a power of two: the comparison decides
    t = "0"
    while len(t) < 4096:
        t += t.translate(str.maketrans("01", "10"))
    other = t.translate(str.maketrans("01", "10"))
    assert common_end("x" + t, other) == slow_end("x" + t, other)
    began = time.perf_counter()
    half = "ab" * 250_000
    assert common_end("c" + half, half + "d") == len(half) and common_end("a" * 1_000_000, "a" * 999_999 + "b") == 999_999
    assert time.perf_counter() - began < 5


def test_joined(spark):
    df = spark.createDataFrame([(["abcab", "cabx", "x"],), ([],), (["a"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(joined("t")).collect()] == ["abcabx", "", "a", None]


def brute(fused, corpus, most=1200, pool=20):
    """query -> (number of windows, pool rows) by lists: best first, documents in order of appearance, merged, sorted, deduped."""
    by_id = {c[0]: c for c in corpus}
    place = {c[0]: i for i, c in enumerate(sorted(corpus, key=lambda c: (c[1], c[2])))}
    out = {}
    for q in {f[0] for f in fused}:
        hits = sorted((f for f in fused if f[0] == q and f[6] > 0), key=lambda f: (-f[6], place[f[1]]))
        docs = {}
        for f in hits:
            docs.setdefault(by_id[f[1]][1], []).append(f)
        windows = []
        for group in docs.values():
            current, size = [], 0
            for f in sorted(group, key=lambda f: by_id[f[1]][2]):
                _, _, ord_, text = by_id[f[1]]
                if current and ord_ == by_id[current[-1][1]][2] + 1 and size + len(text) <= most:
                    current.append(f)
                    size += len(text)
                else:
                    windows.append(current) if current else None
                    current, size = [f], len(text)
            windows.append(current)
        windows.sort(key=lambda w: -max(f[6] for f in w))
        seen, rows = set(), []
        for w in windows:
            text = slow_joined([by_id[f[1]][3] for f in w])
            if text not in seen:
                seen.add(text)
                best = max(w, key=lambda f: f[6])
                rows.append((by_id[w[0][1]][1], by_id[w[0][1]][2], by_id[w[-1][1]][2], best[6], best[1], text))
        out[q] = (len(windows), rows[:pool])
    return out


def run(spark, fused, corpus, options=fusion.Options()):
    c, f = spark.createDataFrame(corpus, CORPUS).repartition(3), spark.createDataFrame(fused, FUSED).repartition(5)
    rows, counts = fusion.candidates(f, c, options)
    got = {r.query_id: (r.windows, []) for r in counts.collect()}
    for r in rows.orderBy("query_id", "pos").collect():
        got[r.query_id][1].append((r.doc_id, r.ord_start, r.ord_end, r.rrf, r.best_chunk, r.matched))
    return got


def test_ties_follow_the_documents_first_appearance(spark):
    corpus = [(1, "d1", 0, "a1"), (2, "d2", 0, "b1"), (3, "d2", 2, "b2")]
    fused = [(1, 1, None, None, 1.0, 2, 0.5), (1, 2, None, None, 2.0, 1, 0.9), (1, 3, None, None, 1.0, 2, 0.5)]
    assert [r[5] for r in run(spark, fused, corpus)[1][1]] == ["b1", "b2", "a1"]


@pytest.mark.parametrize("seed", range(2))
def test_candidates_against_lists(spark, seed):
    rng = random.Random(seed)
    corpus, at = [], 0
    for d in range(25):
        o = 0
        for _ in range(rng.randint(1, 30)):
            o += rng.choice([1, 1, 1, 2])
            corpus.append((at, f"d{d:02}", o, rng.choice(["ab", "abc " * 60, "cab", "x" * 700, f"own {rng.randint(0, 40)} ab", ""])))
            at += 1
    fused = [(q, c[0], rng.choice([None, rng.random()]), 1, 1.0, rng.choice([0, 3, 5]), rng.choice([0.0, 0.1, 0.2, 0.3])) for q in range(4) for c in corpus if rng.random() < 0.8]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # windows go over the ends of batches
    try:
        got = run(spark, fused, corpus)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(fused, corpus)


def test_pool_grows_past_copies(spark):
    """Two chunks that make one text in a hundred ways fill the first blocks; the pool is full all the same."""
    corpus = [(2 * i + j, f"d{i:03}", j, p) for i in range(100) for j, p in enumerate(("x" * (i + 1), "x" * (100 - i) + "y"))]
    corpus += [(1000 + i, f"e{i:03}", 0, f"text {i}") for i in range(30)]
    fused = [(1, c[0], None, None, 1.0, 1, 0.9 if c[0] < 1000 else 0.1) for c in corpus]
    got, want = run(spark, fused, corpus), brute(fused, corpus)
    assert got == want and len(got[1][1]) == 20


def test_a_refused_query_drops_all_its_windows(spark):
    pool = spark.createDataFrame([(1, 1, 0.9, 0, 0.03, 1), (2, 2, 0.9, 0, 0.03, 1), (2, 3, 0.1, 0, 0.03, 2)], "query_id int, chunk_id int, cosine double, bm25_rank int, rrf double, pos int")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    sig = spark.createDataFrame([(1, 0.2, 0.5), (2, 0.9, 0.5)], "query_id int, max_cosine double, cos_gap double")
    seen = spark.createDataFrame([(1, 50), (2, 60)], "query_id int, windows long")
    assert {tuple(r) for r in fusion.gate(pool, q, sig, windows=seen)[1].collect()} == {(1, 0, 50, True), (2, 1, 1, False), (3, 0, 0, True)}


def test_all_windows_have_texts(spark):
    corpus = [(i, "d", i, t) for i, t in enumerate(("one two", "two three", "three", "z" * 1300, "end"))]
    c = spark.createDataFrame(corpus, CORPUS)
    fused = spark.createDataFrame([(q, i, None, None, 1.0, 1, 0.1) for q in (1, 2) for i in range(5)], FUSED)
    got = sorted((r.query_id, r.ord_start, r.ord_end, r.matched) for r in fusion.windows(fused, c).collect())
    assert got == [(q, *w) for q in (1, 2) for w in ((0, 2, "one two three"), (3, 3, "z" * 1300), (4, 4, "end"))]
    assert fusion.windows(fused.limit(0), c).count() == 0
    assert fusion.expand(fusion.windows(fused, c).where(F.lit(False)), c).count() == 0


def test_leading_documents_fill_the_pool(spark):
    """The pool from a query's best scores is that of all its hits, with copies, neighbours and fewer windows than scores."""
    r = random.Random(4)
    words = ["red", "fox", "owl", "sea", "sky"]
    docs = [[" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(r.randint(1, 7))] for _ in range(30)]
    rows = [(d * 100 + o, d, o, t) for d, ls in enumerate([*docs, *docs[:10]]) for o, t in enumerate(ls)]
    c = spark.createDataFrame(rows, "chunk_id long, doc_id long, ord int, content string").repartition(3)
    q = spark.createDataFrame([(1, "red fox"), (2, "owl"), (3, "none"), (4, "sea sky red")], "query_id int, text string")
    for size in (1, 3, 50):
        options = fusion.with_overrides(fusion.Options(), mmr_pool_size=size, max_window_chars=40)
        every = fusion.fuse(None, bm25.scores(c, q, digits=6), options).withColumn("rrf", F.round("rrf", 9))
        columns = ["query_id", "pos", "doc_id", "ord_start", "ord_end", "best_chunk", "bm25", "bm25_rank", "rrf", "matched"]
        got, want = (sorted(tuple(x) for x in rows.select(*columns).collect()) for rows in (fusion.keyword_candidates(c, q, options), fusion.candidates(every, c, options)[0]))
        assert got == want and got


def test_keyword_windows_where_documents_lie(spark, monkeypatch):
    """Rows of windows() of fuse(), copies, overlaps and long runs included, in several blocks of queries; no hit is shuffled."""
    monkeypatch.setattr(legs, "RANK_ROWS", 40)
    monkeypatch.setattr(legs, "SHOWN", 3)
    monkeypatch.setattr(bm25, "PAIRS", 12)
    rng = random.Random(5)
    docs = []
    for d in range(40):
        lines = [" ".join(rng.choices(["a", "b", "c", "d", "🎉e", "zz"], k=rng.randint(1, 9))) for _ in range(rng.randint(1, 30))]
        docs.append((d, [(i, t + t[::-1]) for i, t in enumerate(lines) if rng.random() < 0.9]))
    docs += [(100 + d, t) for d, t in docs[:3]] + [(200, [])]
    rows = [(d * 1000 + i, d, i, t) for d, ts in docs for i, t in ts]
    c = spark.createDataFrame(rows, "chunk_id long, doc_id long, ord int, content string").repartition(3)
    q = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "zz e a"), (4, "none"), (5, ""), (6, "d b c")], "query_id int, text string")
    names = ["query_id", "doc_id", "ord_start", "ord_end", "rrf", "bm25", "bm25_rank", "matched"]
    options = fusion.Options(max_window_chars=60)
    fused = fusion.fuse(None, bm25.scores(c, q, digits=6)).withColumn("rrf", F.round("rrf", 9))
    want = sorted(map(tuple, fusion.windows(fused, c, options).select(*names).collect()))
    got = legs.keyword_windows(legs.legs(c, q, 6), spark.createDataFrame(docs, "doc_id long, chunks array<struct<ord: int, content: string>>").repartition(3), 60, options.rrf_k)
    assert got.columns == names and sorted(map(tuple, got.collect())) == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert len(want) > 300 and max(r[3] - r[2] for r in want) == 2
