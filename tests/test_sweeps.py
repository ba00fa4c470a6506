"""Figures of several settings at once against plain loops, callbacks that fail, comparisons of runs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import calibrate, evaluate, fusion, verify


def metrics(rows, golden, gold):
    """setting -> figures, by loops. rows: setting, query, rank, doc, content."""
    out = {}
    asked = {q: list(dict.fromkeys(rs)) for q, rs in golden.items() if rs}
    for setting in {r[0] for r in rows}:
        r3 = r5 = mrr = top = n = 0.0
        for q, rs in asked.items():
            own = sorted((rank, doc, text) for s, query, rank, doc, text in rows if (s, query) == (setting, q) and rank <= 10)
            n += bool(own)
            firsts = [min((rank for rank, _, text in own if r in text), default=99) for r in rs]
            r3 += sum(f <= 3 for f in firsts) / len(rs)
            r5 += sum(f <= 5 for f in firsts) / len(rs)
            mrr += 1 / min(firsts) if min(firsts) < 99 else 0
            top += bool(own) and own[0][1] in gold.get(q, ())
        out[setting] = (n, *(pytest.approx(x / len(asked)) for x in (r3, r5, mrr, top)))
    return out


def test_ranked_metrics(spark):
    rng = random.Random(1)
    golden = {q: rng.choices(["aa", "ab", "ba", "cc"], k=rng.randint(0, 3)) for q in range(12)}
    rows = [(s, q, rank, rng.randint(0, 4), "".join(rng.choices("abc", k=5))) for s in ("x", "y") for q in range(10) for rank in range(1, rng.randint(2, 13))]
    gold = {q: {q % 5, 3} for q in golden}
    g = spark.createDataFrame([(q, rs) for q, rs in golden.items()], "query_id int, relevant array<string>")
    w = spark.createDataFrame(rows, "s string, query_id int, rank int, doc_id int, content string").repartition(4)
    docs = spark.createDataFrame([(q, d) for q, ds in gold.items() for d in ds], "query_id int, doc_id int")
    got = {r.s: (r.queries, r.recall3, r.recall5, r.mrr, r.doc_top1) for r in evaluate.ranked_metrics(w, g, ["s"], docs).collect()}
    assert got == metrics(rows, golden, gold)
    assert "doc_top1" not in evaluate.ranked_metrics(w, g, ["s"]).columns


def test_admission_of_each_bound_is_that_of_the_gate(spark):
    rng = random.Random(2)
    rows = [(q, i + 1, rng.choice([None, rng.random()]), 1, 0.1 / (i + 1), q * 100 + i) for q in range(6) for i in range(20)]
    pool = spark.createDataFrame(rows, "query_id int, pos int, cosine double, bm25_rank int, rrf double, chunk_id int")
    q = pool.select("query_id").distinct()
    signals = spark.createDataFrame([(i, 0.9 if i else 0.1, 0.5) for i in range(6)], "query_id int, max_cosine double, cos_gap double")
    swept = calibrate.admission_sweep(pool, signals.where("max_cosine < 0.53"), [0.2, 0.5, 0.8]).collect()
    for v in (0.2, 0.5, 0.8):
        kept, _ = fusion.gate(pool, q, signals, fusion.with_overrides(fusion.Options(), min_vec_score=v))
        assert {(r.query_id, r.pos, r["rank"]) for r in swept if r.min_vec == v} == {(r.query_id, r.pos, r.place) for r in kept.collect()}


def test_selection_sweep(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.89, 2), (1, 3, 0.5, 3)], "query_id int, best_chunk int, relevance double, place int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "chunk_id int, vector array<float>")
    got = {}
    for r in calibrate.selection_sweep(hits, vectors, [0.5, 1.0], 2).orderBy("lam", "rank").collect():
        got.setdefault(r.lam, []).append(r.best_chunk)
    assert got == {0.5: [1, 3], 1.0: [1, 2]}


def test_rerank_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 2, 10), (1, 2, 1, 11)], "query_id int, pos int, rerank_pos int, doc_id int")
    passages = spark.createDataFrame([(1, 1, "no"), (1, 2, "yes")], "query_id int, pos int, content string")
    golden = spark.createDataFrame([(1, ["yes"])], "query_id int, relevant array<string>")
    assert {r.stage: r.mrr for r in evaluate.rerank_metrics(ranked, passages, golden).collect()} == {"before": 0.5, "after": 1.0}


def test_a_failing_scorer_leaves_verification_lexical(spark):
    sentences = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "answer_id int, sentence_no int, sentence string")

    def broken(rows, scope):
        raise RuntimeError("no model")

    def broken_in_a_task(rows, scope):
        return rows.select("answer_id", "sentence_no", F.raise_error(F.lit("lost")).cast("double").alias("semantic"))

    for scorer in (broken, broken_in_a_task):
        with pytest.warns(UserWarning, match="lexical"):
            assert verify.with_scorer(sentences, None, scorer) is None
    assert verify.with_scorer(sentences, None, None) is None
    some = verify.with_scorer(sentences, None, lambda rows, scope: rows.where("sentence_no = 0").withColumn("semantic", F.lit(0.5)))
    assert {(r.sentence_no, r.semantic) for r in some.collect()} == {(0, 0.5), (1, None)}


def test_first_mismatches_and_citation_shares(spark):
    run = lambda rows: spark.createDataFrame(rows, "query_id int, covered array<string>, top_doc int, hits int")
    a, b = run([(1, ["x", "y"], 1, 3), (2, [], None, 0), (3, ["z"], 5, 1)]), run([(1, ["y", "x"], 1, 3), (2, [], None, 1), (3, ["z"], 6, 1)])
    assert [(r.query_id, r.covered_differs, r.top_doc, r.top_doc_b, r.hits, r.hits_b) for r in evaluate.mismatches(a, b).collect()] == [(2, False, None, None, 0, 1), (3, False, 5, 6, 1, 1)]
    assert [r.query_id for r in evaluate.mismatches(a, b, 1).collect()] == [2]
    v = spark.createDataFrame([(1, 4, 1, 0), (2, 0, 0, 2)], "answer_id int, claims long, uncited_claims long, out_of_range_claims long")
    assert tuple(evaluate.citation_shares(v).first()) == (4, 0.25, 0.5)


def test_corpora_told_by_a_column_are_scored_apart_in_one_pass(spark, monkeypatch):
    from corpusloom.operators import bm25

    monkeypatch.setattr(bm25, "HELD", 4)
    monkeypatch.setattr(bm25, "PAIRS", 6)
    words = ["alpha beta", "beta gamma gamma", "alpha", "delta", "", None, "alpha beta delta", "beta"]
    rows = spark.createDataFrame([(128 + 32 * (i % 3), i, words[i * i % 8]) for i in range(60)], "max_tokens int, chunk_id long, content string").repartition(3)
    queries = spark.createDataFrame([(7, "alpha"), (8, "beta gamma"), (9, "nothing known")], "query_id long, text string")
    first = lambda df: {k: [r.chunk_id for r in sorted(v, key=lambda r: (-r.bm25, r.chunk_id))[:3]] for k, v in grouped(df).items()}

    def grouped(df):
        out = {}
        for r in df.collect():
            out.setdefault((r.max_tokens, r.query_id), []).append(r)
        return out

    want = {}
    for n in (128, 160, 192):
        want |= first(bm25.best(rows.where(F.col("max_tokens") == n), queries, 3, 6).withColumn("max_tokens", F.lit(n)))
    assert first(bm25.best_by(rows, queries, "max_tokens", 3, 6)) == want
