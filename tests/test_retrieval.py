import pytest
from pyspark.sql import functions as F

from corpusloom.operators import acl, bm25, dense, evidence, fusion, index


def test_leg_ranks(spark):
    df = spark.createDataFrame([(1, i, s, s) for i, s in enumerate([3.0, 1.0, 3.0, 0.0])], "query_id int, chunk_id int, bm25 double, cosine double")
    words = {r.chunk_id: r.r for r in fusion.leg_ranks(df, "bm25", "r").collect()}
    vec = {r.chunk_id: r.r for r in fusion.leg_ranks(df, "cosine", "r", keep_zero=True).collect()}
    assert words == {0: 1, 1: 3, 2: 1} and vec == {0: 1, 1: 3, 2: 1, 3: 4}
    out = {r.chunk_id: r for r in fusion.fuse(df.select("query_id", "chunk_id", "cosine"), df.select("query_id", "chunk_id", "bm25")).collect()}
    assert out[0].rrf == pytest.approx(2 / 61) and out[3].rrf == pytest.approx(1 / 64) and out[3].bm25_rank == 0


def corpus(spark, sizes=(500, 500, 500, 500, 10)):
    rows = [(i, "d", o, chr(97 + i) * n) for i, (o, n) in enumerate(zip((0, 1, 2, 4, 5), sizes, strict=True))]
    return spark.createDataFrame(rows, "chunk_id int, doc_id string, ord int, content string")


def test_windows_merge_while_they_fit(spark):
    c = corpus(spark)
    hits = c.select(F.lit(1).alias("query_id"), "chunk_id", (1.0 + F.col("chunk_id")).alias("bm25"))
    got = {(r.ord_start, r.ord_end): r for r in fusion.windows(fusion.fuse(None, hits), c).collect()}
    assert set(got) == {(0, 1), (2, 2), (4, 5)}
    assert got[4, 5].best_chunk == 4 and got[4, 5].bm25 == 5.0 and got[4, 5].matched == "d" * 500 + "e" * 10


def test_dedupe_keeps_the_better(spark):
    df = spark.createDataFrame([(1, "a", 0, "t", 0.1), (1, "b", 0, "t", 0.2), (1, "c", 0, "u", 0.15)], "query_id int, doc_id string, ord_start int, matched string, rrf double")
    assert [(r.doc_id, r.pos) for r in fusion.dedupe(df).orderBy("pos").collect()] == [("b", 1), ("c", 2)]


POOL = "query_id int, chunk_id int, cosine double, bm25_rank int, rrf double, pos int"


def test_gate(spark):
    pool = spark.createDataFrame([(1, 1, 0.9, 0, 0.03, 1), (1, 2, 0.6, 1, 0.02, 2), (1, 3, 0.7, 0, 0.001, 3), (1, 4, 0.2, 2, 0.03, 4), (2, 5, 0.9, 0, 0.03, 1), (3, 6, 0.9, 0, 0.03, 1)], POOL)
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    sig = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.52, 0.5), (3, 0.9, 0.07), (4, 0.9, 0.5)], "query_id int, max_cosine double, cos_gap double")
    kept, report = fusion.gate(pool, q, sig)
    assert {(r.chunk_id, round(r.relevance, 3)) for r in kept.collect()} == {(1, 0.9), (2, 0.65)}
    assert {(r.query_id, r.hits, r.dropped, r.no_relevant_hit) for r in report.collect()} == {(1, 2, 2, False), (2, 0, 1, True), (3, 0, 1, True), (4, 0, 0, True)}
    words, _ = fusion.gate(pool, q, None)
    assert {(r.chunk_id, round(r.relevance, 6)) for r in words.collect()} == {(2, 0.6), (4, 0.55)}


def test_mmr(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.89, 2), (1, 3, 0.5, 3)], "query_id int, best_chunk int, relevance double, place int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "chunk_id int, vector array<float>")
    pick = lambda lam: [r.best_chunk for r in fusion.mmr(hits, 2, lam, vectors).orderBy("pick").collect()]
    assert pick(0.5) == [1, 3] and pick(1.0) == [1, 2]


def test_expand_shrinks_left_then_right(spark):
    c = corpus(spark, (500, 500, 500, 500, 700))
    hits = spark.createDataFrame([(1, "d", 1, 1), (2, "d", 0, 0), (3, "d", 5, 5), (4, "d", 4, 4)], "query_id int, doc_id string, ord_start int, ord_end int")
    got = {r.query_id: (r.window_start, r.window_end) for r in fusion.expand(hits, c).collect()}
    assert got == {1: (1, 2), 2: (0, 1), 3: (4, 5), 4: (4, 5)}
    tight = fusion.with_overrides(fusion.Options(), max_window_chars=400)
    assert {r.query_id: (r.window_start, r.window_end) for r in fusion.expand(hits, c, tight).collect()} == {1: (1, 1), 2: (0, 0), 3: (5, 5), 4: (4, 4)}


def test_unknown_option():
    with pytest.raises(ValueError, match="nope"):
        fusion.with_overrides(fusion.Options(), nope=1)


def test_rerank(spark):
    hits = spark.createDataFrame([(1, i, [i]) for i in range(1, 13)], "query_id int, pos int, chunk_ids array<int>")
    s = spark.createDataFrame([(1, 3, 2.0), (1, 12, 9.0), (1, 5, 2.0)], "query_id int, chunk_id int, logit double")
    out = fusion.rerank(hits, s).orderBy("rerank_pos").collect()
    assert [r.pos for r in out][:4] == [3, 5, 1, 2] and len(out) == 10
    none = fusion.rerank(hits, s.limit(0)).orderBy("rerank_pos").collect()
    assert [r.pos for r in none] == list(range(1, 11))
    effect = fusion.rerank_effect(fusion.rerank(hits, s)).first()
    assert effect.top_changed and effect.overlap == 5


def test_invisible_documents_change_nothing(spark):
    docs = spark.createDataFrame([(1, "default", "", 0, "apples and pears"), (2, "default", "x", 1, "apples")], "doc_id int, tenant_id string, department string, classification int, content string")
    hidden = spark.createDataFrame([(9, "default", "y", 0, "apples apples pears"), (8, "other", "", 0, "pears"), (7, "default", "", 2, "apples")], docs.schema)
    q = spark.createDataFrame([(1, "apples pears")], "query_id int, text string")

    def run(d):
        seen = acl.visible(d, "default", ["x"], 1)
        c = seen.select(F.col("doc_id").alias("chunk_id"), "content")
        return sorted(tuple(r) for r in bm25.scores(c, q).collect()), bm25.coverage(c, q).first().idf_coverage

    assert run(docs) == run(docs.unionByName(hidden))


def test_views_share_a_right(spark):
    docs = spark.createDataFrame([(1, "t", "", 0), (2, "t", "a", 1)], "doc_id int, tenant_id string, department string, classification int")
    who = spark.createDataFrame([("p", "t", ["b", "a"], 1), ("q", "t", ["a", "b", "a"], 1), ("r", "t", [], 0)], "identity_id string, tenant string, departments array<string>, clearance int")
    seen, names = acl.views(docs, who)
    assert names.select("view_id").distinct().count() == 2 and seen.count() == 3


def test_file_rights(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    e = spark.createDataFrame([(1, "t", "a", 1), (2, None, None, None)], "doc_id int, tenant string, department string, classification int")
    ids = lambda **k: {r.doc_id for r in acl.visible_by_file(docs, e, "t", ["a"], 1, **k).collect()}
    assert ids(strict=False) == {1, 2, 3} and ids(strict=True) == {1, 2} and ids(strict=False, default={"classification": 2}) == {1, 2}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [1.0])], "chunk_id int, vector array<float>")
    q = spark.createDataFrame([(1, [0.6, 0.8])], "query_id int, vector array<float>")
    unit = df.withColumn("vector", dense.normalise(F.col("vector")))
    assert {r.chunk_id: round(r.cosine, 6) for r in dense.cosine_scores(unit, q).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    s = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "sentence_id int, vector array<float>")
    scopes = spark.createDataFrame([(1, 1), (1, 2)], "sentence_id int, chunk_id int")
    assert {r.sentence_id: round(r.semantic, 4) for r in dense.best_in_scope(s, scopes, unit).collect()} == {1: 0.6, 2: 0.0}


def test_signals_of_variants(spark):
    s = spark.createDataFrame([(1, 0.5, None, 2.0), (1, 0.4, 0.1, 3.0)], "query_id int, max_cosine double, cos_gap double, max_bm25 double")
    r = dense.best_signals(s).withColumn("fired", dense.fired_signals()).first()
    assert (r.max_cosine, r.cos_gap, r.max_bm25, r.fired) == (0.5, 0.1, 3.0, ["max_cosine=0.5000"])


def test_index_operations(spark):
    chunks = spark.createDataFrame([("a", "h1", "x"), ("b", "h1", "x"), ("c", "h2", "y")], "chunk_id string, content_hash string, content string")
    cache = spark.createDataFrame([("h1", "m", "p", [1.0]), ("h2", "other", "p", [1.0])], "content_hash string, model string, scheme string, vector array<float>")
    vectors, fresh, counts = index.reuse_vectors(chunks, cache, dense.hashed_embedder(8), "m", "p")
    assert tuple(counts.first()) == (2, 1, 1) and vectors.count() == 3 and [r.content_hash for r in fresh.collect()] == ["h2"]
    docs = spark.createDataFrame([("1", "report one.md"), ("2", "Report two.md"), ("3", "3"), ("report one.md", "z")], "doc_id string, doc_name string")
    names = spark.createDataFrame([("report one.md",), ("3",), ("TWO",), ("report",), ("?",)], "reference string")
    assert {r.reference: r.doc_id for r in index.resolve_reference(names, docs).collect()} == {"report one.md": "1", "3": "3", "TWO": "2", "report": None, "?": None}
    with pytest.raises(ValueError, match="h2"):
        index.assert_consistent(chunks, cache.where("model = 'm'"), "content_hash", "vector")
    versions = spark.createDataFrame([("v1", "ready", 1, 1), ("v2", "building", 2, None)], "version string, state string, created_at int, activated_at int")
    now = index.activate(versions, "v2", F.lit(9))
    assert {(r.version, r.state) for r in now.collect()} == {("v1", "stale"), ("v2", "ready")}
    with pytest.raises(ValueError):
        index.collect_garbage(now, chunks.withColumn("index_version", F.lit("v2")), "v2")
    assert index.collect_garbage(now, chunks.withColumn("index_version", F.lit("v1")), "v1")[1] == 3


def test_rewrites(spark):
    raw = "1. “first rewrite”\n- First, rewrite!\n* original question\n• second one——because\n\n" + "x" * 41 + "\n③ third\n4) fourth"
    df = spark.createDataFrame([(1, "Original question?", raw)], "query_id int, question string, raw string")
    assert [r.text for r in evidence.parse_rewrites(df).orderBy("variant_no").collect()] == ["first rewrite", "second one", "third"]


def test_labels(spark):
    df = spark.createDataFrame([("a.md", ["x", None, "y", None], 1, 1), ("", [None], 2, 3)], "n string, h array<string>, s int, e int")
    got = [r.l for r in df.select(evidence.citation_label(F.col("n"), F.col("h"), F.col("s"), F.col("e")).alias("l")).collect()]
    assert got == ["a.md · y · P1", "未命名文档 · 正文 · P2-3"]


def test_prompt_snapshot_and_merge(spark):
    p = spark.createDataFrame([(1, 2, "L2", "two", ["c2"], "two"), (1, 1, "L1", "one", ["c1"], "one")], "query_id int, index int, label string, text string, chunk_ids array<string>, content string")
    q = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, question string")
    out = {r.query_id: r.prompt for r in evidence.prompt(q, evidence.prompt_context(p)).collect()}
    assert "[1] L1\none\n\n[2] L2\ntwo" in out[1] and evidence.NO_EVIDENCE in out[2] and out[1].endswith("why?<|im_end|>\n<|im_start|>assistant\n")
    assert '"top_k":5' in evidence.snapshot(p, {"top_k": 5}, "v1").first().snapshot
    parts = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 1, 1)], "run_id int, search_no int, index int")
    assert [(r.search_no, r["index"]) for r in evidence.merge_evidence(parts).orderBy("merged_index").collect()] == [(1, 1), (1, 2), (2, 1)]


def test_scores_move_no_pairs_and_best_keeps_ties(spark, monkeypatch):
    texts = ["red fox", "red fox", "blue fox fox", "red", None, "", "blue red fox 中文", "fox"] * 6
    c = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").repartition(3)
    q = spark.createDataFrame([(1, "red fox"), (2, "blue 中文"), (3, "owl"), (4, "")], "query_id int, text string")
    want = sorted(tuple(r) for r in bm25.joined_scores(c, q, digits=6).collect())
    found = bm25.scores(c, q, digits=6)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "").replace("Exchange RoundRobinPartitioning(3)", "")
    monkeypatch.setattr(bm25, "HELD", 10)
    order = lambda rows, i: sorted((-s, k) for n, k, s in rows if n == i)
    few, kinds = ([tuple(r) for r in bm25.best(c, q, 2, 6, kinds=x).collect()] for x in (False, True))
    for i in (1, 2, 3, 4):
        assert order(few, i)[:2] == order(want, i)[:2]
        scores = sorted({s for n, _, s in want if n == i}, reverse=True)[:2]
        assert [r for r in order(want, i) if -r[0] in scores] == [r for r in order(kinds, i) if -r[0] in scores]
    assert len(few) < len(kinds) < len(want)


@pytest.mark.parametrize("name", ["evidence_context", "extractive_answer", "answer_scores", "redundancy_pairs", "window_dedupe", "recall_at_k", "wider_retrieval", "rerank_metrics"])
def test_first_hits_join_no_pairs(name, spark, sf_dir, monkeypatch):
    from corpusloom.plans import registry

    def refuse(*_, **__):
        raise AssertionError("pairs are joined")

    monkeypatch.setattr(bm25, "joined_scores", refuse)
    monkeypatch.setattr(bm25, "scores", refuse)  # all pairs
    assert registry.QUERIES[name](spark, sf_dir).limit(1).count() == 1
