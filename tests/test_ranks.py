"""Places over ranges against a plain window, signals by linearity, copies among near-duplicates."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import calibrate, dense, evaluate, ranks


def hot(spark, n=20_000):
    """One key with nearly all rows, one score with half of those, null scores and null keys."""
    key = F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), F.col("id") % 7)).when(F.col("id") % 997 == 1, F.lit(None)).otherwise("hot")
    score = F.when(F.col("id") % 2 == 0, 0.5).when(F.col("id") % 101 == 3, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(500)) / 500)
    return spark.range(0, n, 1, 5).select("id", key.alias("k"), score.cast("double").alias("s"))


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("parts", [1, 4, 13])
def test_places_against_a_window(spark, descending, parts):
    rows = hot(spark)
    order = F.desc("s") if descending else F.asc("s")
    key = Window.partitionBy("k")
    want = rows.select("id", F.row_number().over(key.orderBy(order, "id")).alias("row"), F.rank().over(key.orderBy(order)).alias("rank"), F.count("*").over(key).alias("n"))
    got = ranks.places(rows, ["k"], "s", descending, ("id",), parts)
    pick = lambda df, *c: sorted(map(tuple, df.select("id", *c).collect()))
    assert pick(got, "_row", "_rank", "_n") == pick(want, "row", "rank", "n")


def test_no_task_holds_the_hot_key(spark):
    sizes = [r.n for r in ranks.places(hot(spark), ["k"], "s", True, ("id",), 8).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 20_000 / 3


def test_ranked_either_way(spark, monkeypatch):
    rows = hot(spark, 3000).select(F.col("k").alias("query_id"), F.col("id").alias("chunk_id"), "s").where("s IS NOT NULL")
    few = sorted(map(tuple, ranks.ranked(rows, ("query_id",), "s", "r").collect()), key=repr)
    monkeypatch.setattr(ranks, "FEW_ROWS", 0)
    assert sorted(map(tuple, ranks.ranked(rows, ("query_id",), "s", "r").collect()), key=repr) == few
    assert ranks.ranked(rows.limit(0), ("query_id",), "s", "r").count() == 0


def test_percentiles_medians_and_folds_of_a_hot_key(spark):
    rng = np.random.default_rng(1)
    ms = rng.integers(0, 300, 5001).astype(float)
    df = spark.createDataFrame([("a", float(x)) for x in ms] + [("b", 7.0)], "stage string, ms double")
    got = {r.stage: r for r in evaluate.latency_summary(df, ["stage"]).collect()}
    s = np.sort(ms)
    assert (got["a"].p50, got["a"].p95, got["a"].max) == (s[round(0.5 * 5001 + 0.5) - 1], s[round(0.95 * 5001 + 0.5) - 1], s[-1]) and got["b"].p50 == got["b"].p95 == 7.0
    runs = spark.createDataFrame([("a", 1, x) for x in (5.0, 1.0, 9.0)] + [("a", 2, x) for x in (4.0, 8.0)], "stage string, query_id int, ms double")
    assert {(r.query_id, r.ms) for r in evaluate.query_medians(runs, ["stage"]).collect()} == {(1, 5.0), (2, 8.0)}
    samples = spark.createDataFrame([(i, i % 9 != 0) for i in range(900)], "id int, supported boolean")
    folds = {r.id: r.fold for r in calibrate.folds(samples, 4).collect()}
    for cls in (True, False):
        assert [folds[i] for i in range(900) if (i % 9 != 0) == cls] == [j % 4 for j in range(sum((i % 9 != 0) == cls for i in range(900)))]


def test_signals_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    vec = lambda n: rng.standard_normal(n).astype(np.float32).tolist()
    chunks = spark.createDataFrame([(i, vec(8) if i % 5 else (None if i % 2 else vec(4))) for i in range(60)], "chunk_id int, vector array<float>").repartition(4)
    queries = spark.createDataFrame([(i, vec(8)) for i in range(6)] + [(6, vec(4)), (7, None), (8, vec(3))], "query_id int, vector array<float>")
    bm25 = spark.createDataFrame([(0, 1, 2.5), (0, 2, 3.5)], "query_id int, chunk_id int, bm25 double")
    pairs = dense.cosine_scores(chunks, queries)
    want = {r.query_id: (round(r.max_cosine, 9), round(r.cos_gap, 9), r.max_bm25) for r in dense.refusal_signals(pairs.join(bm25, ["query_id", "chunk_id"], "left")).collect()}
    got = lambda: {r.query_id: (round(r.max_cosine, 9), round(r.cos_gap, 9), r.max_bm25) for r in dense.signals(chunks, queries, bm25).collect()}
    assert got() == want and len(want) == 9
    blocks = sorted((r.query_id, r.chunk_id, round(r.cosine, 9)) for r in dense.cosine_blocks(chunks, queries).collect())
    assert blocks == sorted((r.query_id, r.chunk_id, round(r.cosine, 9)) for r in pairs.collect())
    block, dense.QUERY_BLOCK = dense.QUERY_BLOCK, 2
    try:
        assert [len(m.ids) > 0 for m in dense.query_blocks(queries, 2)].count(True) > 1 and sum(len(m.ids) for m in dense.query_blocks(queries, 2)) == 9
    finally:
        dense.QUERY_BLOCK = block
    assert dense.signals(chunks.limit(0), queries).count() == 0


def test_exact_copies_are_near_duplicates(spark):
    texts = ["the same words here", "the same words here", "the same  words here", "the same words here", "other text altogether", "the same words hers", "x", None, "other text altogether"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")
    got = {(r.chunk_1, r.chunk_2): round(r.jaccard, 3) for r in evaluate.near_duplicate_chunks(df).collect()}
    assert {k for k, v in got.items() if v == 1.0} == {(0, 1), (0, 2), (0, 3), (4, 8)}
    assert (0, 5) in got and len(got) == 5
