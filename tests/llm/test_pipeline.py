import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import mixing, pieces


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "mixture", "pieces"]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "pieces":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts[0] == 200 and counts[1] < 200 and counts[2] == counts[1] and counts[3] == counts[4]


def test_run_equals_its_stages_by_hand(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    p = pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    import pyarrow as pa

    ids, at, _ = p.encode(pa.array(out.text.tolist()))
    assert all(list(ids[s:e]) == list(x) for s, e, x in zip(at[:-1], at[1:], out.ids, strict=True))
    assert (out.n_chars == out.text.str.len()).all() and not out.text.str.contains(r"@mail\d").any()


def test_strange_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "123", None, None, 3), (4, "words of a text, bob@example.com", "en", None, 9), (4, "words of a text, bob@example.com", "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copies", F.lit("own"))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r.doc_id for r in docs.collect()} <= {4} and all(r.copies == "own" for r in docs.collect())
    assert mixing.WORD
