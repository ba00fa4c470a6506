"""What stands on disk or in a stream's state: postings with bounds, replaced index rows, streaming ingest; and containment by index."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.hashing import LONG, OFFSET, PRIME, fnv_of
from corpusloom.operators import bm25, bm25_index, dense, evaluate, index
from corpusloom.sources import backups, documents
from corpusloom.streaming import jobs, runs

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark, n, seed=1, first=0):
    rng = random.Random(seed)
    rows = [(first + i, " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(0, 40)))) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, content string").repartition(4)


def plain_top(spark, c, q, k):
    rows = sorted(((r.query_id, -r.bm25, r.chunk_id) for r in bm25.scores(c, q, digits=6).collect()))
    out = {}
    for query, score, chunk in rows:
        out.setdefault(query, []).append((chunk, -score))
    return {query: v[:k] for query, v in out.items()}


@pytest.mark.parametrize("k", [1, 4])
def test_standing_index_gives_the_exact_best(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(bm25_index, "FIRST", 1)
    q = spark.createDataFrame([(1, "w0 w1"), (2, "w40 w50 w59"), (3, "w7"), (4, "nothing"), (5, "w0 w55 W1"), (6, "")], "query_id int, text string")
    old, new = corpus(spark, 300), corpus(spark, 120, 2, 300)
    bm25_index.add_batch(old, str(tmp_path), 0, blocks=40)
    got = lambda: {q: [(c, s) for _, c, s in sorted(v)] for q, v in grouped(bm25_index.top_k(spark, str(tmp_path), queries, k, 6)).items()}
    queries = q

    def grouped(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.bm25))
        return out

    assert got() == plain_top(spark, old, q, k)
    bm25_index.add_batch(new, str(tmp_path), 1, blocks=40)
    whole = old.unionByName(new)
    assert got() == plain_top(spark, whole, q, k)
    n, mean = bm25_index.totals(spark, str(tmp_path)).first()
    want = bm25.totals(whole).first()
    assert n == 420 and mean == pytest.approx(want.avg_length)
    assert sorted(map(tuple, bm25_index.frequencies(spark, str(tmp_path)).collect())) == sorted(map(tuple, bm25.document_frequencies(bm25.postings(whole)).collect()))


@pytest.mark.parametrize("terms", [200_000, 1])
def test_index_blocks_are_packed_and_scored_whole(spark, tmp_path, monkeypatch, terms):
    """A block and term is one row, a chunk is in one block; pairs are summed in the block's task, or by joins for very many terms. Rows are exact."""
    monkeypatch.setattr(bm25_index, "BLOCK", 16)
    monkeypatch.setattr(bm25_index, "FIRST", 2)
    monkeypatch.setattr(bm25, "BATCH_TERMS", terms)
    monkeypatch.setattr(bm25, "PAIRS", 20)
    c, q = corpus(spark, 150), spark.createDataFrame([(1, "w0 w1 w9"), (2, "w3 w50"), (3, "nothing")], "query_id int, text string")
    for i in (0, 1):
        bm25_index.add_batch(c.where(F.col("chunk_id") % 2 == i), str(tmp_path), i)
    held = spark.read.parquet(f"{tmp_path}/postings")
    assert held.count() == held.select("block", "term").distinct().count() > 100
    own = held.select("block", F.explode("chunks").alias("c")).distinct()
    assert own.count() == own.select("c").distinct().count() and own.groupBy("block").count().agg(F.max("count")).first()[0] <= 16
    top = bm25_index.top_k(spark, str(tmp_path), q, 4, 6)
    got = {}
    for r in sorted(top.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.chunk_id, r.bm25))
    assert got == plain_top(spark, c, q, 4)
    assert ("FlatMapCoGroups" in top._jdf.queryExecution().executedPlan().toString()) == (terms > 1)


def test_a_batch_without_totals_does_not_count(spark, tmp_path, monkeypatch):
    c = corpus(spark, 50)
    bm25_index.add_batch(c, str(tmp_path), 0)
    before = sorted(map(tuple, bm25_index.frequencies(spark, str(tmp_path)).collect()))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(bm25, "lengths", fail)
        with pytest.raises(OSError, match="lost"):
            bm25_index.add_batch(corpus(spark, 50, 3, 50), str(tmp_path), 1)
    assert sorted(map(tuple, bm25_index.frequencies(spark, str(tmp_path)).collect())) == before and bm25_index.batches(spark, str(tmp_path)) == [0]
    bm25_index.add_batch(corpus(spark, 50, 3, 50), str(tmp_path), 1)
    assert bm25_index.batches(spark, str(tmp_path)) == [0, 1] and bm25_index.totals(spark, str(tmp_path)).first().n == 100


def test_replacing_rows_on_disk(spark, tmp_path, monkeypatch):
    path, schema = f"file://{tmp_path}/index", "doc_id long, index_version string, x string"
    rows = lambda a, b, v, x: spark.createDataFrame([(i, v, x) for i in range(a, b)], schema)
    held = lambda: sorted(map(tuple, backups.read_index(spark, path, schema).collect()))
    assert held() == []
    backups.replace_index(rows(0, 100, "v1", "a").unionByName(rows(0, 10, "v2", "a")), path)
    first = held()
    assert len(first) == 110
    whole = spark.read.parquet(f"{path}/data").count()
    backups.replace_index(rows(5, 8, "v1", "b"), path)
    second = held()
    assert second == sorted([(i, "v1", "b" if 5 <= i < 8 else "a") for i in range(100)] + [(i, "v2", "a") for i in range(10)])
    assert spark.read.parquet(f"{path}/data").count() < 2 * whole  # parts without such keys stay as they are
    # a write that stops before the manifest changes nothing, and the next one takes its place
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet

    def broken(self, to, *args, **kwargs):
        if "/manifest/" in to:
            raise OSError("lost")
        return write(self, to, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", broken)
        with pytest.raises(OSError, match="lost"):
            backups.replace_index(rows(0, 50, "v1", "c"), path)
    assert held() == second
    backups.replace_index(rows(20, 21, "v1", "d").unionByName(rows(500, 501, "v3", "n")), path)
    assert held() == sorted([(500, "v3", "n"), *[(i, v, "d" if i == 20 and v == "v1" else x) for i, v, x in second]])


def test_ingest_keeps_state_replaces_and_reuses_vectors(spark, tmp_path):
    src, out, cp = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp")
    made = []

    def run(rows):
        spark.createDataFrame(rows, "doc_name string, text string, seq long").coalesce(1).write.mode("append").parquet(src)
        jobs.ingest(spark.readStream.schema("doc_name string, text string, seq long").parquet(src), out, "v1", cp, embed=dense.hashed_embedder(4), model="m", scheme="p").awaitTermination()
        made.append(spark.read.parquet(f"{out}/vectors").count())
        return {r.content for r in jobs.latest_chunks(spark, out).collect()}

    assert run([("a.md", "first text", 1), ("b.md", "other", 1), ("b.md", "other, newer", 2)]) == {"first text", "other, newer"}
    # b turns into a's text: no new vector; an older row of a is left out; c holds a text of its own
    assert run([("b.md", "first text", 3), ("a.md", "late", 0), ("c.md", "third", 1)]) == {"first text", "third"}
    assert run([("a.md", "first text", 5)]) == {"first text", "third"}
    assert made == [2, 3, 3]
    assert spark.read.parquet(f"{out}/catalogue").count() == 4
    vectors, chunks = jobs.latest_vectors(spark, out), jobs.latest_chunks(spark, out)
    assert vectors.count() == chunks.count() == 3
    names = chunks.join(spark.read.parquet(f"{out}/catalogue").select("doc_id", "doc_name").distinct(), "doc_id")
    assert {(r.doc_name, r.content) for r in names.collect()} == {("a.md", "first text"), ("b.md", "first text"), ("c.md", "third")}


def test_running_totals_equal_the_batch_ones(spark, tmp_path):
    c = corpus(spark, 80)
    c.repartition(3).write.parquet(str(tmp_path / "c"))
    s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
    jobs.standing_index(s, str(tmp_path / "i"), str(tmp_path / "cp")).awaitTermination()
    assert len(bm25_index.batches(spark, str(tmp_path / "i"))) == 3
    assert tuple(bm25_index.totals(spark, str(tmp_path / "i")).first()) == pytest.approx(tuple(bm25.totals(c).first()))
    assert sorted(map(tuple, bm25_index.frequencies(spark, str(tmp_path / "i")).collect())) == sorted(map(tuple, bm25.document_frequencies(bm25.postings(c)).collect()))


def test_live_statistics_have_the_last_value(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:01", 5.0), ("a", "2024-01-01 00:00:03", 1.0), ("a", "2024-01-01 00:00:02", 9.0)]
    spark.createDataFrame(rows, "stage string, at string, duration double").selectExpr("stage", "timestamp(at) AS ts", "duration").write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema("stage string, ts timestamp, duration double").parquet(str(tmp_path / "s"))
    r = runs.to_table(jobs.live_stage_stats(s), "complete").first()
    assert (r["count"], r.total, r["last"]) == (3, 15.0, 1.0)


def test_containment_by_index(spark, monkeypatch):
    rng = random.Random(3)
    names = [f"{''.join(rng.choices('aBc.', k=rng.randint(1, 8)))}{i}.md" for i in range(150)]
    refs = sorted({n[rng.randrange(len(n)) :][: rng.randint(1, 6)].swapcase() for n in names * 2} | {".md", "zzz", "", "é"})
    d = spark.createDataFrame([(f"d{i}", n) for i, n in enumerate(names)], "doc_id string, doc_name string")
    got = {r.reference: (r.n, r.doc_id) for r in index.names_holding(spark.createDataFrame([(r,) for r in refs], "reference string"), d).collect()}
    want = {}
    for r in refs:
        held = [f"d{i}" for i, n in enumerate(names) if r and r.lower() in n.lower()]
        if held:
            want[r] = (len(held), min(held))
    assert got == want
    docs = spark.createDataFrame([(i, n) for i, n in enumerate([*names, None, ""])], "doc_id int, content string")
    golden = spark.createDataFrame([(1, ["aB", "c."]), (2, []), (3, ["no such thing"]), (4, [""]), (5, ["aB"])], "query_id int, relevant array<string>")
    for most in (50_000, 1):
        monkeypatch.setattr(evaluate, "PATTERNS", most)
        gold = {(r.query_id, r.doc_id) for r in evaluate.gold_documents(docs, golden).collect()}
        assert gold == {(q, i) for q, rs in ((1, ["aB", "c."]), (3, ["no such thing"]), (4, [""]), (5, ["aB"])) for i, n in enumerate([*names, None, ""]) if n is not None and any(r in n for r in rs)}
    one = evaluate.Patterns(["ab", "b", ""])
    one.machine = None
    assert one.found("xab") == [0, 1, 2]


def test_suffixes_of_any_case(spark, tmp_path):
    for name in ("a.md", "B.MD", "c.Txt", "d.exe"):
        (tmp_path / name).write_text(name)
    assert {(r.doc_name, r.suffix) for r in documents.read_directory(spark, str(tmp_path)).collect()} == {("a.md", "md"), ("B.MD", "md"), ("c.Txt", "txt")}


def test_hash_of_long_texts():
    def slow(t):
        h = OFFSET
        raw = t.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ (raw[i] | raw[i + 1] << 8)) * PRIME) & 0xFFFFFFFF
        return f"{h:08x}"

    texts = ["", "a", "x" * (LONG - 1), "é🎉" * LONG, "y" * LONG, "z" * (LONG + 1)]
    assert fnv_of(texts) == [slow(t) for t in texts]
    began = time.perf_counter()
    fnv_of(["q" * 3_000_000, "short"])
    assert time.perf_counter() - began < 5
