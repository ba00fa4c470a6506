import base64
import json
import struct

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import registry
from corpusloom.sources import backups, documents
from corpusloom.streaming import jobs, runs


def test_directory(spark, tmp_path):
    (tmp_path / "b.md").write_text("# T\ntext", "utf-8")
    (tmp_path / "a.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.bin").write_bytes(b"x")
    rows = documents.read_directory(spark, str(tmp_path), most=1000)
    good, bad = documents.split_quarantine(rows)
    assert [(r.doc_name, r.text) for r in good.collect()] == [("b.md", "# T\ntext")] and [r.error for r in bad.collect()] == ["not UTF-8"]
    assert documents.split_quarantine(documents.read_directory(spark, str(tmp_path), most=3))[1].count() == 2


def test_json_sets(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"queries": [{"id": "q1", "question": "x", "relevant": ["r"]}, {"id": "n1", "question": "y", "negative": True}]}))
    got = documents.read_golden(spark, str(tmp_path / "g.json")).orderBy("query_id").collect()
    assert [(r.query_id, r.grp, r.negative, r.relevant, r.key_points) for r in got] == [("n1", "n", True, [], []), ("q1", "q", False, ["r"], [])]
    (tmp_path / "v.json").write_text(json.dumps({"chunks": {"a": [1, 2.5]}, "expansions": {"q1": ["x", "y"]}}))
    assert documents.read_vectors(spark, str(tmp_path / "v.json"), "chunks").first().vector == [1.0, 2.5]
    assert [tuple(r) for r in documents.read_rewrites(spark, str(tmp_path / "v.json")).orderBy("variant_no").collect()] == [("q1", 1, "x"), ("q1", 2, "y")]


def test_vectors(spark):
    good = base64.b64encode(struct.pack("<2f", 1.5, -2)).decode()
    df = spark.createDataFrame([(good,), ("",), (None,), (base64.b64encode(b"abc").decode(),), ("!!",)], "t string")
    assert [r.v for r in df.select(backups.decode_vector("t").alias("v")).collect()] == [[1.5, -2.0], None, None, None, None]


def backup(version):
    chunks = [{"chunkId": "a", "content": "x"}, {"chunkId": "b", "content": "y", "prevId": "zz"}]
    return {"version": version, "conversations": [{"id": "c", "messages": [{"id": "m", "role": "user", "content": "hi"}]}, {"id": "empty"}], "vectorIndexes": [{"convId": "c", "chunks": chunks}]}


def test_backup(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps(backup("1.0")))
    (tmp_path / "2.json").write_text(json.dumps(backup("2.0")))
    (tmp_path / "3.json").write_text(json.dumps(backup("9")))
    conv, chunks = backups.read_backup(spark, str(tmp_path / "1.json"))
    assert [(r.chunk_id, r.ord, r.prev_id, r.next_id, r.page_start) for r in chunks.orderBy("ord").collect()] == [("a", 0, "", "b", 1), ("b", 1, "a", "", 1)]
    assert [r.prev_id for r in backups.read_backup(spark, str(tmp_path / "2.json"))[1].orderBy("ord").collect()] == ["", "zz"]
    with pytest.raises(ValueError, match="9"):
        backups.read_backup(spark, str(tmp_path / "3.json"))
    backups.write_backup(conv, chunks, str(tmp_path / "out"))
    again, held = backups.read_backup(spark, str(tmp_path / "out"), lines=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, conv.collect())) and {r.conv_id for r in again.collect()} == {"c", "empty"}
    assert sorted(map(str, held.collect())) == sorted(map(str, chunks.collect()))


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "v1", "a"), (2, "v1", "b")], "k int, index_version string, x string")
    assert {tuple(r) for r in backups.upsert(t, t.where("k = 2").withColumn("x", F.lit("c")), ["k"]).collect()} == {(1, "v1", "a"), (2, "v1", "c")}
    backups.write_index(t, str(tmp_path / "i"))
    assert (tmp_path / "i" / "index_version=v1").is_dir()
    backups.append_audit(t, str(tmp_path / "log"))
    backups.append_audit(t, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_ingest_goes_on_and_skips(spark, tmp_path):
    src, out, cp = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp")
    make = lambda rows: spark.createDataFrame(rows, "doc_name string, text string").coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema("doc_name string, text string").parquet(src)
    make([("a.md", "first text; and more"), ("b.md", "other")])
    jobs.ingest(read(), out, "v1", cp).awaitTermination()
    make([("a.md", "first text; and more"), ("b.md", "changed")])
    jobs.ingest(read(), out, "v1", cp).awaitTermination()
    got = {r.content for r in jobs.latest_chunks(spark, out).collect()}
    assert got == {"first text; and more", "changed"}
    assert spark.read.parquet(f"{out}/catalogue").count() == 3


def test_once_by_key(spark, tmp_path):
    rows = [("a", "h", "2024-01-01 00:00:00")] * 3 + [("a", "i", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "doc_id string, content_hash string, at string").selectExpr("doc_id", "content_hash", "timestamp(at) AS arrived_at").write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema("doc_id string, content_hash string, arrived_at timestamp").parquet(str(tmp_path / "s"))
    assert runs.to_table(jobs.first_of_key(s), "append").count() == 2


def test_running_frequencies(spark, tmp_path):
    spark.createDataFrame([("a", "x y x"), ("b", "x")], "chunk_id string, content string").write.parquet(str(tmp_path / "c"))
    s = spark.readStream.schema("chunk_id string, content string").parquet(str(tmp_path / "c"))
    assert {tuple(r) for r in runs.to_table(jobs.running_frequencies(s), "complete").collect()} == {("x", 2), ("y", 1)}


def test_audit_stream(spark, tmp_path):
    spark.createDataFrame([("a",)], "e string").write.parquet(str(tmp_path / "e"))
    for _ in range(2):
        jobs.append_audit(spark.readStream.schema("e string").parquet(str(tmp_path / "e")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 1


def test_large_conversations_are_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backups, "PART_CHUNKS", 10)
    conv = spark.createDataFrame([("a", "t"), ("b", "u"), ("c", "v")], "conv_id string, title string")
    rows = [("a", f"a{i}", None if i >= 95 else i, [float(i)]) for i in range(100)] + [("b", "b0", 0, [1.0]), ("lost", "x", 0, [2.0])]
    chunks = spark.createDataFrame(rows, "conv_id string, chunk_id string, ord int, vector array<float>")
    backups.write_backup(conv, chunks, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).agg({"value": "count"}).first()[0] > 5
    again, held = backups.read_backup(spark, str(tmp_path / "out"), lines=True)
    assert sorted((r.conv_id, r.title) for r in again.collect()) == [("a", "t"), ("b", "u"), ("c", "v")]
    want = sorted((c, k, i if o is None else o, v) for c, k, o, v, i in ((*r, n - 95) for n, r in enumerate(rows)) if c != "lost")
    assert sorted((r.conv_id, r.chunk_id, r.ord, r.vector) for r in held.collect()) == want


def test_stream_ingest_keeps_documents_without_chunks(spark, tmp_path):
    import duckdb

    texts = ["", "plain text", "changed before", None, "<p>", "  ", "changed", "\n\n", None, "", "a. b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL["stream_ingest"]).fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["stream_ingest"](spark, str(tmp_path)).collect()) == sorted(want)
