import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common


def test_slices_and_buffers():
    col = pa.array(["aa", None, "bbb" * 10, "", "é", "x"] * 3)
    batch = pa.RecordBatch.from_arrays([col], names=["t"])
    parts = list(common.slices([batch, batch.slice(0, 0)], 0, 8))
    assert [v for p in parts for v in p.column(0).to_pylist()] == col.to_pylist() and max(p.num_rows for p in parts) < 6
    for p in parts:
        data, at = common.buffers(p.column(0))
        assert [data[s:e].tobytes().decode() for s, e in zip(at[:-1], at[1:], strict=True)] == [v or "" for v in p.column(0).to_pylist()]


def test_ranges(spark):
    df = spark.range(0, 1000, 3).withColumn("id", F.when(F.col("id") == 0, None).otherwise(F.col("id")))
    bounds = common.ranges(df, F.col("id"), 5)
    assert sum(n for *_, n in bounds) == 334 and bounds[0][0] == common.NULL_ID
    rows = df.withColumn("r", common.range_number(bounds, F.col("id"))).collect()
    for r in rows:
        lo, hi, _ = bounds[r.r]
        assert lo <= (common.NULL_ID if r.id is None else r.id) <= hi
    assert common.ranges(df.limit(0), F.col("id"), 5) == []


@pytest.mark.parametrize("most", [0, 100])
def test_attach(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i % 2}") for i in range(60)], "id int, k string")
    small = spark.createDataFrame([(None, 1), ("k1", 2)], "k string, v int")
    got = {(r.id, r.v) for r in common.attach(df, small, "k", F.col("id")).collect()}
    assert got == {(i, 1 if i % 3 == 0 else 2 if i % 2 else None) for i in range(60)}


def test_staged_reads_what_was_written(spark):
    df = spark.createDataFrame([(1, ["a"], b"x")], "i int, l array<string>, b binary")
    assert common.staged(df, "t").collect() == df.collect()
    assert common.staged(df.limit(0), "t").schema.names == df.columns


def test_set_aside(spark):
    df = spark.createDataFrame([(1, 2)], "a int, score int")
    safe, own = common.set_aside(df, ("score",))
    assert safe.withColumn("score", F.lit(9)).select(*own).first().asDict() == {"a": 1, "score": 2}


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_attach_counted(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i % 4}") for i in range(60)], "id int, k string")
    table = df.where("k IS NOT NULL AND k <> 'k2'").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v"))
    got = {(r.id, r.k, r.v) for r in common.attach_counted(df, table, "k", "n").select("id", "k", "v").collect()}
    least = {f"k{i % 4}": i for i in range(59, -1, -1) if i % 3}
    assert got == {(i, None if i % 3 == 0 else f"k{i % 4}", None if i % 3 == 0 or i % 4 == 2 else least[f"k{i % 4}"]) for i in range(60)}
