"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from corpusloom.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = registry.QUERIES[name](spark, sf_dir)
    if name not in registry.ORACLE_SQL:
        # no SQL: some rows, and the same ones however they are dealt
        have = rows(got.toPandas())
        assert have[1]
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        try:
            assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == have
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        return
    have, want = rows(got.toPandas()), rows(duck.sql(registry.ORACLE_SQL[name]).df())
    assert have[0] == want[0]
    assert len(have[1]) == len(want[1])
    wrong = [(a, b) for a, b in zip(have[1], want[1], strict=True) if a != b]
    assert not wrong, wrong[:3]


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
