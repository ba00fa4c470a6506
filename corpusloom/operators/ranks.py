"""RNK1, EVL13, CAL3: exact places in an order, without one task a key.

Rows are dealt by ranges of (key, score), so a key with all rows is spread over all tasks. Each task numbers its rows
where they lie; one row a task and key says how many there are and where the last score began, and running sums over
those few rows give every task its offset. Equal scores may lie on both sides of an end: the later part takes the place
at which the earlier one began.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.shared import bounded, staged

#: Rows, over all keys, up to which one window task a key is quicker than two passes.
FEW_ROWS = 1 << 22


def _numbered(keys: int, score: int):
    """Rows of one range in their order, with the range and places within (range, key): of the row, and of the first row of its score."""

    def run(batches):
        part, before, place, tie = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            coded = [b.column(i).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for i in (*range(keys), score)]
            first = tuple(b.column(i)[0].as_py() for i in (*range(keys), score))
            new_key, new_score = np.ones(n, bool), np.ones(n, bool)
            new_key[1:] = np.logical_or.reduce([np.diff(c) != 0 for c in coded[:-1]]) if keys else False
            new_score[1:] = new_key[1:] | (np.diff(coded[-1]) != 0)
            new_key[0] = before is None or before[:-1] != first[:-1]
            new_score[0] = new_key[0] or before[-1] != first[-1]
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new_key, at, -1))
            places = np.where(start < 0, at + place, at - start)
            lead = np.maximum.accumulate(np.where(new_score, at, -1))
            ties = np.where(lead < 0, tie, places[np.maximum(lead, 0)])
            before, place, tie = tuple(b.column(i)[n - 1].as_py() for i in (*range(keys), score)), int(places[-1]) + 1, int(ties[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(places), pa.array(ties)], names=[*b.schema.names, "_part", "_place", "_tie"])

    return run


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & a[c].eqNullSafe(b[f"_{c}_"])
    return out


def places(rows: DataFrame, by: list[str], score: str, descending: bool = True, then: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """rows with _row (1, 2, ... by score, then by the columns `then`), _rank (1 + rows of better score) and _n, all within `by`."""
    spark = rows.sparkSession
    own = [c for c in rows.columns if c not in (*by, score)]
    order = [F.desc(score) if descending else F.asc(score), *then]
    src = staged(rows.select(*by, score, *own), "ranked")  # ranges are sampled first
    dealt = src.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order).sortWithinPartitions(*by, *order)
    schema = ", ".join(f"`{n}` {t}" for n, t in src.dtypes) + ", _part int, _place long, _tie long"
    marked = staged(dealt.mapInArrow(_numbered(len(by), len(by)), schema), "ranges")
    ends = marked.groupBy(*by, "_part").agg(F.count("*").alias("_rows"), F.max(F.when(F.col("_place") == 0, F.col(score))).alias("_first"), F.max_by(score, "_place").alias("_last"), F.max("_tie").alias("_last_tie"))
    key = Window.partitionBy(*by)
    ends = staged(ends.withColumn("_before", F.coalesce(F.sum("_rows").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_rows").over(key)), "range-ends")
    began = ends.groupBy(*[F.col(c).alias(f"_{c}_") for c in by], F.col("_last").alias("_score")).agg(F.min(F.col("_before") + F.col("_last_tie")).alias("_began"))
    ends = ends.join(began, _same(ends, began, by) & ends["_first"].eqNullSafe(began["_score"]), "left").select(*[F.col(c).alias(f"_{c}_") for c in by], F.col("_part").alias("_of"), "_before", "_n", F.coalesce("_began", "_before").alias("_began"))
    ends = bounded(staged(ends, "offsets"))
    out = marked.join(ends, _same(marked, ends, by) & (marked["_part"] == ends["_of"]))
    rank = F.when(F.col("_tie") == 0, F.least("_began", "_before")).otherwise(F.col("_before") + F.col("_tie")) + 1
    return out.select(*[marked[c] for c in rows.columns], (F.col("_before") + F.col("_place") + 1).alias("_row"), rank.alias("_rank"), "_n")


def ranked(rows: DataFrame, by: tuple[str, ...], score: str, name: str) -> DataFrame:
    """RNK1: rows with their competition rank by descending score. The rows are counted: few go by a window, many by places()."""
    rows = staged(rows, "scored")
    if rows.count() <= FEW_ROWS:
        return rows.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score))))
    return places(rows, list(by), score).withColumn(name, F.col("_rank").cast("int")).drop("_row", "_rank", "_n")


def nearest_ranks(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """EVL13: for each key the values at the nearest ranks of the shares, one column each."""
    at = places(rows.select(*by, value), by, value, descending=False)
    own = lambda p: F.greatest(F.lit(1), F.least(F.col("_n"), F.bround(F.lit(p) * F.col("_n") + 0.5).cast("long")))
    return at.groupBy(*by).agg(*[F.max(F.when(F.col("_row") == own(p), F.col(value))).alias(name) for name, p in shares.items()])
