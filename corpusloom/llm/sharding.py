"""Sharding by longest-processing-time scheduling: groups of equal texts stay together, sizes come out near equal.

Groups are sorted by size and each goes to the least-loaded shard, through a heap. Groups of one size are
interchangeable, so the heap needs only how many groups each size has: the sizes of all groups sum up to the table's
bytes B, so that there are at most sqrt(2 B) different ones (14 million at 100 TB), and those go to the driver. A size
with many groups is dealt in one step, to the loads that the heap would reach, and each of its groups gets its shard by
its rank within the size. The schedule is the one of all groups, at any scale.

Defined cases: a null text counts as empty, of size 1; rows that repeat an id are rows of their own; an empty table
gives an empty one; extra columns pass through the assignment unseen. Two different texts with one hash share a group,
which is harmless. A group larger than a shard's share makes that shard the largest, as nothing may split it.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import attach, attach_counted, partitions, staged, text_of

SHARDS = 8
#: Groups of one size that are ranked in one task.
RANKED = 50_000


def longest_first(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """sizes: (size, number of groups). How many groups of each size every shard takes.

    A shard's groups of one size would be popped at loads a step of the size apart. So all shards take what lies below
    a common load, which leaves less than one group a shard, and the heap deals the rest.
    """
    loads = [0] * shards
    taken = {}
    for size, n in sorted(sizes, reverse=True):

        def below(level: int) -> list[int]:
            return [max(0, -(-(level - x) // size)) for x in loads]

        low = min(loads)
        level = low + bisect_left(range(size * n + max(loads) - low + 2), True, key=lambda t: sum(below(low + t)) > n) - 1
        got = below(level)
        heap = [(x + k * size, s) for s, (x, k) in enumerate(zip(loads, got, strict=True))]
        heapq.heapify(heap)
        for _ in range(n - sum(got)):
            load, s = heapq.heappop(heap)
            got[s] += 1
            heapq.heappush(heap, (load + size, s))
        loads = [x + k * size for x, k in zip(loads, got, strict=True)]
        taken[size] = got
    return taken


def group_shards(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """groups (key, a long; size; rows) with an int column shard. groups: a staged table with one row a key."""
    spark = groups.sparkSession
    counts = groups.groupBy("size").agg(F.count("*").alias("n"))
    taken = longest_first([(r["size"], r.n) for r in counts.collect()], shards)  # one row a size
    # ranks below these belong to shard 0, 1, ...; a size of many groups is ranked in buckets of its own
    quotas = spark.createDataFrame([(size, [sum(got[: s + 1]) for s in range(shards)], -(-sum(got) // RANKED)) for size, got in taken.items()], "size long, ends array<long>, buckets int")
    # few sizes are broadcast, many are met by salts; then all is dealt by size and bucket
    dealt = attach(groups, quotas, "size", F.col("key")).withColumn("_bucket", F.pmod(F.xxhash64("key"), F.col("buckets")).cast("int")).repartition("size", "_bucket")
    before = dealt.groupBy("size", "_bucket").count().withColumn("_base", F.sum("count").over(Window.partitionBy("size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("size", "_bucket").orderBy("key")) - 1
    ranked = dealt.withColumn("_place", place).join(before.drop("count"), ["size", "_bucket"]).withColumn("_rank", F.col("_place") + F.coalesce("_base", F.lit(0)))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("_rank")))
    return ranked.select("key", "rows", shard.cast("int").alias("shard"))


def assign_shards(rows: DataFrame, key: str, size: str, shards: int = SHARDS) -> DataFrame:
    """rows with an int column shard. rows: a staged table with a long group key and a size."""
    groups = staged(rows.groupBy(F.col(key).alias("key")).agg(F.sum(size).alias("size"), F.count("*").alias("rows")), "shard-groups")
    placed = staged(group_shards(groups, shards), "group-shards").withColumnRenamed("key", key)
    return attach_counted(rows, placed, key, "rows")


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with a long column slot, gapless from 0 in each shard: a place in its (shard, bucket) after the buckets before."""
    n = partitions(rows.sparkSession)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = rows.groupBy("shard", "_bucket").count().withColumn("_base", F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("count")  # shards * n rows at most
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*order))
    return rows.withColumn("_place", place).join(F.broadcast(before), ["shard", "_bucket"]).withColumn("slot", F.col("_place") - 1 + F.coalesce("_base", F.lit(0))).drop("_bucket", "_place", "_base")


def op10_lpt_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select("doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), F.xxhash64(text_of()).alias("group_key"))
    placed = with_slots(assign_shards(staged(slim, "shard-rows"), "group_key", "size"), ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
