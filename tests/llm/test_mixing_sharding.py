import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import common, mixing, sharding


def targets(sizes, weights=(5, 2, 1), epochs=1.5, most=2.0):
    """Shares by weight, capped again and again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, budget = set(), epochs * sum(sizes.values())
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return {**{s: most * sizes[s] for s in full}, **share}
        full |= over


def docs():
    return [(i, f"s{i % 7}" if i % 11 else None, None if i % 13 == 5 else "w " * ((i * 37) % 90)) for i in range(400)]


def test_targets_and_copies(spark):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    out = mixing.with_copies(df).withColumn("size", mixing.words()).collect()
    for r in out:
        rate = want[r.source] / sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        u = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.copies == int(rate + 1e-9) + (u < rate - int(rate + 1e-9)) and r.copies <= 2
    mixed = mixing.mix_sources(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)
    taken = defaultdict(int)
    for r in out:
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - want[s]) <= 0.35 * want[s] for s in want)


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, ""), (None, "a", "x y"), (2, "a", "x y")], "doc_id long, source string, text string")
    assert len(mixing.with_copies(df).collect()) == 4
    assert mixing.with_copies(df.limit(0)).count() == 0
    zero = mixing.with_copies(df.where("source IS NULL")).collect()
    assert all(r.copies == 0 and r.target == 0 for r in zero)


def test_large_source_table_is_salted(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    df = spark.createDataFrame(docs(), "doc_id long, source string, text string")
    few = {(r.doc_id, r.copies) for r in mixing.with_copies(df).select("doc_id", "copies").collect()}
    monkeypatch.undo()
    assert few == {(r.doc_id, r.copies) for r in mixing.with_copies(df).select("doc_id", "copies").collect()}


def test_native(spark, sf_dir):
    assert not re.search("Python|Arrow|Pandas", mixing.op8_source_mix(spark, sf_dir)._jdf.queryExecution().toString())


def heap_loads(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for n in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, s))
    return {s: load for load, s in heap}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(1, 9))
def test_longest_first_is_the_heap_over_all_groups(sizes, shards):
    taken = sharding.longest_first(list(Counter(sizes).items()), shards)
    assert {n: sum(got) for n, got in taken.items()} == Counter(sizes)
    assert {s: sum(n * got[s] for n, got in taken.items()) for s in range(shards)} == heap_loads(sizes, shards)


@pytest.mark.parametrize(("ranked", "hot"), [(1, 1000), (50_000, 2), (7, 10)])
def test_shards(spark, tmp_path, ranked, hot, monkeypatch):
    monkeypatch.setattr(sharding, "RANKED", ranked)
    monkeypatch.setattr(common, "HOT", hot)
    rows = [(i, None if i % 50 == 3 else "hot" * 40 if i % 3 == 0 else f"text {i % 97} " * (i % 23)) for i in range(600)] + [(5, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op10_lpt_shards(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    group, slots, load, size = {}, defaultdict(list), defaultdict(int), defaultdict(int)
    for r in out:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        size[r.text_crc32] += r.size
        assert group.setdefault(r.text_crc32, r.shard) == r.shard and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < 8 for s in slots)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert {s: load.get(s, 0) for s in range(8)} == heap_loads(size.values(), 8)


def test_near_equal(spark, sf_dir):
    load = [r.n for r in sharding.op10_lpt_shards(spark, sf_dir).groupBy("shard").agg({"size": "sum"}).toDF("shard", "n").collect()]
    assert len(load) == 8 and max(load) <= 1.05 * min(load)


def test_shards_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sharding.op10_lpt_shards(spark, str(tmp_path)).count() == 0
