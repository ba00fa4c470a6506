"""Near-duplicate classes from fast similarity sketches, banding and exact verification.

A document's set holds the hashes of its distinct word shingles. Its sketch has COORDINATES places; in round i every
element is thrown into a hashed place with a value in [i, i + 1), each place keeps its least value, and the rounds go
on until every place is filled. From round COORDINATES on, round i throws all elements into place i - COORDINATES, so
that 2 * COORDINATES rounds fill all. The share of equal places estimates the Jaccard coefficient with the
concentration of independent draws. BANDS bands of ROWS places give candidates: a pair at 0.8 is missed with
probability (1 - 0.8 ** 4) ** 25 < 2e-6.

1. Documents with equal sets are one class, known by its least doc_id; only classes go on.
2. In each band's bucket all classes are joined to the least one: a number of rows linear in the bucket, whose
   connected components are the candidate clusters. No pair with a common bucket lies across two clusters.
3. Whole clusters are packed in blocks. A block's task checks bucket mates on full sets: central classes first, and of
   the rest those that are not yet connected to the largest part. It skips a pair only where both are in one component.
4. A cluster whose sets exceed CLUSTER_BYTES is not brought together. Its candidate pairs are checked by rounds, each
   from class sets dealt by hash: best hub of each class, hub of each bucket, all pairs across components.

Defined cases: a null text has no words; a document without words has the empty set, is linked with nothing and stays;
with fewer words than a shingle, the whole sequence is its one shingle; rows that repeat a doc_id are one node, which
links the classes of all its rows (an empty one among them shares their component); a null doc_id is a node of its own,
below all others; an empty table gives an empty one; extra columns are ignored. Shingles
are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, NULL_ID, attach_counted, buffers, give_back, mix64, partitions, powers, set_aside, slices, small_batches, staged

SHINGLE = 2
LEAST = 80  # percent
ROWS, BANDS = 4, 25
COORDINATES = ROWS * BANDS
CLUSTER_BYTES = 32 << 20
BLOCK_BYTES = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and where each text's words start and end."""
    n = len(data)
    gap = _SPACE[data]
    head, tail = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    head[offsets[:-1]] = tail[offsets[1:]] = True
    word = ~gap
    before = np.r_[False, word[:-1]] if n else word
    after = np.r_[word[1:], False] if n else word
    starts = np.flatnonzero(word & (~before | head[:n]))
    ends = np.flatnonzero(word & (~after | tail[1 : n + 1])) + 1
    power, inverse = powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n])])
    return mix64((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = word_hashes(*buffers(texts))
    rolled = words.copy()
    for i in range(1, k):
        rolled[: len(words) - i] = mix64(rolled[: len(words) - i] * np.uint64(3) + words[i:])
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= k:
            own = np.sort(rolled[s : e - k + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:  # salted by the number of words, so that it equals no full shingle
            h = np.full(min(1, e - s), 0x5EED + e - s, np.uint64)
            for i in range(s, e):
                h = mix64(h * np.uint64(3) + words[i : i + 1])
            out.append(h)
    return out


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of t places a set; an empty set's stay empty."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * t, full, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if not len(x):
            break
        h = mix64(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, doc * t + place, np.uint64(i << 32) | (h >> np.uint64(32)))
        open_ = (out.reshape(-1, t) == full).any(axis=1)[doc]
        x, doc = x[open_], doc[open_]
    return out.reshape(-1, t)


def band_values(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit value a band."""
    part = sketch.reshape(len(sketch), -1, rows)
    h = np.arange(1, part.shape[1] + 1, dtype=np.uint64)[None, :].repeat(len(sketch), 0)
    for i in range(rows):
        h = mix64(h * np.uint64(3) + part[:, :, i])
    return h.view(np.int64)


def set_key(s: np.ndarray) -> bytes | None:
    """128 bits that tell sets apart; None for the empty set."""
    return np.array([mix64(s).sum(), mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).tobytes() if len(s) else None


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def sketch_documents(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """node, n_shingles, set_key, bands."""

    def run(batches):
        for b in slices(batches, 1):
            sets = shingle_sets(b.column(1), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), _lists(band_values(sketches(sets)))], names=["node", "n_shingles", "set_key", "bands"])

    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("node"), "text").mapInArrow(run, "node long, n_shingles long, set_key binary, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, component of every node whose component's least node is another. edges: a, b.

    Alternates two steps: each node's greater neighbours are joined to the least of its neighbourhood, then its lesser
    ones. A hub's edges meet its least neighbour by a broadcast of the hubs that hold a thousandth of all edges.
    """

    def with_least(e: DataFrame) -> DataFrame:
        """e (staged) with m, the least v of each u."""
        return attach_counted(e, staged(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least"), "u", "n")

    stars = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct(), "large-stars")
        small = with_least(large)
        stars = staged(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now


def _rest(df: DataFrame, nodes: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi join that leaves df where it is if the nodes are few."""
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(nodes) if few else nodes, key, how)


def resolve(node: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, least: int = LEAST, scans: list | None = None) -> np.ndarray:
    """The least node of each item's component; items with a common band value are compared unless already connected."""
    n = len(node)
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            up[max(i, j)] = min(i, j)

    first: dict[int, int] = {}
    for i, v in enumerate(node.tolist()):
        union(i, first.setdefault(v, i))
    width = bands.shape[1]
    key = mix64(bands.view(np.uint64) + np.arange(width, dtype=np.uint64)[None, :]).ravel()
    _, bucket, count = np.unique(key, return_inverse=True, return_counts=True)
    item = np.argsort(bucket, kind="stable") // width
    ends = np.cumsum(count)
    bucket = bucket.reshape(n, width)
    degree = (count[bucket] - 1).sum(axis=1)
    # clusters: items that share buckets, directly or not
    cluster = list(range(n))

    def top(i: int) -> int:
        while cluster[i] != i:
            cluster[i] = cluster[cluster[i]]
            i = cluster[i]
        return i

    for b in np.flatnonzero(count > 1):
        members = item[ends[b] - count[b] : ends[b]].tolist()
        t = top(members[0])
        for m in members[1:]:
            cluster[top(m)] = t
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    _, code = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(flat) + 1, np.uint8)
    scanned = np.zeros(n, bool)

    def scan(i: int) -> None:
        scanned[i] = True
        own = bucket[i][count[bucket[i]] > 1]
        mates = np.unique(np.concatenate([item[ends[b] - count[b] : ends[b]] for b in own])) if len(own) else np.zeros(0, np.int64)
        mates = mates[~scanned[mates] & (sizes[mates] * 100 >= sizes[i] * least) & (sizes[i] * 100 >= sizes[mates] * least)]
        root = find(i)
        mates = np.array([m for m in mates.tolist() if find(m) != root], np.int64)
        if not len(mates):
            return
        mine = code[begin[i] : begin[i] + sizes[i]]
        mark[mine] = 1
        ends_ = np.cumsum(sizes[mates])
        at = np.arange(int(ends_[-1])) + np.repeat(begin[mates] - (ends_ - sizes[mates]), sizes[mates])
        both = np.add.reduceat(mark[code[at]].astype(np.int64), ends_ - sizes[mates])
        mark[mine] = 0
        if scans is not None:
            scans.append(len(mates))
        for m in mates[100 * both >= least * (sizes[i] + sizes[mates] - both)].tolist():
            union(i, m)

    groups: dict[int, list[int]] = {}
    for i in np.argsort(-degree, kind="stable").tolist():
        if degree[i]:
            groups.setdefault(top(i), []).append(i)
    for members in groups.values():
        for i in members[:2]:
            scan(i)
        roots: dict[int, int] = {}
        for i in members:
            r = find(i)
            roots[r] = roots.get(r, 0) + 1
        main = max(roots, key=roots.__getitem__)
        for i in members:  # what stays unscanned is all in one component
            if not scanned[i] and find(i) != find(main):
                scan(i)
    lowest: dict[int, int] = {}
    for i, v in enumerate(node.tolist()):
        r = find(i)
        lowest[r] = min(lowest.get(r, v), v)
    return np.array([lowest[find(i)] for i in range(n)], np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs a, b whose sets are alike. A block's task holds its share of the sets; the partner's set comes once a block."""
    total = sets.agg(F.coalesce(F.sum(F.octet_length("set")), F.lit(0))).first()[0]
    n = max(partitions(pairs.sparkSession), -(-total // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("b"), F.lit(n)).cast("int")
    asked = pairs.groupBy(block.alias("block"), "a").agg(F.collect_list("b").alias("b")).join(sets.select(F.col("node").alias("a"), F.col("set").alias("a_set")), "a").select("block", "a", "a_set", "b")
    held = sets.select(F.pmod(F.xxhash64("node"), F.lit(n)).cast("int").alias("block"), "node", "set")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        own: dict[int, list[np.ndarray]] = {}
        for v, s in zip(right["node"].to_pylist(), right["set"], strict=True):
            own.setdefault(v, []).append(np.frombuffer(s.as_buffer(), np.uint64))
        made: list[tuple[int, int]] = []
        for a, s, bs in zip(left["a"].to_pylist(), left["a_set"], left["b"].to_pylist(), strict=True):
            x = np.frombuffer(s.as_buffer(), np.uint64)
            for b in bs:
                for y in own.get(b, ()):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= least * (len(x) + len(y) - both):
                        made.append((a, b))
                        break
        return pa.table({"a": pa.array([m[0] for m in made], pa.int64()), "b": pa.array([m[1] for m in made], pa.int64())})

    return asked.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(check, "a long, b long")


def by_rounds(buckets: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """node, component for clusters too large for one task. buckets: band, value, node; sets: node, set."""
    at = ["band", "value"]
    counted = buckets.join(buckets.groupBy(*at).agg(F.count("*").alias("mates")).where("mates > 1"), at)
    degree = counted.groupBy("node").agg(F.sum("mates").alias("degree"))
    ranked = staged(counted.join(degree, "node"), "ranked")
    hubs = ranked.groupBy(*at).agg(F.max(F.struct("degree", "node")).alias("hub"))
    stars = staged(ranked.join(hubs, at).where("node <> hub.node").select(*at, "node", "hub"), "hub-stars")
    links = staged(_verified(stars.groupBy("node").agg(F.max("hub").alias("hub")).select(F.col("hub.node").alias("a"), F.col("node").alias("b")), sets, least), "links")

    def labelled(pairs: DataFrame, found: DataFrame) -> DataFrame:
        a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").distinct()

    found = components(links)
    links = staged(links.unionByName(_verified(labelled(stars.select(F.col("hub.node").alias("a"), F.col("node").alias("b")), found), sets, least)), "links")
    found = components(links)
    named = ranked.join(found, "node", "left").select(*at, "node", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy(*at).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(*at)
    left = staged(named.join(mixed, at), "unresolved")
    pairs = left.select(*at, F.col("node").alias("a"), F.col("component").alias("ca")).join(left.select(*at, F.col("node").alias("b"), F.col("component").alias("cb")), at).where("a < b AND ca <> cb").select("a", "b").distinct()
    return components(links.unionByName(_verified(pairs, sets, least)))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, least: int = LEAST, cluster_bytes: int = CLUSTER_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. docs: doc_id, text."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    made = staged(sketch_documents(docs, k), "sketches")
    full = made.where(F.col("set_key").isNotNull())
    classes = staged(full.groupBy("set_key").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "classes")
    # bands are written once and read twice, and meet in buckets by their values alone
    reps = staged(full.join(classes.select("set_key", F.col("rep").alias("node")), ["set_key", "node"], "left_semi").dropDuplicates(["set_key"]).select("node", "n_shingles", "bands"), "reps")
    rows = reps.select("node", F.explode("bands").alias("value"))  # a value holds its band's number
    buckets = rows.groupBy("value").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    mates = staged(rows.join(buckets.select("value", "hub"), "value"), "mates")
    clusters = components(mates.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    # nodes of clusters, with the bytes of their sets
    named = mates.select("node").distinct().join(clusters, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
    members = staged(named.join(reps.groupBy("node").agg(F.max("n_shingles").alias("n")), "node").select("node", "n", "cluster"), "members")
    sizes = members.groupBy("cluster").agg(F.sum(F.col("n") * 8).alias("bytes"), F.count("*").alias("n")).where("n > 1")
    heavy = staged(sizes.where(F.col("bytes") > cluster_bytes).select("cluster"), "heavy")
    total = members.agg(F.coalesce(F.sum(F.col("n") * 8), F.lit(0))).first()[0]
    blocks = max(1, partitions(docs.sparkSession), -(-total // block_bytes))

    def to_sets(batches):
        for b in slices(batches, 1):
            sets = shingle_sets(b.column(1), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), _lists(band_values(sketches(sets)))], names=["node", "set", "bands"])

    plain = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("node"), "text")
    sets = _rest(plain, members.select("node"), "node").mapInArrow(to_sets, "node long, set binary, bands array<long>")
    own = members.select("node", F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int").alias("block"), "cluster")
    light = _rest(own, heavy, "cluster", "left_anti").drop("cluster")

    def work(t: pa.Table) -> pa.Table:
        node = t["node"].to_numpy().astype(np.int64)
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t["set"]]
        bands = t["bands"].combine_chunks()
        bands = bands.chunk(0) if isinstance(bands, pa.ChunkedArray) else bands
        got = resolve(node, sets, bands.flatten().to_numpy().reshape(len(node), -1), least)
        other = got != node
        give_back()
        return pa.table({"node": node[other], "component": got[other]})

    found = sets.join(light, "node").groupBy("block").applyInArrow(work, "node long, component long")
    if heavy.limit(1).count():
        heavy_nodes = staged(own.join(heavy, "cluster").select("node"), "heavy-nodes")
        found = found.unionByName(by_rounds(mates.join(heavy_nodes, "node", "left_semi").select(F.lit(0).alias("band"), "value", "node"), staged(sets.join(heavy_nodes, "node", "left_semi").select("node", "set"), "heavy-sets"), least))
    found = staged(found.groupBy("node").agg(F.min("component").alias("component")), "found")
    # rows that repeat a doc_id join the classes of their sets
    again = staged(made.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "again")
    if again.limit(1).count():
        of_class = _rest(made.select("node", "set_key"), again, "node").join(classes.select("set_key", "rep"), "set_key", "left")
        found = components(of_class.select(F.col("node").alias("a"), F.coalesce("rep", "node").alias("b")).unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    labelled = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", "n", F.coalesce("component", "rep").alias("component"))
    alone = found.select("node", F.col("component").alias("own"))  # of a repeated id's empty rows
    named = attach_counted(made.select("node", "n_shingles", "set_key"), staged(labelled, "labelled"), "set_key", "n")
    done = named.where("set_key IS NOT NULL").unionByName(named.where("set_key IS NULL").drop("component").join(alone, "node", "left").withColumnRenamed("own", "component")).withColumn("component", F.coalesce("component", "node"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return done.select(real("node").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("node") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, least: int = LEAST) -> DataFrame:
    """docs with one row of each class of near-duplicates, that of the least doc_id (null last). Texts without words stay.

    Where ids are missing or repeat, rows get numbers of their own first, so that each row is judged by its own text;
    of rows that repeat an id with like texts one stays, whichever.
    """
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        gone = near_duplicates(docs, k, least).where(~F.col("kept")).select("doc_id")
        return _rest(docs, staged(gone, "gone"), "doc_id", "left_anti")
    safe, own = set_aside(docs, ("_row",))
    rows = staged(safe.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), k, least).select(F.col("doc_id").alias("_row"), "component_id")
    first = rows.select("_row", "doc_id").join(found, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    return rows.join(staged(first.select(F.col("first._row").alias("_row")), "stay"), "_row", "left_semi").select(*own)


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
