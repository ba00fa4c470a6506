import random
import re

import numpy as np
import pyarrow as pa

from corpusloom.llm import neardup

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k=2):
    raw = (text or "").encode()
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    w = WORDS.findall(raw)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*[w[i:] for i in range(k)], strict=False))


def brute(rows, k=2, least=80):
    sets = [(d, shingles(t, k)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= least * len(a | b):
                x, y = find(d), find(e)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in sets}, {d: len(s) for d, s in sets}


def made(n=160, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "THE"]
    rows, bases = [], []
    for i in range(n):
        if bases and rng.random() < 0.7:
            words = list(rng.choice(bases[:4] if rng.random() < 0.7 else bases))
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))]
            bases.append(words)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(1000, None), (1001, ""), (1002, "  \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "onetwo")]


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in neardup.near_duplicates(df, **options).collect()}
    want, sizes = brute(rows, options.get("k", 2))
    assert {d: r.component_id for d, r in out.items()} == want
    assert {d: r.n_shingles for d, r in out.items()} == sizes
    assert all(r.kept == (d == r.component_id) for d, r in out.items())


def test_against_brute_force(spark):
    check(spark, made())


def test_five_words(spark):
    check(spark, made(seed=2), k=5)


def test_by_rounds_gives_the_same(spark):
    check(spark, made(100, seed=3), cluster_bytes=0)


def test_resolve_many_seeds():
    for seed in range(8):
        rows = [(d, t) for d, t in made(120, seed) if t and t.strip()]
        sets = neardup.shingle_sets(pa.array([t for _, t in rows]))
        got = neardup.resolve(np.array([d for d, _ in rows]), sets, neardup.band_values(neardup.sketches(sets)))
        want, _ = brute(rows)
        assert dict(zip([d for d, _ in rows], got.tolist(), strict=True)) == want


def test_large_group_is_not_compared_pair_by_pair():
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append(" ".join(words))
    sets = neardup.shingle_sets(pa.array(rows))
    scans: list[int] = []
    got = neardup.resolve(np.arange(600), sets, neardup.band_values(neardup.sketches(sets)), scans=scans)
    assert set(got.tolist()) == {0} and sum(scans) < 5 * 600


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    s = neardup.sketches([np.sort(np.r_[common, a]), np.sort(np.r_[common, b]), common[:1], np.zeros(0, np.uint64)], 400)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1
    assert (s[2] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (s[3] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_repeated_and_null_ids_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(4, text, 1), (4, text, 1), (None, text, 2), (9, text + " b", 3)], "doc_id long, text string, kept int")
    out = neardup.near_duplicates(df).collect()
    assert len(out) == 4 and {r.component_id for r in out} == {None} and sum(r.kept for r in out) == 1
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_keep_one(spark):
    rows = [r for r in made(60, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute(rows, 5)
    assert {r.doc_id for r in neardup.keep_one(df).collect()} == {d for d, c in want.items() if d == c}


def test_an_id_of_several_texts_links_their_classes(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (2, b), (3, a), (3, b), (3, None), (7, "alone in the world"), (8, None), (9, None), (9, "")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(1, 1, True), (2, 1, False), *[(3, 1, False)] * 3, (7, 7, True), (8, 8, True), (9, 9, True), (9, 9, True)]


def test_keep_one_judges_rows_of_one_id_by_their_own_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, 5), (3, a, 6), (3, b, 7), (None, b, 8), (None, c, 9), (None, c, 9), (4, None, 1), (4, None, 1)]
    out = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _row long")).collect()
    assert sorted(str((r.doc_id, r.text, r["_row"])) for r in out) == sorted(map(str, [(1, a, 5), (3, b, 7), (None, c, 9), (4, None, 1), (4, None, 1)]))


def test_buckets_carry_values_and_nodes_alone(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(neardup, "staged", lambda df, name, f=neardup.staged: kept.setdefault(name, f(df, name)) if name in ("reps", "mates") else f(df, name))
    check(spark, made(40, 5))
    assert kept["mates"].columns == ["value", "node", "hub"]
    assert kept["reps"].columns == ["node", "n_shingles", "bands"]
