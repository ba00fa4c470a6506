import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import winnowing as w


def brute(text, k, window):
    """Positions by the definition."""
    points = np.array([ord(c) for c in text], np.uint32)
    if not len(points):
        return []
    k = min(k, len(points))
    h = w.rolling(points, k).tolist()
    found = []
    for s in range(max(1, len(h) - window + 1)):
        part = h[s : s + window]
        at = s + max(i for i, x in enumerate(part) if x == min(part))
        if not found or found[-1] != at:
            found.append(at)
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=200), min_size=1, max_size=5))
def test_against_definition(texts):
    for text, entries in zip(texts, w.fingerprints(texts), strict=True):
        assert entries["at"].tolist() == brute(text, w.GRAM, w.WINDOW)


def test_rolling_hash_is_place_independent():
    a = np.array([ord(c) for c in "xxhello world, hello world!"], np.uint32)
    h = w.rolling(a, 11)
    assert h[2] == h[15] and len(set(h.tolist())) == len(h) - 1


def test_match_guarantee():
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh") for _ in range(w.GRAM + w.WINDOW - 1))
    texts = ["".join(rng.choice("ijkl") for _ in range(300)) + shared + "".join(rng.choice("mnop") for _ in range(200)) for _ in range(2)]
    a, b = (set(x["hash"].tolist()) for x in w.fingerprints(texts))
    assert a & b


def test_sequence(spark):
    rows = [(i, None if i == 7 else ("é" * i + chr(97 + i % 5) * 40 * (i % 6))) for i in range(60)]
    out = {r.doc_id: r for r in w.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(out) == 60
    for i, text in rows:
        own, following = text or "", rows[i - 1][1] or ""
        half = len(own) // 2
        assert out[i].edited_sha256 == hashlib.sha256((own[: len(own) - half] + following[:half]).encode()).hexdigest()
        assert out[i].n_chars == len(own)


def test_lone_repeated_null_and_empty(spark):
    make = lambda rows: w.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert make([]) == []
    one = make([(5, "a" * 100)])
    assert len(one) == 1 and one[0].near_next == one[0].near_edited == 1.0
    many = make([(5, "a" * 100), (5, "a" * 100), (None, "b"), (3, "c" * 50)])
    assert len(many) == 4 and many[0].fingerprint == many[1].fingerprint or len({r.fingerprint for r in many if r.doc_id == 5}) == 1


def test_short_texts_keep_their_first_half():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    for n in range(30, 160):
        for _ in range(5):
            own = text(n)
            edited = w.edited_text(own, text(200))
            a, b = (set(x["hash"].tolist()) for x in w.fingerprints([own, edited]))
            assert 0 < w.likeness(a, b) < 1, n
