import public_tokenizers
import pytest

from corpusloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def p():
    return pieces.pieces(MODEL)


def brute(p, text):
    """The plain dynamic programme over all substrings."""
    if not text:
        return [], 0.0
    t = "▁" + text.replace(" ", "▁")
    best = [(0.0, 0, [])] + [None] * len(t)
    for i in range(1, len(t) + 1):
        for j in range(max(0, i - 20), i):
            word = t[j:i].encode()
            if word in p.lexicon:
                step = best[j][0] + p.lexicon[word][1], j, [p.lexicon[word][0]]
            elif i - j == 1:
                step = best[j][0] + p.unknown, j, [int(p.byte_ids[b]) for b in word]
            else:
                continue
            if best[i] is None or step[0] > best[i][0]:
                best[i] = step
    i, ids = len(t), []
    while i:
        ids, i = best[i][2] + ids, best[i][1]
    return ids, best[-1][0]


TEXTS = ["Hello world", " two  blanks ", "", "a\nb\n\nc", "日本語 🎉 mixed ▁x", "x" * 300, "thhahe ereanti", "\t", "ça été où", "no-break space"]


def test_against_brute_force(p):
    import pyarrow as pa

    ids, at, score = p.encode(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        want, total = brute(p, text)
        assert ids[at[i] : at[i + 1]].tolist() == want, text
        assert score[i] == pytest.approx(total)
    assert p.decode(ids, at) == [t.replace("▁", " ") for t in TEXTS]


def test_slices_of_a_larger_array(p):
    import pyarrow as pa

    col = pa.array([f"word{i} and {i * i}" for i in range(500)]).slice(100, 50)
    ids, at, _ = p.encode(col)
    assert p.decode(ids, at) == col.to_pylist()


def test_columns(spark, sf_dir):
    df = spark.createDataFrame([(1, "some text", 5), (2, None, 6), (3, "", 7), (1, "some text", 5)], "doc_id long, text string, ids int")
    out = pieces.decode_pieces(pieces.encode_pieces(df, MODEL), MODEL).collect()
    assert {(r.doc_id, r.decoded, None if r.ids is None else len(r.ids) > 0) for r in out} == {(1, "some text", True), (2, None, None), (3, "", False)}
    assert pieces.encode_pieces(df.limit(0), MODEL).count() == 0


def test_query_round_trips(spark, sf_dir):
    out = pieces.op2_sentencepiece(spark, sf_dir)
    assert out.count() == 200 and out.where("NOT round_trip OR n_pieces = 0").count() == 0
