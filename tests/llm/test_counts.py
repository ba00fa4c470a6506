import random

import public_tokenizers
import pyarrow as pa
import pytest

from corpusloom.llm import counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"ab 1.,'\n\t\r\x0b\x0c\x1c\x85\xa0  é中🎉ſst​́", "<|endoftext|>", "  ", "'s", " the", "\n\n", "ü "]


def library(texts, path=BYTES):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(n)]


def test_units_give_the_librarys_counts():
    texts = odd_texts(20_000)
    own = counts.Counter(BYTES, memory=50_000)  # the memory is emptied often
    assert own.by_unit
    for at in range(0, len(texts), 997):
        part = texts[at : at + 997]
        assert own.count(pa.array(part)).tolist() == library(part)
    assert own.count(pa.array([None, "", "a" * 100_000, " \n" * 1000])).tolist() == library([None, "", "a" * 100_000, " \n" * 1000])
    assert own.count(pa.array(["x", "two words", None]).slice(1)).tolist() == library(["two words", None])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_get_whole_texts(name):
    own, texts = counts.Counter(public_tokenizers.path(name)), [*odd_texts(300), "", None]
    assert not own.by_unit and own.count(pa.array(texts)).tolist() == library(texts, public_tokenizers.path(name))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "d", "n") for i, t in enumerate(texts)], "doc_id long, text string, _digest string, n_tokens string").repartition(3)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())


def cached(spark, folder):
    return sorted(counts.open_cache(spark, folder, counts.tokenizer_version(BYTES)).collect())


def test_cache(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/counts"
    texts = ["same text"] * 40 + [None, "", "word " * 600, *odd_texts(30)]
    want = [(i, len((t or "").encode()), n, n > 512) for i, (t, n) in enumerate(zip(texts, library(texts), strict=True))]
    assert rows_of(counts.count_tokens(docs_of(spark, texts), BYTES, folder)) == want
    first = cached(spark, folder)
    assert len(first) == len(set(texts) - {None})  # one a distinct text
    # nothing is encoded that the cache knows, and what it says is taken
    path = f"{folder}/{counts.tokenizer_version(BYTES)}"
    files = set((tmp_path / "counts" / counts.tokenizer_version(BYTES)).glob("*.parquet"))
    assert rows_of(counts.count_tokens(docs_of(spark, texts), BYTES, folder)) == want
    assert set((tmp_path / "counts" / counts.tokenizer_version(BYTES)).glob("*.parquet")) == files
    # new texts are appended alone; rows that another run appended too count once
    spark.read.parquet(path).write.mode("append").parquet(path)
    more = [*texts, "a new text", "a new text"]
    got = rows_of(counts.count_tokens(docs_of(spark, more), BYTES, folder))
    assert got[: len(want)] == want and [r[2] for r in got[len(want) :]] == library(["a new text"] * 2)
    assert len(cached(spark, folder)) == len(first) + 1
    # beyond the broadcast bound the misses meet their texts by a join
    monkeypatch.setattr(counts, "MISSES", 0)
    assert rows_of(counts.count_tokens(docs_of(spark, more), BYTES)) == got


def test_versions_have_caches_of_their_own(spark, tmp_path):
    folder = f"file://{tmp_path}/counts"
    texts = ["Two Words", "", "x"]
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        assert [r[2] for r in rows_of(counts.count_tokens(docs_of(spark, texts), path, folder))] == library(texts, path)
    assert len(list((tmp_path / "counts").iterdir())) == 2


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/counts"
    assert counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTES, folder).count() == 0
    assert not (tmp_path / "counts").exists()


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(d.doc_id, len((d.text or "").encode()), n, n > 512) for d, n in zip(docs, library([d.text for d in docs]), strict=True)]
    assert rows_of(counts.op13_token_counts(spark, sf_dir)) == want
