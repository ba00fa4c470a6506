import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from corpusloom.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello, World's end.", "", "  a\tb\n\nc\x0bd\x0ce  ", "日本語 ça ÉTÉ ΣΑΣ", "no break  line", "don't 12345 !!!???", "x" * 2000, "é ́a",
    "<|endoftext|> end", "x <|startoftext|>y<|endoftext|> <|ENDOFTEXT|>", "<|endoftext|>", "\x1c\x1d\x85z", "É́ ẖ H̱o", "a²b½ ªº ÷×ß ÿŸ", "'story we're I'LL 'S",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pieces_give_what_whole_texts_give(library):
    enc = tokens.WordEncoder(PATH)
    assert enc.by_piece
    for _ in range(2):
        ids, at = enc.encode(pa.array([*TEXTS, None]), 2)
        for i, t in enumerate([*TEXTS, ""]):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids + [2], t


def test_random_texts(library):
    rng = np.random.default_rng(5)
    signs = list("aZ9 \t\n.,'-_&@é ÀÿßÉ́ 　日²½İ")
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(600)]
    ids, at = tokens.WordEncoder(PATH).encode(pa.array(texts), None)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_other_tokenizers_get_whole_texts():
    enc, library = tokens.WordEncoder(BYTES), Tokenizer.from_file(BYTES)
    assert not enc.by_piece
    ids, at = enc.encode(pa.array(TEXTS), None)
    for i, t in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_small_memory_of_pieces(library):
    enc = tokens.WordEncoder(PATH, most=3)
    for _ in range(2):
        ids, at = enc.encode(pa.array(TEXTS[:6]), None)
        for i, t in enumerate(TEXTS[:6]):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_files(spark, library):
    rows = [(i * 3, None if i == 5 else f"Document {i} says {'word ' * (i % 7)}<|endoftext|>") for i in range(40)] + [(None, "null id"), (6, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    manifest = tokens.write_tokens(df, PATH)
    out = tokens.read_tokens(manifest).collect()
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in out), key=lambda r: r[1]) == want
    first = manifest.orderBy("part").first()
    f = tokens.TokenFile(first.path)
    assert isinstance(f.all, np.memmap) and f.kind == np.uint16 and f.offsets[-1] == len(f.all) and len(f.doc_ids) == first.docs


def test_ranged_reads(spark, monkeypatch):
    """Off a mounted store the same ids come by byte ranges."""
    df = spark.createDataFrame([(1, "some words"), (2, "and some more")], "doc_id long, text string").coalesce(1)
    for r in tokens.write_tokens(df, PATH).collect():
        near = tokens.TokenFile(r.path)
        with monkeypatch.context() as m:
            found = lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), uri.removeprefix("file://").lstrip("/"))
            m.setattr(tokens, "fs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=found), LocalFileSystem=fs.LocalFileSystem))
            far = tokens.TokenFile(r.path)
        assert not far.mounted and far.ids(1, 4).tolist() == near.ids(1, 4).tolist() and far.offsets.tolist() == near.offsets.tolist()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_tokens(tokens.write_tokens(df, PATH)).count() == 0
