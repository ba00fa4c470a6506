"""Token files: flat unsigned integers plus 64-bit document offsets, written in document order and memory-mapped.

write_tokens cuts the documents in ascending ranges of doc_id, encodes each range in one task and writes two files for
it in the shared folder: `.bin` (ids, little-endian, 16 bits where the vocabulary allows it, else 32; written as they
come) and `.idx` (a header, n + 1 offsets and n doc_ids, 64 bits each). Files get their final name by a rename when
they are whole, so that a task which is tried again replaces them by equal ones. The range totals' prefix sums are the
bases. Off a mounted store the reader fetches byte ranges of the `.bin`.

Where the tokenizer is one that marks word ends and drops white space, and whole and piecewise encoding of PROBES agree,
the encoder calls it once for each new piece of a worker (a run of letters, a digit, a run of other signs) and joins
the results; its memory of pieces is emptied when it holds PIECES of them. A text that holds the string of a special
token goes to the library whole, as does every text for another kind of tokenizer.

Defined cases: a null text counts as empty and gives the end id alone; a null doc_id comes first and reads back as
null; rows that repeat an id follow each other by text; strings of special tokens become their ids, as the library has
it; an empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import NULL_ID, partitions, ragged, range_number, ranges, shared_dir, slices, staged

END_ID = 2
PIECES = 800_000
#: Documents and ids that a reader takes from a file at once.
READ_DOCS, READ_IDS = 10_000, 4 << 20
IDX = "<8sQQ"  # magic, bytes an id, documents
IDX_MAGIC = b"LOOMIDX1"
#: Words of these characters (no apostrophe: it joins letters in contractions) are made of whole pre-tokens.
SIMPLE = "^[!-&(-~À-ÿ]+$"
PIECE = "([a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"
PROBES = ["Two words,  and\ttabs\nlines: don't 'tis 3.14 x² ÀÉß×ÿ (a-b)_c --- \u3000 wide\u00a0space e\u0301a", "日本語 ΣΑΣ İI ﬁ <tag> a@b.co #1,234"]


class WordEncoder:
    """Encodes texts by the pieces of their words between ASCII white space."""

    def __init__(self, path: str, most: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.most = most
        self.forget()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.vocabulary, bool)
        for s, i in self.tokenizer.get_vocab().items():
            self.last[i] = bool(suffix) and s.endswith(suffix)
        self.by_piece = bool(suffix) and not any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added)
        self.by_piece = self.by_piece and all(self.encode(pa.array([p]), None)[0].tolist() == self.whole([p])[0] for p in PROBES)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.pool, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str], simple: int) -> None:
        """Keep the ids of new pieces, of which the first `simple` are one pre-token each."""
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def add(lists: list[list[int]]) -> None:
            ids.extend(np.array(x, np.uint32) for x in lists)
            sizes.append(np.array([len(x) for x in lists], np.int64))

        groups = [new[i : min(i + 100, simple)] for i in range(0, simple, 100)]
        for at in range(0, len(groups), 100):
            own = groups[at : at + 100]
            for group, e in zip(own, self.tokenizer.encode_batch_fast([" ".join(g) for g in own], add_special_tokens=False), strict=True):
                x = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.last[x]) + 1
                if len(ends) == len(group) and ends[-1] == len(x):
                    ids.append(x)
                    sizes.append(np.diff(ends, prepend=0))
                else:
                    add(self.whole(group))
        for i in range(simple, len(new), 10_000):
            add(self.whole(new[i : i + 10_000]))
        size, total = np.concatenate([*sizes, np.zeros(0, np.int64)]), sum(map(len, ids))
        if self.used + total > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), self.used + total))
        self.pool[self.used : self.used + total] = np.concatenate([*ids, np.zeros(0, np.uint32)])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.starts = np.r_[self.starts, self.used + np.cumsum(size)]
        self.used += total

    def pieces(self, simple: list[str], other: list[str]) -> np.ndarray:
        """Place of each piece in the memory."""
        new = [[x for x in part if x not in self.known] for part in (simple, other)]
        if len(self.known) + len(new[0]) + len(new[1]) > self.most:
            self.forget()
            new = [simple, other]
        self.learn(new[0] + new[1], len(new[0]))
        return np.fromiter((self.known[x] for part in (simple, other) for x in part), np.int64, len(simple) + len(other))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and where each word's start and end."""
        simple = pc.match_substring_regex(words, SIMPLE)
        cut = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(simple)), PIECE, r"\1 ")))
        coded = _coded(cut.flatten())
        other = words.filter(pc.invert(simple))
        place = self.pieces(coded.dictionary.to_pylist(), other.to_pylist())
        own, rest = place[: len(coded.dictionary)], place[len(coded.dictionary) :]
        # the pieces of all words in order: a word that isn't simple is one piece
        flag = simple.to_numpy(zero_copy_only=False)
        counts = np.ones(len(words), np.int64)
        counts[flag] = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        of_simple = np.repeat(flag, counts)
        at = np.empty(len(of_simple), np.int64)
        at[of_simple] = own[coded.indices.to_numpy(zero_copy_only=False)]
        at[~of_simple] = rest
        lengths = np.diff(self.starts)[at]
        ends = np.r_[0, np.cumsum(lengths)]
        return self.pool[ragged(self.starts[at], lengths)], ends[np.r_[0, np.cumsum(counts)]]

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids start and end."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.by_piece:
            apart = np.ones(len(texts), bool)
        else:
            apart = np.zeros(len(texts), bool)
            for s in self.special:
                apart |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(apart), "", texts) if apart.any() else texts)
        coded = _coded(lists.flatten())
        ids, ends = self.words(coded.dictionary)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        counts = np.diff(offsets)
        # the pool: words, then texts that were encoded whole, then the end id
        apart_ids = [np.array(x, np.uint32) for i in np.flatnonzero(apart) for x in self.whole([texts[int(i)].as_py()])]
        tail = apart_ids + ([np.array([end_id], np.uint32)] if end_id is not None else [])
        pool = np.concatenate([ids, *tail])
        starts = np.concatenate([ends, ends[-1] + np.cumsum([len(x) for x in tail], dtype=np.int64)])
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n_words = len(ends) - 1
        docs = np.repeat(np.arange(len(texts)), counts)
        if apart.any():  # such a text is one item in place of the empty words that stand for it
            keep = ~apart[docs]
            where = np.flatnonzero(apart)
            at, docs = np.r_[at[keep], n_words + np.arange(len(where))], np.r_[docs[keep], where]
            order = np.argsort(docs, kind="stable")
            at, docs = at[order], docs[order]
            counts = np.bincount(docs, minlength=len(texts))
        offsets = np.r_[0, np.cumsum(counts)]
        if end_id is not None:
            at = np.insert(at, offsets[1:], n_words + len(apart_ids))
            offsets = offsets + np.arange(len(offsets))
        lengths = np.diff(starts)[at]
        done = np.r_[0, np.cumsum(lengths)]
        return pool[ragged(starts[at], lengths)], done[offsets]


def _coded(col: pa.Array) -> pa.DictionaryArray:
    made = col.dictionary_encode()
    return made.combine_chunks() if isinstance(made, pa.ChunkedArray) else made


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder, kept between tasks with the words it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


@contextmanager
def whole_file(target: fs.FileSystem, path: str):
    """A stream that is written under another name and gets its own by a rename."""
    draft = f"{path}.{uuid.uuid4().hex}.part"
    with target.open_output_stream(draft) as out:
        yield out
    target.move(draft, path)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files of docs (doc_id, text); returns the manifest: part, path, docs, ids, base, width."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    bounds = ranges(docs, F.col("doc_id"), partitions(spark))

    def write(batches):
        parts = slices(batches, 2, 6 << 20)
        first = next(parts, None)
        if first is None:
            return
        enc = encoder(tokenizer)
        kind = np.dtype("<u2" if enc.vocabulary <= 1 << 16 else "<u4")
        part, total, offsets, doc_ids = first.column(0)[0].as_py(), 0, [np.zeros(1, np.int64)], []
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        path = f"{root}/part-{part:07d}"
        with whole_file(target, f"{path}.bin") as out:
            for b in chain([first], parts):
                ids, at = enc.encode(b.column(2), end_id)
                out.write(ids.astype(kind))
                offsets.append(at[1:] + total)
                doc_ids.append(pc.fill_null(b.column(1), NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64))
                total += len(ids)
        n = sum(map(len, doc_ids))
        with whole_file(target, f"{path}.idx") as out:
            for x in (struct.pack(IDX, IDX_MAGIC, kind.itemsize, n), *offsets, *doc_ids):
                out.write(x)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:07d}"], "docs": [n], "ids": [total], "width": pa.array([kind.itemsize], pa.int32())})

    dealt = docs.select(range_number(bounds, F.col("doc_id")).alias("part"), "doc_id", "text").repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("doc_id", "text")
    made = sorted(staged(dealt.mapInArrow(write, "part int, path string, docs long, ids long, width int"), "token-manifest").collect())  # one row a file
    bases = np.cumsum([0] + [r.ids for r in made])
    return spark.createDataFrame([(r.part, r.path, r.docs, r.ids, int(base), r.width) for r, base in zip(made, bases, strict=False)], "part int, path string, docs long, ids long, base long, width int")


class TokenFile:
    """A file pair: offsets, doc_ids, and ids by range; memory-mapped where the store is a mounted one, else read by range."""

    def __init__(self, path: str):
        self.source, self.root = fs.FileSystem.from_uri(path)
        self.mounted = isinstance(self.source, fs.LocalFileSystem)
        if self.mounted:
            index = np.memmap(f"{self.root}.idx", np.uint8, "r")
        else:
            with self.source.open_input_file(f"{self.root}.idx") as f:
                index = np.frombuffer(f.read(), np.uint8)
        head = struct.calcsize(IDX)
        magic, width, n = struct.unpack(IDX, index[:head].tobytes())
        if magic != IDX_MAGIC:
            raise ValueError(f"{self.root}.idx is no index of token offsets")
        rest = index[head:].view("<i8")
        self.kind, self.offsets, self.doc_ids = np.dtype(f"<u{width}"), rest[: n + 1], rest[n + 1 :]
        if self.mounted:
            name = f"{self.root}.bin"
            self.all = np.memmap(name, self.kind, "r") if os.path.getsize(name) else np.zeros(0, self.kind)

    def ids(self, start: int, end: int) -> np.ndarray:
        if self.mounted:
            return self.all[start:end]
        with self.source.open_input_file(f"{self.root}.bin") as f:
            return np.frombuffer(f.read_at((end - start) * self.kind.itemsize, start * self.kind.itemsize), self.kind)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as 32-bit integers), from the files."""
    n = max(1, manifest.count())

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(path)
                low = 0
                while low < len(f.doc_ids):
                    # so many documents as have READ_IDS ids together, one at least
                    high = max(low + 1, int(np.searchsorted(f.offsets[low + 1 : low + READ_DOCS + 1], f.offsets[low] + READ_IDS, side="right")) + low)
                    at = np.asarray(f.offsets[low : high + 1])
                    ids = f.ids(int(at[0]), int(at[-1]))
                    crc = [zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
                    own = np.asarray(f.doc_ids[low:high])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    low = high

    return manifest.select("path", "base", "part").repartitionById(n, "part").select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_tokens(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))
