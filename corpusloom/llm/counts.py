"""Token counts with a digest cache.

The cache is a Parquet table below a folder of its own for each tokenizer version (the digest of the tokenizer's file,
the library's version and the settings), with a content's digest and its token count. Documents are reduced to digests
of their normalised text first; only distinct digests that the cache lacks are encoded, each once, and their counts are
appended. Then every document meets the cache by its digest. Appended rows may repeat what another run appends at the
same time; readers take one a digest.

Normalising must not change a count: null becomes the empty text, and `fold` (a function of a column; none by default)
may fold what the tokenizer itself folds. A byte-level vocabulary tells all texts apart, so its query folds nothing.

Texts are shuffled once at most: equal ones meet in the map tasks, so that a text in a third of all rows is one row a
task. With few misses (MISSES, checked) their digests are broadcast and only missing texts are shuffled; without any,
none are. Documents meet counts by digests of 32 bytes; digests that hold a thousandth of the rows are broadcast.

The byte-level tokenizer without normaliser is called for each new unit of a worker only: a text is cut before white
space that follows a sign that isn't white space. No pre-token spans such a place, as white space only starts one. What
follows the cut is seen as before, and nothing looks back. The memory of units is emptied when it holds MEMORY bytes.
Any other tokenizer gets whole texts.

Defined cases: a null text counts as empty and has no tokens; strings of special tokens count as the library has it;
rows that repeat a doc_id stay; an empty table gives no rows and leaves the cache as it is. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import attach_counted, buffers, shared_dir, slices, small_batches, staged, text_of

LIMIT = 512
#: Missing digests up to which they are broadcast: 32 bytes each.
MISSES = 100_000
MEMORY = 32 << 20
#: Bytes of texts that a tokenizer which sees whole texts gets at once.
WHOLE_BYTES = 1 << 20
SETTINGS = "no special tokens added, no truncation, no padding"


def tokenizer_version(path: str) -> str:
    """Digest of what decides about counts: the file, the library and its version, the settings."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(b"\0".join([f.read(), library.encode(), SETTINGS.encode()])).hexdigest()


class Counter:
    """Token counts of texts by one tokenizer file."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memory, self.by_unit = memory, False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                said = json.load(f)
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.whole = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            pre = said.get("pre_tokenizer") or {}
            self.by_unit = (
                said.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
                and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in said.get("added_tokens") or [])
            )
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0

    def learn(self, units: list[bytes]) -> np.ndarray:
        new = [u for u in units if u not in self.known]
        size = sum(map(len, new)) + 100 * len(new)
        if self.held + size > self.memory:
            self.forget()
            new = units
        at = 0
        while at < len(new):  # so many as have WHOLE_BYTES together, one at least
            to, total = at, 0
            while to < len(new) and (to == at or total + len(new[to]) <= WHOLE_BYTES):
                total += len(new[to])
                to += 1
            self.known.update(zip(new[at:to], self.whole([u.decode("utf-8", "replace") for u in new[at:to]]), strict=True))
            at = to
        self.held += size
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def count(self, texts: pa.Array) -> np.ndarray:
        if not self.by_unit:
            return np.array(self.whole(pc.fill_null(texts, "").to_pylist()), np.int64)
        raw, off = buffers(texts)
        if not len(raw):
            return np.zeros(len(texts), np.int64)
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        # a sign surely not white space: of ASCII, or of the two-byte letters from U+00C0 on
        solid = np.zeros(256, bool)
        solid[33:127] = True
        lead = np.zeros(256, bool)
        lead[0xC3:0xCA] = True
        firm = solid[raw]
        firm[1:] |= lead[raw[:-1]]
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = blank[raw[1:]] & firm[:-1]
        cut[off] = True
        places = np.flatnonzero(cut)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = units.dictionary_encode()
        counts = self.learn(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        done = np.r_[0, np.cumsum(counts)]
        at = np.searchsorted(places, off)
        return done[at[1:]] - done[at[:-1]]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This worker's counter, kept between tasks with the units it knows."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def open_cache(spark, folder: str, version: str) -> DataFrame:
    """_digest, n_tokens of one tokenizer version, one row a digest; empty where nothing was appended yet."""
    path = f"{folder.rstrip('/')}/{version}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "_digest binary, n_tokens long")
    return spark.read.schema("_digest binary, n_tokens long").parquet(path).groupBy("_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT, fold: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of docs (doc_id, text); cache: folder of the counts, a new one where None."""
    spark = docs.sparkSession
    small_batches(spark)
    folder, version = cache or shared_dir(spark, "token-counts"), tokenizer_version(tokenizer)
    text = fold(text_of()) if fold else text_of()
    own = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"), text.alias("_text"))
    digests = staged(own.drop("_text"), "count-digests")
    keys = digests.groupBy("_digest").agg(F.count("*").alias("_rows"))
    missing = staged(keys.join(open_cache(spark, folder, version), "_digest", "left_anti").select("_digest"), "count-misses")
    misses = missing.count()
    if misses:
        rows = own.select("_digest", "_text")
        if misses <= MISSES:
            rows = rows.join(F.broadcast(missing), "_digest", "left_semi")
        texts = rows.groupBy("_digest").agg(F.first("_text").alias("_text"))
        if misses > MISSES:
            texts = texts.join(missing, "_digest", "left_semi")

        def encode(batches):
            for part in slices(batches, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counter(tokenizer).count(part.column(1)))], names=["_digest", "n_tokens"])

        texts.mapInArrow(encode, "_digest binary, n_tokens long").write.mode("append").parquet(f"{folder.rstrip('/')}/{version}")
    counts = staged(keys.join(open_cache(spark, folder, version), "_digest"), "count-table")
    done = attach_counted(digests, counts, "_digest", "_rows")
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
