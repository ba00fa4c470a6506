"""Document fingerprints by winnowing.

The rolling hash of every k-gram of code points is taken; of every WINDOW consecutive ones the least is kept, the
rightmost among equals, with its position. Two texts that share WINDOW + GRAM - 1 code points in a row share a
fingerprint. A text with fewer k-grams than a window has one window, a text shorter than GRAM is one gram.

Defined cases: a null text counts as empty; an empty text has the empty fingerprint; the likeness of two fingerprints
is the Jaccard coefficient of their hashes, 1 for two empty ones; equal texts have equal fingerprints; a text of any
length is handled whole. In a sequence of documents rows that repeat an id follow each other by text, a null id is
last in descending order, and a lone document follows itself. Columns other than doc_id and text are not needed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import NULL_ID, mix64, partitions, powers, range_number, ranges, slices

GRAM = 8
WINDOW = 8


def rolling(points: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of each run of k code points, from differences of one running sum."""
    n = len(points)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n])])
    return mix64((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def rightmost_least(h: np.ndarray, window: int) -> np.ndarray:
    """Position of the rightmost least value of each window, by doubling."""
    value, at, size = h, np.arange(len(h)), 1

    def joined(step: int) -> tuple[np.ndarray, np.ndarray]:
        right = value[step:] <= value[: len(value) - step]
        return np.where(right, value[step:], value[: len(value) - step]), np.where(right, at[step:], at[: len(at) - step])

    while size * 2 <= window:
        value, at = joined(size)
        size *= 2
    return joined(window - size)[1] if window > size else at


def winnow(points: np.ndarray, ends: np.ndarray, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of texts that lie one after another; ends: 0 and where each ends. (document, hash of 32 bits, position)."""
    sizes = np.diff(ends)
    h = rolling(points, k)
    grams = np.maximum(sizes - k + 1, 0)
    windows = np.maximum(grams - window + 1, 0)
    found_doc, found_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if windows.sum():
        least = rightmost_least(h, window)
        doc = np.repeat(np.arange(len(sizes)), windows)
        first = np.repeat(ends[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(len(doc))
        at = least[first]
        new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]
        found_doc, found_at = doc[new], at[new]
    hashes = h[found_at]
    extra_doc, extra_hash, extra_at = [], [], []
    for d in np.flatnonzero((windows == 0) & (sizes > 0)):
        s, n = int(ends[d]), int(sizes[d])
        if n < k:
            own = rolling(points[s : s + n], n)
        else:
            own = h[s : s + n - k + 1]
        i = len(own) - 1 - int(np.argmin(own[::-1]))
        extra_doc.append(d)
        extra_hash.append(own[i])
        extra_at.append(s + i)
    doc = np.concatenate([found_doc, np.array(extra_doc, np.int64)])
    hashes = np.concatenate([hashes, np.array(extra_hash, np.uint64)])
    at = np.concatenate([found_at, np.array(extra_at, np.int64)])
    order = np.argsort(doc, kind="stable")
    doc, hashes, at = doc[order], hashes[order], at[order]
    return doc, (hashes >> np.uint64(32)).astype(np.uint32), at - ends[:-1][doc]


ENTRY = np.dtype([("hash", ">u4"), ("at", ">u4")])


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Of each text, an ENTRY array in order of position."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.r_[0, np.cumsum(sizes)]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    doc, h, at = winnow(points, ends)
    entries = np.empty(len(doc), ENTRY)
    entries["hash"], entries["at"] = h, at
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [entries[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]


def likeness(a: set, b: set) -> float:
    """Jaccard coefficient of two sets of hashes."""
    return len(a & b) / len(a | b) if a or b else 1.0


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column fingerprint: hash and position of each entry, 8 hexadecimal digits each."""
    at = docs.columns.index(text)
    keep = [f for f in docs.schema.fields if f.name != "fingerprint"]

    def run(batches):
        for b in slices(batches, at):
            made = [x.tobytes().hex() for x in fingerprints(pc.fill_null(b.column(at), "").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in keep] + [pa.array(made, pa.string())], names=[f.name for f in keep] + ["fingerprint"])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField("fingerprint", T.StringType())]))


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's, by descending doc_id.

    Documents are dealt to near equal ranges of doc_id. The first row of a range goes to the range before it as well
    (that of the highest to the last one), so that every row meets the one that follows it: one shuffle of the texts.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    bounds = ranges(docs, F.col("doc_id"), partitions(spark))
    n = max(1, len(bounds))
    number = range_number(bounds, F.col("doc_id"))
    heads = F.broadcast(spark.createDataFrame([(b[1],) for b in bounds] or [(NULL_ID,)], "_head long"))  # one row a range
    copies = F.when(F.col("_head").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    dealt = (
        docs.select(key.alias("_key"), number.alias("_range"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(heads, F.col("_key") == F.col("_head"), "left")
        .withColumn("after", F.explode(copies))
        .select(F.when(F.col("after"), F.pmod(F.col("_range") + 1, F.lit(n))).otherwise(F.col("_range")).cast("int").alias("_range"), "after", "_key", "doc_id", "text")
        .repartitionById(n, "_range")
        .sortWithinPartitions("after", F.desc("_key"), "text")
        .select("after", "doc_id", "text")
    )

    def run(batches):
        ids: list = []
        texts: list[str] = []
        ended = False
        for b in slices(batches, 2, 3 << 20):
            for after, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not ended:
                    ids.append(doc_id)
                    texts.append(text)
                    ended = after
            if len(texts) > 1:
                yield compared(ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    return dealt.mapInArrow(run, COMPARED)


def compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all documents but the last, each against the next."""
    edited = [edited_text(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    plain, changed = fingerprints(texts), fingerprints(edited)
    own = [set(x["hash"].tolist()) for x in plain]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids[:-1], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": [x.tobytes().hex() for x in plain[:-1]],
        "edited_fingerprint": [x.tobytes().hex() for x in changed],
        "near_edited": [likeness(a, set(x["hash"].tolist())) for a, x in zip(own[:-1], changed, strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
    })


def op3_winnowing(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
