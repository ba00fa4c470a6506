"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point. An n-gram's vector is the product of
its letters' vectors, each rotated by its distance from the n-gram's end; a text's vector is the sum over its n-grams, a
language's prototype the sum over its documents, and a document gets the language of the closest prototype by cosine.

Bundles add up: each task sums the vectors of its labelled rows by language in 64-bit integers, the sums meet in one
small shuffle, and the driver gets languages * DIMENSIONS numbers, whatever the input and the order of its rows.

Letters are lower-cased; marks that belong to letters (accents, vowel signs) are symbols as letters are; whatever else is
a gap, and runs of gaps count once. Defined cases: a null text, or one without a letter, gets `und` and score 0; a table
without labelled letters predicts `und` for all; ties go to the first language in order; a negative cosine scores 0.
Columns named like the added ones are replaced, all others pass through.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import buffers, mix64, set_aside, slices, small_batches

DIMENSIONS = 1024
GRAM = 3
SEED = 20
GRAMS_AT_ONCE = 4096
#: Bytes of text handled at once; arrays of some hundred bytes for each of them are made.
SLICE = 512 << 10
UNKNOWN = "und"
#: Bits of a letter in the code of an n-gram; 0 is the gap.
BITS = 21
#: Least cosine with the closest prototype of a document that keep_known keeps: twice the standard deviation of the cosine of unrelated vectors. At sf0.1 the least of a clean text (23 code points) is 0.069.
LEAST_SCORE = 2 / DIMENSIONS**0.5

_TABLES: dict = {}


def symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point (of a letter its lower case, of a mark itself, else 0), and whether it is a letter."""
    if "symbols" not in _TABLES:
        symbols, letters = np.zeros(0x110000, np.int32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            if chr(c).isalpha():
                symbols[c], letters[c] = ord(chr(c).lower()[0]), True
            elif unicodedata.category(chr(c))[0] == "M":
                symbols[c] = c
        _TABLES["symbols"] = symbols, letters
    return _TABLES["symbols"]


def letter_vectors(letters: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """One row of +1 and -1 a symbol, from its hash."""
    key = mix64(letters.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    words = mix64(key[:, None] + np.arange(1, -(-dimensions // 64) + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1)[:, :dimensions]
    return (bits.astype(np.int8) << 1) - 1


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """One row an n-gram code: rotated letter vectors bound together."""
    out = None
    for back in range(GRAM):
        letters, place = np.unique(grams >> (BITS * back) & ((1 << BITS) - 1), return_inverse=True)
        bound = np.roll(letter_vectors(letters, dimensions, seed), back, axis=1)[place]
        out = bound if out is None else out * bound
    return out


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram) of every n-gram with a letter in it, and whether each document has a letter."""
    data, offsets = buffers(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(chars))
    symbols, letters = symbol_table()
    symbol = symbols[points].astype(np.int64)
    lettered = np.zeros(len(offsets) - 1, bool)
    lettered[doc[letters[points]]] = True
    # a gap stands before and after each text: append one to every document, drop repeated gaps
    symbol = np.insert(symbol, chars[:-1], 0) if len(chars) > 1 else symbol
    doc = np.insert(doc, chars[:-1], np.arange(len(chars) - 1)) if len(chars) > 1 else doc
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
    ends = np.flatnonzero(last) + 1
    symbol, doc = np.insert(symbol, ends, 0), np.insert(doc, ends, doc[last])
    again = np.r_[False, (symbol[1:] == 0) & (symbol[:-1] == 0) & (doc[1:] == doc[:-1])] if len(doc) else np.zeros(0, bool)
    symbol, doc = symbol[~again], doc[~again]
    n = len(symbol) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    code, some = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(GRAM):
        part = symbol[i : i + n]
        code = code << BITS | part
        some |= part > 0
    fits = some & (doc[:n] == doc[GRAM - 1 :])
    return doc[:n][fits], code[fits], lettered


def counted(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams, and (document, place of the n-gram, count) in order."""
    grams, place = np.unique(code, return_inverse=True)
    key, n = np.unique(doc * len(grams) + place, return_counts=True)
    return grams, key // len(grams), key % len(grams), n


def bundles(doc: np.ndarray, code: np.ndarray, docs: int, dimensions: int, seed: int, kind=np.float32) -> np.ndarray:
    """The sum of the n-grams' vectors of each document."""
    out = np.zeros((docs, dimensions), kind)
    if not len(doc):
        return out
    grams, doc, place, n = counted(doc, code)
    for low in range(0, len(grams), GRAMS_AT_ONCE):
        vectors = gram_vectors(grams[low : low + GRAMS_AT_ONCE], dimensions, seed).astype(kind)
        own = (place >= low) & (place < low + GRAMS_AT_ONCE)
        d, at, k = doc[own], place[own] - low, n[own].astype(kind)
        starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else []
        for s, e in zip(starts, np.r_[starts[1:], len(d)], strict=True):
            out[d[s]] += k[s:e] @ vectors[at[s:e]]
    return out


def language_sums(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, place, total: the bundle of each language, over the rows that have one."""
    small_batches(docs.sparkSession)

    def add(batches):
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, 0, SLICE):
            doc, code, _ = grams_of(b.column(0))
            names, number = np.unique(np.array(b.column(1).to_pylist(), object), return_inverse=True)
            # sums below 2 ** 24 are whole numbers in 32-bit floats, all others here in 64-bit ones
            made = bundles(number[doc], code, len(names), dimensions, seed, np.float32 if len(code) < 1 << 24 else np.float64)
            for name, own in zip(names, made, strict=True):
                total[name] = total.get(name, 0) + own.astype(np.int64)
        for name, own in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name], pa.string()), "sums": pa.array([own.tolist()], pa.list_(pa.int64()))})

    made = docs.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(add, "lang string, sums array<long>")
    return made.select("lang", F.posexplode("sums").alias("place", "part")).groupBy("lang", "place").agg(F.sum("part").alias("total"))


def train(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes (rows of unit length); a language without a letter is none."""
    rows = language_sums(docs, dimensions, seed, text, lang).toPandas()
    names = sorted(rows.lang[rows.total != 0].unique())
    vectors = np.zeros((len(names), dimensions))
    for i, name in enumerate(names):
        own = rows[rows.lang == name]
        vectors[i, own.place.to_numpy()] = own.total.to_numpy(np.float64)
    return names, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def scores(texts: pa.Array, prototypes: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of each text with each prototype, and whether it has a letter."""
    doc, code, lettered = grams_of(texts)
    if not len(prototypes):
        return np.zeros((len(texts), 0), np.float32), lettered
    made = bundles(doc, code, len(texts), prototypes.shape[1], seed)
    length = np.linalg.norm(made, axis=1, keepdims=True)
    return made @ prototypes.T.astype(np.float32) / np.where(length > 0, length, 1), lettered


ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], seed: int = SEED, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; only the text is looked at."""
    names, prototypes = model
    at = docs.columns.index(text)
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def predict(batches):
        for b in slices(batches, at, SLICE):
            cosine, lettered = scores(b.column(at), prototypes, seed)
            lettered &= bool(names)
            best = cosine.argmax(axis=1) if names else np.zeros(len(lettered), int)
            pred = [names[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
            score = np.clip(np.where(lettered, cosine[np.arange(len(best)), best], 0), 0, 1) if names else np.zeros(len(lettered))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in keep] + [pa.array(pred, pa.string()), pa.array(score.astype(np.float64))], names=[f.name for f in keep] + ["lang_pred", "score"])

    return docs.mapInArrow(predict, T.StructType([*keep, *ADDED]))


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = LEAST_SCORE, languages: tuple[str, ...] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without those that are in none of the learned languages (or of `languages`); a null lang becomes the predicted one.

    A document goes if it is null or has no letter, if its best cosine is below `least`, or if its language is not wanted.
    Where nothing was learned there is no cosine to go by: lettered documents stay as they are.
    """
    safe, own = set_aside(docs, ("lang_pred", "score"))
    if not model[0]:
        return safe.where(F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")).select(*own)
    made = identify(safe, model, text=text).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    if languages is not None:
        made = made.where(F.col("lang_pred").isin(*languages))
    return made.withColumn(lang, F.coalesce(lang, "lang_pred")).select(*own) if lang in docs.columns else made.select(*own)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fourth of the rows that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_profiles(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
