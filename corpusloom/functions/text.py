"""Text as columns: cleaning, sentences, tokens, identity. Patterns name their characters, so that engines agree on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space of the browser's trim().
BLANKS = "".join(map(chr, (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
# What counts as a word, a counted word, a Han character, a sentence and a citation mark.
WORD = r"[A-Za-z0-9]+(?:\.[0-9]+)?%?"
COUNTED_WORD = r"[a-zA-Z0-9]+(?:\.[0-9]+)?"
HAN = "[一-鿿]"
SENTENCE = r"[^。！？!?；;\n]+[。！？!?；;\n]?|\n+"
MARK = r"\[[0-9]+(?:\s*[,，]\s*[0-9]+)*\]"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def trim_end(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"[{BLANKS}]+$", "")


def clean_text(c: Column | str) -> Column:
    """TXT1: tags out, runs of blanks and tabs to one blank, at most one empty line in a row, trimmed."""
    c = F.regexp_replace(col(c), "<[^>]*>", "")
    c = F.regexp_replace(c, "[ \t]+", " ")
    return trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


def strip_front_matter(c: Column | str) -> Column:
    """TXT3: a byte-order mark and a YAML head go; the head only if it is blank or has a `key:` line."""
    c = F.regexp_replace(col(c), "^\uFEFF", "")
    head = r"\A---\r?\n((?s:.*?))\r?\n---(?:\r?\n|\z)"
    body = F.regexp_extract(c, head, 1)
    real = c.rlike(head) & ((trim(body) == "") | body.rlike(r"(?m)^[A-Za-z0-9_-]+\s*:"))
    return F.when(real, F.regexp_replace(c, head, "")).otherwise(c)


def normalise_for_eval(c: Column | str) -> Column:
    """TXT5: heading lines out, at most one empty line in a row, trimmed."""
    lines = F.filter(F.split(col(c), "\r?\n", -1), lambda line: ~line.rlike(r"^#{1,6}\s"))
    return trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def sentences(c: Column | str) -> Column:
    """TXT6: sentences with their separators; blank pieces out."""
    return F.filter(F.regexp_extract_all(col(c), F.lit(SENTENCE), F.lit(0)), lambda s: trim(s) != "")


def cited_sentences(c: Column | str) -> Column:
    """TXT7: sentences of an answer; marks that stand alone or lead the next sentence belong to the one before."""
    marks = rf"\A((?:\s*{MARK})+)\s*"
    nothing = F.array().cast("array<string>")

    def join(acc: Column, part: Column) -> Column:
        n = F.size(acc)
        lead, rest = F.regexp_extract(part, marks, 1), F.regexp_replace(part, marks, "")
        alone = part.rlike(rf"\A(?:\s*{MARK})+\s*\z")
        grown = F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.when(alone, part).otherwise(lead))))
        moved = F.when(alone | (F.trim(rest) == ""), grown).otherwise(F.array_append(grown, rest))
        return F.when((n > 0) & (lead != ""), moved).otherwise(F.array_append(acc, part))

    return F.aggregate(F.regexp_extract_all(col(c), F.lit(SENTENCE), F.lit(0)), nothing, join)


def count_tokens(c: Column | str) -> Column:
    """TXT8: Han characters and runs of letters and digits."""
    return F.regexp_count(col(c), F.lit(COUNTED_WORD)) + F.regexp_count(col(c), F.lit(HAN))


def tokens(c: Column | str) -> Column:
    """TXT9: words in lower case, then bigrams of Han runs (a lone character stays); repeats are kept."""
    words = F.transform(F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0)), F.lower)
    pairs = F.transform(F.regexp_extract_all(col(c), F.lit(f"{HAN}+"), F.lit(0)), lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))))
    return F.concat(words, F.flatten(pairs))


def token_set(c: Column | str) -> Column:
    """TXT10."""
    return F.array_distinct(tokens(c))


def utf16_length(c: Column | str) -> Column:
    """TXT12: length in UTF-16 units."""
    return (F.length(F.encode(col(c), "UTF-16LE")) / 2).cast("int")


def document_id(name: Column | str) -> Column:
    """TXT13: an id from the file name alone, the first sixteen digits of its version 5 UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(F.concat(F.lit("rag-doc:"), col(name)), "UTF-8")))
    return F.concat(F.lit("doc_"), F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3))


def strip_think(c: Column | str) -> Column:
    """TXT16: the first thought goes, or everything after one that never ends; left-over tags go too."""
    c = col(c)
    start, stop = "<think>", "</think>"
    at = F.instr(c, start)
    rest = F.substring(c, at + len(start), F.length(c))
    end = F.instr(rest, stop)
    cut = F.when(at == 0, c).when(end == 0, F.substring(c, F.lit(1), at - 1)).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), F.substring(rest, end + len(stop), F.length(c))))
    return trim(F.regexp_replace(cut, f"{start}|{stop}", ""))


def text_stats(c: Column | str) -> list[Column]:
    """TXT17: chars, lines, non_empty_lines, words."""
    c = col(c)
    lines = F.split(c, "\n", -1)
    return [F.length(c).alias("chars"), F.when(c == "", 0).otherwise(F.size(lines)).alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).alias("non_empty_lines"), F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")]


#: Texts up to so many characters try every length, longer ones go by hashes.
SHORT = 64
_ODD = 0x9E3779B97F4A7C15


def common_end(a: str, b: str) -> int:
    """TXT18: length of the longest start of b that ends a, in time linear in the shorter one.

    Hashes of all starts of b and all ends of a come from running sums modulo 2 ** 64; what agrees is compared, longest
    first. Powers of an odd number make every length comparable without a division.
    """
    most = min(len(a), len(b))
    a, b = a[len(a) - most :], b[:most]
    if most <= SHORT:
        return next((n for n in range(most, 0, -1) if a.endswith(b[:n])), 0)
    at = a.find(b[:8])
    if at < 0:  # nothing so long
        return next((n for n in range(7, 0, -1) if a.endswith(b[:n])), 0)
    if b.startswith(a[at:]):
        return most - at
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for s in (a, b))
    powers = np.full(most, _ODD, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    starts = np.cumsum(y * powers)
    ends = np.cumsum((x * powers)[::-1])
    fits = np.flatnonzero(starts * powers[::-1] == ends)  # entry n - 1: the end of length n is moved by most - n places
    return next((int(n) + 1 for n in fits[::-1] if a.endswith(b[: n + 1])), 0)


@F.pandas_udf(T.IntegerType())
def _common_end(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else common_end(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.StringType())
def joined(texts: pd.Series) -> pd.Series:
    """Texts of an array one after another, each without what all before it already end with; '' for none."""

    def join(parts):
        if parts is None:
            return None
        out = ""
        for p in parts:
            out += p[common_end(out, p) :]
        return out

    return texts.map(join)


def overlap_length(a: Column, b: Column) -> Column:
    """TXT18: length of the longest start of b that ends a."""
    return _common_end(a, b)


def without_overlap(a: Column, b: Column) -> Column:
    return F.concat(a, F.substring(b, overlap_length(a, b) + 1, F.length(b)))


def bigram_set(c: Column | str) -> Column:
    """Distinct two-character pieces of a text without white space."""
    t = F.regexp_replace(col(c), f"[{BLANKS}]+", "")
    return F.array_distinct(F.regexp_extract_all(t, F.lit("(?s)(?=(..))"), F.lit(1)))  # one pass, where substring() would start anew for every pair


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 1 for two empty arrays."""
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
