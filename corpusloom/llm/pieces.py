"""Encoding to and decoding from the pieces of a SentencePiece vocabulary.

An Aho-Corasick automaton over the pieces' UTF-8 bytes reads each word once. At every position the output links, from
the longest piece that ends there to the shortest, relax the best score of a path that reaches it; the path of the
greatest sum of piece scores is then followed back. A character that is no piece costs the least score less 10 and
comes out as byte pieces. Ties keep the longest last piece.

A blank becomes U+2581, one is put before the text, and pieces hold that sign at their start only (the vocabulary's
blank runs, which score -1e9 and never win, stay out of the automaton), so a text's best path is the best path of its
words, each with its sign. The words of a slice are therefore encoded once each, all at the same time: step i of the
automaton moves every word that has a byte i.

Defined cases: a null text gives null ids and score; an empty text gives no ids and score 0; decoding gives the text
back except that U+2581 in a text comes back as a blank; ids outside the vocabulary raise an error. Columns named like
the added ones are replaced, all others pass through. A vocabulary without byte pieces is refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import buffers, give_back, ragged, slices, small_batches

SIGN = "▁"
UNKNOWN_COST = 10.0
#: Bytes of text whose words are encoded together.
WORD_BYTES = 1 << 20


class Automaton:
    """States are prefixes of pieces. move: next state by byte; piece: id of the piece that a state spells, or -1; emit: the state itself or its nearest suffix that spells a piece; link: the next such suffix."""

    def __init__(self, pieces: dict[bytes, tuple[int, float]]):
        prefixes = sorted({p[:i] for p in pieces for i in range(len(p) + 1)}, key=len)
        number = {p: i for i, p in enumerate(prefixes)}
        n = len(prefixes)
        children: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for p in prefixes[1:]:
            children[number[p[:-1]]].append((p[-1], number[p]))
        self.move = np.zeros((n, 256), np.uint16 if n <= 1 << 16 else np.int32)
        self.piece, self.score, self.length = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n, np.int64)
        self.emit, self.link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        fail = np.zeros(n, np.int32)
        for s, p in enumerate(prefixes):
            if p in pieces:
                self.piece[s], self.score[s] = pieces[p]
                self.length[s] = len(p)
            if s:
                self.move[s] = self.move[fail[s]]
                self.link[s] = self.emit[fail[s]]
                self.emit[s] = s if self.piece[s] >= 0 else self.link[s]
            for byte, child in children[s]:
                fail[child] = self.move[s, byte] if s else 0  # before the own edge replaces it
                self.move[s, byte] = child


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if model.is_byte(i)]
        if len(byte) != 256:
            raise ValueError(f"{path} has no byte pieces")
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and SIGN not in names[i][1:]]
        self.lexicon = {names[i].encode(): (i, model.get_score(i)) for i in plain}
        self.unknown = min(s for _, s in self.lexicon.values()) - UNKNOWN_COST
        self.automaton = Automaton(self.lexicon)
        self.byte_ids = np.zeros(256, np.int32)
        for i in byte:
            self.byte_ids[int(names[i][3:5], 16)] = i
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(names[i]) for i in plain if len(names[i]) == 1]] = True
        spelled = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else x.encode() for i, x in enumerate(names)]
        self.spelled = pa.array(spelled, pa.large_binary())

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, each with the sign before it; where each word's start and end; each word's score."""
        a = self.automaton
        data, offsets = buffers(words)
        n = len(words)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0)
        sign = np.frombuffer(SIGN.encode(), np.uint8)
        data = np.insert(data, np.repeat(offsets[:-1], len(sign)), np.tile(sign, n))
        offsets = offsets + np.arange(n + 1) * len(sign)
        sizes = np.diff(offsets)
        # the length of each unknown character, at its last byte
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        tails = np.r_[heads[1:], len(data)] - 1
        strange = ~self.single[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
        lone = np.zeros(len(data), np.int64)
        lone[tails[strange]] = (tails - heads + 1)[strange]

        order = np.argsort(-sizes, kind="stable")
        size, start = sizes[order], offsets[:-1][order]
        base = start + order  # position 0 of each word among all positions; a word has one more than bytes
        best = np.full(len(data) + n, -np.inf)
        back = np.full(len(data) + n, -1, np.int32)  # -1: a byte piece
        best[base] = 0.0
        state = np.zeros(n, np.int32)
        longest = int(size[0])
        active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # words of more than i bytes
        for i in range(longest):
            m = active[i]
            at = start[:m] + i
            pos = base[:m] + i + 1
            s = a.move[state[:m], data[at]]
            state[:m] = s
            out = a.emit[s]
            own = np.flatnonzero(out)
            out = out[own]
            while len(own):
                p = pos[own]
                reach = best[p - a.length[out]] + a.score[out]
                good = reach > best[p]
                best[p[good]] = reach[good]
                back[p[good]] = out[good]
                out = a.link[out]
                more = out > 0
                own, out = own[more], out[more]
            length = lone[at]
            own = np.flatnonzero(length)
            if len(own):
                p = pos[own]
                reach = best[p - length[own]] + self.unknown
                good = reach > best[p]
                best[p[good]] = reach[good]
                back[p[good]] = -1
        # back from the ends, all words at once
        word, pos, low = order, base + size, base
        steps = []
        while len(word):
            more = pos > low
            word, pos, low = word[more], pos[more], low[more]
            if not len(word):
                break
            b = back[pos]
            steps.append((word, np.where(b >= 0, a.piece[b], self.byte_ids[data[pos - 1 - word]])))
            pos = pos - np.where(b >= 0, a.length[b], 1)
        count = np.zeros(n, np.int64)
        for w, _ in steps:
            count[w] += 1
        ends = np.cumsum(count)
        ids, left = np.zeros(int(ends[-1]), np.int32), ends.copy()
        for w, piece in steps:
            left[w] -= 1
            ids[left[w]] = piece
        return ids, np.r_[0, ends], best[offsets[1:] + np.arange(n)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one after another; where each text's start and end; each text's score."""
        texts = texts.cast(pa.large_string())
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, at, score = self.words(coded.dictionary)
        w = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        empty = (pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) == 0) & (counts > 0)
        w, counts = np.delete(w, (np.cumsum(counts) - counts)[empty]), np.where(empty, 0, counts)
        lengths = np.diff(at)[w]
        docs = np.r_[0, np.cumsum(counts)].astype(np.int64)
        done = np.r_[0, np.cumsum(lengths)]
        total = np.r_[0.0, np.cumsum(score[w])]
        return ids[ragged(at[:-1][w], lengths)], done[docs], total[docs[1:]] - total[docs[:-1]]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        data, at = _binary(self.spelled.take(pa.array(ids)))
        raw = data.tobytes()
        ends = at[offsets]
        sign = SIGN.encode()
        return [raw[s:e].replace(sign, b" ")[1:].decode("utf-8", "replace") for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """This worker's automaton, built once."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
        give_back()
    return _LOADED[path]


def encode_pieces(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """df with ids (array of int) and piece_score."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)
    keep = [f for f in df.schema.fields if f.name not in ("ids", "piece_score")]

    def run(batches):
        for b in slices(batches, at, WORD_BYTES):
            p = pieces(model)
            ids, ends, score = p.encode(b.column(at))
            null = pc.is_null(b.column(at)).to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.r_[null, False]), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in keep] + [lists, pa.array(score, mask=null)], names=[f.name for f in keep] + ["ids", "piece_score"])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("piece_score", T.DoubleType())]))


def decode_pieces(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that its ids spell; null for null."""
    at = df.columns.index(ids)
    keep = [f for f in df.schema.fields if f.name != text]

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                col = b.column(at)
                flat = pc.fill_null(col.flatten(), 0).to_numpy(zero_copy_only=False)
                counts = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                null = pc.is_null(col).to_numpy(zero_copy_only=False)
                made = pieces(model).decode(flat, np.r_[0, np.cumsum(counts)].astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in keep] + [pa.array([None if x else t for t, x in zip(made, null, strict=True)], pa.string())], names=[f.name for f in keep] + [text])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(text, T.StringType())]))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces, and whether decoding them gives the text back."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = decode_pieces(encode_pieces(docs, model), model)
    return done.select("doc_id", "ids", F.size("ids").alias("n_pieces"), "piece_score", F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
