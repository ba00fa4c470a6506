"""Media columns: documents as Ogg streams of 8-bit samples, and the reading of such a column.

encode_ogg adds a binary column with one Ogg file a row. The samples are cut in packets of 576 which alternate
between two logical streams; each stream opens with a header packet. read_ogg verifies every page's checksum,
joins packets from lacing values (over page ends too), separates the logical streams, and derives every packet's
time from the page's granule position.

Defined cases: a null text counts as empty, an empty text gives one packet of padding; equal texts give equal bytes
(serial numbers come from the content); a null media value gives null features; a page whose checksum fails is
dropped and counted in bad_pages, and the packets that it held are lost. Packet length and number of streams are read
from any intact header packet; where all are lost, n_bytes and seconds are null, and a packet that isn't the last of its
page has no time and is left out of the payload. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import slices

PACKET = 576
RATE = 8000
STREAMS = 2
MAGIC = b"\x01loompcm"
HEADER = struct.Struct("<8sIBBIQ")  # magic, samples a second, stream, streams, samples a packet, bytes of content
PAGE = struct.Struct("<4sBBqIII")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 04c11db7, most significant bit first, from 0) of a page whose checksum field is 0.

    It is zlib's reflected CRC over bit-reversed bytes without the inversions, bit-reversed.
    """
    return int.from_bytes((zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF).to_bytes(4, "little").translate(_REVERSED), "big")


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream. packets: (data, granule at its end); the first is the header, on its own page."""
    pages: list[tuple[int, bytes]] = []
    seq = 0

    def put(lacing: bytearray, body: list[bytes], granule: int, continued: bool, last: bool) -> None:
        nonlocal seq
        flags = continued | (seq == 0) << 1 | last << 2
        tail = bytes([len(lacing)]) + bytes(lacing) + b"".join(body)
        crc = page_crc(PAGE.pack(b"OggS", 0, flags, granule, serial, seq, 0) + tail)
        pages.append((granule, PAGE.pack(b"OggS", 0, flags, granule, serial, seq, crc) + tail))
        seq += 1

    lacing, body, granule, continued = bytearray(), [], -1, False
    for k, (data, at) in enumerate(packets):
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        pos = 0
        while values:
            if len(lacing) == 255:
                put(lacing, body, granule, continued, False)
                lacing, body, granule, continued = bytearray(), [], -1, pos > 0
            take = values[: 255 - len(lacing)]
            n = sum(take)
            lacing += take
            body.append(data[pos : pos + n])
            pos += n
            values = values[len(take) :]
        granule = at
        if k == 0 or k == len(packets) - 1:
            put(lacing, body, granule, continued, k == len(packets) - 1)
            lacing, body, granule, continued = bytearray(), [], -1, False
    return pages


def write_ogg(payload: bytes, n_bytes: int) -> bytes:
    """payload: a positive multiple of PACKET bytes, of which n_bytes are the content."""
    base = zlib.crc32(payload)
    streams: list[list[tuple[bytes, int]]] = [[(HEADER.pack(MAGIC, RATE, s, STREAMS, PACKET, n_bytes), 0)] for s in range(STREAMS)]
    for k in range(len(payload) // PACKET):
        streams[k % STREAMS].append((payload[k * PACKET : (k + 1) * PACKET], (k + 1) * PACKET))
    made = [stream_pages((base + s * 0x9E3779B9) & 0xFFFFFFFF, packets) for s, packets in enumerate(streams)]
    first = [pages[0][1] for pages in made]  # opening pages precede all others
    rest = sorted((g, s, i, page) for s, pages in enumerate(made) for i, (g, page) in enumerate(pages) if i)
    return b"".join(first + [x[-1] for x in rest])


def read_pages(media: bytes):
    """(flags, granule, serial, sequence number, lacing, body) of each intact page, None for a damaged one."""
    at = 0
    while at >= 0 and at + 27 <= len(media):
        if media[at : at + 4] != b"OggS":
            yield None
            at = media.find(b"OggS", at + 1)
            continue
        _, version, flags, granule, serial, seq, crc = PAGE.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + media[at + 26]]
        end = at + 27 + media[at + 26] + sum(lacing)
        if version or end > len(media) or page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            yield None
            at = media.find(b"OggS", at + 1)
            continue
        yield flags, granule, serial, seq, lacing, media[at + 27 + len(lacing) : end]
        at = end


def header_of(packet: bytes) -> tuple[int, int, int] | None:
    """Samples a second, samples between two packets of one stream, bytes of content; None for a packet of samples."""
    if len(packet) != HEADER.size or not packet.startswith(MAGIC):
        return None
    _, rate, _, streams, length, n_bytes = HEADER.unpack(packet)
    return rate, streams * length, n_bytes


def demultiplex(media: bytes) -> tuple[dict[int, list[tuple[bytes, int | None]]], int, int]:
    """Packets with the granule at their end by serial number, number of pages, number of damaged pages.

    A page tells the granule of the last packet that ends on it; those before it lie apart by what the header says.
    """
    found: dict[int, list[tuple[bytes, int, int]]] = {}
    open_: dict[int, bytes | None] = {}
    due: dict[int, int] = {}
    pages = bad = 0
    for page in read_pages(media):
        if page is None:
            bad += 1
            continue
        flags, granule, serial, seq, lacing, body = page
        pages += 1
        if seq != due.get(serial, seq):  # a page is missing, and with it the start of what goes on here
            open_[serial] = None
        due[serial] = seq + 1
        out = found.setdefault(serial, [])
        part, skip = (open_.get(serial), open_.get(serial) is None) if flags & 1 else (b"", False)
        ended, pos, run = [], 0, 0
        for v in lacing:
            run += v
            if v < 255:
                if not skip:
                    ended.append(part + body[pos : pos + run])
                part, skip, pos, run = b"", False, pos + run, 0
        open_[serial] = None if skip else part + body[pos : pos + run]
        out += [(p, granule, len(ended) - 1 - i) for i, p in enumerate(ended)]
    step = next((h[1] for packets in found.values() for p, _, _ in packets if (h := header_of(p))), None)
    at = lambda granule, after: granule if not after else None if step is None else granule - after * step
    return {serial: [(p, at(granule, after)) for p, granule, after in packets] for serial, packets in found.items()}, pages, bad


def read_ogg(media: bytes) -> dict:
    """payload (samples in the order of their times), n_bytes, packets, pages, bad_pages, seconds."""
    found, pages, bad = demultiplex(media)
    timed, n_bytes, rate = [], None, None
    for packets in found.values():
        for data, granule in packets:
            if header := header_of(data):
                rate, _, n_bytes = header
            elif granule is not None:
                timed.append((granule, data))
    # the last packet of a stream that holds fewer ends later on its page's granule only if it is the last in time
    timed.sort(key=lambda x: x[0])
    return {"payload": b"".join(d for _, d in timed), "n_bytes": n_bytes, "packets": len(timed), "pages": pages, "bad_pages": bad, "streams": len(found), "seconds": None if rate is None else timed[-1][0] / rate if timed else 0.0}


def encode_ogg(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a binary column `media` in place of the text column."""
    at = df.columns.index(text)
    keep = [f for f in df.schema.fields if f.name not in (text, media)]

    def run(batches):
        for b in slices(batches, at):
            made = []
            for t in b.column(at):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                made.append(write_ogg(raw + b"\xff" * (max(PACKET, -len(raw) // PACKET * -PACKET) - len(raw)), len(raw)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in keep] + [pa.array(made, pa.binary())], names=[f.name for f in keep] + [media])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(media, T.BinaryType())]))


FEATURES = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("seconds", T.DoubleType()), T.StructField("bad_pages", T.LongType())])


def features(media: bytes) -> tuple:
    got = read_ogg(media)
    payload = got["payload"]
    x = np.frombuffer(payload, np.uint8)
    y = x.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    feature = f"streams={got['streams']};pages={got['pages']};packets={got['packets']};sum={int(y.sum())};squares={int((y * y).sum())};crossings={crossings};low={int(x.min()) if len(x) else 0};high={int(x.max()) if len(x) else 0}"
    return got["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, got["seconds"], got["bad_pages"]


def ogg_features(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the FEATURES of its media column in that column's place."""
    at = df.columns.index(media)
    names = {f.name for f in FEATURES}
    keep = [f for f in df.schema.fields if f.name != media and f.name not in names]

    def run(batches):
        for b in slices(batches, at):
            rows = [features(m.as_py()) if m.is_valid else (None,) * len(FEATURES) for m in b.column(at)]
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in keep] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.name for f in keep] + FEATURES.names)

    return df.mapInArrow(run, T.StructType([*keep, *FEATURES.fields]))


def op1_ogg_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as an Ogg stream and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ogg_features(encode_ogg(docs)).select("doc_id", *[F.col(c) for c in FEATURES.names])
