import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import ogg


def slow_crc(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=200))
def test_checksum(data):
    assert ogg.page_crc(data) == slow_crc(data)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 400))
def test_round_trip(packets):
    payload = b"".join(hashlib.sha256(bytes([i % 256, packets % 256])).digest() * 18 for i in range(packets))
    got = ogg.read_ogg(ogg.write_ogg(payload, len(payload)))
    assert got["payload"] == payload and got["packets"] == packets and not got["bad_pages"]
    assert got["seconds"] == pytest.approx(packets * ogg.PACKET / ogg.RATE)


def test_packets_over_page_ends():
    packets = [(b"h" * 30, 0), (b"a" * 70_000, 5), (b"", 6), (b"b" * 255, 7), (b"c" * 510, 8)]
    pages = ogg.stream_pages(7, packets)
    got, n, bad = ogg.demultiplex(b"".join(p for _, p in pages))
    assert [d for d, _ in got[7]] == [d for d, _ in packets] and n == len(pages) and bad == 0


def test_damaged_page_is_dropped_and_counted():
    payload = bytes(range(256)) * 9 * 200
    media = bytearray(ogg.write_ogg(payload, len(payload)))
    media[len(media) // 2] ^= 1
    got = ogg.read_ogg(bytes(media))
    assert got["bad_pages"] >= 1 and len(got["payload"]) < len(payload) and len(got["payload"]) % ogg.PACKET == 0


def test_columns_nulls_and_names(spark):
    rows = [(1, "x" * 1000, "k"), (2, None, None), (3, "", "k"), (4, "x" * 1000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    out = {r.doc_id: r for r in ogg.ogg_features(ogg.encode_ogg(df)).collect()}
    payload = b"x" * 1000 + b"\xff" * (1152 - 1000)
    assert out[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and out[1].n_bytes == 1000 and out[1].payload_bytes == 1152
    assert out[1].tail_crc32 == zlib.crc32(payload[-32:]) and out[1].media_sha256 == out[4].media_sha256
    assert out[2].payload_bytes == out[3].payload_bytes == 576 and out[2].feature == out[3].feature
    assert ogg.ogg_features(ogg.encode_ogg(df.limit(0))).count() == 0


def test_null_media(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert ogg.ogg_features(df).first().payload_sha256 is None


def naive(media: bytes):
    """(serial, packet) in page order, with every checksum verified bit by bit."""
    at, parts, out = 0, {}, []
    while at < len(media):
        assert media[at : at + 4] == b"OggS"
        serial, n = int.from_bytes(media[at + 14 : at + 18], "little"), media[at + 26]
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        assert slow_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) == int.from_bytes(media[at + 22 : at + 26], "little")
        pos = at + 27 + n
        for v in lacing:
            parts[serial] = parts.get(serial, b"") + media[pos : pos + v]
            pos += v
            if v < 255:
                out.append((serial, parts.pop(serial)))
        at = end
    assert not parts
    return out


def test_the_query_by_brute_force(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = ogg.op1_ogg_media(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id]
        payload = raw + b"\xff" * (max(576, -len(raw) // 576 * -576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        if len(raw) < 3000:
            media = ogg.write_ogg(payload, len(raw))
            assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
            streams = {}
            for serial, packet in naive(media):
                streams.setdefault(serial, []).append(packet)
            a, b = (s[1:] for s in streams.values())  # after each header
            assert b"".join(x for i in range(len(a)) for x in (a[i : i + 1] + b[i : i + 1])) == payload
        assert abs(r.seconds - len(payload) / 8000) < 1e-9


def test_times_come_from_the_header_and_a_lost_one_is_told(monkeypatch):
    payload = bytes(range(250)) * 20
    with monkeypatch.context() as m:
        m.setattr(ogg, "PACKET", 250)
        media = ogg.write_ogg(payload, 4990)
    got = ogg.read_ogg(media)
    assert got["payload"] == payload and got["n_bytes"] == 4990 and got["seconds"] == pytest.approx(len(payload) / ogg.RATE)
    one = bytearray(media)
    one[40] ^= 1  # the first stream's header page
    assert ogg.read_ogg(bytes(one))["payload"] == payload and ogg.read_ogg(bytes(one))["bad_pages"] == 1
    both = bytearray(one)
    both[media.find(b"OggS", 4) + 40] ^= 1
    got = ogg.read_ogg(bytes(both))
    assert got["n_bytes"] is None and got["seconds"] is None and got["bad_pages"] == 2
