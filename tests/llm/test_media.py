import hashlib
import struct
import zlib
from fractions import Fraction

import pytest

from chronoweave.llm import media, queries


@pytest.mark.parametrize("text", [None, "", "a", "x" * 191, "x" * 192, "x" * 193, "hé\xff" * 4000, "w " * 200_000])
def test_round_trip(text):
    payload, n = media.payload_of(text)
    stored = media.mux(payload)
    stream = media.parse(stored)
    assert media.demux(stored, stream) == payload and payload[:n] == (text or "").encode() and len(payload) % 192 == 0 < len(payload)
    assert stream.table["frames"] == len(stream.offsets) and stream.crc_bad == stream.skipped == 0 and stream.crc_ok == len(stream.offsets) + 1
    assert Fraction(*stream.duration) == Fraction(1152 * len(stream.offsets), 48000)


def test_mux_refuses_other_sizes():
    for bad in (b"", b"x" * 100):
        with pytest.raises(ValueError):
            media.mux(bad)


def test_resynchronises_and_reports_damage():
    stored = media.mux(media.payload_of("hello world" * 500)[0], "Tïtle")
    clean = media.parse(stored)
    assert clean.tags["TIT2"] == "Tïtle" and clean.tags["id3v2"] == "2.4.0"
    noisy = media.parse(b"junk\xff\xfb" + stored[stored.index(b"\xff\xfa") :])
    assert len(noisy.offsets) == len(clean.offsets) and noisy.skipped == 6
    hurt = bytearray(stored)
    hurt[clean.offsets[1] + 10] ^= 1
    assert media.parse(bytes(hurt)).crc_bad == 1
    assert len(media.parse(stored[: clean.offsets[-1] + 50]).offsets) == len(clean.offsets) - 1


@pytest.mark.parametrize("data", [b"", b"\xff", b"TAG" + bytes(125), b"ID3\x04\0\0\0\0\0\x05hello", bytes(1000), b"\xff\xfb\x90\x64" + bytes(10)])
def test_bytes_without_frames(data):
    s = media.parse(data)
    assert s.offsets == [] and s.duration == (0, 1)


def test_headers_of_all_kinds():
    assert media.header(bytes.fromhex("fffb9064")).length == 417  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz
    assert media.header(bytes.fromhex("fff38464")).version == 2
    assert media.header(bytes.fromhex("fffd9064")).layer == 2 and media.header(bytes.fromhex("ffff9064")).samples == 384
    for bad in ("fffbf064", "fffb0064", "fffb9c64", "ffe99064", "fe000000"):
        assert media.header(bytes.fromhex(bad)) is None


def test_vbri_table():
    frame = bytearray(417)
    frame[:4] = bytes.fromhex("fffb9064")
    frame[36:40] = b"VBRI"
    frame[40:62] = struct.pack(">HHHIIHHHH", 1, 0, 75, 2 * 417, 1, 2, 1, 2, 1)
    frame[62:66] = struct.pack(">HH", 417, 417)
    s = media.parse(bytes(frame) + bytes.fromhex("fffb9064") + bytes(413))
    assert s.table["kind"] == "VBRI" and s.table["toc"] == [417, 417] and len(s.offsets) == 1


def test_columns_and_query(spark, sf):
    df = spark.createDataFrame([(1, media.mux(b"x" * 192)), (2, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.media_columns(df).collect()}
    assert got[1]["frames"] == 1 and got[1]["table_kind"] == "Xing" and got[2]["frames"] == 0 and got[2]["seconds_under"] == 1
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_media_columns"](spark, sf).collect():
        payload, n = media.payload_of(texts[r["doc_id"]])
        stored = media.mux(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (n, len(payload), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string, media int")).count() == 0
