"""MPEG audio columns: a muxer for lossless payloads and a parser for headers and seek tables.

The muxer writes MPEG-1 Layer III at 48 kHz stereo. Each frame's granules are empty, so the
stream decodes to silence, and its ancillary bytes, which decoders pass over, hold the payload in units of 192
bytes; the last frames use smaller bit rates, so the stream is variable and begins with a
Xing table. Tags (ID3v2 before, ID3v1 behind) and a CRC in every frame are written too.

The parser takes any MPEG audio: it skips and reads tags, resynchronises on frame headers
that a second header confirms, reads Xing/Info and VBRI tables, verifies checksums of Layer III
(those of protected Layer I and II frames are neither checked nor counted), and stores
exact durations (samples over rate, as a fraction) and the byte offsets of frames.

Defined results. Null text: as the empty text, which is one unit of padding. Bytes without
a frame: no frames, duration 0/1. A cut last frame isn't counted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.llm.common import id_text, map_arrow, steps

UNIT = 192
#: Fixed values of the format (ISO 11172-3, 13818-3): bit rates in kbit/s by index, by (version 1 or not, layer).
BIT_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Fixed: sample rates in Hz by index, by version.
SAMPLE_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
#: Every which frame's offset a seek table keeps.
SEEK_EVERY = 32


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    """A frame header's fields; ``length`` in bytes, header included."""

    version: int
    layer: int
    protected: bool
    bit_rate: int
    sample_rate: int
    mode: int
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        mono = self.mode == 3
        return (17 if mono else 32) if self.version == 1 else (9 if mono else 17)


@lru_cache(4096)
def header(data: bytes) -> Header | None:
    """Four bytes as a frame header; None if they aren't one (free format included)."""
    if len(data) < 4 or data[0] != 0xFF or data[1] & 0xE0 != 0xE0:
        return None
    version = {0: 25, 2: 2, 3: 1}.get(data[1] >> 3 & 3)
    layer = 4 - (data[1] >> 1 & 3)
    rate, sampling = data[2] >> 4, data[2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or sampling == 3 or data[3] & 3 == 2:
        return None
    bit_rate = BIT_RATES[1 if version == 1 else 2, layer][rate] * 1000
    sample_rate, pad = SAMPLE_RATES[version][sampling], data[2] >> 1 & 1
    if layer == 1:
        return Header(version, 1, not data[1] & 1, bit_rate, sample_rate, data[3] >> 6, (12 * bit_rate // sample_rate + pad) * 4, 384)
    samples = 576 if layer == 3 and version != 1 else 1152
    return Header(version, layer, not data[1] & 1, bit_rate, sample_rate, data[3] >> 6, samples // 8 * bit_rate // sample_rate + pad, samples)


@dataclass
class Stream:
    """What parsing finds."""

    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    first: Header | None = None
    samples: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)

    @property
    def duration(self) -> tuple[int, int]:
        """Seconds as a fraction in lowest terms."""
        if not self.first:
            return 0, 1
        g = gcd(self.samples, self.first.sample_rate) or 1
        return self.samples // g, self.first.sample_rate // g


def _synchsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _tags_before(data: bytes, stream: Stream) -> int:
    """Read ID3v2 tags at the start; where audio begins."""
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6 : at + 10]) < 128:
        major, size = data[at + 3], _synchsafe(data[at + 6 : at + 10])
        end, p = at + 10 + size, at + 10
        stream.tags["id3v2"] = f"2.{major}.{data[at + 4]}"
        while major >= 3 and p + 10 <= min(end, len(data)) and data[p]:
            raw = data[p + 4 : p + 8]
            n = _synchsafe(raw) if major == 4 else struct.unpack(">I", raw)[0]
            body = data[p + 10 : min(p + 10 + n, end)]
            if data[p : p + 1] == b"T" and body:
                stream.tags[data[p : p + 4].decode("latin1")] = body[1:].decode({0: "latin1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            p += 10 + n
        at = end + (10 if data[at + 5] & 0x10 else 0)
    return min(at, len(data))


def _rate_table(frame: bytes, h: Header) -> dict:
    """A Xing, Info or VBRI table in a stream's first frame, if it is one."""
    at = 4 + 2 * h.protected + h.side if h.layer == 3 else -1
    for place in (at, 4 + h.side):  # some writers pass over the checksum
        if h.layer == 3 and frame[place : place + 4] in (b"Xing", b"Info"):
            flags, p = struct.unpack_from(">I", frame, place + 4)[0], place + 8
            out: dict = {"kind": frame[place : place + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit and p + 4 <= len(frame):
                    out[name], p = struct.unpack_from(">I", frame, p)[0], p + 4
            if flags & 4 and p + 100 <= len(frame):
                out["toc"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, quality, size, frames, entries, scale, width, per = struct.unpack_from(">HHHIIHHHH", frame, 40)
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries) if 62 + (i + 1) * width <= len(frame)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "frames_per_entry": per, "toc": toc}
    return {}


def _sync(data: bytes, at: int, end: int) -> int:
    """The next header at or after ``at`` that another one (or the end) confirms."""
    while (at := data.find(b"\xff", at, end)) >= 0:
        h = header(data[at : at + 4])
        if h and h.length >= 4:
            after = at + h.length
            if after == end or after < end and (g := header(data[after : after + 4])) and (g.version, g.layer, g.sample_rate) == (h.version, h.layer, h.sample_rate):
                return at
        at += 1
    return end


def parse(data: bytes) -> Stream:
    """Parse MPEG audio; see the module's description."""
    stream = Stream()
    at = _tags_before(data, stream)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        stream.tags["id3v1"] = data[end + 3 : end + 33].decode("latin1").rstrip("\0 ")
    first = True
    while at < end:
        h = header(data[at : at + 4])
        if not h or h.length < 4 or at + h.length > end or stream.first and (h.version, h.layer, h.sample_rate) != (stream.first.version, stream.first.layer, stream.first.sample_rate):
            found = _sync(data, at + bool(h), end)
            stream.skipped += found - at
            at = found
            continue
        if first:
            if not stream.first and _sync(data, at, end) != at:  # nothing confirms it
                stream.skipped += 1
                at += 1
                continue
            first = False
            stream.first = h
            stream.table = _rate_table(data[at : at + h.length], h)
        if h.protected and h.layer == 3:  # over half of the header, and the side information
            if crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == data[at + 4] << 8 | data[at + 5]:
                stream.crc_ok += 1
            else:
                stream.crc_bad += 1
        if stream.table and "at" not in stream.table:
            stream.table["at"] = at  # the table's own frame plays nothing
        else:
            stream.offsets.append(at)
            stream.lengths.append(h.length)
            stream.samples += h.samples
        at += h.length
    return stream


def _frame_header(rate_index: int) -> bytes:
    """MPEG-1 Layer III, protected, 48 kHz, stereo."""
    return bytes((0xFF, 0xFA, rate_index << 4 | 1 << 2, 0))


@lru_cache(8)
def _frame_parts(rate_index: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information of a frame, and the frame's length."""
    h = _frame_header(rate_index)
    side = bytes(32)
    return h + crc16(h[2:4] + side).to_bytes(2, "big") + side, header(h).length


#: Units of payload in a frame by bit rate index: 80, 160, 224 and 320 kbit/s at 48 kHz.
HOLDS = {4: 14, 3: 12, 2: 10, 1: 6}


def mux(payload: bytes, title: str = "") -> bytes:
    """MPEG audio that holds ``payload``, a positive multiple of 192 bytes."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError("payloads are positive multiples of 192 bytes")
    body = bytearray()
    at, offsets = 0, []
    for n, index in sorted(HOLDS.items(), reverse=True):
        prefix, length = _frame_parts(index)
        fill = bytes(length - len(prefix) - n * UNIT)
        while units >= n:
            offsets.append(len(body))
            body += prefix
            body += payload[at : at + n * UNIT]
            body += fill
            at += n * UNIT
            units -= n
    prefix, length = _frame_parts(9)
    size = length + len(body)
    toc = bytes(min(255, (length + offsets[i * len(offsets) // 100]) * 256 // size) for i in range(100))
    table = prefix + b"Xing" + struct.pack(">III", 7, len(offsets), size) + toc
    text = b"\x03" + title.encode()
    tag = b"TIT2" + bytes((len(text) >> 21 & 127, len(text) >> 14 & 127, len(text) >> 7 & 127, len(text) & 127)) + b"\0\0" + text
    parts = [b"ID3\x04\0\0" + bytes((len(tag) >> 21 & 127, len(tag) >> 14 & 127, len(tag) >> 7 & 127, len(tag) & 127)), tag, table.ljust(length, b"\0"), bytes(body), b"TAG".ljust(128, b"\0")]
    return b"".join(parts)


def demux(data: bytes, stream: Stream) -> bytes:
    """The payload that mux() stored, read at the parsed frames' offsets."""
    holds = {_frame_parts(i)[1]: n * UNIT for n, i in HOLDS.items()}
    skip = len(_frame_parts(1)[0])
    view = memoryview(data)
    return b"".join([view[o + skip : o + skip + holds[n]] for o, n in zip(stream.offsets, stream.lengths, strict=True)])


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of 192, and their number before."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" "), len(data)


def feature(stream: Stream) -> str:
    """Equal streams, equal text: rate, frames, exact duration, checksums, seek offsets' hash."""
    seek = np.array(stream.offsets[::SEEK_EVERY], "<u8").tobytes()
    over, under = stream.duration
    h = stream.first
    rate = f"mpeg{h.version}.l{h.layer}.{h.sample_rate}" if h else "none"
    return f"{rate} table={stream.table.get('kind', '-')}:{stream.table.get('frames', 0)} frames={len(stream.offsets)} seconds={over}/{under} crc={stream.crc_ok}:{stream.crc_bad} skipped={stream.skipped} seek={zlib.crc32(seek):08x}"


MEDIA_FIELDS = "frames long, samples long, sample_rate int, seconds_over long, seconds_under long, crc_ok long, crc_bad long, skipped_bytes long, table_kind string, tags map<string,string>, seek array<long>, feature string"


def media_columns(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", seek_every: int = SEEK_EVERY) -> DataFrame:
    """Parse a binary column: one row of MEDIA_FIELDS for each input row; null is as no bytes."""
    source = media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].cast("binary").alias("media"))
    kinds = pa.schema([("doc_id", pa.int64()), ("frames", pa.int64()), ("samples", pa.int64()), ("sample_rate", pa.int32()), ("seconds_over", pa.int64()), ("seconds_under", pa.int64()), ("crc_ok", pa.int64()), ("crc_bad", pa.int64()), ("skipped_bytes", pa.int64()), ("table_kind", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("seek", pa.list_(pa.int64())), ("feature", pa.string())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = parse(data or b"")
                over, under = s.duration
                rows.append({"doc_id": doc_id, "frames": len(s.offsets), "samples": s.samples, "sample_rate": s.first.sample_rate if s.first else None, "seconds_over": over, "seconds_under": under, "crc_ok": s.crc_ok, "crc_bad": s.crc_bad, "skipped_bytes": s.skipped, "table_kind": s.table.get("kind"), "tags": list(s.tags.items()), "seek": s.offsets[::seek_every], "feature": feature(s)})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return map_arrow(source, fn, "doc_id long, " + MEDIA_FIELDS)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as MPEG audio and read it back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, and with ``keep_media`` the stored bytes as ``media``.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    payload, n = payload_of(text)
                    media = mux(payload)
                    stream = parse(media)
                    back = demux(media, stream)
                    rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream), media if keep_media else None))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 8 + keep_media], names=names[: 8 + keep_media])

    return map_arrow(id_text(docs, id_col, text_col), fn, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media)
