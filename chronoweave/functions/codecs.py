"""Codecs of project files: base91, zlib envelopes, fixed binary series, JSON merging.

These have no built-in form and run as Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the 91 characters in order of value.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!#$%&()*+,./:;<=>?@[]^_`{|}~\""
_VALUE = {c: i for i, c in enumerate(ALPHABET)}


#: Bytes, or pairs of characters, that codecs shift through one number at a time.
_CHUNK = 1024


def base91_encode(data: bytes) -> str:
    """Pairs of characters carry 13 bits, or 14 where the low 13 are 88 or less."""
    number, bits, out = 0, 0, []
    for at in range(0, len(data), _CHUNK):
        part = data[at : at + _CHUNK]
        number |= int.from_bytes(part, "little") << bits
        bits += 8 * len(part)
        while bits > 13:
            width = 13 if number & 0x1FFF > 88 else 14
            high, low = divmod(number & ((1 << width) - 1), 91)
            out += ALPHABET[low], ALPHABET[high]
            number >>= width
            bits -= width
    if bits:
        high, low = divmod(number, 91)
        out.append(ALPHABET[low])
        if bits > 7 or high:
            out.append(ALPHABET[high])
    return "".join(out)


def base91_decode(text: str) -> bytes:
    """Characters outside the alphabet are passed over."""
    codes = [_VALUE[c] for c in text if c in _VALUE]
    pairs = [a + 91 * b for a, b in zip(codes[::2], codes[1::2], strict=False)]
    number, bits, out = 0, 0, []
    for at in range(0, len(pairs), _CHUNK):
        for value in pairs[at : at + _CHUNK]:
            number |= value << bits
            bits += 13 if value & 0x1FFF > 88 else 14
        whole = bits // 8
        out.append((number & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
        number >>= 8 * whole
        bits -= 8 * whole
    if len(codes) % 2:  # what is left, and one more character, make the last byte
        out.append(((number | codes[-1] << bits) & 255).to_bytes(1, "little"))
    return b"".join(out)


def pack_quaternions(rows: list[tuple[int, float, float, float, float]]) -> bytes:
    """A count, then (time, w, x, y, z) of each, little-endian 64-bit."""
    return struct.pack("<Q", len(rows)) + b"".join(struct.pack("<q4d", *r) for r in rows)


def unpack_quaternions(data: bytes) -> list[tuple[int, float, float, float, float]]:
    """A payload whose length doesn't fit its count raises."""
    (n,) = struct.unpack_from("<Q", data)
    if len(data) != 8 + 40 * n:
        raise ValueError("a cut or overlong quaternion payload")
    return [struct.unpack_from("<q4d", data, 8 + 40 * i) for i in range(n)]


def envelope(data: bytes) -> str:
    return base91_encode(zlib.compress(data, 9))


def open_envelope(text: str) -> bytes:
    return zlib.decompress(base91_decode(text)) if text else b""


def merge(a: Any, b: Any) -> Any:
    """Objects merge by key, lists follow one another, an object joins a list, anything else is replaced."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: merge(a[k], v) if k in a else v for k, v in b.items()}
    if isinstance(a, list):
        return a + (b if isinstance(b, list) else [b]) if isinstance(b, (list, dict)) else b
    return b


def _mapped(f: Callable, kind: str) -> Callable[[Column], Column]:
    """A function on a column, made when it is called: a session must be there by then."""


    def each(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return lambda c: F.pandas_udf(each, kind)(c)


base91 = _mapped(lambda x: base91_encode(bytes(x)), "string")
unbase91 = _mapped(base91_decode, "binary")
zip91 = _mapped(lambda x: envelope(bytes(x)), "string")
unzip91 = _mapped(open_envelope, "binary")


def merged_text(x: str | None, y: str | None) -> str | None:
    if x is None or y is None:
        return y if x is None else x
    return json.dumps(merge(json.loads(x), json.loads(y)), sort_keys=True, separators=(",", ":"))


def merge_json(a: Column, b: Column) -> Column:
    """Both as JSON text; the result has sorted keys."""

    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([merged_text(u, v) for u, v in zip(x, y, strict=True)])

    return F.pandas_udf(both, "string")(a, b)


def cbor_head(major: int, n: int) -> bytes:
    """A head with the shortest argument."""
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise ValueError("too large a number")


def cbor(x: Any) -> bytes:
    """Canonical CBOR of JSON-like values: shortest heads, shortest exact floats."""
    if x is None or isinstance(x, bool):
        return bytes([{None: 0xF6, True: 0xF5, False: 0xF4}[x]])
    if isinstance(x, int):
        return cbor_head(0, x) if x >= 0 else cbor_head(1, -1 - x)
    if isinstance(x, float):
        if x != x:
            return b"\xf9\x7e\x00"
        for code, form in ((0xF9, ">e"), (0xFA, ">f")):
            try:
                if struct.unpack(form, data := struct.pack(form, x))[0] == x:
                    return bytes([code]) + data
            except (OverflowError, struct.error):
                continue
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, str):
        data = x.encode()
        return cbor_head(3, len(data)) + data
    if isinstance(x, (bytes, bytearray)):
        return cbor_head(2, len(x)) + bytes(x)
    if isinstance(x, (list, tuple)):
        return cbor_head(4, len(x)) + b"".join(map(cbor, x))
    if isinstance(x, dict):
        return cbor_head(5, len(x)) + b"".join(cbor(k) + cbor(v) for k, v in x.items())
    raise TypeError(type(x))


def uncbor(data: bytes) -> Any:
    """The value of a whole CBOR text."""

    def read(at: int) -> tuple[Any, int]:
        major, info = data[at] >> 5, data[at] & 31
        at += 1
        if major == 7:
            if info in (20, 21, 22):
                return (False, True, None)[info - 20], at
            form, size = {25: (">e", 2), 26: (">f", 4), 27: (">d", 8)}[info]
            return struct.unpack_from(form, data, at)[0], at + size
        n = info
        if info >= 24:
            size = 1 << (info - 24)
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if major < 2:
            return (n if major == 0 else -1 - n), at
        if major in (2, 3):
            part = bytes(data[at : at + n])
            return (part if major == 2 else part.decode()), at + n
        items = []
        for _ in range(n * (2 if major == 5 else 1)):
            v, at = read(at)
            items.append(v)
        return (items if major == 4 else dict(zip(items[::2], items[1::2], strict=True))), at

    value, end = read(0)
    if end != len(data):
        raise ValueError("bytes behind the value")
    return value
