"""Protocol-buffer messages read without a schema: values by field number."""

from __future__ import annotations

import struct


def varint(n: int) -> bytes:
    """Seven bits a byte, the lowest first; negative numbers as 64-bit two's complement."""
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(*fields: tuple[int, int | float | str | bytes]) -> bytes:
    """A message of (number, value): ints as varints, floats as doubles, text and bytes with their length."""
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 1) + struct.pack("<d", value)
        else:
            body = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(body)) + body
    return out


class Message:
    """The fields of a message, in order. What stands behind a broken field is left out."""

    def __init__(self, data: bytes = b"") -> None:
        self.fields: dict[int, list[int | bytes]] = {}
        self._data, self._at = bytes(data), 0
        try:
            while self._at < len(self._data):
                tag = self._varint()
                value = self._value(tag & 7)
                self.fields.setdefault(tag >> 3, []).append(value)
        except (IndexError, ValueError):
            pass

    def _varint(self) -> int:
        n = shift = 0
        while True:
            byte = self._data[self._at]
            self._at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    def _value(self, kind: int) -> int | bytes:
        if kind == 0:
            return self._varint()
        if kind not in (1, 2, 5):
            raise ValueError("an unknown wire type")
        size = {1: 8, 5: 4}.get(kind) or self._varint()
        if self._at + size > len(self._data):
            raise IndexError("a cut field")
        self._at += size
        return self._data[self._at - size : self._at] if size else b""

    def all(self, number: int) -> list[int | bytes]:
        return self.fields.get(number, [])

    def has(self, number: int) -> bool:
        return number in self.fields

    def bytes(self, number: int) -> bytes:
        """The first value of a field with a length; empty if there is none."""
        return next((v for v in self.all(number) if not isinstance(v, int)), b"")

    def of(self, *path: int) -> Message:
        """The message nested under a path of field numbers; an empty one if there is none."""
        here = self
        for number in path:
            here = Message(here.bytes(number))
        return here

    def int(self, number: int) -> int:
        return next((v for v in self.all(number) if isinstance(v, int)), 0)

    def signed(self, number: int) -> int:
        n = self.int(number)
        return n - (1 << 64) if n >> 63 else n

    def text(self, number: int) -> str:
        return self.bytes(number).decode("utf-8", "replace").rstrip("\0")

    def real(self, number: int) -> float:
        """The first 32-bit or 64-bit float; 0 if there is none."""
        body = self.bytes(number)
        return struct.unpack("<f" if len(body) == 4 else "<d", body)[0] if len(body) in (4, 8) else 0.0

    def reals(self, number: int) -> list[float]:
        """Repeated 32-bit floats, one a field or packed."""
        body = b"".join(v for v in self.all(number) if not isinstance(v, int))
        return list(struct.unpack(f"<{len(body) // 4}f", body[: len(body) // 4 * 4]))
