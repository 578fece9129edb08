"""SentencePiece encoding and decoding that keeps every piece's span in the original bytes.

Normalisation walks the model's compiled character map (a double-array trie) by longest
prefix and records, for every byte it writes, the byte of the source it came from. No piece
reaches over some boundaries (checked against the vocabulary when the model is loaded): before
a space mark that follows another character, and around a line feed. So a text's ids are the
ids of its segments between such boundaries, which the library encodes once for each distinct
segment and worker; pieces' lengths add up to spans, and the alignment carries those back to
the original. That holds for models whose character map is empty, as the query's is; texts of
models with a map go whole to the library, whose own pieces and spans are taken.

The vocabulary file's path is a parameter. Where executors lack the file its bytes, which the
driver reads, are broadcast (models are some MB at most, checked by ``MAX_MODEL_BYTES``).

Defined results. Null text: as the empty text, which has no pieces besides begin and end ids.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.llm.common import KEPT, id_text, map_arrow

MAX_MODEL_BYTES = 64 << 20
#: Distinct segments that a worker remembers; it starts afresh when they are more.
REMEMBERED = 400_000
MARK = "▁"


class CharacterMap:
    """A compiled map: four bytes of trie size, the trie's units, then zero-ended results."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.results = blob[4 + size :] if size else b""

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(bytes matched, place of the result) of the longest key that starts at ``at``."""
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            c = data[k]
            node ^= c
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (k + 1 - at, self.units[node] & 0x7FFFFFFF)
        return found

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each the place in ``data`` of what it came from (and one
        more entry for the end)."""
        if not self.units:
            return data, np.arange(len(data) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit:
                step, place = hit
                piece = self.results[place : self.results.index(0, place)]
            else:
                first = data[at]
                step = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                piece = data[at : at + step]
            out += piece
            source += [at] * len(piece)
            at += step
        return bytes(out), np.array([*source, len(data)], np.int64)


class Pieces:
    """A loaded model: ids, spans and decoding of whole texts."""

    def __init__(self, model: bytes, begin: bool = True, end: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as messages

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = messages.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        inner = [p.piece for p in spec.pieces if p.type in (1, 4)]  # normal and user-defined pieces
        splits = not any(MARK in p.lstrip(MARK) for p in inner) and self.escape and not spec.trainer_spec.treat_whitespace_as_suffix
        # without those boundaries, or where a user-defined piece may hold anything, whole texts are the segments
        splits &= not any(p.type == 4 for p in spec.pieces) and not any("\n" in p for p in inner)
        self.segments = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if splits else "(?s).+").findall
        # the library's own normaliser must leave segments alone: only an identity map can be cut
        self.exact = splits and not self.map.units and not self.squeeze and spec.trainer_spec.byte_fallback
        # normalised bytes that a piece stands for: a byte piece is one byte of its character
        self.sizes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.begin, self.end = [self.library.bos_id()] * begin, [self.library.eos_id()] * end
        self.known: dict[str, bytes] = {}
        self.plain = self._without_prefix(spec) if self.exact else None

    def _without_prefix(self, spec):
        """The same model without the prefix, for segments inside a text."""
        import sentencepiece

        spec.normalizer_spec.add_dummy_prefix = False
        return sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())

    def _learn(self, segments: list[str]) -> None:
        for s, ids in zip(segments, self.plain.encode(segments, num_threads=1), strict=True):
            self.known[s] = np.array(ids, "<u4").tobytes()

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The text that pieces are made of, and the source byte of each of its bytes."""
        data = text.encode()
        out, source = self.map.apply(data)
        if not out:
            return "", np.zeros(1, np.int64)
        b = np.frombuffer(out, np.uint8)
        source = np.append(np.repeat(source[:-1], np.where(b == 32, 3, 1)), source[-1])
        text = out.decode().replace(" ", MARK)
        if self.prefix:
            text, source = MARK + text, np.concatenate([np.zeros(3, np.int64), source])
        return text, source

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end ids, and the original byte span [begin, end) of each."""
        if not self.exact:
            return self._whole(text)
        norm, source = self.normalised(text)
        segments = self.segments(norm)
        known = self.known
        if new := [s for s in dict.fromkeys(segments) if s not in known]:
            if len(known) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(segments))
            self._learn(new)
        ids = np.frombuffer(b"".join([known[s] for s in segments]), "<u4")
        stops = np.cumsum(self.sizes[ids])
        stops = source[stops]
        starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
        size = len(text.encode())
        wrap = lambda x, a, b: np.concatenate([np.full(len(self.begin), a, np.int64), x, np.full(len(self.end), b, np.int64)])
        return np.concatenate([np.array(self.begin, "<u4"), ids, np.array(self.end, "<u4")]), wrap(starts, 0, size), wrap(stops, 0, size)

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For models that texts can't be cut for: the library's own pieces and spans."""
        size = len(text.encode())
        pieces = self.library.encode(text, return_type="proto").pieces
        ids = [*self.begin, *(p.id for p in pieces), *self.end]
        spans = [(0, 0)] * len(self.begin) + [(p.begin, p.end) for p in pieces] + [(size, size)] * len(self.end)
        return np.array(ids, "<u4"), np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return model


_LOADED: dict[tuple, Pieces] = {}
KEPT[__name__] = _LOADED.clear


def loaded(model: bytes, begin: bool, end: bool) -> Pieces:
    """One loaded model for each worker."""
    key = (hashlib.sha256(model).digest(), begin, end)
    if key not in _LOADED:
        _LOADED[key] = Pieces(model, begin, end)
    return _LOADED[key]


#: What encode() can return for each document.
OUTPUTS = {"ids": "array<int>", "begins": "array<long>", "ends": "array<long>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "n_bytes_covered": "long"}


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "begins", "ends"), begin: bool = True, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``outputs`` of each document; begins and ends are byte offsets in the text."""
    held = docs.sparkSession.sparkContext.broadcast(load(path))

    def row(p: Pieces, text: str) -> dict:
        ids, begins, ends = p.encode(text)
        out: dict = {"n_tokens": len(ids), "n_bytes_covered": int((ends - begins).sum())}
        if "ids" in outputs:
            out["ids"] = ids.astype(np.int32)
        out |= {"begins": begins, "ends": ends} if "begins" in outputs or "ends" in outputs else {}
        if "ids_sha256" in outputs:
            out["ids_sha256"] = hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
        if "decoded" in outputs or "decoded_sha256" in outputs:
            out["decoded"] = p.decode(ids)
            out["decoded_sha256"] = hashlib.sha256(out["decoded"].encode()).hexdigest()
        return {k: out[k] for k in outputs}

    kinds = {"array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "string": pa.string(), "long": pa.int64()}
    wanted = [pa.field(k, kinds[OUTPUTS[k]]) for k in outputs]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(held.value, begin, end)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [row(p, t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[f.name] for r in rows], f.type) for f in wanted)], names=["doc_id", *outputs])

    return map_arrow(id_text(docs, id_col, text_col), fn, ", ".join(["doc_id long", *(f"{k} {OUTPUTS[k]}" for k in outputs)]))
