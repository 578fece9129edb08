"""Shared pieces: Arrow mapping, vectorised word hashing, and cases every operator treats alike.

Every operator names its own columns by parameter, selects just those from its input (extra
columns, also with clashing names, never meet the operator's own), and treats a null text as
empty unless it says otherwise.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import ensure_shipped

U64 = np.uint64
#: Text that one vectorised step holds at a time, in bytes (one document at least).
STEP_BYTES = 2 << 20


#: What operators keep from task to task in a worker: the module of the last operator, and each module's way to let go.
_LAST: list[str] = []
KEPT: dict[str, Callable[[], None]] = {}


def release(module: str) -> None:
    """Workers outlive stages: lets go of what operators of other modules than ``module`` keep in this worker."""
    if _LAST == [module]:
        return
    _LAST[:] = [module]
    for owner, drop in KEPT.items():
        if owner != module:
            drop()


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do so; allocators would keep it for an idle worker."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package shipped to the executors, and without what earlier stages left in their workers."""
    ensure_shipped(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(fn.__module__)
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns (doc_id, text) of ``docs``, whatever else it holds."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null rows are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text holds at most ``most`` bytes, or one row."""
    _, offsets = bytes_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_TABLE_POSITIONS = 256
_TABLE: list[np.ndarray] = []


def _position_table() -> np.ndarray:
    """A random word for each pair of position in a word and byte value."""
    if not _TABLE:
        _TABLE.append(mix(np.arange(_TABLE_POSITIONS * 256, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(0x1234567)))
    return _TABLE[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment [start, end) of ``data``: a sum of one random word for
    every (position, byte), so that it vectorises over all segments at once."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    index = np.arange(int(lengths.sum()), dtype=np.int64)
    at = index + inside
    position = at - np.repeat(starts, lengths)
    if int(lengths.max()) <= _TABLE_POSITIONS:
        words = _position_table()[(position << 8) | data[at]]
    else:
        with np.errstate(over="ignore"):
            words = mix(((position.astype(U64) << U64(8)) | data[at].astype(U64)) * U64(0x9E3779B97F4A7C15) + U64(0x1234567))
    sums = np.add.reduceat(words, np.cumsum(lengths) - lengths)
    with np.errstate(over="ignore"):
        return mix(sums + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


#: Bytes that aren't an ASCII letter or digit, nor part of a longer UTF-8 sequence.
_MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def words_of(array: pa.Array, marks_too: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row, A-Z lower-cased: their hashes, the row of
    each, and byte starts and ends within the row's text. With ``marks_too`` ASCII marks
    separate words as spaces do."""
    data, offsets = bytes_of(array)
    data = _LOWER[data]
    inside = ~(_MARKS if marks_too else _SPACE)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[offsets[1:-1]] = True
    edge = edge[:-1]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:] & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return segment_hashes(data, starts, ends), rows, starts - offsets[rows], ends - offsets[rows]


def windows(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``n`` words within a row, and the row of each."""
    if len(words) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = len(words) - n + 1
    with np.errstate(over="ignore"):
        h = np.zeros(total, U64)
        for k in range(n):
            h = mix(h * U64(0x9E3779B97F4A7C15) + words[k : k + total] + U64(k + 1))
    keep = rows[:total] == rows[n - 1 :]
    return h[keep], rows[:total][keep]


#: Bytes of rows up to which a join may broadcast them.
BROADCAST_BYTES = 32 << 20


def checked(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if its rows take ``most`` bytes at most. Its columns must be of
    fixed width (8 bytes each and 16 a row in a hash table), and its rows should be stored already, so
    that counting them is cheap; beyond the bound joins shuffle."""
    wide = [f.name for f in df.schema if f.dataType.typeName() not in ("long", "integer", "short", "byte", "double", "float", "boolean")]
    if wide:
        raise ValueError(f"columns of no fixed width can't be checked by counting: {wide}")
    return F.broadcast(df) if df.count() * (16 + 8 * len(df.columns)) <= most else df


def frequent(df: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of ``df`` with the largest positive counts, at most ``most`` of them.

    A histogram of counts on a fine log scale (some thousand cells, whatever the input) gives
    the cut; rows of one cell go in or stay out together. No task sorts or gathers candidates."""
    cell = F.floor(F.log2(F.col(column).cast("double")) * 256).cast("int")
    total, cut_at = 0, None
    for r in sorted(df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["cell"]):
        total += r["n"]
        if total > most:
            break
        cut_at = r["cell"]
    return df.where(F.lit(False) if cut_at is None else cell >= cut_at)
