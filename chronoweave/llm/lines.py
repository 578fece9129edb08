"""Line de-duplication by range-partitioned hashes and per-document keep bitmaps.

Each document sends only (hash, doc_id, position) of its eligible lines. The rows are
range-partitioned by all three and sorted by hash, document (largest first) and position, so
one line held by a third of all documents is spread over many partitions. Every partition then
streams its runs batch by batch: a run's first row is its keeper, and no more of it is held than the rows of
the few documents that don't yet make it common. What a run that crosses a partition's edge needs from the neighbours is
two rows a partition. Bitmaps meet the texts by a broadcast while they are small, so that no text is
shuffled; beyond ``BROADCAST_BYTES`` both sides are.

Defined results. Null text: one empty line. A null doc_id: the document is kept as it is
and its lines count for nobody. Rows that share a doc_id count as one document; each row has the
bitmap of its own text, so rows with one id and different texts don't touch each other's lines. Empty
tables: empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import BROADCAST_BYTES, id_text, map_arrow, steps
from chronoweave.runtime import cut, discard, partitions

#: What is stripped from a line's ends: space, tab, LF, VT, FF, CR.
STRIP = " \t\n\x0b\x0c\r"
MIN_CODE_POINTS = 20
MIN_DOCS = 3


def line_keys(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """(h1, h2, doc_id, own, pos) of every line whose key has ``min_code_points`` at least: a
    128-bit hash of the stripped line with A-Z lower-cased; ``own`` tells the texts of one doc_id apart."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                hashes, rows, positions = [], [], []
                for row, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                    if not text or doc_id is None:
                        continue
                    for pos, line in enumerate(text.split("\n")):
                        if len(line) >= min_code_points and len(key := line.strip(STRIP)) >= min_code_points:
                            hashes.append(xxhash.xxh3_128_digest(key.encode().lower()))
                            rows.append(row)
                            positions.append(pos)
                pair = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), batch.column("doc_id").take(at), batch.column("own").take(at), pa.array(positions, pa.int32())], names=["h1", "h2", "doc_id", "own", "pos"])

    return map_arrow(docs.withColumn("own", F.xxhash64("text")), fn, "h1 long, h2 long, doc_id long, own long, pos int")


def _starts(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one hash start, and where runs of one document within them do."""
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_doc = new.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    return np.flatnonzero(new), new_doc


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last run of a partition: hash, documents, first and last doc_id."""
    from pyspark import TaskContext

    first: list[int] | None = None
    run: list[int] | None = None  # of the run that is open: h1, h2, documents, first, last
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
        starts, new_doc = _starts(h1, h2, doc)
        ends = np.append(starts[1:], len(h1))
        for i in sorted({0, len(starts) - 1}):
            a, b = int(starts[i]), int(ends[i])
            found = [int(h1[a]), int(h2[a]), int(new_doc[a:b].sum()), int(doc[a]), int(doc[b - 1])]
            if run is not None and run[:2] == found[:2]:
                run = [*run[:2], run[2] + found[2] - (run[4] == found[3]), run[3], found[4]]
            else:
                first, run = first or run, found
    if run is None:
        return
    part = TaskContext.get().partitionId()
    names = ["part", "at", "h1", "h2", "n", "top", "low"]
    out = [dict(zip(names, (part, k, *r), strict=True)) for k, r in enumerate((first, run)) if r is not None]
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("at", pa.int32()), *((x, pa.int64()) for x in names[2:])]))


def _crossing(edges: list) -> dict[tuple[int, int], tuple[int, int]]:
    """Documents and largest doc_id of each hash whose run lies in several partitions."""
    found: dict[tuple[int, int], list[int]] = {}
    seen: dict[tuple[int, int], int] = {}
    for r in sorted(edges, key=lambda r: (r["part"], r["at"])):
        key = (r["h1"], r["h2"])
        if key in found:  # a document cut by the edge counts once
            found[key][0] += r["n"] - (found[key][2] == r["top"])
            found[key][2] = r["low"]
        else:
            found[key] = [r["n"], r["top"], r["low"]]
        seen[key] = seen.get(key, 0) + 1
    return {k: (v[0], v[1]) for k, v in found.items() if seen[k] > 1}


def _dropped(crossing, min_docs: int):
    """Of sorted rows, (doc_id, own, pos) lists of the lines that go: those of runs with ``min_docs`` documents,
    except of the first document."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the rows of a run that isn't yet common
        open_: tuple[int, int, int] | None = None  # a common run that may go on: h1, h2, its first document

        def lists(batch: pa.RecordBatch, gone: np.ndarray) -> pa.RecordBatch:
            doc, own, pos = (batch.column(c).to_numpy()[gone] for c in ("doc_id", "own", "pos"))
            by = np.lexsort((pos, own, doc))
            doc, own, pos = doc[by], own[by], pos[by]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]))) if len(doc) else np.zeros(0, np.int64)
            made = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(pos.astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(own[first]), made], names=["doc_id", "own", "pos"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch, held = pa.concat_batches([held, batch]), None
            h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
            runs, new_doc = _starts(h1, h2, doc)
            counts, top = np.add.reduceat(new_doc.astype(np.int64), runs), doc[runs].copy()
            for i in sorted({0, len(runs) - 1}):
                key = (int(h1[runs[i]]), int(h2[runs[i]]))
                if (whole := crossing.value.get(key)) is not None:
                    counts[i], top[i] = whole
                elif open_ is not None and key == open_[:2]:
                    counts[i], top[i] = min_docs, open_[2]
            lengths = np.diff(np.append(runs, len(h1)))
            last = (int(h1[-1]), int(h2[-1]))
            open_ = (*last, int(top[-1])) if counts[-1] >= min_docs else None
            gone = (np.repeat(counts, lengths) >= min_docs) & (np.repeat(top, lengths) != doc)
            if open_ is None and last not in crossing.value:
                held = batch.slice(int(runs[-1]))
            if gone.any():
                yield lists(batch, gone)

    return fn


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, counts = [], []
        for pos in batch.column("pos").to_pylist():
            bits = np.ones(-(-(max(pos) + 1) // 8) * 8, np.uint8)
            bits[pos] = 0
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
            counts.append(len(set(pos)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("own"), pa.array(maps, pa.binary()), pa.array(counts, pa.int64())], names=["doc_id", "own", "keep", "n_drop"])


def drop_bitmaps(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, own, keep, n_drop), stored: for each text that loses lines, a zlib-compressed bitmap
    with bit i set if line i stays; lines past its end stay. ``own`` is the text's xxhash64.

    A key found in ``min_docs`` documents keeps its lines in the largest doc_id alone.
    """
    spark = docs.sparkSession
    keys = cut(line_keys(id_text(docs, id_col, text_col), min_code_points), "line-keys")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("own"), F.col("pos")]
    # a reliable checkpoint, since both passes must see the same partitions; the cleaner of spark.cleaner.referenceTracking.cleanCheckpoints deletes it
    ranged = keys.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).checkpoint()
    discard(keys)
    crossing = spark.sparkContext.broadcast(_crossing(map_arrow(ranged, _edges, "part int, at int, h1 long, h2 long, n long, top long, low long").collect()))
    dropped = map_arrow(ranged, _dropped(crossing, min_docs), "doc_id long, own long, pos array<int>")
    positions = dropped.groupBy("doc_id", "own").agg(F.flatten(F.collect_list("pos")).alias("pos"))
    return cut(map_arrow(positions, _pack, "doc_id long, own long, keep binary, n_drop long"), "line-bitmaps")


def _small(maps: DataFrame) -> DataFrame:
    """Bitmaps, marked for broadcast if their bytes are few."""
    size = maps.agg(F.sum(F.length("keep") + 64)).first()[0] or 0
    return F.broadcast(maps) if size <= BROADCAST_BYTES else maps


def _kept(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """What stays of a text, its lines before, and the lines dropped."""
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    gone = set(np.flatnonzero(bits[: len(lines)] == 0).tolist())
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def dedup_lines(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Apply the bitmaps: (doc_id, text, n_lines, n_dropped), one row for each input row.

    With ``digest`` the text is given as its lowercase hex SHA-256, ``kept_sha256``.
    """
    import hashlib

    source = id_text(docs, id_col, text_col)
    maps = _small(drop_bitmaps(docs, min_code_points, min_docs, id_col, text_col).select("doc_id", "own", "keep"))
    joined = source.withColumn("own", F.xxhash64("text")).join(maps, ["doc_id", "own"], "left").select("doc_id", "text", "keep")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in steps(whole, "text")):
            rows = [_kept(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True)]
            text = pa.array([hashlib.sha256(r[0].encode()).hexdigest() if digest else r[0] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["doc_id", "out", "n_lines", "n_dropped"])

    name = "kept_sha256" if digest else "text"
    return map_arrow(joined, fn, "doc_id long, out string, n_lines long, n_dropped long").withColumnRenamed("out", name)


def apply_bitmaps(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns in their order, with each text's dropped lines taken out; a null
    text stays null."""
    columns = [f"_c{i}" for i in range(len(docs.columns))]
    key, text = columns[docs.columns.index(id_col)], columns[docs.columns.index(text_col)]
    plain = docs.toDF(*columns)
    named = _small(maps).select(F.col("doc_id").alias("_doc_id"), F.col("own").alias("_own"), F.col("keep").alias("_keep"))
    same = (F.col(key).cast("long") == F.col("_doc_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_own"))
    joined = plain.join(named, same, "left").drop("_doc_id", "_own")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text)
        for batch in (part for whole in batches for part in steps(whole, text)):
            texts = [t if t is None else _kept(t, k)[0] for t, k in zip(batch.column(text).to_pylist(), batch.column("_keep").to_pylist(), strict=True)]
            arrays = [batch.column(c) for c in columns]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return map_arrow(joined, fn, schema).toDF(*docs.columns)
