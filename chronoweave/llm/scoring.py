"""Stupid-backoff scores, computed relationally.

1. Word counts over the whole corpus, by 64-bit hash. Every word counts for itself. The ``KNOWN`` most frequent
   get ids by rank and are broadcast with their counts; all others (rare below) go by their hash.
2. Counts of word pairs. Pairs of two of the ``HEAD`` most frequent words are the only ones that can be hot;
   their table has at most (HEAD + 1)^2 cells and is broadcast.
3. All other pairs of documents are exploded as (document, pair, times) and partitioned by the pair's hash. They
   travel in packed blocks, a block for each partition and part of it, whose columns' bytes lie plane by plane and are
   compressed. A partition's parts are joined one after the other: a part is sorted by pair, where a run's
   sum is the pair's count. What a rare word's count is missing for is joined with the table of 1.
4. Logs are summed by document.

All pairs are counted. One that occurs once was seen in the scored document alone, which can't speak for
itself, so it backs off:
S(w | v) = c(v, w) / c(v) if c(v, w) >= MIN_COUNT, else BACKOFF * c(w) / N; a document's first word has
its unigram share c(w) / N. A document's score is the mean of log S over its words.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

A caller may bound the vocabulary by ``size``: then all but the ``size`` most frequent words are the one word <unk>.

Defined results. Null or wordless texts: n_words 0, log_prob 0, score null. Rows that repeat
a doc_id are scored each for itself (and count each for itself).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import U64, frequent, id_text, map_arrow, mix, steps, words_of
from chronoweave.runtime import cut, partitions

#: Words that the model tells apart: all.
VOCABULARY = math.inf
#: Words whose counts are broadcast, and those of them whose pairs are.
KNOWN, HEAD = 65_536, 1024
MIN_COUNT, BACKOFF = 2, 0.4
#: Pairs (with repeats) in a part of a partition: the parts' number follows the corpus.
PART = 750_000
#: Text whose pairs are packed together, in bytes.
PACK_BYTES = 2 << 20
#: Rows whose sums by document a task holds at a time.
SUMS = 1 << 21
#: Set in every word's hash, so that as a signed number it is below all ids.
_RARE = U64(1 << 63)


class Vocabulary:
    """Ids by rank of the most frequent words' hashes. Other words are <unk>, the next id, in
    a ``closed`` vocabulary, else their own (negative) hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, head: int, closed: bool):
        by = np.argsort(hashes)
        self.hashes, self.ids = hashes[by], by.astype(np.int64)
        self.unknown, self.total, self.closed = len(hashes), total, closed
        self.counts = np.append(counts, max(0, total - int(counts.sum()))).astype(np.float64)
        self.head = min(head, self.unknown)
        #: In a pair's place: what stands before a first word.
        self.start = self.unknown + 1

    def of(self, words: np.ndarray) -> np.ndarray:
        words = words | _RARE
        other = np.full(len(words), self.unknown, np.int64) if self.closed else words.view(np.int64)
        if not len(self.hashes):
            return other
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.ids[at], other)

    def slot(self, ids: np.ndarray) -> np.ndarray:
        """Place in the head's table, or -1; <unk> is in the head."""
        return np.where(ids < 0, -1, np.where(ids < self.head, ids, np.where(ids == self.unknown, self.head, -1)))

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and rows of words, and the indices of words that follow another in their row."""
        words, rows, _, _ = words_of(texts)
        ids = self.of(words)
        follows = np.flatnonzero(rows[1:] == rows[:-1]) + 1 if len(rows) else np.zeros(0, np.int64)
        return ids, rows, follows, np.bincount(rows, minlength=len(texts))

    def log_count(self, ids: np.ndarray) -> np.ndarray:
        """0 for rare words and for marks."""
        return np.log(np.where((ids >= 0) & (ids <= self.unknown), self.counts[np.clip(ids, 0, self.unknown)], 1.0))


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n) of every word of the corpus, by 64-bit hash."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text", 8 << 20):
                h, n = np.unique(words_of(batch.column("text"))[0] | _RARE, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return map_arrow(docs, fn, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def fit_vocabulary(counts: DataFrame, size: float = VOCABULARY, head: int = HEAD, known: int = KNOWN) -> Vocabulary:
    """The words of the stored table ``counts`` that are broadcast."""
    closed = size != math.inf
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = sorted(frequent(counts, "n", size if closed else known).collect(), key=lambda r: (-r["n"], r["h"]))
    return Vocabulary(np.array([r["h"] for r in rows], np.int64).view(U64), np.array([r["n"] for r in rows], np.int64), total, head, closed)


def head_counts(docs: DataFrame, held) -> np.ndarray:
    """The table of pairs within the head: a bounded square."""
    width = held.value.head + 1

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        total = np.zeros(width * width, np.int64)
        for whole in batches:
            for batch in steps(whole, "text"):
                ids, _, follows, _ = v.pairs(batch.column("text"))
                a, b = v.slot(ids[follows - 1]), v.slot(ids[follows])
                both = (a >= 0) & (b >= 0)
                total += np.bincount(a[both] * width + b[both], minlength=width * width)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    found = map_arrow(docs, fn, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(width * width)
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return table


_PAIR = (np.int64, np.int64, np.int64, np.int32)
_OWN = (np.int64, np.int64, np.int64, np.float64, np.int8)


def pack(arrays: tuple[np.ndarray, ...], kinds: tuple[type, ...], press) -> bytes:
    """Arrays of one length, each as planes of its first, second, ... bytes, compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(x, k).view(np.uint8).reshape(len(x), np.dtype(k).itemsize).T).tobytes() for x, k in zip(arrays, kinds, strict=True)]
    return press.compress(b"".join(planes))


def unpack(data: bytes, kinds: tuple[type, ...], press) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(press.decompress(data), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(widths)
    ends = np.cumsum([n * w for w in widths])
    return tuple(np.ascontiguousarray(raw[e - n * w : e].reshape(w, n).T).view(k).reshape(n) for e, w, k in zip(ends.tolist(), widths, kinds, strict=True))


def score(docs: DataFrame, size: float = VOCABULARY, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """(doc_id, n_words, log_prob, score) of every row, under the counts of all rows."""
    spark = docs.sparkSession
    source = id_text(docs, id_col, text_col)
    counts = cut(word_counts(source), "word-counts")
    held = spark.sparkContext.broadcast(fit_vocabulary(counts, size, head, known))
    square = spark.sparkContext.broadcast(head_counts(source, held))

    n_parts = partitions(spark)
    splits = max(1, math.ceil(held.value.total / (n_parts * PART)))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of documents, with what the head gives them, and of their other pairs."""
        v, cells, press = held.value, square.value, zstandard.ZstdCompressor(level=1)
        width = v.head + 1
        for whole in batches:
            for batch in steps(whole, "text", PACK_BYTES):
                n = batch.num_rows
                ids, rows, follows, words = v.pairs(batch.column("text"))
                first = np.ones(len(ids), bool)
                first[follows] = False
                first = np.flatnonzero(first)
                sure = np.bincount(rows[first], v.log_count(ids[first]) - np.log(v.total), n) if len(first) else np.zeros(n)
                rare = first[ids[first] < 0]
                a, b = ids[follows - 1], ids[follows]
                sa, sb = v.slot(a), v.slot(b)
                both = (sa >= 0) & (sb >= 0)
                c = cells[sa[both] * width + sb[both]]
                logs = np.where(c >= MIN_COUNT, np.log(np.maximum(c, 1)) - v.log_count(a[both]), np.log(BACKOFF) + v.log_count(b[both]) - np.log(v.total))
                sure += np.bincount(rows[follows][both], logs, n) if both.any() else 0
                owner = np.concatenate([rows[follows][~both], rows[rare]])
                a = np.concatenate([a[~both], np.full(len(rare), v.start)])
                b = np.concatenate([b[~both], ids[rare]])
                names = batch.column("row").to_numpy()
                known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                part, split, data = [int(names[0] % n_parts)], [-1], [pack((names, batch.column("doc_id").fill_null(0).to_numpy(), words, sure, known), _OWN, press)]
                # by place, then by document and pair, whose repeats become one
                key = _pair_key(a, b)
                place = (key % U64(n_parts * splits)).astype(np.int64)
                by = np.lexsort((key, owner, place))
                owner, a, b, key, place = owner[by], a[by], b[by], key[by], place[by]
                new = np.ones(len(by), bool)
                new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(by)))
                owner, a, b, place = names[owner[at]], a[at], b[at], place[at]
                edges = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place)) if len(place) else np.zeros(1, np.int64)
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    part.append(int(place[i]) % n_parts)
                    split.append(int(place[i]) // n_parts)
                    data.append(pack((owner[i:j], a[i:j], b[i:j], times[i:j]), _PAIR, press))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(split, pa.int32()), pa.array(data, pa.binary())], names=["part", "split", "data"])

    rows = source.withColumn("row", F.monotonically_increasing_id())
    exploded = map_arrow(rows, explode, "part int, split int, data binary")
    # a pair outside the head is no more frequent than the word after the head
    dealt = exploded.repartitionById(n_parts, "part").sortWithinPartitions("split")

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By document, what is sure, and (need, weight): log counts of rare words still to be added."""
        v, press = held.value, zstandard.ZstdDecompressor()
        sums, size = [], 0

        def part(row, need, weight=None, ids=None, words=None, value=None) -> pa.RecordBatch:
            """Rows without a need go by their number, which no rare word has."""
            n = len(row)
            zero = pa.array(np.zeros(n, np.int64))
            columns = [pa.array(row), pa.array(need), zero if weight is None else pa.array(weight), pa.nulls(n, pa.int64()) if ids is None else ids, zero if words is None else pa.array(words), pa.array(np.zeros(n) if value is None else value)]
            return pa.RecordBatch.from_arrays(columns, names=["row", "need", "weight", "doc_id", "n_words", "log_prob"])

        for split, blocks in _splits(batches):
            if split < 0:
                for block in blocks:
                    row, ids, words, sure, known = unpack(block, _OWN, press)
                    yield part(row, row, None, pa.array(ids, mask=known == 0), words, sure)
                continue
            row, a, b, times = map(np.concatenate, zip(*(unpack(block, _PAIR, press) for block in blocks), strict=True))
            key = _pair_key(a, b)
            by = np.argsort(key)
            row, a, b, times, key = row[by], a[by], b[by], times[by].astype(np.int64), key[by]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.repeat(np.add.reduceat(times, starts), np.diff(np.append(starts, len(key))))
            first, seen = a == v.start, count >= MIN_COUNT
            logs = np.where(seen, np.log(np.maximum(count, 1)) - v.log_count(a), np.log(BACKOFF) + v.log_count(b) - np.log(v.total))
            value = np.where(first, 0.0, logs * times)  # a first word's share of N is sure
            word = np.where(seen & ~first, a, b)
            open_ = np.flatnonzero(word < 0)
            if len(open_):
                yield part(row[open_], word[open_], np.where(seen & ~first, -times, times)[open_])
            sums.append(_summed([(row, value)]))
            size += len(sums[-1][0])
            if size >= SUMS:
                sums = [_summed(sums)]
                size = len(sums[0][0])
                if size >= SUMS // 2:
                    yield part(sums[0][0], sums[0][0], value=sums[0][1])
                    sums, size = [], 0
        if sums:
            keys, value = _summed(sums)
            yield part(keys, keys, value=value)

    parts = map_arrow(dealt, price, "row long, need long, weight long, doc_id long, n_words long, log_prob double")
    parts = parts.join(counts.withColumnRenamed("h", "need"), "need", "left")
    log_prob = F.col("log_prob") + F.coalesce(F.col("weight") * F.log("n"), F.lit(0.0))
    total = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum(log_prob).alias("log_prob"))
    return total.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("score"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by key."""
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([x for _, x in parts]), len(keys))


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair."""
    with np.errstate(over="ignore"):
        return mix(mix(a.view(U64) * U64(0x9E3779B97F4A7C15)) + b.view(U64) * U64(0xD6E8FEB86659FD93))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Of rows sorted by split: each part with its blocks; documents' own blocks, of part -1, come one by one."""
    at, blocks = None, []
    for batch in batches:
        for split, data in zip(batch.column("split").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if split < 0:
                yield split, [data]
                continue
            if split != at and blocks:
                yield at, blocks
                blocks = []
            at = split
            blocks.append(data)
    if blocks:
        yield at, blocks
