"""Benchmark decontamination by spaced seeds.

Fixed masks of ``SPAN`` words ignore some positions, so a window still hashes alike when ignored
words were substituted. Hashes of benchmark windows meet those of documents; around
each hit the two texts are laid against each other on the hit's diagonal, and the best
run (a match counts 1, a substitution costs ``COST``) decides: it must match half of the item or
``MIN_WHOLE`` words. Runs on diagonals within ``NEAR`` of each other, which inserted or missing words
part, are added up. Texts are case-folded as Unicode
has it and in form NFC; words are what marks, symbols and spaces, of ASCII or not, separate.

Where the benchmark's windows are ``MAX_BROADCAST`` at most, their sorted hashes are
broadcast and documents are read once, without a shuffle. Beyond that bound documents' window
hashes are joined by a shuffle, and hits are joined with both texts.

Defined results. Items of fewer than ``SPAN`` words must occur whole and unchanged; those of
fewer than ``MIN_WORDS`` are no evidence and are passed over, as are null items. Null texts
are clean. A document that matches no item has no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import U64, id_text, map_arrow, mix, steps, words_of
from chronoweave.runtime import cut

SPAN = 11
#: 1: the word counts; 0: it may be any. Each has weight 7, and both ends count.
MASKS = ("11011010011", "11100101101", "10110101011")
MIN_WORDS = 5
#: A run must have this share of matching words, and this many words or the whole item,
MIN_IDENTITY, MIN_RUN = 0.8, 12
#: and cover this share of the item, or this many of its words.
MIN_SHARE, MIN_WHOLE = 0.5, 13
#: Diagonals this close are one copy with words inserted or left out; runs of so many matches add up.
NEAR, MIN_PIECE = 4, 4
COST = 2.0
MAX_BROADCAST = 2_000_000

Hit = tuple[int, int, int, int, int]


def folded(texts: pa.Array) -> pa.Array:
    """Texts without case, in form NFC, with spaces for non-ASCII marks, symbols and spaces;
    ASCII texts are as they are."""
    found = [t or "" for t in texts.to_pylist()]
    other = [i for i, t in enumerate(found) if not t.isascii()]
    if not other:
        return texts
    for i in other:
        found[i] = unicodedata.normalize("NFC", found[i].casefold())
    marks = [c for c in set().union(*(found[i] for i in other)) if c > "\x7f" and unicodedata.category(c)[0] in "PSZ"]
    if marks:
        spaces = re.compile(f"[{''.join(map(re.escape, sorted(marks)))}]").sub
        for i in other:
            found[i] = spaces(" ", found[i])
    return pa.array(found, pa.large_string())


def seeds(words: np.ndarray, rows: np.ndarray, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes and the word index where each window starts: every mask over every
    window within a row, and plain windows of the lengths in ``short``."""
    hashes, places = [], []
    for k, mask in enumerate((*MASKS, *("1" * n for n in short))):
        span = len(mask)
        total = len(words) - span + 1
        if total <= 0:
            continue
        with np.errstate(over="ignore"):
            h = np.full(total, U64((k if span == SPAN else 100 + span) * 0x51_7C_C1_B7 + 1))
            for i, c in enumerate(mask):
                if c == "1":
                    h = mix(h * U64(0x9E3779B97F4A7C15) + words[i : i + total])
        at = np.flatnonzero(rows[:total] == rows[span - 1 :])
        hashes.append(h[at])
        places.append(at)
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def best_run(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """The best-scoring run (first and last + 1 word in ``doc``, matches) on a diagonal: word
    ``i`` of the item against word ``i + diagonal`` of the document."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return None
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -COST))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return lo + diagonal + start, lo + diagonal + end, int(same[start:end].sum())


def verified(run: tuple[int, int, int] | None, n_item: int) -> bool:
    if run is None:
        return False
    length, matches = run[1] - run[0], run[2]
    if n_item < SPAN:
        return matches == n_item
    return length >= min(n_item, MIN_RUN) and matches >= MIN_IDENTITY * length and matches >= min(MIN_SHARE * n_item, MIN_WHOLE)


def added_up(doc: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple[int, int, int] | None:
    """First and last + 1 word in ``doc``, and matches, of the runs on close diagonals together."""
    best = None
    for chain in np.split(np.array(diagonals), np.flatnonzero(np.diff(diagonals) > NEAR) + 1):
        around = sorted({int(x) + k for x in chain for k in range(-NEAR, NEAR + 1)})
        of_item, of_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
        for diagonal in around:
            run = best_run(doc, item, diagonal)
            if run is None or run[2] < MIN_PIECE or run[2] < MIN_IDENTITY * (run[1] - run[0]):
                continue
            at = np.arange(run[0], run[1])
            at = at[doc[at] == item[at - diagonal]]
            of_doc[at] = True
            of_item[at - diagonal] = True
        places = np.flatnonzero(of_doc)
        matches = int(min(of_item.sum(), len(places)))
        if matches and (best is None or best[2] < matches):
            best = int(places[0]), int(places[-1]) + 1, matches
    return best


class Benchmark:
    """Items' words, and their window hashes sorted for look-up."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, rows, _, _ = words_of(folded(pa.array(texts, pa.string())), marks_too=True)
        counts = np.bincount(rows, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.ids = np.array(ids, np.int64)
        self.ends = np.cumsum(counts)
        self.words = words
        self.short = tuple(sorted({int(c) for c in counts if MIN_WORDS <= c < SPAN}))
        hashes, places = seeds(words, rows, self.short)
        row = rows[places]
        at = places - (self.ends - counts)[row]
        # a short window stands for items of its own length alone
        of_short = np.zeros(len(hashes), bool)
        n = counts[row]
        whole = {int(h) for c in self.short for h in _plain(words, rows, c, counts)}
        if self.short:
            of_short = np.isin(hashes, np.array(sorted(whole), U64))
        keep = (n >= SPAN) & ~of_short | (n < SPAN) & of_short
        by = np.argsort(hashes[keep], kind="stable")
        self.hashes, self.item, self.at = hashes[keep][by], row[keep][by], at[keep][by]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes & U64((1 << 22) - 1)).astype(np.int64)] = True

    def of(self, k: int) -> np.ndarray:
        return self.words[(self.ends[k - 1] if k else 0) : self.ends[k]]


def _plain(words: np.ndarray, rows: np.ndarray, n: int, counts: np.ndarray) -> np.ndarray:
    """Hashes of the whole items of ``n`` words."""
    keep = counts[rows] == n
    w = words[keep].reshape(-1, n)
    with np.errstate(over="ignore"):
        h = np.full(len(w), U64((100 + n) * 0x51_7C_C1_B7 + 1))
        for i in range(n):
            h = mix(h * U64(0x9E3779B97F4A7C15) + w[:, i])
    return h


def overlaps(bench: Benchmark, texts: pa.Array) -> dict[int, list[Hit]]:
    """By row: (item_id, first word, last word + 1, matches, words of the item)."""
    words, rows, _, _ = words_of(folded(texts), marks_too=True)
    hashes, places = seeds(words, rows, bench.short)
    maybe = np.flatnonzero(bench.bits[(hashes & U64((1 << 22) - 1)).astype(np.int64)])
    left = np.searchsorted(bench.hashes, hashes[maybe], "left")
    right = np.searchsorted(bench.hashes, hashes[maybe], "right")
    starts = np.searchsorted(rows, np.arange(len(texts) + 1))
    hit: dict[tuple[int, int], set[int]] = {}
    for m, a, b in zip(maybe[right > left].tolist(), left[right > left].tolist(), right[right > left].tolist(), strict=True):
        place = int(places[m])
        row = int(rows[place])
        for k in range(a, b):
            hit.setdefault((row, int(bench.item[k])), set()).add(place - int(starts[row]) - int(bench.at[k]))
    best: dict[tuple[int, int], Hit] = {}
    for (row, item), diagonals in hit.items():
        doc, target = words[int(starts[row]) : int(starts[row + 1])], bench.of(item)
        runs = [run for x in sorted(diagonals) if verified(run := best_run(doc, target, x), len(target))]
        # a copy with words inserted or left out lies on several diagonals
        if len(target) >= SPAN and max((run[2] for run in runs), default=0) < len(target):
            whole = added_up(doc, target, sorted(diagonals))
            if whole and whole[2] >= min(max(MIN_SHARE * len(target), MIN_RUN), MIN_WHOLE) and whole[2] >= MIN_SHARE * (whole[1] - whole[0]):
                runs.append(whole)
        if runs:
            best[row, item] = (int(bench.ids[item]), *max(runs, key=lambda run: run[2]), len(target))
    out: dict[int, list[Hit]] = {}
    for (row, _), hit in sorted(best.items()):
        out.setdefault(row, []).append(hit)
    return out


SCHEMA = "doc_id long, item_ids array<long>, max_share double, overlaps array<struct<item_id:long,first_word:long,end_word:long,matches:long,item_words:long>>"
_HITS = pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "first_word", "end_word", "matches", "item_words")]))


def _batch(ids: list, hits: list[list[Hit]]) -> pa.RecordBatch:
    names = ("item_id", "first_word", "end_word", "matches", "item_words")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([sorted({h[0] for h in x}) for x in hits], pa.list_(pa.int64())),
            pa.array([max(h[3] / h[4] for h in x) for x in hits], pa.float64()),
            pa.array([[dict(zip(names, h, strict=True)) for h in x] for x in hits], _HITS),
        ],
        names=["doc_id", "item_ids", "max_share", "overlaps"],
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row for each document that overlaps an item: SCHEMA."""
    spark = docs.sparkSession
    source = id_text(docs, id_col, text_col)
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("text")).where("item_id is not null and text is not null")
    # a text of n characters has n / 2 words at most
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) / 2 * len(MASKS) > max_broadcast:
        return _shuffled(source, items)
    rows = sorted((r["item_id"], r["text"]) for r in items.collect())
    held = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(*held.value)
        for whole in batches:
            for batch in steps(whole, "text"):
                if found := overlaps(bench, batch.column("text")):
                    ids = batch.column("doc_id").to_pylist()
                    yield _batch([ids[r] for r in found], list(found.values()))

    return map_arrow(source, fn, SCHEMA)


def _shuffled(source: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: window hashes are joined, then texts verified."""

    def hashed(short: tuple[int, ...]):
        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in steps(whole, "text"):
                    words, rows, _, _ = words_of(folded(batch.column("text")), marks_too=True)
                    h, places = seeds(words, rows, short)
                    key = batch.column(0).to_numpy()[rows[places]] if len(places) else np.zeros(0, np.int64)
                    _, one = np.unique(np.stack([h.view(np.int64), key]), axis=1, return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)[one]), pa.array(key[one], pa.int64())], names=["h", "key"])

        return fn

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                bench = Benchmark(batch.column("item_id").to_pylist(), batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(bench.hashes.view(np.int64)), pa.array(bench.ids[bench.item], pa.int64())], names=["h", "item_id"])

    short = tuple(range(MIN_WORDS, SPAN))
    docs = cut(source.where("text is not null").withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text"), "decontaminate")
    left = map_arrow(docs, hashed(short), "h long, key long")
    right = map_arrow(items, of_items, "h long, item_id long").distinct()
    pairs = left.join(right, "h").select("key", "item_id").distinct()
    both = pairs.join(docs.withColumnRenamed("row", "key"), "key").join(items.withColumnRenamed("text", "item_text"), "item_id")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, hits = batch.to_pylist(), [], []
            for r in rows:
                found = overlaps(Benchmark([r["item_id"]], [r["item_text"]]), pa.array([r["text"]], pa.string()))
                if found:
                    ids.append((r["key"], r["doc_id"]))
                    hits.append(found[0][0])
            names = ("item_id", "first_word", "end_word", "matches", "item_words")
            yield pa.RecordBatch.from_arrays([pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int64()), pa.array([dict(zip(names, h, strict=True)) for h in hits], _HITS.value_type)], names=["row", "doc_id", "hit"])

    hit = "struct<item_id:long,first_word:long,end_word:long,matches:long,item_words:long>"
    one = map_arrow(both, fn, f"row long, doc_id long, hit {hit}")
    grouped = one.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list("hit")).alias("overlaps"))
    return grouped.select("doc_id", F.array_sort(F.array_distinct(F.transform("overlaps", lambda h: h["item_id"]))).alias("item_ids"), F.array_max(F.transform("overlaps", lambda h: h["matches"] / h["item_words"])).alias("max_share"), "overlaps")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that overlap an item, all columns as they are. Rows
    without a doc_id stay."""
    found = cut(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return docs.join(found, id_col, "left_anti")
