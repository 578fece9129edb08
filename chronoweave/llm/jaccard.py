"""Exact Jaccard components over word shingles, by prefix filters under several global orders.

Equal shingle sets are one class and go through the join once. Under a global order of
shingles two sets of Jaccard similarity t or more share one of their first
``n - ceil(t n) + 1`` shingles. Every order here puts the heavy shingles (a bounded list of
those in many classes, the same on all tasks) last and orders the others by a hash of its own, so
shared passages seldom reach a prefix.

* The first order's prefixes are grouped by shingle. Stars, not pairs, leave a group: each
  member with the group's leader; members that are already connected to it are passed over. A member
  keeps the leader it shares most with, and after verification components grow.
* After the star rounds only pairs between different components remain. A class that can be in
  one shares enough prefix shingles with other components' classes of some band of sizes: as many as the
  band's sizes ask for, less what fits outside the prefixes. Such classes give all their shingles, which are put in a third
  kind of order: by the exact number of those classes that hold them, and those that one component
  alone holds come first. What a class shares with no other component then fills its prefix, so
  that an edited copy below the threshold seldom has a shared shingle in it, and the position of one
  that it has bounds the overlap closely. Pairs come from these prefixes,
  must share as many first-order prefix shingles as their sizes ask for, and must meet the
  other orders' prefix filters as well, before their sets are intersected. So no link between
  components is lost, and no group's pairs are all made.

Classes go by 64 bits of a 128-bit digest of their set; where two digests agree in those, which is
found by counting, the other 64 bits stand in.

Sizes in 100ths: two sets link if 100 * intersection >= ``threshold`` * union.

Defined results. Null or wordless text: no shingles, linked with nothing. Fewer than ``width``
words: one shingle, the whole sequence. Repeated rows each get a row. A null doc_id has a row and
no say in a component's name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.llm.common import U64, checked, frequent, id_text, map_arrow, mix, steps, windows, words_of
from chronoweave.llm.graph import components
from chronoweave.runtime import cut, discard, partitions

WIDTH, THRESHOLD = 5, 75
#: Heavy shingles that orders put last, whatever the input's size; and from how many classes
#: among HEAVY_BLOCK shingles of a task one is proposed.
HEAVY, HEAVY_FROM, HEAVY_BLOCK = 100_000, 4, 4_000_000
#: Star rounds before remaining pairs are enumerated.
STAR_ROUNDS = 1
#: Leaders that a member is held against in a round: those that it shares most with.
LEADERS = 3
#: A round that links less than this share of its pairs is the last.
WORTH = 0.05
#: Members of one leader that are verified together.
SHARE = 512
ORDERS = 3


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by (row, hash), the row of each, and each row's count."""
    words, rows, _, _ = words_of(texts)
    h, of = windows(words, rows, width)
    counts = np.bincount(rows, minlength=len(texts)) if len(rows) else np.zeros(len(texts), np.int64)
    for n in range(1, width):
        mine = np.flatnonzero(counts[rows] == n) if len(rows) else np.zeros(0, np.int64)
        if len(mine):
            w = words[mine].reshape(-1, n)
            with np.errstate(over="ignore"):
                x = np.full(len(w), U64(n) * U64(0xA24BAED4963EE407))
                for k in range(n):
                    x = mix(x * U64(0x9E3779B97F4A7C15) + w[:, k])
            h, of = np.concatenate([h, x]), np.concatenate([of, rows[mine].reshape(-1, n)[:, 0]])
    by = np.lexsort((h, of))
    h, of = h[by], of[by]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[keep], of[keep]
    return h, of, np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)


def _digests(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit digest of each row's set."""
    ends = np.cumsum(counts)
    data = h.view(np.uint8)
    raw = b"".join(xxhash.xxh3_128_digest(data[8 * (e - n) : 8 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True))
    both = np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _classes(h: np.ndarray, counts: np.ndarray, clash: list[int]) -> list[int | None]:
    """The name of each row's class: the digest's first half, or its second for names in ``clash``."""
    first, second = _digests(h, counts)
    if clash:
        first = np.where(np.isin(first, clash), second, first)
    return [c if n else None for c, n in zip(first.tolist(), counts.tolist(), strict=True)]


def _signatures(width: int):
    """Rows of two kinds: documents (doc_id, n, both halves of the digest), and proposals of heavy shingles (token, n)."""

    def rows(kind: int, a: np.ndarray | list, n: np.ndarray, cls: pa.Array, other: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(a, pa.int64()), pa.array(n, pa.int64()), cls, other], names=["kind", "id", "n", "cls", "other"])

    def heavy(block: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, n = np.unique(np.concatenate(block), return_counts=True)
        often = np.flatnonzero(n >= HEAVY_FROM)
        often = often[np.argsort(-n[often], kind="stable")][: HEAVY // 4]
        if len(often):
            none = pa.nulls(len(often), pa.int64())
            yield rows(1, tokens[often].view(np.int64), n[often], none, none)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        block: list[np.ndarray] = []
        held = 0
        for whole in batches:
            for batch in steps(whole, "text"):
                h, of, counts = shingle_sets(batch.column("text"), width)
                first, second = _digests(h, counts)
                yield rows(0, batch.column("doc_id").cast(pa.int64()), counts, pa.array(first, mask=counts == 0), pa.array(second, mask=counts == 0))
                new = np.array([n > 0 and not (c in seen or seen.add(c)) for c, n in zip(first.tolist(), counts.tolist(), strict=True)], bool)
                block.append(h[new[of]])
                held += len(block[-1])
                if held >= HEAVY_BLOCK:
                    yield from heavy(block)
                    block, held = [], 0
        if held:
            yield from heavy(block)

    return fn


class Orders:
    """Global orders of shingles: by heaviness, then by the order's own hash."""

    def __init__(self, heavy: np.ndarray):
        by = np.argsort(heavy)
        self.tokens, self.rank = heavy[by], by.astype(U64)

    def keys(self, h: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """A sort key for each shingle, and whether it is heavy."""
        with np.errstate(over="ignore"):
            key = mix(h + U64(order + 1) * U64(0x9E3779B97F4A7C15)) >> U64(1)
        heavy = np.zeros(len(h), bool)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
            heavy = self.tokens[at] == h
            # among heavy shingles all orders start from the least heavy; a hash splits ranks of one size
            key[heavy] = (U64(1) << U64(63)) + (self.rank[at[heavy]] >> U64(2 * order)) * U64(1 << 8) + (key[heavy] >> U64(55))
        return key, heavy

    def prefix(self, h: np.ndarray, order: int, threshold: int) -> np.ndarray:
        """One set's shingles that come first."""
        n = len(h)
        p = n - (-(-threshold * n // 100)) + 1
        key, _ = self.keys(h, order)
        return h[np.lexsort((h, key))[:p]]


def _prefixes(held, width: int, threshold: int, salts: int, clash: list[int]):
    """(token, salt, cls, n, pos): the first order's prefix rows, each class once a task."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(held.value)
        seen: set = set()
        for whole in batches:
            for batch in steps(whole, "text"):
                h, of, counts = shingle_sets(batch.column("text"), width)
                names = _classes(h, counts, clash)
                new = np.array([not (c is None or c in seen or seen.add(c)) for c in names], bool)
                keep = new[of]
                h, of = h[keep], of[keep]
                key, heavy = orders.keys(h, 0)
                by = np.lexsort((h, key, of))
                h, of, heavy = h[by], of[by], heavy[by]
                counts = np.where(new, counts, 0)
                starts = np.cumsum(counts) - counts
                pos = np.arange(len(h)) - starts[of]
                first = pos < (counts - (-(-threshold * counts // 100)) + 1)[of]
                h, of, heavy, pos = h[first], of[first], heavy[first], pos[first]
                cls = np.array([c or 0 for c in names], np.int64)[of]
                # salt 0 is for shingles that aren't heavy
                salt = np.where(heavy, U64(1) + cls.view(U64) % U64(salts), U64(0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salt), pa.array(cls), pa.array(counts[of].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["token", "salt", "cls", "n", "pos"])

    return fn


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, salt, cls): those of groups with two classes or more, without
    repeats. A group that ends one batch and starts the next is carried over by its last row;
    that a group goes on is known from its salt, too, since other salts may hold the rest."""
    tail: pa.RecordBatch | None = None

    def groups(batch: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        token, cls, salt = (batch.column(c).to_numpy() for c in ("token", "cls", "salt"))
        if not len(token):
            return batch, None
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        distinct = new.copy()
        distinct[1:] |= cls[1:] != cls[:-1]
        starts = np.flatnonzero(new)
        cut_at = len(token) if last else int(starts[-1])
        run = np.cumsum(new) - 1
        count = np.bincount(run[distinct], minlength=len(starts))
        keep = distinct & ((count[run] > 1) | (salt > 0))
        keep[cut_at:] = False
        return batch.take(pa.array(np.flatnonzero(keep))), batch.slice(cut_at)

    for batch in batches:
        if tail is not None and tail.num_rows:
            batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        if batch.num_rows:
            out, tail = groups(batch, False)
            if out.num_rows:
                yield out
    if tail is not None and tail.num_rows:
        yield groups(tail, True)[0]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of shingles as bytes."""
    for batch in batches:
        data = [np.array(t, np.int64).tobytes() for t in batch.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array(data, pa.binary())], names=["cls", "n", "shingles"])


def _sets(width: int, clash: list[int]):
    """A class's set from the text of its first document. ``cls`` is what is asked for, if a
    document was named for it: a repeated doc_id with another text is passed over."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                h, _, counts = shingle_sets(batch.column("text"), width)
                ends = np.cumsum(counts)
                names = _classes(h, counts, clash)
                own = [b is not None and (a is None or a == b) for a, b in zip(batch.column("cls").to_pylist(), names, strict=True)]
                data = [h[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                made = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(counts.astype(np.int32)), pa.array(data, pa.binary())], names=["cls", "n", "shingles"])
                yield made.filter(pa.array(own, pa.bool_()))

    return fn


class Sets:
    """Whole sets of classes, read from texts when first asked for."""

    def __init__(self, docs: DataFrame, first: DataFrame, width: int, clash: list[int]):
        self.docs, self.first, self.fn = docs, first, _sets(width, clash)
        self.tables: list[DataFrame] = []

    def all(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.union(t)
        return out

    def of(self, wanted: DataFrame) -> DataFrame:
        """(cls, n, shingles) with those of ``wanted`` (cls, distinct) among them."""
        if self.tables:
            wanted = wanted.join(self.all().select("cls"), "cls", "left_anti")
        missing = cut(self.first.join(wanted, "cls"), "wanted-classes")
        if not self.tables or not missing.isEmpty():
            schema = "cls long, n int, shingles binary"
            texts = self.docs.join(checked(missing.where("doc_id is not null")), "doc_id").select("cls", "text")
            found = map_arrow(texts, self.fn, schema)
            nameless = missing.where("doc_id is null").select("cls")
            if not nameless.isEmpty():  # rows without a doc_id are looked through for their classes
                own = map_arrow(self.docs.where("doc_id is null").select(F.lit(None).cast("long").alias("cls"), "text"), self.fn, schema)
                found = found.union(own.join(checked(nameless), "cls", "left_semi").dropDuplicates(["cls"]))
            self.tables.append(cut(found, "shingle-sets"))
        discard(missing)
        return self.all()


Test = Callable[[np.ndarray, np.ndarray, int, int], bool]


def _passing(make: Callable[[], Callable[[np.ndarray, int], Test]]):
    """Rows sorted by (x, share, cls is not x): the first of each group holds x's shingles. Keeps
    the pairs for which ``make()(x's shingles, x's size)`` says yes to (y's shingles, y's size)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepare, x, test = make(), None, None
        for batch in batches:
            us, vs = [], []
            for a, b, n, data in zip(*(batch.column(c).to_pylist() for c in ("x", "cls", "n", "shingles")), strict=True):
                h = np.frombuffer(data, U64)
                if a == b:
                    x, test = a, prepare(h, n)
                elif x != a:
                    raise RuntimeError("a group without its leader's set")
                elif test(h, n):
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return fn


def _linked(held, threshold: int):
    """The whole test, on whole sets: other orders' prefixes meet, then sets are intersected."""

    def make():
        orders = Orders(held.value)

        def prepare(own: np.ndarray, size: int):
            firsts = [orders.prefix(own, k, threshold) for k in range(1, ORDERS)]

            def test(h: np.ndarray, n: int) -> bool:
                if 100 * min(n, size) < threshold * max(n, size):
                    return False
                if not all(np.isin(orders.prefix(h, k, threshold), f, assume_unique=True).any() for k, f in enumerate(firsts, 1)):
                    return False
                common = len(np.intersect1d(h, own, assume_unique=True))
                return 100 * common >= threshold * (n + size - common)

            return test

        return prepare

    return _passing(make)


def _promising(threshold: int):
    """A bound from the first order's prefixes alone: what isn't in both lies in the rest of the one that ends first."""

    def make():
        def prepare(own: np.ndarray, size: int):
            def test(h: np.ndarray, n: int) -> bool:
                if 100 * min(n, size) < threshold * max(n, size):
                    return False
                need = -(-threshold * (n + size) // (100 + threshold))
                rest = -(-threshold * max(n, size) // 100) - 1
                return len(np.intersect1d(h, own, assume_unique=True)) + rest >= need

            return test

        return prepare

    return _passing(make)


def _met(pairs: DataFrame, sets: DataFrame, test, name: str) -> DataFrame:
    """The (x, y) of ``pairs`` that pass, as (u, v). ``sets`` (cls, n, shingles) travel to their pairs' leader."""
    n = partitions(pairs.sparkSession)
    # a leader's members go to shares of about SHARE each, so a large group is many tasks' work
    sizes = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("members"))
    shares = cut(sizes.select("x", F.ceil(F.col("members") / SHARE).cast("int").alias("shares")), "shares")
    members = pairs.join(checked(shares), "x").select("x", (F.abs(F.hash("y")) % F.col("shares")).alias("share"), F.col("y").alias("cls"))
    leaders = shares.select("x", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("x").alias("cls"))
    rows = cut(members.union(leaders), "to-verify")
    full = sets.join(checked(rows), "cls")
    order = [F.col("x"), F.col("share"), F.col("cls") != F.col("x")]
    dealt = full.select("x", "share", "cls", "n", "shingles").repartition(n, "x", "share").sortWithinPartitions(*order)
    out = cut(map_arrow(dealt, test, "u long, v long"), name)
    discard(shares, rows)
    return out


def verify(pairs: DataFrame, prefixes: DataFrame, sets: Sets, held, threshold: int) -> DataFrame:
    """The (x, y) of ``pairs`` that link: first by prefixes, which are short, then by whole sets."""
    hopeful = _met(pairs, prefixes, _promising(threshold), "hopeful")
    both = hopeful.select(F.col("u").alias("cls")).union(hopeful.select("v")).distinct()
    out = _met(hopeful.select(F.col("u").alias("x"), F.col("v").alias("y")), sets.of(both), _linked(held, threshold), "links")
    discard(hopeful)
    return out


def _relabel(rows: DataFrame, labels: DataFrame | None, column: str, out: str) -> DataFrame:
    """``rows`` with the component of a class; a class in no link is its own."""
    if labels is None:
        return rows.withColumn(out, F.col(column))
    named = labels.select(F.col("node").alias(column), F.col("label").alias("_label"))
    return rows.join(checked(named), column, "left").withColumn(out, F.coalesce("_label", column)).drop("_label")


#: Bands of the ratio of two sets' sizes, from the threshold to 1 (in parts of the way there):
#: the nearer the ratio is to 1, the more prefix shingles a pair must share.
BANDS = (0, 0.002, 0.004, 0.008, 0.016, 0.032, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.92, 1)


def _banded(threshold: int):
    """Of rows sorted by (token, salt, n, comp): (cls, comp, n, mask). Bit k of mask says that
    a class of another component holds the token and that its size is in band k of this class's. Salted
    tokens, of which other tasks hold rows, have all bits."""
    t = threshold / 100
    edges = [t + (1 - t) * x for x in BANDS]
    smaller = list(zip(edges[:-1], edges[1:], strict=True))
    bands = smaller + [(1 / b, 1 / a) for a, b in smaller]

    def masks(batch: pa.RecordBatch) -> pa.RecordBatch:
        token, salt, comp, n = (batch.column(c).to_numpy() for c in ("token", "salt", "comp", "n"))
        n = n.astype(np.int64)
        fresh = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
        new = fresh | np.append(True, comp[1:] != comp[:-1])
        group, starts = np.cumsum(fresh) - 1, np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(n)))
        run_end = np.repeat(starts + lengths, lengths)
        heads = np.flatnonzero(fresh)
        several = (np.minimum.reduceat(comp, heads) < np.maximum.reduceat(comp, heads))[group]
        at = np.flatnonzero(several & (salt == 0))
        step = int(n.max() / t) + 3
        key = group * step + n
        mask = np.where(salt > 0, (1 << len(bands)) - 1, 0)
        for k, (a, b) in enumerate(bands):
            low = np.searchsorted(key, group[at] * step + np.ceil(n[at] * a - 1e-6).astype(np.int64), "left")
            high = np.searchsorted(key, group[at] * step + np.floor(n[at] * b + 1e-6).astype(np.int64), "right")
            low_ = np.minimum(low, len(key) - 1)
            mask[at] |= ((low < high) & ~((run_end[low_] >= high) & (comp[low_] == comp[at]))).astype(np.int64) << k
        made = pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("comp"), batch.column("n"), pa.array(mask)], names=["cls", "comp", "n", "mask"])
        return made.filter(pa.array(mask != 0))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None
        for batch in batches:
            if tail is not None and tail.num_rows:
                batch = pa.concat_batches([tail, batch])
            if batch.num_rows:
                token, salt = (batch.column(c).to_numpy() for c in ("token", "salt"))
                change = np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
                last = int(change[-1]) + 1 if len(change) else 0
                tail = batch.slice(last)
                if last:
                    yield masks(batch.slice(0, last))
        if tail is not None and tail.num_rows:
            yield masks(tail)

    return fn, bands


def open_classes(rows: DataFrame, threshold: int) -> DataFrame:
    """(cls, comp, n) of those classes of the prefix rows that can be in a link between components."""
    t = threshold / 100
    fn, bands = _banded(threshold)
    dealt = rows.select("token", "salt", "cls", "comp", "n").repartition(partitions(rows.sparkSession), "token", "salt").sortWithinPartitions("token", "salt", "n", "comp")
    found = map_arrow(dealt, fn, "cls long, comp long, n int, mask long")
    counts = [F.sum(F.shiftright("mask", k).bitwiseAND(F.lit(1))).alias(f"m{k}") for k in range(len(bands))]
    enough = F.lit(False)
    for k, (a, b) in enumerate(bands):
        # of a pair's common shingles all but (threshold of the larger size) are in both prefixes
        need = t * (1 + a) / (1 + t) - t if b <= 1 else t * (1 + b) / (1 + t) - t * b
        enough = enough | (F.col(f"m{k}") >= F.greatest(F.lit(1), F.ceil(F.col("n") * need - 1e-6)))
    return found.groupBy("cls").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), *counts).where(enough).select("cls", "comp", "n")


def _opened(held, salts: int):
    """(token, salt, cls, comp, n) of all shingles of sets; only heavy shingles are salted."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.sort(held.value)
        for batch in batches:
            at = 0
            sizes = batch.column("n").to_numpy().astype(np.int64)
            while at < batch.num_rows:  # some hundred thousand shingles at a time
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 18)))
                part = batch.slice(at, end - at)
                n = sizes[at:end]
                h = np.frombuffer(b"".join(part.column("shingles").to_pylist()), U64)
                cls, comp = (np.repeat(part.column(c).to_numpy(), n) for c in ("cls", "comp"))
                heavy = np.isin(h, tokens)
                salt = np.where(heavy, U64(1) + cls.view(U64) % U64(salts), U64(0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salt), pa.array(cls), pa.array(comp), pa.array(np.repeat(n, n).astype(np.int32))], names=["token", "salt", "cls", "comp", "n"])
                at = end

    return fn


def _crossing(held):
    """Of rows sorted by (token, salt, cls), without repeats: (token, cls, comp, n, f) of those shingles that several
    components hold. f orders shingles: the classes that hold it, or for heavy ones, which are
    all kept, their rank beyond those."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.argsort(held.value)
        tokens, rank = held.value[by], by.astype(np.int64)
        tail: pa.RecordBatch | None = None

        def groups(batch: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
            token, salt, cls = (batch.column(c).to_numpy() for c in ("token", "salt", "cls"))
            again = np.zeros(len(token), bool)
            again[1:] = (token[1:] == token[:-1]) & (cls[1:] == cls[:-1])
            if again.any():
                batch = batch.filter(pa.array(~again))
            token, salt, cls, comp, n = (batch.column(c).to_numpy() for c in ("token", "salt", "cls", "comp", "n"))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            starts = np.flatnonzero(new)
            cut_at = len(token) if last else int(starts[-1])
            several = np.minimum.reduceat(comp, starts) < np.maximum.reduceat(comp, starts)
            f = np.diff(np.append(starts, len(token)))
            heavy = salt[starts] > 0
            if heavy.any():
                f = f.copy()
                f[heavy] = (1 << 40) + rank[np.searchsorted(tokens, token[starts][heavy].view(U64))]
            run = np.cumsum(new) - 1
            keep = (several | heavy)[run]
            keep[cut_at:] = False
            at = np.flatnonzero(keep)
            made = pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(cls[at]), pa.array(comp[at]), pa.array(n[at]), pa.array(f[run[at]].astype(np.int64))], names=["token", "cls", "comp", "n", "f"])
            return made, batch.slice(cut_at)

        for batch in batches:
            if tail is not None and tail.num_rows:
                batch = pa.concat_batches([tail, batch])
            if batch.num_rows:
                out, tail = groups(batch, False)
                yield out
        if tail is not None and tail.num_rows:
            yield groups(tail, True)[0]

    return fn


def crossing_prefixes(open_: DataFrame, sets: DataFrame, held, threshold: int, salts: int) -> DataFrame:
    """(token, cls, comp, n, pos): prefixes of the classes ``open_`` (cls, comp, n) in the order of
    how many of those classes hold a shingle; what one component alone holds comes first and is left out."""
    n = partitions(open_.sparkSession)
    whole = sets.join(checked(open_.select("cls", "comp")), "cls").select("cls", "comp", "n", "shingles")
    dealt = map_arrow(whole, _opened(held, salts), "token long, salt int, cls long, comp long, n int").repartition(n, "token", "salt").sortWithinPartitions("token", "salt", "cls")
    shared = map_arrow(dealt, _crossing(held), "token long, cls long, comp long, n int, f long")
    own = Window.partitionBy("cls")
    place = F.row_number().over(own.orderBy("f", "token")) - F.lit(1)
    ranked = shared.withColumn("m", F.count(F.lit(1)).over(own)).withColumn("pos", (F.col("n") - F.col("m") + place).cast("int"))
    p = F.col("n") - F.ceil(F.col("n") * threshold / 100.0 - 1e-9) + 1
    return cut(ranked.where(F.col("pos") < p).select("token", "cls", "comp", "n", "pos"), "crossing-prefixes")


def link_classes(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Documents (doc_id, n, cls), verified links between classes (u, v), and their components
    (node, label), or None if nothing links."""
    spark = docs.sparkSession
    n = partitions(spark)
    found = cut(map_arrow(docs, _signatures(width), "kind int, id long, n long, cls long, other long"), "shingle-signatures", ["kind"])
    signatures = found.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "cls", "other")
    # of so many 64-bit names, about classes^2 / 2^65 agree by chance
    clash = [r["cls"] for r in signatures.where("cls is not null").groupBy("cls").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a < b").collect()]
    name = F.when(F.col("cls").isin(clash), F.col("other")).otherwise(F.col("cls")) if clash else F.col("cls")
    signatures = signatures.select("doc_id", "n", name.alias("cls"))
    often = frequent(cut(found.where("kind = 1").groupBy(F.col("id").alias("token")).agg(F.sum("n").alias("n")), "often"), "n", HEAVY)
    # rank by count: the least heavy first
    top = np.array([r["token"] for r in sorted(often.collect(), key=lambda r: (r["n"], r["token"]))], np.int64).view(U64)
    held = spark.sparkContext.broadcast(top)
    salts = 16
    dealt = map_arrow(docs, _prefixes(held, width, threshold, salts, clash), "token long, salt int, cls long, n int, pos int").repartition(n, "token", "salt").sortWithinPartitions("token", "salt", "cls")
    shared = cut(map_arrow(dealt, _shared, "token long, salt int, cls long, n int, pos int"), "shared-prefixes")
    active = shared.select("cls").distinct()
    first = cut(signatures.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(active, "cls"), "active-classes")
    sets = Sets(docs, first, width, clash)
    # the least edited of near copies share most of their prefix with others: they lead best
    p = F.col("n") - F.ceil(F.col("n") * threshold / 100.0 - 1e-9) + 1
    central = cut(shared.groupBy("cls").agg(F.round(F.count(F.lit(1)) / F.first(p), 2).alias("central")), "central")
    ranked = cut(shared.join(checked(central), "cls"), "ranked-prefixes")
    discard(shared, central)
    shared = ranked
    packed = shared.groupBy("cls").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("token")).alias("tokens"))
    prefixes = cut(map_arrow(packed, _pack, "cls long, n int, shingles binary"), "packed-prefixes")

    links: DataFrame | None = None
    tried: DataFrame | None = None
    labels: DataFrame | None = None
    for k in range(STAR_ROUNDS):
        rows = _relabel(shared, labels, "cls", "comp")
        rank = F.struct((-F.floor(F.col("central") * (50 >> k))).alias("c"), F.xxhash64("cls", F.lit(k)).alias("h"))
        # stars by (token, salt), then between the leaders of a token's salts
        lead = rows.groupBy("token", "salt").agg(F.min(F.struct(rank.alias("r"), "cls", "comp", "n")).alias("lead"), F.min("comp").alias("a"), F.max("comp").alias("b"))
        lead = cut(lead.where("a < b or salt > 0").drop("a", "b"), "leaders")
        star = rows.join(lead, ["token", "salt"]).select(F.col("lead.cls").alias("x"), F.col("lead.comp").alias("cx"), F.col("lead.n").alias("nx"), F.col("cls").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"))
        heads = lead.groupBy("token").agg(F.min("lead").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1")
        ends = lead.join(heads, "token").select(F.col("head.cls").alias("x"), F.col("head.comp").alias("cx"), F.col("head.n").alias("nx"), F.col("lead.cls").alias("y"), F.col("lead.comp").alias("cy"), F.col("lead.n").alias("ny"))
        near = star.union(ends).where((F.col("cx") != F.col("cy")) & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * threshold))
        counted = near.groupBy("y", "x").agg(F.count(F.lit(1)).alias("s"))
        if tried is not None:
            counted = counted.join(checked(tried), ["x", "y"], "left_anti")
        ranked = counted.groupBy("y").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "x")), False), 1, LEADERS).alias("best"))
        pairs = cut(ranked.select(F.explode("best.x").alias("x"), "y"), "star-pairs")
        discard(lead)
        made = pairs.count()
        if not made:
            break
        tried = pairs if tried is None else tried.union(pairs)
        new = verify(pairs, prefixes, sets, held, threshold)
        links = new if links is None else links.union(new)
        discard(labels)
        labels = components(links)
        if new.count() < WORTH * made:
            break

    # every pair that is left between components
    open_ = cut(open_classes(_relabel(shared, labels, "cls", "comp"), threshold), "open-classes")
    mixed = crossing_prefixes(open_, sets.of(open_.select("cls")), held, threshold, salts)
    a = mixed.select("token", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("comp").alias("cx"))
    # the smaller set's prefix is shorter: its partner's size raises the overlap that is asked for
    index = F.col("n") - F.ceil(F.col("n") * (2.0 * threshold) / (100.0 + threshold) - 1e-9)
    b = mixed.where(F.col("pos") <= index).select("token", F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("comp").alias("cy"))
    # a class pair once, with the larger set (then the larger name) as leader
    order = (F.col("nx") > F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y"))
    need = F.ceil((F.col("nx") + F.col("ny")) * threshold / (100.0 + threshold) - 1e-9)
    near = (F.col("px") <= F.col("nx") - need) & (F.col("py") <= F.col("ny") - need)
    pairs = a.join(b, "token").where(order & (F.col("cx") != F.col("cy")) & (F.col("ny") * 100 >= F.col("nx") * threshold) & near)
    left = pairs.select("x", "y").distinct()
    if tried is not None:
        both = tried.union(tried.select(F.col("y").alias("x"), F.col("x").alias("y")))
        left = left.join(both, ["x", "y"], "left_anti")
    left = cut(left, "left-pairs")
    if not left.isEmpty():
        new = verify(left, prefixes, sets, held, threshold)
        links = new if links is None else links.union(new)
        discard(labels)
        labels = components(links)
    discard(shared, prefixes, *sets.tables, open_, mixed, left, first)
    if links is None:
        links = spark.createDataFrame([], "u long, v long")
    return signatures, links, labels


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): one row for each row of ``docs``;
    component_id is the smallest doc_id reachable by links, n_links the links of the
    document's class to other classes that were verified."""
    signatures, links, labels = link_classes(id_text(docs, id_col, text_col), width, threshold)
    named = signatures.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"))
    both = links.union(links.select("v", "u")).groupBy(F.col("u").alias("cls")).agg(F.count_distinct("v").alias("n_links"))
    named = _relabel(named, labels, "cls", "comp")
    # stored, so that the join can broadcast it, or part the rows of a large component
    named = cut(named, "named-classes")
    least = cut(named.groupBy("comp").agg(F.min("first").alias("component_id")), "least-ids")
    table = cut(named.join(checked(least), "comp").join(both, "cls", "left").select("cls", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "class-components")
    # documents without shingles match nothing in the join: each has a key of its own
    key = F.coalesce(F.col("cls"), F.xxhash64("doc_id"))
    out = signatures.withColumn("key", key).join(checked(table.withColumnRenamed("cls", "key")), "key", "left")
    empty = F.col("cls").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.lit(0)).otherwise(F.col("n_links")).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: its smallest doc_id. All columns stay as
    they are; of rows that repeat a doc_id all stay or go; rows without a doc_id stay."""
    found = near_duplicates(docs, width, threshold, id_col, text_col)
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "near-duplicates")
    return docs.join(checked(gone), id_col, "left_anti")
