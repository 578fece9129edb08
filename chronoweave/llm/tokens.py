"""Token counts without ids: pieces are counted once for each distinct pre-token.

1. Pre-tokens of every text are found by vectorised boundaries over code points, and counted
   in each step of a task; a partial and a final aggregation give the corpus's distinct
   pre-tokens with their frequencies.
2. The tokenizer counts the pieces of each distinct pre-token once; the table
   (piece_token, n_pieces, frequency) is stored in the shared folder.
3. Documents' pre-token frequencies meet that table: its most frequent rows, at most ``HEAD``
   of them, as a broadcast table, all others by a shuffled join on the pre-token. So no key
   that is frequent enough to be hot is ever shuffled. Sums by document end it.

Defined results. Null text: as the empty text, no tokens. A special string inside a text is
one token, as the library's default has it. Rows that repeat a doc_id (or have none) are counted each
for itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import U64, frequent, id_text, map_arrow, mix, steps
from chronoweave.runtime import cut

#: Most rows of the broadcast table, whatever the input's size.
HEAD = 150_000
MAX_VOCABULARY_BYTES = 64 << 20

#: Code point classes: letter, number, white space, other.
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_CLASSES: dict[tuple, np.ndarray] = {}
#: Fixed: endings that the pre-tokenizer's pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: (code point, class) of those that a library knows otherwise than ``regex`` does.
Fixes = tuple[tuple[int, int], ...]


def classes(fixes: Fixes = ()) -> np.ndarray:
    """The class of every code point, by Unicode's letter, number and white-space properties."""
    if fixes not in _CLASSES:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, points):
                a, b = ord(points[m.start()]), ord(points[m.end() - 1])
                table[a : b + 1] = kind
                if a < 0xD800 <= b:
                    table[0xD800:0xE000] = OTHER
        for point, kind in fixes:
            table[point] = kind
        _CLASSES[fixes] = table
    return _CLASSES[fixes]


def fixes_of(pre_tokenizer) -> Fixes:
    """What the library's own pattern says of code points on which two versions of Unicode,
    those of ``regex`` and of Python, differ: some thousand newly assigned ones."""
    import unicodedata

    kinds = {"L": LETTER, "N": NUMBER}
    table = classes()
    out = []
    for point in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        kind = kinds.get(unicodedata.category(chr(point))[0], OTHER)
        if table[point] != kind and table[point] != SPACE:
            c = chr(point)
            kind = LETTER if len(pre_tokenizer.pre_tokenize_str("a" + c)) == 1 else NUMBER if len(pre_tokenizer.pre_tokenize_str("1" + c)) == 1 else OTHER
            if table[point] != kind:
                out.append((point, kind))
    return tuple(out)


def boundaries(points: np.ndarray, text_starts: np.ndarray, fixes: Fixes = ()) -> np.ndarray:
    """Where pre-tokens start in ``points``: texts' code points laid end to end.

    The rule, for runs of one class within a text: a run of letters, numbers or others takes
    a space (U+0020) just before it along; of a run of white space that something follows, the last one
    stands alone or goes along; an apostrophe alone before one of CONTRACTIONS goes with it.
    """
    n = len(points)
    kind = classes(fixes)[points]
    first = np.zeros(n, bool)
    first[text_starts[text_starts < n]] = True
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last of a run of white space before something else in the same text
    last_space = np.zeros(n, bool)
    last_space[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    goes_along = last_space & (points == 32)
    start = new | last_space
    # a run that a space goes along with starts at that space
    follows = np.zeros(n, bool)
    follows[1:] = goes_along[:-1]
    start &= ~follows
    # contractions: an apostrophe that begins a token, with letters right after it
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    for q in quote.tolist():
        for ending in CONTRACTIONS:
            end = q + 1 + len(ending)
            if end <= n and not first[q + 1 : end].any() and points[q + 1 : end].tolist() == [ord(c) for c in ending]:
                start[q + 1] = False
                if end < n and kind[end] == LETTER and not first[end]:
                    start[end] = True
                break
    return np.flatnonzero(start)


class Split:
    """Pre-tokens of a step's texts: which are distinct, and each document's frequencies."""

    def __init__(self, texts: list[str | None], specials: tuple[str, ...], fixes: Fixes = ()):
        self.special_rows: list[int] = []
        parts, rows = [], []
        for row, text in enumerate(texts):
            rest = [text or ""]
            for s in specials:
                if s in (text or ""):
                    cut_up = [p.split(s) for p in rest]
                    self.special_rows += [row] * sum(len(p) - 1 for p in cut_up)
                    rest = [x for p in cut_up for x in p]
            for x in rest:
                if x:
                    parts.append(x)
                    rows.append(row)
        sizes = np.array([len(x) for x in parts], np.int64)
        text_starts = np.cumsum(sizes) - sizes if len(sizes) else sizes
        self.text = "".join(parts)
        self.points = points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            self.starts = self.ends = self.distinct = np.zeros(0, np.int64)
            self.token = self.row = np.zeros(0, np.int64)
            return
        self.starts = starts = boundaries(points, text_starts, fixes)
        self.ends = ends = np.append(starts[1:], len(points))
        lengths = ends - starts
        position = np.arange(len(points)) - np.repeat(starts, lengths)
        with np.errstate(over="ignore"):
            words = ((position.astype(U64) << U64(21)) | points.astype(U64)) * U64(0x9E3779B97F4A7C15) + U64(0xA0761D6478BD642F)
            words = mix(words)
            hashes = np.add.reduceat(words, starts) + lengths.astype(U64)
        _, self.distinct, self.token = np.unique(hashes, return_index=True, return_inverse=True)
        self.row = np.asarray(rows, np.int64)[np.searchsorted(text_starts, starts, "right") - 1]

    def strings(self, which: np.ndarray) -> list[str]:
        """The text of pre-tokens, by their number among the distinct ones."""
        at = self.distinct[which]
        return [self.text[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def pretokens(docs: DataFrame, specials: tuple[str, ...], fixes: Fixes = ()) -> DataFrame:
    """(token, n): distinct pre-tokens and their frequencies over all of ``docs``."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                s = Split(batch.column("text").to_pylist(), specials, fixes)
                if len(s.distinct):
                    yield pa.RecordBatch.from_arrays([pa.array(s.strings(np.arange(len(s.distinct))), pa.string()), pa.array(np.bincount(s.token))], names=["token", "n"])

    return map_arrow(docs, fn, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _tokenizer(spec: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def piece_counts(tokens: DataFrame, spec: str) -> DataFrame:
    """(token, n, n_pieces): the tokenizer's pieces of each distinct pre-token."""
    held = tokens.sparkSession.sparkContext.broadcast(spec)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = _tokenizer(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                counts = [len(e.ids) for e in tokenizer.encode_batch_fast(part.column("token").to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column("token"), part.column("n"), pa.array(counts, pa.int32())], names=["token", "n", "n_pieces"])

    return map_arrow(tokens, fn, "token string, n long, n_pieces int")


def load(path: str) -> tuple[str, tuple[str, ...], Fixes]:
    """A tokenizer file's text, its special strings, and its own view of code points. The file must hold a byte-level
    tokenizer that splits by its own pattern; another kind is refused."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(MAX_VOCABULARY_BYTES)
    held = json.loads(spec)
    pre = held.get("pre_tokenizer") or {}
    if held.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: not a byte-level tokenizer with the usual pattern")
    added = held.get("added_tokens") or []
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
        raise ValueError(f"{path}: added tokens that take their surroundings along are not supported")
    return spec, tuple(sorted((t["content"] for t in added), key=lambda x: (-len(x), x))), fixes_of(_tokenizer(spec).pre_tokenizer)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, row) of every row of ``docs``."""
    spark = docs.sparkSession
    spec, specials, fixes = load(path)
    source = id_text(docs, id_col, text_col)
    table = cut(piece_counts(pretokens(source, specials, fixes), spec), "pieces")
    top = spark.sparkContext.broadcast({r["token"]: r["n_pieces"] for r in frequent(table, "n", head).select("token", "n_pieces").collect()})
    rows = source.withColumn("row", F.monotonically_increasing_id())

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = top.value
        for whole in batches:
            for batch in steps(whole, "text"):
                texts = batch.column("text").to_pylist()
                s = Split(texts, specials, fixes)
                n = len(texts)
                strings = s.strings(np.arange(len(s.distinct)))
                counts = np.array([known.get(x, -1) for x in strings], np.int64)
                sure = np.bincount(s.row, np.maximum(counts, 0)[s.token], n).astype(np.int64) if len(s.token) else np.zeros(n, np.int64)
                if s.special_rows:
                    sure += np.bincount(s.special_rows, minlength=n)
                # one row for the document, and one for each of its pre-tokens that isn't in the head
                rare = np.flatnonzero(counts[s.token] < 0) if len(s.token) else s.token
                pairs, times = np.unique(s.row[rare] * max(1, len(strings)) + s.token[rare], return_counts=True)
                owners, which = pairs // max(1, len(strings)), pairs % max(1, len(strings))
                ids, keys = batch.column("doc_id").to_pylist(), batch.column("row").to_numpy()
                rows_out = [ids, keys.tolist(), [len((t or "").encode()) for t in texts], sure.tolist(), [None] * n, [0] * n]
                names = [strings[w] for w in which.tolist()]
                tail = [[None] * len(names), keys[owners].tolist(), [None] * len(names), [0] * len(names), names, times.tolist()]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([*a, *b], k) for a, b, k in zip(rows_out, tail, kinds, strict=True)], names=["doc_id", "row", "n_bytes", "sure", "token", "times"])

    found = map_arrow(rows, fn, "doc_id long, row long, n_bytes long, sure long, token string, times long")
    # rows without a token match nothing in the join and keep their place by a salt
    key = F.coalesce("token", F.concat(F.lit("\0row"), F.col("row").cast("string")))
    joined = found.withColumn("key", key).join(table.select(F.col("token").alias("key"), "n_pieces"), "key", "left")
    total = F.sum(F.col("sure") + F.coalesce(F.col("times") * F.col("n_pieces"), F.lit(0)))
    by_row = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
    return by_row.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
