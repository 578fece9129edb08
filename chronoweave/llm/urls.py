"""URL filters: host and path rules, then a character language-model ratio.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each URL a
length-normalised difference of log-likelihoods; a threshold calibrated on held-out labelled
URLs turns it into a verdict. Counts cover every labelled URL (those that a rule decides), one for each
distinct context and (context, byte) by 64-bit hash, so a model grows with the number of those.

Defined results. Null URLs, or URLs without ``://``: empty host and path, no rule; the models
judge what there is, and the empty URL is allowed. Nothing to learn from on one side: the other
side's verdict; on both: allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import U64, bytes_of, map_arrow, mix

ORDER = 4
#: Pseudo-counts that the next shorter context's estimate weighs.
STRENGTH = 2.0
#: Scores' bins for calibration, over [-BOUND, BOUND].
BINS, BOUND = 512, 4.0
#: Of the labelled URLs, one in this many (by hash) calibrates instead of being counted.
HELD_OUT = 5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to / ? # (A-Z lower-cased), and then up to ? #."""
    url = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*+)", 1), upper, upper.lower())
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1)


def apply_rules(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, rule_verdict): the longest rule that fits, by text."""
    host, path = host_and_path(pages[url_col].cast("string"))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), host.alias("host"), path.alias("path"))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return rows.withColumn("rule", text).withColumn("rule_verdict", verdict)


def _contexts(array: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order, the hash of each (context, byte) and of each context; rows; lengths.

    A URL is its lower-cased bytes after the scheme with an end mark; contexts don't reach
    over its start."""
    data, offsets = bytes_of(array)
    lengths = np.diff(offsets) + 1
    ends = np.cumsum(lengths)
    symbols = np.zeros(int(lengths.sum()), U64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    inner = np.ones(len(symbols), bool)
    inner[ends - 1] = False
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    symbols[inner] = lower.astype(U64) + U64(1)
    place = np.arange(len(symbols)) - np.repeat(ends - lengths, lengths)
    pairs, contexts = [], []
    h = np.zeros(len(symbols), U64)
    with np.errstate(over="ignore"):
        for k in range(ORDER + 1):
            if k:
                before = np.zeros(len(symbols), U64)
                before[k:] = symbols[:-k]
                h = np.where(place >= k, mix(h * U64(0x9E3779B97F4A7C15) + before + U64(k)), h)
            pairs.append(mix(h + (symbols + U64(1)) * U64(0xD6E8FEB86659FD93)))
            contexts.append(mix(h ^ U64(0x5851F42D4C957F2D)))
    return pairs, contexts, rows, lengths


#: Sorted hashes and their counts.
Counts = tuple[np.ndarray, np.ndarray]


def _count(table: Counts, hashes: np.ndarray) -> np.ndarray:
    keys, counts = table
    if not len(keys):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, counts[at], 0)


def _log_likelihood(tables: list[list[Counts]], pairs: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
    p = np.full(len(pairs[0]), 1 / 257)
    for k in range(ORDER + 1):
        p = (_count(tables[0][k], pairs[k]) + STRENGTH * p) / (_count(tables[1][k], contexts[k]) + STRENGTH)
    return np.log(p)


@dataclass(frozen=True)
class UrlModel:
    """tables[side][0 pairs, 1 contexts][order], sides 0 accepted and 1 rejected."""

    tables: list[list[list[Counts]]]
    threshold: float
    constant: str | None = None

    def scores(self, array: pa.Array) -> np.ndarray:
        """Difference of log-likelihoods a byte, accepted less rejected."""
        if not len(array):
            return np.zeros(0)
        pairs, contexts, rows, lengths = _contexts(array)
        gap = _log_likelihood(self.tables[0], pairs, contexts) - _log_likelihood(self.tables[1], pairs, contexts)
        return np.bincount(rows, gap, len(lengths)) / lengths


def _stripped(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*+://", "")


def fit(labelled: DataFrame) -> UrlModel:
    """A model of ``labelled`` (url, accepted boolean); rows without a label are passed over."""
    rows = labelled.where("accepted is not null").select(_stripped(F.col("url")).alias("url"), F.when(F.col("accepted"), 0).otherwise(1).alias("side"))
    rows = rows.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = batch.column("side").to_numpy()
            for s in (0, 1):
                part = batch.filter(pa.array(side == s)).column("url")
                if not len(part):
                    continue
                pairs, contexts, _, _ = _contexts(part)
                for k in range(ORDER + 1):
                    for kind, hashes in enumerate((pairs[k], contexts[k])):
                        h, n = np.unique(hashes, return_counts=True)
                        table = np.full(len(h), (s * 2 + kind) * (ORDER + 1) + k, np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(table), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["table", "h", "n"])

    spark = labelled.sparkSession
    found = map_arrow(rows.where("not held").select("url", "side"), counts, "table int, h long, n long").groupBy("table", "h").agg(F.sum("n").alias("n")).toArrow()
    table, h, n = found.column("table").to_numpy(), found.column("h").to_numpy().view(U64), found.column("n").to_numpy()
    by = np.lexsort((h, table))
    table, h, n = table[by], h[by], n[by]
    ends = np.searchsorted(table, np.arange(4 * (ORDER + 1) + 1))
    flat_tables = [(h[i:j], n[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    tables = [[flat_tables[(s * 2 + kind) * (ORDER + 1) :][: ORDER + 1] for kind in (0, 1)] for s in (0, 1)]
    seen = [len(tables[s][0][0][0]) > 0 for s in (0, 1)]
    if not all(seen):
        return UrlModel(tables, 0.0, "block" if seen[1] else "allow")
    held = spark.sparkContext.broadcast(UrlModel(tables, 0.0))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            scores = held.value.scores(batch.column("url"))
            at = np.clip(((scores + BOUND) * (BINS / (2 * BOUND))).astype(int), 0, BINS - 1)
            for s in (0, 1):
                total[s] += np.bincount(at[batch.column("side").to_numpy() == s], minlength=BINS)
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(flat)), pa.array(flat[flat > 0])], names=["cell", "n"])

    found = map_arrow(rows.where("held").select("url", "side"), bins, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    seen_at = np.zeros(2 * BINS)
    for r in found:
        seen_at[r["cell"]] = r["n"]
    good, bad = seen_at.reshape(2, BINS)
    # balanced error of allowing from each bin on; in the middle of the best ones
    lost = np.concatenate([[0], np.cumsum(good)]) / max(1, good.sum())
    passed = 1 - np.concatenate([[0], np.cumsum(bad)]) / max(1, bad.sum())
    best = np.flatnonzero(np.isclose(lost + passed, (lost + passed).min()))
    return UrlModel(tables, float(best[len(best) // 2]) * (2 * BOUND / BINS) - BOUND)


def judge(pages: DataFrame, model: UrlModel) -> DataFrame:
    """``pages`` (page_id, url, host, path, rule, rule_verdict) with score and verdict."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    source = pages.withColumn("bare", _stripped(F.col("url")))
    kind = dict(pages.dtypes)["page_id"]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            scores = model.scores(batch.column("bare"))
            words = [model.constant or ("allow" if s >= model.threshold else "block") for s in scores.tolist()]
            columns = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            said = [v or w if u else v or "allow" for v, w, u in zip(batch.column("rule_verdict").to_pylist(), words, batch.column("bare").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return map_arrow(source.select("page_id", "host", "path", "rule", "rule_verdict", "bare"), fn, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rules first, then models learnt from what the rules decide."""
    ruled = apply_rules(pages, rules, id_col, url_col)
    model = fit(ruled.where("rule is not null").select("url", (F.col("rule_verdict") == "allow").alias("accepted")))
    return judge(ruled, model)
