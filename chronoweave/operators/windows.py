"""Operators on a series' neighbouring rows, as native windows.

``Series`` names the columns that identify and order a series. Window functions sort within a series
and spill; a series is one task's work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    by: tuple[str, ...]
    t: str
    seq: str

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.t, self.seq)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.by)


def rate(s: Series, value: str) -> Column:
    """Change of a value over change of time (seconds) to the row before; null where no time passed."""
    w = s.window()
    dt = (F.col(s.t) - F.lag(s.t).over(w)) / 1e6
    return F.when(dt > 0, (F.col(value) - F.lag(value).over(w)) / dt)


def rolling_min(s: Series, value: str, half: int) -> Column:
    """Least of the rows up to ``half`` away; padding the ends with their own values changes nothing."""
    return F.min(value).over(s.window().rowsBetween(-half, half))


def gaussian(half: int, sigma: float) -> list[float]:
    """Weights of offsets -half to half, summing to 1."""
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def convolve(s: Series, value: str, weights: list[float]) -> Column:
    """Weighted sum of neighbours; beyond the ends the end's value counts."""
    half = len(weights) // 2
    near = F.collect_list(value).over(s.window().rowsBetween(-half, half))
    # rows before the first, or behind the last, that a frame lacks
    at = F.row_number().over(s.window())
    missing_before = F.greatest(F.lit(0), half + 1 - at)
    padded = F.concat(F.array_repeat(F.element_at(near, 1), missing_before), near)
    full = F.concat(padded, F.array_repeat(F.element_at(near, -1), F.lit(len(weights)) - F.size(padded)))
    terms = F.zip_with(full, F.array(*map(F.lit, weights)), lambda x, w: x * w)
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def smooth_nullable(s: Series, value: str, half: int, sigma: float, strength: float = 1.0) -> Column:
    """Weighted mean of the neighbours that have a value, blended with the row's own; a null
    row stays null."""
    w = s.window().rowsBetween(-half, half)
    at = F.row_number().over(s.window())
    near = F.collect_list(F.struct(at.alias("i"), F.col(value).alias("v"))).over(w)
    weight = lambda r: F.when(r["v"].isNotNull(), F.exp(-((r["i"] - at) * (r["i"] - at)) / (2 * sigma * sigma))).otherwise(0.0)
    total = F.aggregate(near, F.lit(0.0), lambda a, r: a + weight(r) * F.coalesce(r["v"], F.lit(0.0)))
    mass = F.aggregate(near, F.lit(0.0), lambda a, r: a + weight(r))
    return F.when(F.col(value).isNotNull(), F.col(value) * (1 - strength) + total / mass * strength)


def median_filter(s: Series, value: str, kernel: int) -> Column:
    """Sliding median of an odd kernel, with zeros beyond the ends and for nulls."""
    half = kernel // 2
    near = F.collect_list(F.coalesce(value, F.lit(0.0))).over(s.window().rowsBetween(-half, half))
    full = F.concat(near, F.array_repeat(F.lit(0.0), F.lit(2 * half + 1) - F.size(near)))
    return F.element_at(F.array_sort(full), half + 1)


def fill_gaps(s: Series, value: str) -> Column:
    """Linear between the nearest known rows by row position; ends stay null."""
    w = s.window()
    at = F.row_number().over(w)
    known = F.when(F.col(value).isNotNull(), F.struct(at.alias("i"), F.col(value).alias("v")))
    lo = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = (at - lo["i"]) / (hi["i"] - lo["i"])
    return F.when(F.col(value).isNotNull(), F.col(value)).otherwise(lo["v"] + (hi["v"] - lo["v"]) * x)


def midpoint(s: Series) -> Column:
    """Time halfway to the next row; the last row keeps its own."""
    return F.col(s.t) + F.coalesce(F.floor((F.lead(s.t).over(s.window()) - F.col(s.t)) / 2), F.lit(0))


def gap_sessions(df: DataFrame, s: Series, gap_us: int) -> DataFrame:
    """(by, first, last, n) of runs without a gap of more than ``gap_us``; a run of one time is none."""
    w = s.window()
    new = F.coalesce((F.col(s.t) - F.lag(s.t).over(w) > gap_us).cast("int"), F.lit(1))
    marked = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*s.by, "_run").agg(F.min(s.t).alias("first_us"), F.max(s.t).alias("last_us"), F.count(F.lit(1)).alias("n"))
    return runs.where("first_us < last_us").drop("_run")


def peaks(s: Series, score: str, radius: int, least: float) -> Column:
    """Whether a row is the highest within ``radius`` rows (the first of equals) and above ``least``."""
    w = s.window()
    before = F.max(score).over(w.rowsBetween(-radius, -1))
    behind = F.max(score).over(w.rowsBetween(1, radius))
    return (F.col(score) >= least) & (before.isNull() | (F.col(score) > before)) & (behind.isNull() | (F.col(score) >= behind))


def sign_flips(s: Series, parts: tuple[str, str, str, str], jump: float = 1.5) -> Column:
    """1 or -1: the sign that keeps quaternions near the row before."""
    w = s.window()
    d = F.sqrt(sum((F.pow(F.col(p) - F.lag(p).over(w), F.lit(2.0)) for p in parts), F.lit(0.0)))
    flips = F.sum((F.coalesce(d, F.lit(0.0)) > jump).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(flips % 2 == 0, 1.0).otherwise(-1.0)
