"""Adaptive zoom: field-of-view curves from borders, smoothed by windows or envelopes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import scans, windows
from chronoweave.operators.windows import Series


def static(s: Series, value: str) -> Column:
    """The least field of view of a series, in each of its rows."""
    return F.min(value).over(s.whole())


def frames(window_s: float, fps: float) -> int:
    """Rows of a window: odd, one at least."""
    n = int(window_s * fps)
    return max(1, n if n % 2 else n + 1)


def dynamic(df: DataFrame, s: Series, value: str, window_s: float, fps: float, out: str = "fov") -> DataFrame:
    """Rolling minimum, then a Gaussian of a sixth of the window."""
    n = frames(window_s, fps)
    low = df.withColumn("_low", windows.rolling_min(s, value, n // 2))
    return low.withColumn(out, windows.convolve(s, "_low", windows.gaussian(n // 2, n / 6.0))).drop("_low")


def followed(df: DataFrame, s: Series, value: str, window_s: float, fps: float, out: str = "fov") -> DataFrame:
    """Two envelope passes: the window's time constant, then 0.2 s."""
    weight = lambda tau: 1 - math.exp(-(1 / fps) / tau)
    return scans.envelope(scans.envelope(df, s, value, weight(window_s), "_first"), s, "_first", weight(0.2), out).drop("_first")


#: How much of the excess each round takes.
THRESHOLDS = (0.95, 0.9, 0.85, 0.8)


def limit_once(fov: Column, limit: Column, least: float, round_: int) -> Column:
    """A row's smoothing limit after a round in which its field of view was below ``least``."""
    return F.when(fov < least, limit * F.least(fov / least, F.lit(THRESHOLDS[min(round_, 3)]))).otherwise(limit)


def trim_mask(s: Series, value: str, start: float, end: float) -> Column:
    """The value inside a share of the series, its largest value outside."""
    at = F.row_number().over(s.window()) - 1
    n = F.count(F.lit(1)).over(s.whole())
    inside = (at >= F.floor(n * start)) & (at <= F.ceil(n * end))
    return F.when(inside, F.col(value)).otherwise(F.max(value).over(s.whole()))


def border(df: DataFrame, width: float, height: float, margin: float, steps: int) -> DataFrame:
    """A row for each of 4 (steps - 1) points around a rectangle: (..., k, bx, by)."""
    n = steps - 1
    k = F.explode(F.sequence(F.lit(0), F.lit(4 * n - 1)))
    rows = df.withColumn("k", k).withColumn("_e", F.floor(F.col("k") / n)).withColumn("_u", (F.col("k") % n) / n)
    w, h = width - 2 * margin, height - 2 * margin
    x = F.when(F.col("_e") == 0, F.col("_u") * w).when(F.col("_e") == 1, w).when(F.col("_e") == 2, (1 - F.col("_u")) * w).otherwise(0.0)
    y = F.when(F.col("_e") == 0, 0.0).when(F.col("_e") == 1, F.col("_u") * h).when(F.col("_e") == 2, h).otherwise((1 - F.col("_u")) * h)
    return rows.withColumn("bx", x + margin).withColumn("by", y + margin).drop("_e", "_u")


def fov_of_border(df: DataFrame, by: list[str], x: Column, y: Column, width: float, height: float) -> DataFrame:
    """(by, fov): the widest centred rectangle of the frame's shape that the border points leave."""
    aspect = height / width
    half = F.min(F.greatest(F.abs(x - width / 2), F.abs(y - height / 2) / aspect))
    return df.groupBy(*by).agg((half * 2 / width).alias("fov"))
