"""Trim ranges: filters, back-to-back concatenation, rebased times. Ranges are a short, ordered list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ranges = tuple[tuple[int, int], ...]


def inside(t: Column, ranges: Ranges) -> Column:
    """Within a range, both ends included; no ranges means everywhere."""
    out = F.lit(not ranges)
    for a, b in ranges:
        out = out | t.between(a, b)
    return out


def rebase(t: Column, ranges: Ranges) -> Column:
    """Time in the first range that holds it, as if ranges lay end to end; null outside."""
    out, before = F.lit(None).cast("long"), sum(b - a for a, b in ranges)
    for a, b in reversed(ranges):
        before -= b - a
        out = F.when(t.between(a, b), t - a + before).otherwise(out)
    return out


def from_shares(shares: tuple[tuple[float, float], ...], duration: Column) -> Column:
    """array<struct<start, end>> of shares of a duration; 0 and 1 are open ends (null)."""
    return F.array(*(F.struct((F.lit(a) * duration if a > 0 else F.lit(None).cast("double")).alias("start"), (F.lit(b) * duration if b < 1 else F.lit(None).cast("double")).alias("end")) for a, b in shares))


def replaced(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``new``, and those of ``old`` for series that ``new`` has none of."""
    return new.unionByName(old.join(new.select(*by).distinct(), by, "left_anti"))
