"""Offset search between two signals: every candidate offset is scored, the best one wins.

Candidate offsets are a small, fixed set, so the grid is exploded from an array in each row
(no cross join): a row meets its partner at each offset through one equi-join on time slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def offsets(radius: int, step: int) -> Column:
    """Candidates -radius to radius, in slots."""
    return F.sequence(F.lit(-radius), F.lit(radius), F.lit(step))


def align(a: DataFrame, b: DataFrame, by: list[str], slot: str, value: str, radius: int, step: int = 1) -> DataFrame:
    """(by, offset, x, y): a's value at a slot and b's at the slot plus offset."""
    left = a.select(*by, F.col(value).alias("x"), F.col(slot).alias("_slot"), F.explode(offsets(radius, step)).alias("offset"))
    left = left.withColumn("_at", F.col("_slot") + F.col("offset"))
    right = b.select(*by, F.col(slot).alias("_at"), F.col(value).alias("y"))
    return left.join(right, [*by, "_at"]).select(*by, "offset", "x", "y")


def best_by_error(pairs: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """(by, offset, cost, n): least mean squared difference; candidates with fewer than
    ``least`` matches don't count; equal costs go to the smaller offset."""
    cost = pairs.groupBy(*by, "offset").agg(F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("cost"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return cost.groupBy(*by).agg(F.min(F.struct("cost", "offset", "n")).alias("b")).select(*by, "b.offset", "b.cost", "b.n")


def best_by_correlation(pairs: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """(by, offset, r, n): largest Pearson correlation, equal ones to the smaller offset; a
    candidate whose x or y is constant has none and doesn't count."""
    found = pairs.groupBy(*by, "offset").agg(F.expr("try_divide(covar_pop(x, y), stddev_pop(x) * stddev_pop(y))").alias("r"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    return found.groupBy(*by).agg(F.min(F.struct((-F.col("r")).alias("cost"), "offset", "n")).alias("b")).select(*by, "b.offset", (-F.col("b.cost")).alias("r"), "b.n")


def trimmed_sum(df: DataFrame, by: list[str], value: Column, keep: float = 0.9) -> DataFrame:
    """(by, total, n): sum of whole-number values without the largest tenth (by count).

    A histogram of values is summed from below, so no group is sorted in one task."""
    counted = df.select(*by, F.floor(value).cast("long").alias("v")).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    rows = counted.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).withColumn("n", F.sum("c").over(whole))
    kept = F.floor(F.col("n") * F.lit(keep)).cast("long")
    take = F.greatest(F.lit(0), F.least(F.col("c"), kept - F.col("before")))
    return rows.groupBy(*by).agg(F.sum(F.col("v") * take).alias("total"), F.max("n").alias("n"))
