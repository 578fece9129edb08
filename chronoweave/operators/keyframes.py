"""Keyframe curves: look-up with easing, neighbours, snapping, upserts, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.scalars import ease
from chronoweave.operators import asof


def value_at(probes: DataFrame, keys: DataFrame, by: list[str], t: str, seq: str, provider: Column | None = None) -> DataFrame:
    """``probes`` with ``value``: keys (by, t, seq, value, easing) eased between neighbours, held
    beyond the ends; ``provider``, where it isn't null, comes first."""
    found = asof.bracket(probes, keys, by, t, seq, ["value", "easing"])
    lo, hi = F.col("lo"), F.col("hi")
    x = asof.share(lo, hi, F.col(t))
    inner = ease(lo["value"], hi["value"], x, lo["easing"], hi["easing"])
    value = F.coalesce(inner, lo["value"], hi["value"])
    return found.withColumn("value", value if provider is None else F.coalesce(provider, value)).drop("lo", "hi")


def value_at_sensor(probes: DataFrame, keys: DataFrame, offsets: DataFrame, by: list[str], t: str, seq: str, scale: float = 1.0) -> DataFrame:
    """``probes`` at the sensor's times, moved to the video's by the offset curve (by, t, seq, value; microseconds, 0 without
    any) and scaled, with ``value`` of the keys there."""
    found = asof.bracket(probes, offsets, by, t, seq, ["value"])
    offset = F.coalesce(asof.lerp(F.col("lo"), F.col("hi"), F.col(t), "value"), F.lit(0.0))
    moved = found.withColumn(t, F.bround((F.col(t) + offset) * scale, 0).cast("long")).drop("lo", "hi")
    return value_at(moved, keys, by, t, seq)


def neighbours(keys: DataFrame, by: list[str], t: str) -> DataFrame:
    """``keys`` with the strictly earlier and later key times."""
    w = Window.partitionBy(*by).orderBy(t)
    return keys.withColumn("previous", F.max(t).over(w.rangeBetween(Window.unboundedPreceding, -1))).withColumn("next", F.min(t).over(w.rangeBetween(1, Window.unboundedFollowing)))


def upsert(keys: DataFrame, changes: DataFrame, by: list[str], t: str, value: str, snap: int) -> DataFrame:
    """Keys within ``snap`` of a change (the earlier one first) take its value; other changes are new."""
    bucket = lambda c: F.floor(c / (2 * snap + 1))
    near = changes.select(*by, F.col(t).alias("_ct"), F.col(value).alias("_cv"), F.explode(F.array(*(bucket(F.col(t)) + i for i in (-1, 0, 1)))).alias("_b"))
    held = keys.withColumn("_b", bucket(F.col(t)))
    hits = held.join(near, [*by, "_b"]).where(F.abs(F.col(t) - F.col("_ct")) <= snap)
    chosen = hits.groupBy(*by, "_ct").agg(F.min(F.struct(F.col(t).alias("t"))).alias("_key"), F.first("_cv").alias("_cv"))
    updates = chosen.groupBy(*by, F.col("_key.t").alias(t)).agg(F.max(F.struct("_ct", "_cv")).alias("_u"))
    kept = keys.join(updates, [*by, t], "left").withColumn(value, F.coalesce("_u._cv", value)).drop("_u")
    new = changes.join(chosen.select(*by, F.col("_ct").alias(t)), [*by, t], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def as_json(keys: DataFrame, by: list[str], t: str, fields: list[str]) -> DataFrame:
    """(by, json): {time: {fields}} with times in order."""
    entry = F.struct(F.col(t).alias("t"), F.struct(*fields).alias("v"))
    pairs = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["t"].cast("string").alias("k"), e["v"].alias("v")))
    return keys.groupBy(*by).agg(F.to_json(F.map_from_entries(pairs)).alias("json"))
