"""As-of joins: floor and ceiling rows of a series for each probe, and what follows from them.

Both sides are united and scanned in time order. The scan is cut into time buckets: a window
works within (series, bucket), and a small table of each bucket's first and last samples
carries values over, so one long series is spread over many tasks. Tie and clamp
rules differ between look-ups and are kept apart on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.quaternion import Quat

#: Width of a time bucket: a day in microseconds.
BUCKET_US = 86_400_000_000


def bracket(probes: DataFrame, samples: DataFrame, by: list[str], t: str, seq: str, values: list[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """``probes`` with ``lo`` and ``hi``: the last sample at or before, and the first at or
    after ``t``, as struct(t, seq, *values); null where there is none. Of samples of one
    time ``lo`` takes the largest ``seq``, ``hi`` the smallest."""
    sample = F.struct(F.col(t).alias("t"), F.col(seq).alias("seq"), *(F.col(v).alias(v) for v in values))
    mine = F.struct(*(F.col(c).alias(c) for c in probes.columns))
    kind, shape = samples.select(sample.alias("s")).schema["s"].dataType, probes.select(mine.alias("p")).schema["p"].dataType
    left = probes.select(*by, F.col(t).alias("_t"), F.lit(None).cast(kind).alias("s"), mine.alias("p"))
    right = samples.select(*by, F.col(t).alias("_t"), sample.alias("s"), F.lit(None).cast(shape).alias("p"))
    rows = left.unionByName(right).withColumn("_b", F.floor(F.col("_t") / bucket_us))
    parts = [*by, "_b"]
    tie = F.col("s.seq")
    # at one time samples stand before probes for lo, and behind them for hi
    up = Window.partitionBy(*parts).orderBy("_t", F.col("s").isNull(), tie).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*parts).orderBy(F.desc("_t"), F.col("s").isNull(), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.select(*parts, "p", F.last("s", ignorenulls=True).over(up).alias("lo"), F.last("s", ignorenulls=True).over(down).alias("hi")).where("p is not null")
    ends = rows.groupBy(*parts).agg(F.max("s").alias("top"), F.min("s").alias("low"))
    over = Window.partitionBy(*by)
    before = over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = over.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(*parts, F.last("top", ignorenulls=True).over(before).alias("top"), F.first("low", ignorenulls=True).over(after).alias("low"))
    found = near.join(carried, parts).select("p.*", F.coalesce("lo", "top").alias("lo"), F.coalesce("hi", "low").alias("hi"))
    return found


def nearest(lo: Column, hi: Column, t: Column, within: int) -> Column:
    """An exact hit, else the strictly nearer side if it is nearer than ``within``; sides that
    are equally far give null."""
    a, b = t - lo["t"], hi["t"] - t
    far = F.lit(2**62)
    da, db = F.coalesce(a, far), F.coalesce(b, far)
    return F.when(a == 0, lo).when((da < db) & (da < within), lo).when((db < da) & (db < within), hi)


def later_than_closest(probes: DataFrame, samples: DataFrame, by: list[str], t: str, seq: str, value: str, within: int, rows: int) -> DataFrame:
    """``probes`` with ``later``: the value that many rows behind the sample closest in time (the earlier of two), if
    that one is not farther than ``within`` and there are so many."""
    ahead = samples.withColumn("later", F.lead(value, rows).over(Window.partitionBy(*by).orderBy(t, seq)))
    found = bracket(probes, ahead, by, t, seq, ["later"])
    a, b = F.col(t) - F.col("lo.t"), F.col("hi.t") - F.col(t)
    pick = F.when(F.coalesce(a <= b, F.col("hi").isNull()), F.when(a <= within, F.col("lo.later"))).when(b <= within, F.col("hi.later"))
    return found.select(*probes.columns, pick.alias("later"))


def share(lo: Column, hi: Column, t: Column) -> Column:
    """How far ``t`` is from lo to hi, 0 where both are one time."""
    span = hi["t"] - lo["t"]
    # the engine may work out a quotient before it knows whether its case holds
    return F.when(span == 0, F.lit(0.0)).otherwise(F.try_divide(t - lo["t"], span))


def lerp(lo: Column, hi: Column, t: Column, value: str) -> Column:
    """Linear between neighbours, the end's value beyond the ends, null without samples."""
    x = share(lo, hi, t)
    inner = lo[value] * (1 - x) + hi[value] * x
    return F.coalesce(inner, lo[value], hi[value])


def slerp(lo: Column, hi: Column, t: Column, parts: tuple[str, str, str, str]) -> Quat:
    """Spherical between neighbours; an end's rotation beyond the ends."""
    a, b = (Quat(*(F.coalesce(s[p], o[p]) for p in parts)) for s, o in ((lo, hi), (hi, lo)))
    return a.slerp(b, F.coalesce(share(lo, hi, t), F.lit(0.0)))


def with_slerp(df: DataFrame, parts: tuple[str, str, str, str], prefix: str = "", t: str = "t") -> DataFrame:
    """``df`` (with lo and hi) with the columns <prefix><part> of ``slerp``, one projection a step: each step's
    values are computed once for a row, and no expression holds another one many times."""
    ends = {f"_{x}{i}": F.coalesce(F.col(a)[p], F.col(b)[p]) for x, a, b in (("a", "lo", "hi"), ("b", "hi", "lo")) for i, p in enumerate(parts)}
    out = df.withColumns({**ends, "_u": F.coalesce(share(F.col("lo"), F.col("hi"), F.col(t)), F.lit(0.0))})
    a, b = (Quat(*(F.col(f"_{x}{i}") for i in range(4))) for x in "ab")
    out = out.withColumn("_dot", a.dot(b))
    size, u = F.abs("_dot"), F.col("_u")
    out = out.withColumns({"_near": size > 0.9995, "_far": F.acos(F.least(size, F.lit(1.0))), "_sign": F.when(F.col("_dot") < 0, -1.0).otherwise(1.0)})
    near, far = F.col("_near"), F.col("_far")
    out = out.withColumns({"_wa": F.when(near, 1 - u).otherwise(F.try_divide(F.sin((1 - u) * far), F.sin(far))), "_wb": F.when(near, u).otherwise(F.try_divide(F.sin(u * far), F.sin(far))) * F.col("_sign")})
    out = out.withColumns({f"_m{i}": p * F.col("_wa") + q * F.col("_wb") for i, (p, q) in enumerate(zip(a.parts, b.parts, strict=True))})
    mixed = Quat(*(F.col(f"_m{i}") for i in range(4)))
    out = out.withColumn("_n", F.sqrt(mixed.dot(mixed)))
    made = {f"{prefix}{p}": F.when(F.col("_n") > 0, F.try_divide(m, F.col("_n"))) for p, m in zip(parts, mixed.parts, strict=True)}
    return out.withColumns(made).drop(*ends, "_u", "_dot", "_near", "_far", "_sign", "_wa", "_wb", "_n", *(f"_m{i}" for i in range(4)))
