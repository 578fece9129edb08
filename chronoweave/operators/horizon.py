"""Locking the horizon: orientations with their roll replaced, by view direction or by gravity, and tilt into turns.

Tables have the columns of ``frames``: by, t (microseconds), seq, qw, qx, qy, qz. Locks are projections; rates and tilts without a
limit are affine recurrences and so scans; only a limited tilt is sequential.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import camera
from chronoweave.functions.quaternion import Quat
from chronoweave.operators import asof, scans
from chronoweave.operators.frames import PARTS, quat
from chronoweave.operators.windows import Series


def _towards(df: DataFrame, made: Quat, percent: Column) -> DataFrame:
    """The orientation moved towards ``made`` by percent."""
    lo = F.struct(F.lit(0.0).alias("t"), *(c.alias(p) for c, p in zip(made.parts, PARTS, strict=True)))
    hi = F.struct(F.lit(1.0).alias("t"), *PARTS)
    both = df.withColumns({"lo": lo, "hi": hi, "_left": 1 - percent / 100})
    return asof.with_slerp(both, PARTS, "", "_left").select(*df.columns)


def lock(df: DataFrame, percent: Column, roll: Column, pitch: Column | None = None) -> DataFrame:
    """By where the camera looks to: its roll (and pitch, if given), in degrees, is replaced."""
    return _towards(df, camera.level(quat(), F.radians(roll), None if pitch is None else F.radians(pitch)), percent)


def lock_by_gravity(df: DataFrame, percent: Column, roll: Column, org: str = "o_", gravity: tuple[str, str] = ("gx", "gy")) -> DataFrame:
    """By gravity in the picture: the smoothed orientation turned about its axis of view so that the original's gravity
    stands upright. Without an original (columns with the prefix ``org``) the orientation itself counts, without gravity (0, 1)."""
    s = quat()
    o = Quat(*(F.coalesce(F.col(f"{org}{p}"), F.col(p)) for p in PARTS))
    c = o.inverse() * s
    # the correction's turn about the axis of view
    turned = F.atan2(2 * (c.w * c.z - c.x * c.y), 1 - 2 * (c.y * c.y + c.z * c.z))
    gx, gy = (F.coalesce(F.col(g), F.lit(d)) for g, d in zip(gravity, (0.0, 1.0), strict=True))
    rows = df.withColumn("_half", (F.atan2(gx, gy) - turned + F.radians(roll)) / 2)
    about_view = Quat(F.cos("_half"), F.lit(0.0), F.lit(0.0), F.sin("_half"))
    return _towards(rows, s * about_view, percent).drop("_half")


def _since(s: Series) -> Column:
    return (F.col(s.t) - F.lag(s.t).over(s.window())) / 1e6


def _weight(dt: Column, tau: float) -> Column:
    return dt / (tau + dt) if tau > 0 else F.when(dt.isNotNull(), 1.0)


def roll_rates(df: DataFrame, s: Series, tau: float, out: str = "rate") -> DataFrame:
    """``df`` with the smoothed rate of roll in degrees a second. Rows less than one second (and more than none) after the one before
    have one; angles go the short way round. The first of them counts as it is."""
    w = s.window()
    rows = df.withColumn("_a", F.degrees(quat().euler()[2]))
    rows = rows.withColumns({"_dt": _since(s), "_d": F.col("_a") - F.lag("_a").over(w)})
    near = F.when(F.col("_d") > 180, F.col("_d") - 360).when(F.col("_d") < -180, F.col("_d") + 360).otherwise(F.col("_d"))
    rows = rows.withColumn("_raw", F.when((F.col("_dt") > 0) & (F.col("_dt") < 1), near / F.col("_dt")))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_first": F.coalesce(F.first("_raw", ignorenulls=True).over(whole), F.lit(0.0)), "_w": F.when(F.col("_raw").isNotNull(), _weight(F.col("_dt"), tau)).otherwise(0.0)})
    done = scans.scan(rows, s, 1 - F.col("_w"), F.col("_w") * F.coalesce("_raw", F.lit(0.0)), start=F.col("_first"), out="_state")
    return done.withColumn(out, F.when(F.col("_raw").isNotNull(), F.col("_state"))).select(*df.columns, out)


def tilts(df: DataFrame, s: Series, tau: float, threshold: float = 5.0, multiplier: float = 1.0, limit: float | None = None, rate: str = "rate", out: str = "tilt") -> DataFrame:
    """``df`` with a tilt in degrees that follows rates above a threshold; ``limit`` is how much it may change a second."""
    rows = df.withColumn("_to", F.when(F.abs(rate) > threshold, F.col(rate) * multiplier).otherwise(0.0)).withColumn("_dt", _since(s))
    rows = rows.withColumn("_w", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _weight(F.col("_dt"), tau))), F.lit(1.0)))
    if limit is None:
        return scans.scan(rows, s, 1 - F.col("_w"), F.col("_w") * F.col("_to"), out=out).select(*df.columns, out)

    def follow(pdf) -> dict[str, np.ndarray]:
        state, made = None, np.empty(len(pdf))
        for i, (to, w, dt) in enumerate(zip(pdf["_to"], pdf["_w"], pdf["_dt"], strict=True)):
            step = 0.0 if state is None else (to - state) * w
            most = limit * dt if dt > 0 else abs(step)
            state = to if state is None else state + min(max(step, -most), most)
            made[i] = state
        return {out: made}

    return scans.per_series(rows, s, follow, {out: "double"}).select(*df.columns, out)
