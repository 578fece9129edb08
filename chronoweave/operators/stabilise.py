"""From samples to corrections: durations, channel filters, integration by method, conversion between methods, smoothing by
name, and the chain of rotation, lock, smoothing and correction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import camera, scalars
from chronoweave.functions.quaternion import from_euler
from chronoweave.operators import asof, filters, frames, horizon, orientation, scans, windows
from chronoweave.operators.frames import PARTS, quat
from chronoweave.operators.windows import Series

GYRO, ACCEL = ("gx", "gy", "gz"), ("ax", "ay", "az")
_DOUBLES = dict.fromkeys(PARTS, "double")

#: Integration methods by number; 0 keeps a recording's own orientations.
METHODS: dict[int, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {
    1: lambda t, g, a: orientation.complementary(g, a, orientation.steps(t, g)),
    2: lambda t, g, a: orientation.vqf(g, a, orientation.duration(t) / max(len(t), 1) or 1.0),
    3: lambda t, g, a: orientation.simple(g, orientation.steps(t, g)),
    4: lambda t, g, a: orientation.with_gravity(g, a, orientation.steps(t, g)),
    5: lambda t, g, a: orientation.mahony(g, a, orientation.steps(t, g, 0.001, False)),
    6: lambda t, g, a: orientation.madgwick(g, a, orientation.steps(t, g, 0.001, False)),
}

SMOOTHERS = ("none", "default", "plain", "fixed")


def durations(samples: DataFrame, by: list[str], t_us: str, given_ms: Column) -> DataFrame:
    """(by, duration_ms): the samples' span and one sample time more, if it is positive and more than a
    hundredth of a millisecond off what was given; else what was given."""
    n = F.count(F.lit(1))
    span = (F.max(t_us) / 1000 - F.min(t_us) / 1000) * ((n + 1) / n)
    found = samples.groupBy(*by).agg(span.alias("_span"), F.max(given_ms).alias("_given"))
    return found.select(*by, F.when((F.col("_span") > 0) & (F.abs(F.col("_span") - F.col("_given")) > 0.01), F.col("_span")).otherwise(F.col("_given")).alias("duration_ms"))


def on_channels(df: DataFrame, s: Series, columns: tuple[str, ...], fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` with a function applied to each of a series' channels, as arrays; nulls enter as 0 and stay null."""
    def apply(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        return {f"_new_{c}": fn(np.nan_to_num(pdf[c].to_numpy(float))) for c in columns}

    made = scans.per_series(df, s, apply, {f"_new_{c}": "double" for c in columns})
    return made.withColumns({c: F.when(F.col(c).isNotNull(), F.col(f"_new_{c}")) for c in columns}).select(*df.columns)


def lowpass(df: DataFrame, s: Series, columns: tuple[str, ...], cutoff: float, rate: float) -> DataFrame:
    """Channels without their high frequencies, without phase."""
    return on_channels(df, s, columns, lambda x: filters.lowpass(x, cutoff, rate))


def lowpass_turns(df: DataFrame, s: Series, cutoff: float, rate: float) -> DataFrame:
    """Orientations whose parts are low-passed and brought back to length one; series of fewer than four rows stay."""
    def apply(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        q = pdf[list(PARTS)].to_numpy(float)
        if len(q) >= 4:
            q = orientation.unit(np.stack([filters.lowpass(x, cutoff, rate) for x in q.T], 1))
        return {f"_new_{p}": v for p, v in zip(PARTS, q.T, strict=True)}

    made = scans.per_series(df, s, apply, {f"_new_{p}": "double" for p in PARTS})
    return made.withColumns({p: F.col(f"_new_{p}") for p in PARTS}).select(*df.columns)


def prepared(df: DataFrame, s: Series, axes: str = "XYZ", bias: tuple[float, float, float] = (0.0, 0.0, 0.0), cutoff: float = 0.0, kernel: int = 0, rate: float = 0.0) -> DataFrame:
    """Samples with the bias added to the rates, axes renamed, then low-passed (``cutoff``) and median-filtered twice (``kernel``) if asked."""
    rates = scalars.axis_remap(tuple(F.col(c) + b for c, b in zip(GYRO, bias, strict=True)), axes)
    pulls = scalars.axis_remap(tuple(map(F.col, ACCEL)), axes)
    out = df.withColumns(dict(zip((*GYRO, *ACCEL), (*rates, *pulls), strict=True)))
    if cutoff > 0 and rate > 0:
        out = lowpass(out, s, (*GYRO, *ACCEL), cutoff, rate)
    if kernel > 0:
        for _ in range(2):
            out = out.withColumns({c: F.when(F.col(c).isNotNull(), windows.median_filter(s, c, kernel + 1 - kernel % 2)) for c in (*GYRO, *ACCEL)})
    return out


def integrated(df: DataFrame, s: Series, method: int) -> DataFrame:
    """``df`` with the orientation of each sample (qw..qz) by a method's number."""
    run = METHODS[method]

    def apply(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        g, a = (pdf[list(c)].to_numpy(float) for c in (GYRO, ACCEL))
        return dict(zip(PARTS, np.asarray(run(pdf[s.t].to_numpy(float), g, a)).T, strict=True))

    return scans.per_series(df, s, apply, _DOUBLES)


def at_or_after(probes: DataFrame, turns: DataFrame, by: list[str], prefix: str, t: str = "t", seq: str = "seq") -> DataFrame:
    """``probes`` with the first orientation at or after each time; the identity behind the last."""
    found = asof.bracket(probes, turns, by, t, seq, list(PARTS))
    return found.select(*probes.columns, *(F.coalesce(F.col(f"hi.{p}"), F.lit(float(k == 0))).alias(f"{prefix}{p}") for k, p in enumerate(PARTS)))


def converted(org: DataFrame, method: DataFrame, images: DataFrame, s: Series, share: float = 0.005) -> DataFrame:
    """``org`` moved to another method's orientations: the correction from one to the other (with the image's) is taken whole
    at first, then followed by ``share`` a row."""
    by = list(s.by)
    rows = at_or_after(at_or_after(org, method, by, "n_", s.t, s.seq), images, by, "i_", s.t, s.seq)
    way = quat("n_") * quat("i_") * quat().inverse()
    rows = rows.withColumns({f"c_{p}": c for p, c in zip(PARTS, way.parts, strict=True)})

    def follow(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        goal = pdf[[f"c_{p}" for p in PARTS]].to_numpy(float)
        state, out = np.array([1.0, 0, 0, 0]), np.empty(goal.shape)
        for i, q in enumerate(goal):
            state = orientation.slerp(state, q, share if i else 1.0)
            out[i] = state
        return {f"f_{p}": v for p, v in zip(PARTS, out.T, strict=True)}

    done = scans.per_series(rows, s, follow, {f"f_{p}": "double" for p in PARTS})
    return done.select(*(c for c in org.columns if c not in PARTS), *(c.alias(p) for c, p in zip((quat("f_") * quat()).parts, PARTS, strict=True)))


def smoothed(df: DataFrame, s: Series, kind: int | str, angles: tuple[float, float, float] = (0.0, 0.0, 0.0), **settings: float) -> DataFrame:
    """Orientations by a smoother's name or number (numbers beyond the ends count as the ends); ``angles`` (roll, pitch, yaw in
    degrees) are those of the fixed one."""
    name = SMOOTHERS[min(max(kind, 0), len(SMOOTHERS) - 1)] if isinstance(kind, int) else kind
    if name == "none":
        return df
    if name == "fixed":
        held = camera.fixed_orientation(*(F.lit(float(a)) for a in angles))
        return df.withColumns(dict(zip(PARTS, held.parts, strict=True)))
    run = {"default": orientation.smooth_default, "plain": orientation.smooth_plain}[name]

    def apply(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        t = pdf[s.t].to_numpy(float)
        mean = orientation.duration(t) / max(len(t), 1) or 1.0
        return {f"_new_{p}": v for p, v in zip(PARTS, run(pdf[list(PARTS)].to_numpy(float), 1 / mean, **settings).T, strict=True)}

    made = scans.per_series(df, s, apply, {f"_new_{p}": "double" for p in PARTS})
    return made.withColumns({p: F.col(f"_new_{p}") for p in PARTS}).select(*df.columns)


def stabilised(org: DataFrame, s: Series, kind: int | str, rotation: tuple[float, float, float] = (0.0, 0.0, 0.0), percent: float = 0.0, roll: float = 0.0, ranges: list[tuple[int, int]] = (), **settings) -> tuple[DataFrame, DataFrame]:
    """(corrections, largest angles) of orientations: each is turned by ``rotation`` (pitch, roll, yaw in degrees), its horizon
    locked by percent, the series smoothed; the correction leads from the smoothed to the original one."""
    pitch, tip, yaw = (F.radians(F.lit(float(a))) for a in rotation)
    turned = org.withColumns(dict(zip(PARTS, (quat() * from_euler(tip, pitch, yaw)).parts, strict=True))) if any(rotation) else org
    locked = horizon.lock(turned, F.lit(percent), F.lit(roll)) if percent > 1e-6 else turned
    made = smoothed(locked, s, kind, **settings)
    by = list(s.by)
    return frames.correction(org, made, by, s.t), frames.max_angles(org, made, by, ranges, s.t)
