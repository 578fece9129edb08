"""Calibrations: the inverse of an angle polynomial, other models fitted to it, and planes of pixel formats."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest angle a fit goes to: the tangent must stay finite.
STEEPEST = min(1.55, math.pi / 2 - 1e-3)


def theta_for_radius(radius: Column, k: tuple[Column, Column, Column, Column]) -> Column:
    """The angle whose polynomial theta (1 + k1 theta^2 + .. + k4 theta^8) is a radius, by halving [0, STEEPEST] 60 times;
    0 for no radius. All in generated or interpreted code of the engine, without Python."""
    def value(a: Column) -> Column:
        q = a * a
        return a * (1 + q * (k[0] + q * (k[1] + q * (k[2] + q * k[3]))))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["a"] + s["b"]) / 2
        below = value(middle) < radius
        return F.struct(F.when(below, middle).otherwise(s["a"]).alias("a"), F.when(below, s["b"]).otherwise(middle).alias("b"))

    ends = F.struct(F.lit(0.0).alias("a"), F.lit(STEEPEST).alias("b"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), ends, halve, lambda s: (s["a"] + s["b"]) / 2)
    return F.when(radius <= 0, 0.0).otherwise(found)


#: Powers of the undistorted radius that each radial model adds, in the order of its coefficients.
POWERS = {"poly3": (2,), "poly5": (2, 4), "ptlens": (3, 2, 1)}


def fit(model: str, k: np.ndarray, theta: float, points: int = 512) -> tuple[list[float], float]:
    """A radial model's coefficients by least squares from an angle polynomial up to ``theta``, and the largest relative
    difference of what both do to a picture."""
    a = np.linspace(1e-6, theta, points)
    distorted, plain = a * (1 + sum(c * a ** (2 * i + 2) for i, c in enumerate(k[:4]))), np.tan(a)
    basis = np.stack([plain**p for p in POWERS[model]], -1)
    found = np.linalg.lstsq(basis, distorted / plain - 1, rcond=None)[0]
    again = plain * (1 + basis @ found)
    wanted, got = (np.where(d > 1e-12, plain / np.where(d > 1e-12, d, 1), 1.0) for d in (distorted, again))
    return found.tolist(), float(np.max(np.abs(got - wanted) / np.maximum(np.abs(wanted), 1e-9)))


def fitted(model: str, k: Column, theta: Column) -> Column:
    """``fit`` on columns (array<double>, double) as an array: the coefficients, then the difference."""

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for c, t in zip(x, y, strict=True):
            if c is None or not t > 0:
                out.append(None)
                continue
            found, off = fit(model, np.asarray(c, float), float(t))
            out.append([*found, off])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(each, "array<double>")(k, theta)


def planes(name: Column) -> Column:
    """array<struct(kind, plane, channels, top)>: the planes of a decoder's pixel format, by rule from its name; null
    for names that must be converted to yuv444p16le first."""
    low = F.lower(name)
    depth = F.regexp_extract(low, r"p(\d+)le$", 1).try_cast("int")

    def plane(kind: str, at: int, channels: tuple[int, ...], top: Column | float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(at).alias("plane"), F.array(*map(F.lit, channels)).cast("array<int>").alias("channels"), (top if isinstance(top, Column) else F.lit(top)).cast("double").alias("top"))

    def each(kind: str, n: int, top: Column | float) -> Column:
        return F.array(*(plane(kind, i, (i,), top) for i in range(n)))

    peak = F.pow(F.lit(2.0), depth) - 1
    whole = {"ayuv64le": ("ayuv16", (3, 0, 1, 2), 65535.0), "rgb24": ("rgb8", (), 255.0), "rgba": ("rgba8", (), 255.0), "rgb48be": ("rgb16", (), 65535.0), "rgba64be": ("rgba16", (), 65535.0)}
    out = F.when(low.isin("nv12", "nv21"), F.array(plane("luma8", 0, (0,), 255.0), F.when(low == "nv12", plane("uv8", 1, (1, 2), 255.0)).otherwise(plane("uv8", 1, (2, 1), 255.0))))
    # these formats use all sixteen bits, whatever their names say
    out = out.when(low.rlike("^p[024]1[06]le$"), F.array(plane("luma16", 0, (0,), 65535.0), plane("uv16", 1, (1, 2), 65535.0)))
    out = out.when(low.isin("yuv420p", "yuvj420p"), each("luma8", 3, 255.0)).when(low.rlike("^yuv4(20|22|44)p1[0246]le$"), each("luma16", 3, peak)).when(low.rlike("^yuva444p1[026]le$"), each("luma16", 4, peak))
    out = out.when(low.rlike("^gbra?pf32le$"), F.slice(F.array(*(plane("r32f", 0, (c,), 255.0) for c in (2, 0, 1, 3))), F.lit(1), F.when(low.contains("a"), 4).otherwise(3)))
    for key, (kind, channels, top) in whole.items():
        out = out.when(low == key, F.array(plane(kind, 0, channels, top)))
    return out
