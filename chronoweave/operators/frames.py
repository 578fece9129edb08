"""Orientation tables against each other: corrections, their largest angles, held trims, and the transforms of image rows.

An orientation table has the columns ``by``, ``t`` (microseconds), ``seq``, qw, qx, qy, qz.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import matrix
from chronoweave.functions.quaternion import Quat
from chronoweave.operators import asof

PARTS = ("qw", "qx", "qy", "qz")


def quat(prefix: str = "") -> Quat:
    return Quat(*(F.col(f"{prefix}{p}") for p in PARTS))


def _as(q: Quat, prefix: str = "") -> list[Column]:
    return [c.alias(f"{prefix}{p}") for c, p in zip(q.parts, PARTS, strict=True)]


def correction(org: DataFrame, smooth: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """(by, t, qw..qz): from the smoothed to the original orientation, where both have the time."""
    other = smooth.select(*by, t, *_as(quat(), "s_"))
    return org.select(*by, t, *PARTS).join(other, [*by, t]).select(*by, t, *_as(quat("s_").inverse() * quat()))


def max_angles(org: DataFrame, smooth: DataFrame, by: list[str], ranges: list[tuple[int, int]] = (), t: str = "t", seq: str | None = None, wound: bool = False) -> DataFrame:
    """(by, pitch, yaw, roll): the largest angles, in degrees, of the correction about each axis,
    over smoothed rows within ``ranges`` (all without any); the identity stands for a missing original.
    Rows with the same time meet by ``seq``, if it is named. With ``wound`` quaternions' signs count: turns
    past a half and up to a full one keep their angle."""
    at = [t, seq] if seq else [t]
    inside = F.lit(not ranges)
    for a, b in ranges:
        inside = inside | F.col(t).between(a, b)
    mine = smooth.where(inside).select(*by, *at, *_as(quat(), "s_"))
    rows = mine.join(org.select(*by, *at, *PARTS), [*by, *at], "left")
    found = Quat(F.coalesce("qw", F.lit(1.0)), *(F.coalesce(p, F.lit(0.0)) for p in PARTS[1:]))
    rows = rows.select(*by, *_as(quat("s_").inverse() * found))
    about_x, about_y, about_z = quat().wound_euler() if wound else quat().euler()
    # the tables' names: pitch is about x, yaw about y, roll about z
    return rows.groupBy(*by).agg(*(F.degrees(F.max(F.abs(a))).alias(n) for a, n in ((about_x, "pitch"), (about_y, "yaw"), (about_z, "roll"))))


def trim_fill(rows: DataFrame, by: list[str], ranges: list[tuple[int, int]], t: str = "t", seq: str = "seq") -> DataFrame:
    """``rows`` with the orientation outside ``ranges`` (sorted, apart) replaced.

    Before the first range the first row in it or after it holds, behind the last one the last row up to its end.
    Between two ranges it goes from the first row behind the one (t > its end) to the first row from
    the other's start on, if there is one. Boundary rows come from one aggregation of each series."""
    if not ranges:
        return rows
    row = F.struct(F.col(t).alias("t"), F.col(seq).alias("seq"), *PARTS)
    edges = [F.min(F.when(F.col(t) >= ranges[0][0], row)).alias("_first"), F.max(F.when(F.col(t) <= ranges[-1][1], row)).alias("_last")]
    for k, ((_, end), (start, _)) in enumerate(zip(ranges[:-1], ranges[1:], strict=True)):
        edges += [F.min(F.when(F.col(t) > end, row)).alias(f"_from{k}"), F.min(F.when(F.col(t) >= start, row)).alias(f"_to{k}")]
    found = rows.join(rows.groupBy(*by).agg(*edges), by, "left")
    here = quat()

    def of(name: str) -> Quat:
        return Quat(*(F.col(f"{name}.{p}") for p in PARTS))

    at = F.col(t)
    cases: list[tuple[Column, Quat]] = [(F.col("_first").isNull(), here)]
    cases += [(at.between(a, b), here) for a, b in ranges]
    cases += [(at < ranges[0][0], of("_first"))]
    for k in range(len(ranges) - 1):
        found = asof.with_slerp(found.withColumns({"lo": F.col(f"_from{k}"), "hi": F.col(f"_to{k}")}), PARTS, f"_mixed{k}_", t).drop("lo", "hi")
        cases += [((at > ranges[k][1]) & (at < ranges[k + 1][0]), quat(f"_mixed{k}_"))]
    # with no row up to the last end, the first one holds
    cases += [(F.col("_last").isNull(), of("_first")), (F.lit(True), of("_last"))]
    out = []
    for i in range(4):
        c = F.lit(None).cast("double")
        for when, q in reversed(cases):
            c = F.when(when, q.parts[i]).otherwise(c)
        out.append(c.alias(PARTS[i]))
    return found.select(*(x for x in rows.columns if x not in PARTS), *out)


def row_transforms(frames: DataFrame, org: DataFrame, smooth: DataFrame, by: list[str], rows: int, rotation: float = 0.0, flipped: bool = False) -> DataFrame:
    """(by, frame, y, m0..m8): for each image row, the matrix that takes an output pixel to a ray.

    ``frames`` has by, frame, t (microseconds, of its middle), readout_ms and the output's fx, fy, cx, cy. A row's time runs from
    half a readout before the middle; without a readout a frame is one row. The turn
    is the smoothed one at the middle, after the way from the middle's to the row's own orientation;
    ``rotation`` (degrees) turns the picture, and a buffer read bottom up (``flipped``) changes other signs."""
    still = F.col("readout_ms") == 0
    kept = [*by, "frame", "fx", "fy", "cx", "cy", "y"]
    at_middle = asof.bracket(frames.withColumn("_seq", F.lit(0)), org, by, "t", "seq", list(PARTS))
    at_middle = asof.with_slerp(at_middle, PARTS, "c_").select(*frames.columns, *(f"c_{p}" for p in PARTS))
    at_middle = asof.bracket(at_middle, smooth, by, "t", "seq", list(PARTS))
    flat = asof.with_slerp(at_middle, PARTS, "s_").select(*frames.columns, *_as(quat("s_") * quat("c_").inverse(), "k_"))
    each = flat.withColumn("y", F.explode(F.sequence(F.lit(0), F.when(still, 0).otherwise(rows - 1))))
    time = F.col("t") + F.when(still, 0).otherwise(F.round((F.col("y") / rows - 0.5) * F.col("readout_ms") * 1000)).cast("long")
    each = each.select(*kept, *(f"k_{p}" for p in PARTS), time.alias("t"))
    found = asof.with_slerp(asof.bracket(each, org, by, "t", "seq", list(PARTS)), PARTS, "o_")
    oriented = found.select(*kept, *_as(quat("k_") * quat("o_")))
    turn = matrix.euler_zyx(F.lit(rotation), F.lit(0.0), F.lit(0.0)) @ matrix.from_quat(quat()) if rotation else matrix.from_quat(quat())
    sign = (1, 1, -1, 1, 1, -1, -1, -1, 1) if flipped else (1, -1, -1, -1, 1, 1, -1, 1, 1)
    r = matrix.Matrix(tuple(m * s for m, s in zip(turn.m, sign, strict=True)))
    # the inverse of (intrinsics x turn): a turn's inverse is its transpose
    fx, fy, cx, cy = (F.col(c) for c in ("fx", "fy", "cx", "cy"))
    ray = matrix.Matrix((1 / fx, F.lit(0.0), -cx / fx, F.lit(0.0), 1 / fy, -cy / fy, F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return oriented.select(*by, "frame", "y", *(c.alias(f"m{i}") for i, c in enumerate((r.transposed @ ray).m)))
