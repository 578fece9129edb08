"""Scalar helpers as Column expressions: rounding, time, easing, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp without time zone."""
    name = ts if isinstance(ts, str) else None
    column = F.col(name) if name else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)


def half_even(x: Column) -> Column:
    """Round to an integer, halves to the even neighbour."""
    return F.bround(x, 0).cast("long")


def remap(x: Column, in_min: float, in_max: float, out_min: float, out_max: float) -> Column:
    """Linear range remap."""
    return (x - in_min) / (in_max - in_min) * (out_max - out_min) + out_min


def frame_at(ts_ms: Column, fps: float) -> Column:
    return half_even(ts_ms * fps / 1000.0)


def time_at(frame: Column, fps: float) -> Column:
    return frame * 1000.0 / fps


def ease(a: Column, b: Column, x: Column, easing_a: Column, easing_b: Column) -> Column:
    """a + (b - a) eased at x in [0, 1]: out of a if a's easing lets go softly, into b if b's
    arrives softly."""
    leaving, arriving = easing_a.isin("out", "inout"), easing_b.isin("in", "inout")
    w = F.when(leaving & arriving, (1 - F.cos(x * math.pi)) / 2).when(arriving, F.sin(x * math.pi / 2)).when(leaving, 1 - F.cos(x * math.pi / 2)).otherwise(x)
    return a * (1 - w) + b * w


#: Aspect ratios that have a name.
RATIOS = ((1, 1), (3, 2), (2, 3), (4, 3), (3, 4), (8, 7), (7, 8), (16, 9), (9, 16))


def aspect_label(w: Column, h: Column) -> Column:
    """The nearest named ratio within 0.05, else the reduced fraction."""
    ratio = w / h
    named = F.array(*(F.struct(F.abs(ratio - a / b).alias("d"), F.lit(k).alias("k"), F.lit(f"{a}:{b}").alias("s")) for k, (a, b) in enumerate(RATIOS)))
    best = F.array_min(named)
    # the greatest common divisor by a fixed number of Euclid's steps, enough for 32 bits
    g = F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(w.cast("long").alias("a"), h.cast("long").alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))), lambda s: s["a"])
    p, q = (w / g).cast("long"), (h / g).cast("long")
    other = F.when((p >= 20) | (q >= 20), F.concat(F.format_string("%.1f", ratio.cast("double")), F.lit(":1"))).otherwise(F.concat_ws(":", p.cast("string"), q.cast("string")))
    return F.when((w == 0) | (h == 0), "").when(best["d"] < 0.05, best["s"]).otherwise(other)


#: Least widths and the labels they get, widest first.
SIZES = ((8000, "8k"), (6000, "6k"), (5000, "5k"), (4001, "C4k"), (3840, "4k"), (2700, "2.7k"), (2500, "2.5k"), (2000, "2k"))


def size_label(w: Column, h: Column) -> Column:
    out = F.lit("")
    for least, label in ((640, "480p"), (1280, "720p"), (1920, "1080p")):
        out = F.when(w >= least, label).otherwise(out)
    out = F.when((w == 1920) & (h == 1440), "1440p").otherwise(out)
    for least, label in reversed(SIZES):
        out = F.when(w >= least, label).otherwise(out)
    return out


def checksum(text: Column) -> Column:
    """CRC-32 as eight lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.crc32(text.cast("binary")))), 8, "0")


def identifier(brand: Column, model: Column, lens: Column, info: Column, w: Column, h: Column, fps: Column, extra: Column) -> Column:
    """brand-model-lens-info-WxH@fps-extra, lower case without spaces or doubled dashes; empty if a part that must be there is missing."""
    rate = F.when(brand.isin("RED", "RED RAW"), F.lit(0)).otherwise(fps).cast("string")
    raw = F.concat_ws("-", brand, model, F.coalesce(lens, F.lit("")), info, F.concat(w.cast("string"), F.lit("x"), h.cast("string"), F.lit("@"), rate), F.coalesce(extra, F.lit("")))
    plain = F.replace(F.replace(F.replace(raw, F.lit(" "), F.lit("")), F.lit("--"), F.lit("-")), F.lit("--"), F.lit("-"))
    missing = (F.coalesce(brand, F.lit("")) == "") | (F.coalesce(model, F.lit("")) == "") | (F.coalesce(info, F.lit("")) == "")
    return F.when(missing, "").otherwise(F.lower(F.btrim(plain, F.lit("- "))))


def expand(text: Column, replacements: tuple[tuple[str, str], ...]) -> Column:
    """Ordered literal replacements on lower-cased text; commas and semicolons become spaces."""
    out = F.lower(text)
    for old, new in replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.translate(out, ",;", "  ")


def duration_ms(text: Column, fps: float) -> Column:
    """'12ms', '2.5s' or a number of frames, in milliseconds; null if it is none of these."""
    number = F.expr("try_cast(0 as double)") * 0 + F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(text.rlike(r"^\s*[0-9.]+\s*ms\s*$"), number).when(text.rlike(r"^\s*[0-9.]+\s*s\s*$"), number * 1000).when(text.rlike(r"^\s*[0-9.]+\s*$"), number * 1000 / fps)


def catmull_rom(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """The segment from p1 to p2 at t in [0, 1]; missing ends are reflected."""
    p0, p3 = F.coalesce(p0, p1 * 2 - p2), F.coalesce(p3, p2 * 2 - p1)
    return 0.5 * (p1 * 2 + (p2 - p0) * t + (p0 * 2 - p1 * 5 + p2 * 4 - p3) * t * t + (p1 * 3 - p0 - p2 * 3 + p3) * t * t * t)


def axis_remap(v: tuple[Column, Column, Column], orientation: str) -> tuple[Column, ...]:
    """Reorder three channels: a letter names the axis, lower case turns its sign."""
    if len(orientation) != 3 or set(orientation.lower()) - set("xyz"):
        raise ValueError(f"not an orientation: {orientation}")
    return tuple(v["xyz".index(c.lower())] * (1 if c.isupper() else -1) for c in orientation)


def rgb_to_yuv(r: Column, g: Column, b: Column, limited: bool = True) -> tuple[Column, Column, Column]:
    """Rec. 709 luma and chroma of 8-bit RGB."""
    kr, kb = 0.2126, 0.0722
    y = r * kr + g * (1 - kr - kb) + b * kb
    u, v = (b - y) / (2 * (1 - kb)), (r - y) / (2 * (1 - kr))
    if limited:
        return y * (219 / 255) + 16, u * (224 / 255) + 128, v * (224 / 255) + 128
    return y, u + 128, v + 128
