"""Camera and lens expressions: axes, intrinsics, readout, field of view, names and paths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.functions.quaternion import Quat

_HALF = math.sqrt(0.5)


def camera_axes(x: Column, y: Column, z: Column, degrees: bool = False) -> tuple[Column, Column, Column]:
    """A sensor's axes as the camera's: (-y, x, z); rates in degrees become radians."""
    out = (-y, x, z)
    return tuple(map(F.radians, out)) if degrees else out


def _halves(*angles: Column) -> list[Column]:
    return [f(a / 2) for a in angles for f in (F.cos, F.sin)]


def _after(q: Quat, fixed: tuple[float, float, float, float], first: bool) -> Quat:
    """``q`` times a constant turn that comes first, or last."""
    c = Quat(*map(F.lit, fixed))
    return q * c if first else c * q


def fixed_orientation(roll: Column, pitch: Column, yaw: Column) -> Quat:
    """A camera held at angles in degrees: yaw about z, then pitch about x, then roll about y, from the
    sensor's rest pose (a quarter turn about y, one about z, and one more about y)."""
    cr, sr, cp, sp, cy, sy = _halves(F.radians(roll), F.radians(pitch), F.radians(yaw))
    turned = Quat(cy * cp * cr - sy * sp * sr, cy * sp * cr - sy * cp * sr, cy * cp * sr + sy * sp * cr, cy * sp * sr + sy * cp * cr)
    return _after(turned, (0.0, 0.0, _HALF, _HALF), True)


def level(q: Quat, roll: Column, pitch: Column | None = None) -> Quat:
    """``q`` with its roll (and, if given, its pitch), in radians, replaced: only where it looks to is kept."""
    # where q takes the z axis
    x, y, z = 2 * (q.x * q.z + q.w * q.y), 2 * (q.y * q.z - q.w * q.x), 1 - 2 * (q.x * q.x + q.y * q.y)
    up = pitch if pitch is not None else F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -z)))
    cr, sr, cp, sp, cy, sy = _halves(roll, up, F.atan2(y, x))
    # about y, then x, then z
    turned = Quat(cy * cp * cr + sy * sp * sr, cy * sp * cr + sy * cp * sr, sy * cp * cr - cy * sp * sr, cy * cp * sr - sy * sp * cr)
    return _after(turned, (0.5, 0.5, 0.5, 0.5), False)


def unit_ray(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Length one; a zero vector stays."""
    n = F.sqrt(x * x + y * y + z * z)
    return tuple(F.when(n > 0, c / n).otherwise(c) for c in (x, y, z))


def scaled_fps(fps: Column, scale: Column) -> Column:
    return fps * F.coalesce(scale, F.lit(1.0))


def scaled_duration(ms: Column, scale: Column) -> Column:
    return ms / F.coalesce(scale, F.lit(1.0))


def trim_ratio(ranges: Column) -> Column:
    """The share that array<struct(start, stop)> covers; 1 without ranges."""
    total = F.aggregate(ranges, F.lit(0.0), lambda s, x: s + x["stop"] - x["start"])
    return F.when(F.size(ranges) > 0, total).otherwise(1.0)


def open_ranges(ranges: Column, ms: Column) -> Column:
    """Shares as milliseconds; a bound at the clip's own start or end is null: no cut there."""
    return F.transform(ranges, lambda x: F.struct(F.when(x["start"] > 0, x["start"] * ms).alias("start_ms"), F.when(x["stop"] < 1, x["stop"] * ms).alias("stop_ms")))


def new_intrinsics(fx: Column, fy: Column, stretch: Column, fov: Column, out_w: Column, out_h: Column) -> tuple[Column, Column, Column, Column]:
    """(fx, fy, cx, cy) of the output: focal lengths over stretch and field of view, centred."""
    ratio = F.when(stretch > 0.01, stretch).otherwise(1.0)
    return fx / ratio / fov, fy / ratio / fov, out_w / 2, out_h / 2


def readout_ms(readout: Column, captured: Column, sensor: Column, inverted: Column, horizontal: Column, flipped: Column) -> Column:
    """A frame's readout time: the captured share of the sensor's height, negative when read backwards;
    a flipped buffer turns it, unless rows are read sideways."""
    part = F.when((sensor > 0) & captured.isNotNull(), captured / sensor).otherwise(1.0)
    return F.abs(readout) * part * F.when(flipped & ~horizontal, -1).otherwise(1) * F.when(inverted, -1).otherwise(1)


def frame_fov(keyed: Column, scale: Column, fovs: Column, frame: Column, width: Column, out_width: Column, overview: Column | None = None) -> Column:
    """A frame's field of view: a keyframe's value or else the scale, times the frame's own (the
    last one past the end), at least 0.001, times the ratio of widths."""
    base = F.coalesce(keyed, scale) + (F.when(overview, 1.0).otherwise(0.0) if overview is not None else 0.0)
    n = F.size(fovs)
    own = F.when(frame < n, F.get(fovs, frame.cast("int"))).when(n > 1, F.get(fovs, n - 1)).otherwise(1.0)
    return F.greatest(F.when(n > 0, own * base).otherwise(1.0), F.lit(0.001)) * width / F.greatest(out_width, F.lit(1))


def zoom_compensation(enabled: Column, raw: Column, smooth: Column, any_raw: bool = False) -> Column:
    """True over smoothed focal length; 1 where either is unknown or not positive. With ``any_raw``
    the true one is taken as it is, zero or unknown too."""
    known = enabled & (smooth > 0)
    return F.when(known if any_raw else known & (raw > 0), raw / smooth).otherwise(1.0)


def diagonal_fov(width: Column, height: Column, fy: Column) -> Column:
    """In degrees; 120 without a focal length."""
    return F.when(F.coalesce(fy, F.lit(0.0)) != 0, F.degrees(2 * F.atan(F.hypot(width, height) / (2 * fy)))).otherwise(120.0)


#: Names of cameras as people type them, and how profiles spell them, in the order in
#: which they are replaced.
ALIASES = (
    ("bmpcc4k", "blackmagic pocket cinema camera 4k"), ("bmpcc6k", "blackmagic pocket cinema camera 6k"), ("bmpcc", "blackmagic pocket cinema camera"),
    *((f"gopro{gap}{n}", f"hero{min(n, 11)} black") for n in range(5, 14) for gap in ("", " ")),
    ("session5", "hero5 session"), ("session 5", "hero5 session"),
    ("a73", "a7iii"), ("a74", "a7iv"), ("a75", "a7v"), ("a7r3", "a7riii"), ("a7r4", "a7riv"), ("a7r5", "a7rv"), ("a7s2", "a7sii"), ("a7s3", "a7siii"),
)

#: Single words and their brands' own names.
TOKENS = {
    "gopro": "hero", "gopro2": "hero2", "gopro3": "hero3", "gopro4": "hero4",
    **{f"gopro{n}": f"hero{n} black" for n in range(5, 13)},
    "sony": "ILCE", "fx3": "ILME-FX3", "fx6": "ILME-FX6", "a7": "ILCE-7", "a7s": "ILCE-7S", "a7r": "ILCE-7RM", "a7iv": "ILCE-7M4", "a7iii": "ILCE-7M3",
}

#: What a lens's name loses, in this order.
NAME_NOISE = (".json", "4_3", "4:3", "4by3", "16:9", "169", "16_9", "16*9", "16/9", "16by9", "2_7K", "2,7K", "2.7K", "4K", "5K")

#: How names of videos end.
VIDEO = ("mp4", "mov", "braw", "insv", "360", "mxf")


def token_alias(text: Column) -> Column:
    """A single word's alias, else the word as it is."""
    table = F.create_map(*(F.lit(x) for pair in TOKENS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(text)), text)


def autoload_identifier(text: Column) -> Column:
    """Later models share the profiles of an earlier one."""
    for old, new in (("hero12", "hero11"), ("hero13", "hero11"), ("hero11blackmini", "hero11black")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_name(text: Column) -> Column:
    for noise in NAME_NOISE:
        text = F.replace(text, F.lit(noise), F.lit(""))
    return F.btrim(F.replace(text, F.lit("_"), F.lit(" ")))


def display_name(brand: Column, model: Column, size: Column, aspect: Column, details: Column, width: Column, height: Column, fps: Column, sizes: Column, rates: Column) -> Column:
    """Brand, model, size, aspect, cleaned details; the size and the rate only if ``sizes`` and
    ``rates`` (arrays of all settings') hold a single value; two rates of 200 and more count as one."""
    one_size = F.size(F.array_distinct(sizes)) <= 1
    speeds = F.array_distinct(rates)
    one_rate = (F.size(speeds) <= 1) | ((F.size(speeds) == 2) & (F.array_min(speeds) >= 200))
    lead = F.concat_ws(" ", F.when(brand != "", brand), F.when(model != "", model))
    parts = F.concat(
        lead, F.when(one_size, F.concat(F.lit(" "), size)).otherwise(""), F.lit(" "), aspect,
        F.when(details != "", F.concat(F.lit(" "), clean_name(details))).otherwise(""),
        F.when(one_size, F.concat(F.lit(" "), width.cast("string"), F.lit("x"), height.cast("string"))).otherwise(""),
        F.when(one_rate & (fps > 0), F.concat(F.lit(" "), F.format_string("%.2f", fps), F.lit("fps"))).otherwise(""),
    )
    return F.when((width == 0) | (height == 0), "---").otherwise(parts)


def distortion_hash(lengths: tuple[Column, Column], unknown: Column, scale: Column, coefficients: Column) -> Column:
    """CRC-32, in hex without leading zeros, of the compact JSON of a distortion table's identity."""
    # the keys' names are part of the hashed text
    text = F.to_json(F.struct(F.array(*lengths).alias("unk1"), unknown.alias("unk2"), scale.cast("float").cast("double").alias("unk3"), coefficients.alias("unk4")))
    return F.lower(F.hex(F.crc32(text.cast("binary"))))


def rebased(path: Column, project: Column, present: Column) -> Column:
    """A stored path, or the same file name in the project's own folder if ``present`` says that it is there."""
    name, folder = F.regexp_extract(path, r"([^/]*)$", 1), F.regexp_extract(project, r"^(.*)/[^/]*$", 1)
    return F.when(present & (path != "") & (project != ""), F.concat(folder, F.lit("/"), name)).otherwise(path)


def concrete_name(pattern: Column, number: Column) -> Column:
    """The file of a ``%0Nd`` pattern for a number."""
    width = F.coalesce(F.regexp_extract(pattern, r"%(\d*)d", 1).try_cast("int"), F.lit(1))
    text = number.cast("string")
    return F.regexp_replace(pattern, F.lit(r"%\d*d"), F.lpad(text, F.greatest(width, F.length(text)), "0"))


def is_video(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1)).rlike(f"({'|'.join(VIDEO)})$")


def range_path(path: Column, index: Column) -> Column:
    """``out.mp4`` as ``out-002.mp4`` for the second range (index 1)."""
    number = F.lpad((index + 1).cast("string"), 3, "0")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(F.instr(name, ".") == 0, F.concat(name, F.lit("-"), number)).otherwise(F.concat(F.regexp_extract(path, r"^(.*)\.[^./]*$", 1), F.lit("-"), number, F.lit("."), F.regexp_extract(path, r"\.([^./]*)$", 1)))


def relaxed_json(text: Column, schema: str) -> Column:
    """JSON whose strings may stand in single quotes and whose names may stand in none."""
    return F.from_json(text, schema, {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"})


def swapped(**sizes: tuple[Column, Column]) -> dict[str, Column]:
    """Portrait for landscape: each pair of columns, exchanged, under the names ``<name>_w`` and ``<name>_h``."""
    return {k: c for name, (w, h) in sizes.items() for k, c in ((f"{name}_w", h), (f"{name}_h", w))}
