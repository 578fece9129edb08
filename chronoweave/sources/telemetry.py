"""Motion samples out of cameras' metadata tracks and trailers.

A track's packets are rows (path, packet, duration_ms, payload). One pass in Python turns each payload into
arrays; what depends on a whole file (sample numbers, the time grid, orientation) are aggregates and running sums over
packets' counts, without the payloads. So a long recording is spread over many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.quaternion import Quat
from chronoweave.runtime import ensure_shipped
from chronoweave.sources import probe
from chronoweave.sources.wire import Message

STANDARD_GRAVITY = 9.80665
AXES = ("gx", "gy", "gz", "ax", "ay", "az")
PARTS = ("qw", "qx", "qy", "qz")

#: What a reader makes of a packet: samples (degrees a second, metres a second squared), quaternions, gravity, and tags.
PACKET = (
    "path string, packet int, duration_ms double, n_rate int, stamp_us long, samples array<array<double>>, turns array<array<double>>, images array<array<double>>, "
    "gravity array<array<double>>, tags map<string,string>, mounts array<struct<rank:int,matrix:array<double>,orin:string,orio:string>>"
)
Found = dict[str, object]


def _nodes(data: bytes) -> Iterator[tuple[str, str, int, bytes]]:
    """(key, kind, width of an element, body) of a run of key-length-value nodes; bodies are padded to four bytes."""
    at = 0
    while at + 8 <= len(data):
        key, kind, width, n = struct.unpack_from(">4ssBH", data, at)
        size = width * n
        if at + 8 + size > len(data):
            return
        yield key.decode("latin1"), kind.decode("latin1").rstrip("\0"), width, data[at + 8 : at + 8 + size]
        at += 8 + -(-size // 4) * 4


def node(key: str, kind: str, width: int, body: bytes) -> bytes:
    """One such node; the kind of a nested run is empty."""
    return struct.pack(">4ssBH", key.encode(), kind.encode() or b"\0", width, len(body) // width) + body + bytes(-len(body) % 4)


def _text(body: bytes) -> str:
    return body.decode("latin1").rstrip("\0")


def _shorts(found: tuple[str, int, bytes], scale: float) -> np.ndarray:
    _, width, body = found
    return np.frombuffer(body, ">i2").reshape(-1, width // 2) / scale


#: Tags that name a camera and its lens.
CAMERA_TAGS = ("EISA", "EISE", "VFOV", "ZFOV", "PRJT")


def gpmf(payload: bytes) -> Found:
    """A GPMF packet: rates and accelerations of all devices, CORI with IORI quaternions and gravity of the first
    one, camera tags, and how each stream is mounted."""
    out: Found = {"samples": [], "turns": [], "images": [], "gravity": [], "tags": {}, "mounts": [], "n_rate": 0, "stamp_us": None}
    tags: dict[str, str] = out["tags"]
    devices = [body for key, kind, _, body in _nodes(payload) if key == "DEVC" and not kind]
    for first, device in zip([True, *[False] * len(devices)], devices, strict=False):
        rates = pulls = None
        turns, images = [], []
        for key, kind, width, body in _nodes(device):
            if key in ("DVNM", "DMNL", "MINF"):
                tags["model"] = _text(body)
            elif key in CAMERA_TAGS and kind in ("c", "f"):
                tags.setdefault(key, _text(body) if kind == "c" else str(struct.unpack_from(">f", body)[0]))
            elif key in ("DZST", "DZMX") and kind in ("L", "f", "F"):
                tags[key] = str(struct.unpack_from(">I" if kind == "L" else ">f", body)[0])
            if key != "STRM":
                continue
            stream = {k: (t, w, b) for k, t, w, b in _nodes(body)}
            scale = float(struct.unpack_from(">h", stream["SCAL"][2])[0]) if stream.get("SCAL", ("",))[0] == "s" else None
            name = _text(stream["STNM"][2]) if "STNM" in stream else ""
            if name:
                known = {t: _text(stream[t][2]) if t in stream else None for t in ("ORIN", "ORIO")}
                matrix = [float(v) for v in struct.unpack_from(">9f", stream["MTRX"][2])] if "MTRX" in stream and len(stream["MTRX"][2]) >= 36 else None
                out["mounts"].append({"rank": {"Gyroscope": 0, "Accelerometer": 1}.get(name, 2), "matrix": matrix, "orin": known["ORIN"] or "XYZ", "orio": known["ORIO"]})
            if "GYRO" in stream and stream["GYRO"][0] == "s":
                rates = np.degrees(_shorts(stream["GYRO"], scale or 1.0))
                if "STMP" in stream:
                    out["stamp_us"] = struct.unpack_from(">q", stream["STMP"][2])[0] or out["stamp_us"]
            if "ACCL" in stream and stream["ACCL"][0] == "s":
                pulls = _shorts(stream["ACCL"], scale or 1.0)
            if "GRAV" in stream and stream["GRAV"][0] == "s":
                out["gravity"] += _shorts(stream["GRAV"], scale if scale and scale != 1 else 32767.0).tolist()
            if first and "CORI" in stream:
                turns = _shorts(stream["CORI"], scale or 32767.0).tolist()
            if first and "IORI" in stream:
                images = _shorts(stream["IORI"], scale or 32767.0).tolist()
        out["samples"] += _paired(rates, pulls)
        out["n_rate"] += 0 if rates is None else len(rates)
        if first:
            out["turns"] = turns if len(turns) == len(images) else []
            out["images"] = images
    return out


def _paired(rates: np.ndarray | None, pulls: np.ndarray | None) -> list[list[float | None]]:
    """Rates and accelerations of one packet by position; the shorter list is filled with nulls."""
    gap = [None] * 3
    return [[*(g or gap)[:3], *(a or gap)[:3]] for g, a in zip_longest([] if rates is None else rates.tolist(), [] if pulls is None else pulls.tolist())]


def _tlv(data: bytes) -> dict[int, bytes]:
    """Tags of a two-byte tag, two-byte length run; 0x8300 holds a run of its own, 0x060E is a label of 16 bytes."""
    out, at = {}, 0
    while at + 4 <= len(data):
        tag, size = struct.unpack_from(">HH", data, at)
        if tag == 0x060E:
            at += 16
            continue
        if tag in (0, 0xFFFF) or at + 4 + size > len(data):
            break
        out[tag] = data[at + 4 : at + 4 + size]
        if tag == 0x8300:
            out |= _tlv(out[tag])
        at += 4 + size
    return out


def decimal16(raw: bytes) -> float:
    """A decimal float: four bits of signed exponent, twelve of mantissa."""
    (n,) = struct.unpack(">H", raw[:2])
    power = n >> 12
    return (n & 0xFFF) * 10.0 ** (power - 16 if power > 7 else power)


def vectors(payload: bytes, form: str) -> list[tuple[int, ...]] | None:
    """A table of (time, x, y, z): ``form`` is how a row is packed. None for another row length or a cut
    table, a row of -1 for a negative count (a lens that gives none)."""
    if len(payload) < 8:
        return None
    count, width = struct.unpack_from(">ii", payload)
    if width != struct.calcsize(form):
        return None
    if count < 0:
        return [(-1, -1, -1, -1)]
    return [struct.unpack_from(form, payload, 8 + i * width) for i in range(count)] if len(payload) >= 8 + count * width else None


#: Fixed: rows of the first and second sensor-shift tables and of the lens-shift table.
SHIFT_FORMS = {0xE40F: ">4i", 0xE450: ">i3h", 0xE416: ">4i"}


def rtmd(payload: bytes) -> Found:
    """An RTMD packet: rates and accelerations with their scales, focal length, readout time and mounting."""
    out: Found = {"samples": [], "turns": [], "images": [], "gravity": [], "tags": {}, "mounts": [], "n_rate": 0, "stamp_us": None}
    if len(payload) <= 28 or payload[:2] != b"\x00\x1c":
        return out
    found = _tlv(payload[28:])

    def rows(tag: int, scale: int) -> np.ndarray | None:
        body = found.get(tag, b"")
        count, width = struct.unpack_from(">ii", body) if len(body) >= 8 else (0, 0)
        if count <= 0 or width != 6 or len(body) < 8 + 6 * count:
            return None
        by = struct.unpack_from(">f", found[scale])[0] if len(found.get(scale, b"")) >= 4 else 1.0
        return np.frombuffer(body, ">i2", 3 * count, 8).reshape(-1, 3) / (by or 1.0)

    rates, pulls = rows(0xE43B, 0xE439), rows(0xE44B, 0xE449)
    out["samples"] = _paired(rates, None if pulls is None else pulls * STANDARD_GRAVITY)
    out["n_rate"] = 0 if rates is None else len(rates)
    if len(found.get(0x8005, b"")) >= 2:
        out["tags"]["focal_mm"] = str(decimal16(found[0x8005]) * 1000.0)
    if len(found.get(0xE40E, b"")) >= 4:
        out["tags"]["readout_ms"] = str(struct.unpack_from(">i", found[0xE40E])[0] / 1000.0)
    if len(found.get(0xE43A, b"")) >= 2:
        (code,) = struct.unpack_from(">H", found[0xE43A])
        picks = [code >> shift & 15 for shift in (0, 4, 8)]
        if max(picks) < 6:
            # the camera's first two axes change places, and the third its sign
            x, y, z = ("XxYyZz"[p] for p in picks)
            out["tags"]["orientation"] = y + x + z.swapcase()
    return out


def read(packets: DataFrame, reader: Callable[[bytes], Found]) -> DataFrame:
    """``packets`` as rows of ``PACKET``."""
    ensure_shipped(packets.sparkSession)

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_rate", "stamp_us", "samples", "turns", "images", "gravity", "tags", "mounts"]
        for pdf in parts:
            # a payload's arrays are many times its bytes: few at a time
            for k in range(0, len(pdf), 64):
                some = pdf.iloc[k : k + 64]
                found = [reader(bytes(p)) if p is not None else reader(b"") for p in some["payload"]]
                made = pd.DataFrame({n: pd.Series([f[n] for f in found], dtype=object) for n in names})
                made["stamp_us"] = made["stamp_us"].astype("Int64")
                made["n_rate"] = made["n_rate"].astype("int32")
                yield pd.concat([some[["path", "packet", "duration_ms"]].reset_index(drop=True), made], axis=1)

    return packets.select("path", F.col("packet").cast("int"), F.col("duration_ms").cast("double"), "payload").mapInPandas(fn, PACKET)


def _numbered(found: DataFrame, array: str) -> DataFrame:
    """(path, packet, before): how many elements of ``array`` the packets before hold."""
    w = Window.partitionBy("path").orderBy("packet").rowsBetween(Window.unboundedPreceding, -1)
    return found.select("path", "packet", F.size(array).alias("_n")).select("path", "packet", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("before"))


def steps(found: DataFrame, otherwise_ms: float | None = 5.0) -> DataFrame:
    """(path, step_ms): the time between samples. From the first to the last stamp without the last packet's
    samples, else the track's duration over all samples, else ``otherwise_ms``."""
    has, stamped = F.col("n_rate") > 0, F.col("stamp_us") != 0
    whole = found.groupBy("path").agg(
        F.sum("n_rate").alias("n"), F.sum("duration_ms").alias("total"), F.max_by(F.when(has, F.col("n_rate")), F.when(has, F.col("packet"))).alias("last_n"),
        F.min_by(F.when(stamped, F.col("stamp_us")), F.when(stamped, F.col("packet"))).alias("a"), F.max_by(F.when(stamped, F.col("stamp_us")), F.when(stamped, F.col("packet"))).alias("b"),
    )
    step = F.when(F.col("n") > 0, F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / 1000 / F.greatest(F.lit(1), F.col("n") - F.col("last_n"))).when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(F.lit(otherwise_ms)))
    return whole.select("path", step.alias("step_ms"))


def samples(found: DataFrame, otherwise_ms: float | None = 5.0) -> DataFrame:
    """(path, i, t_ms, gx.., ax..): samples on an even grid from 0 over the whole file."""
    rows = found.select("path", "packet", F.posexplode("samples").alias("_k", "_v"))
    placed = rows.join(_numbered(found, "samples"), ["path", "packet"]).join(steps(found, otherwise_ms), "path")
    i = (F.col("before") + F.col("_k")).cast("long")
    return placed.select("path", i.alias("i"), (i * F.coalesce("step_ms", F.lit(0.0))).alias("t_ms"), *(F.col("_v")[k].alias(c) for k, c in enumerate(AXES)))


def _quat(column: Column, sign: int) -> Quat:
    return Quat(column[0], column[1] * sign, column[2], column[3])


def camera_turns(found: DataFrame, fps: float) -> DataFrame:
    """(path, frame, t_us, qw..qz, iw..iz): camera times image orientation of each frame, and the image's
    with its parts in the order in which gravity and image look-ups use them (x, y, z, w)."""
    rows = found.select("path", "packet", F.posexplode(F.arrays_zip("turns", "images")).alias("_k", "_v")).where("_v.turns is not null")
    placed = rows.join(_numbered(found, "turns"), ["path", "packet"])
    frame = (F.col("before") + F.col("_k")).cast("long")
    q = (_quat(F.col("_v.turns"), -1) * _quat(F.col("_v.images"), -1)).normal()
    image = [F.col("_v.images")[k].alias(n) for k, n in ((1, "iw"), (2, "ix"), (3, "iy"), (0, "iz"))]
    return placed.select("path", frame.alias("frame"), F.bround(frame * (1e6 / fps), 0).cast("long").alias("t_us"), *(c.alias(p) for c, p in zip(q.parts, PARTS, strict=True)), *image)


def gravity(found: DataFrame, turns: DataFrame) -> DataFrame:
    """(path, t_us, x, y, z): gravity at the times of ``camera_turns``, turned by the image's orientation. Only
    for files with as many vectors as turns, not all of them zero."""
    rows = found.select("path", "packet", F.posexplode("gravity").alias("_k", "_v"))
    placed = rows.join(_numbered(found, "gravity"), ["path", "packet"]).select("path", (F.col("before") + F.col("_k")).cast("long").alias("frame"), "_v")
    some = placed.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.max(F.exists("_v", lambda v: v != 0)).alias("_some")).where("_some")
    same = some.join(turns.groupBy("path").agg(F.count(F.lit(1)).alias("_n")), ["path", "_n"]).select("path")
    pairs = placed.join(same, "path", "left_semi").join(turns, ["path", "frame"])
    q = Quat(*(F.col(c) for c in ("iw", "ix", "iy", "iz"))).normal()
    x, y, z = q.rotate((F.col("_v")[0], F.col("_v")[1], F.col("_v")[2]))
    return pairs.select("path", "t_us", x.alias("x"), y.alias("y"), z.alias("z"))


def mounted(matrix: Column) -> Column:
    """How axes are mounted, as three letters, from a matrix (nine numbers by rows): for each row its first
    entry beyond a half, lower case for a negative one; null if a row has none."""
    def letter(row: int) -> Column:
        out = F.lit(None).cast("string")
        for k in (2, 1, 0):
            v = F.get(matrix, F.lit(3 * row + k))
            out = F.when(v > 0.5, "XYZ"[k]).when(v < -0.5, "xyz"[k]).otherwise(out)
        return out

    return F.when(F.size(matrix) == 9, F.concat(*map(letter, range(3))))


def mounted_as(orin: Column, orio: Column) -> Column:
    """The same from the axes' names in the file (``orin``) and in the output (``orio``)."""
    def letter(k: int) -> Column:
        want = F.substring(orio, k + 1, 1)
        at = F.instr(F.lower(orin), F.lower(want))
        same = F.instr(orin, want) == at
        name = F.substring(F.lit("XYZ"), at, F.lit(1))
        return F.when((want != "") & (at > 0), F.when(same, name).otherwise(F.lower(name)))

    return F.when((F.length(orin) == 3) & (F.length(orio) == 3), F.concat(*map(letter, range(3))))


def model_mount(model: Column) -> Column:
    """Models that say nothing of their mounting."""
    return F.when(model.contains("HERO6"), "ZyX").when(model.contains("HERO7 Silver"), "YXz")


def headers(found: DataFrame) -> DataFrame:
    """(path, model, orientation, focal_mm, readout_ms, digital_zoom): what a file says of its camera. The mounting comes from
    the rate stream, else that of acceleration, else any; a matrix goes before names."""
    each = found.select("path", "packet", F.posexplode("mounts").alias("_k", "m"))
    way = F.coalesce(mounted(F.col("m.matrix")), mounted_as(F.col("m.orin"), F.col("m.orio")))
    ranked = each.select("path", F.struct("m.rank", "packet", "_k", way.alias("way")).alias("w")).where("w.way is not null").groupBy("path").agg(F.min("w").alias("w"))
    tag = lambda k: F.try_element_at("tags", F.lit(k))

    def first(k: str) -> Column:
        return F.min_by(tag(k), F.when(tag(k).isNotNull(), F.col("packet")))

    def last(k: str) -> Column:
        there = tag(k).isNotNull() & (tag(k).try_cast("double") != 0)
        return F.max_by(F.when(there, tag(k)), F.when(there, F.col("packet"))).try_cast("double")

    zoom = 1 + last("DZST") / 100 * (F.coalesce(last("DZMX"), F.lit(1.4)) - 1)
    whole = found.groupBy("path").agg(first("model").alias("model"), first("orientation").alias("own"), first("focal_mm").try_cast("double").alias("focal_mm"), first("readout_ms").try_cast("double").alias("readout_ms"), zoom.alias("digital_zoom"))
    return whole.join(ranked, "path", "left").select("path", "model", F.coalesce("own", "w.way", model_mount(F.col("model"))).alias("orientation"), "focal_mm", "readout_ms", "digital_zoom")


def packets(files: DataFrame, codec: str) -> DataFrame:
    """(path, packet, duration_ms, payload) of the first track of a codec (such as gpmd, rtmd or djmd) in MP4
    files (path, content); samples that lie outside the file are left out."""
    ensure_shipped(files.sparkSession)

    def tracks(data: bytes) -> Iterator[tuple[float, bytes]]:
        inside = lambda kind, a, b: [(s, e) for k, s, e in probe.boxes(data, a, b) if k == kind]
        for moov in inside("moov", 0, len(data)):
            for trak in inside("trak", *moov):
                for media in inside("mdia", *trak):
                    scale = next((struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0] for a, _ in inside("mdhd", *media)), 0) or 1000
                    for minf in inside("minf", *media):
                        for table in inside("stbl", *minf):
                            if any(data[a + 12 : a + 16] == codec.encode() for a, _ in inside("stsd", *table)):
                                for offset, size, ticks in probe.sample_table(data, *table):
                                    if offset + size <= len(data):
                                        yield ticks * 1000 / scale, data[offset : offset + size]
                                return

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                batch = []
                for k, (ms, payload) in enumerate(tracks(bytes(content))):
                    batch.append((path, k, ms, payload))
                    if len(batch) == 256:
                        yield pd.DataFrame(batch, columns=["path", "packet", "duration_ms", "payload"])
                        batch = []
                yield pd.DataFrame(batch, columns=["path", "packet", "duration_ms", "payload"])

    return files.select("path", "content").mapInPandas(fn, "path string, packet int, duration_ms double, payload binary")


def dji(packets: DataFrame, fps: float) -> tuple[DataFrame, DataFrame]:
    """(clips, turns) of protocol-buffer packets: clips (path, model, frame_rate, sensor_fps, readout_ms, focal, coefficients), turns
    (path, packet, i, t_us, qw..qz). A turn's time is its frame's, plus its share of the sensor's frame, over the ratio of
    rates; signs keep a packet's turns together."""
    ensure_shipped(packets.sparkSession)
    schema = "path string, packet int, model string, frame_rate double, sensor_fps double, readout_us double, focal double, coefficients array<double>, frame_us long, offset double, quats array<array<double>>"

    def one(path: str, packet: int, payload: bytes) -> tuple:
        whole = Message(payload)
        clip, frame = whole.of(1), whole.of(3)
        unit = frame.of(3)
        pose = unit.of(2)
        if pose.of(1).has(3):
            pose = pose.of(1)
        if not unit.has(2):
            pose = unit.of(4)
        quats = [[Message(v).real(k) for k in (1, 2, 3, 4)] for v in pose.all(3) if not isinstance(v, int)]
        return (
            path, packet, clip.of(1).text(10) or None, whole.of(2, 3).real(3) or None, clip.of(11).real(1) or None, float(clip.of(4).int(1)) or None, clip.of(8).real(1) or None,
            clip.of(3).reals(1) or None, frame.of(1).signed(2) if frame.has(1) else 0, pose.real(4), quats,
        )

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for pdf in parts:
            yield pd.DataFrame([one(p, k, bytes(b)) for p, k, b in zip(pdf["path"], pdf["packet"], pdf["payload"], strict=True)], columns=names)

    # only the first packet describes the clip
    read_ = packets.select("path", F.col("packet").cast("int"), "payload").mapInPandas(fn, schema)
    head = read_.where("packet = 0").select("path", "model", F.when(F.col("frame_rate") > 1, F.col("frame_rate")).otherwise(fps if fps > 0 else 29.97).alias("frame_rate"), "sensor_fps", "readout_us", "focal", "coefficients")
    start = read_.groupBy("path").agg(F.min_by("frame_us", "packet").alias("_start"))
    ratio = F.when(F.col("sensor_fps") > 1, F.col("frame_rate") / F.col("sensor_fps")).otherwise(1.0)
    clips = head.select("path", "model", "frame_rate", "sensor_fps", (F.col("readout_us") / 1e6 / ratio).alias("readout_ms"), "focal", "coefficients")
    rows = read_.select("path", "packet", "frame_us", "offset", F.size("quats").alias("_n"), F.posexplode("quats").alias("i", "_v"))
    rows = rows.join(start, "path").join(head.select("path", "frame_rate", "sensor_fps"), "path", "left").withColumn("frame_rate", F.coalesce("frame_rate", F.lit(fps)))
    vsync = 1000 / F.when(F.col("sensor_fps") > 1, F.col("sensor_fps")).otherwise(F.col("frame_rate"))
    t = ((F.col("frame_us") - F.col("_start")) / 1000 + (F.col("i") - F.col("offset")) / F.col("_n") * vsync) / ratio
    # a fixed change of axes, then half a turn about y
    q = Quat(*map(F.lit, (0.0, 0.0, 1.0, 0.0))) * (Quat(*(F.col("_v")[k] for k in range(4))) * Quat(*map(F.lit, (0.5, -0.5, -0.5, 0.5))))
    there = ~F.exists("_v", F.isnan) & F.exists("_v", lambda v: v != 0)
    turned = rows.where(there).select("path", "packet", "i", (t * 1000).cast("long").alias("t_us"), *(c.alias(p) for c, p in zip(q.parts, PARTS, strict=True)))
    w = Window.partitionBy("path", "packet").orderBy("i")
    gap = F.sqrt(sum(((F.col(p) - F.lag(p).over(w)) * (F.col(p) - F.lag(p).over(w)) for p in PARTS), F.lit(0.0)))
    odd = turned.withColumn("_jump", (F.coalesce(gap, F.lit(0.0)) > 1.5).cast("int")).withColumn("_odd", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    signed = Quat(*(F.col(p) * F.when(F.col("_odd") == 1, -1.0).otherwise(1.0) for p in PARTS)).normal()
    return clips, odd.select("path", "packet", "i", "t_us", *(c.alias(p) for c, p in zip(signed.parts, PARTS, strict=True)))


#: Fixed: a file's last bytes, of which four at 32 say how long the trailer is.
TRAILER = 72


def trailer_records(data: bytes) -> list[tuple[int, int, bytes]]:
    """(id, format, payload) of a trailer of records, each [payload][format][id][size], by its index
    (record 0: id, format, size, offset of each) if there is one, else from the end backwards."""
    if len(data) < TRAILER:
        return []
    (extra,) = struct.unpack_from("<I", data, len(data) - TRAILER + 32)
    start, end = len(data) - extra, len(data) - TRAILER

    def record(stop: int) -> tuple[int, int, int] | None:
        """(format, id, where the payload starts) of the record that ends there."""
        if stop < 6:
            return None
        form, kind, size = struct.unpack_from("<BBI", data, stop - 6)
        return (form, kind, stop - 6 - size) if stop - 6 - size >= 0 else None

    last, out = record(end), {}
    if last and last[1] == 0:
        for kind, form, size, at in struct.iter_unpack("<BBII", data[last[2] : last[2] + (end - 6 - last[2]) // 10 * 10]):
            found = record(start + at + size + 6) if kind and 0 <= start + at and start + at + size + 6 <= len(data) else None
            if found and found[1] == kind and found[2] == start + at:
                out[kind] = (kind, found[0], data[found[2] : found[2] + size])
        if out:
            return list(out.values())
    records = []
    while len(data) - end + 6 < extra and (found := record(end)):
        records.append((found[1], found[0], data[found[2] : end - 6]))
        end = found[2]
    return records


#: How models mount their sensors, with and without the newer lens description.
INSTA_MOUNTS = {
    True: {"Insta360 GO 2": "XYZ", "Insta360 GO 3": "XYZ", "Insta360 GO 3S": "yXZ", "Insta360 GO Ultra": "YxZ", "Insta360 OneR": "Xyz", "Insta360 OneRS": "Xyz", "Insta360 X4": "yzX", "Insta360 X5": "yzX", "": "Xyz"},
    False: {"Insta360 Go": "xyZ", "Insta360 GO 2": "yXZ", "Insta360 OneR": "yXZ", "Insta360 OneRS": "yxz", "Insta360 ONE X2": "xZy", "": "yXZ"},
}


def insta360(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, samples) of files (path, content) with a trailer: headers (path, model, orientation, readout_ms, width, height, raw), samples
    (path, i, t_ms, gx.., ax..). Raw rates and accelerations are offset 16-bit numbers over their ranges; others are
    doubles in radians and in units of gravity. Times run from the first frame."""
    ensure_shipped(files.sparkSession)
    schema = "path string, model string, orientation string, readout_ms double, width int, height int, raw boolean, samples array<array<double>>"

    def one(path: str, data: bytes) -> tuple | None:
        records = trailer_records(data)
        if not records:
            return None
        about = Message(next((p for kind, _, p in records if kind == 1), b""))
        raw, model = about.int(62) != 0, about.text(2)
        pull_range, rate_range = (float(about.of(65).int(k)) or d for k, d in ((1, 16.0), (2, 2000.0)))
        shift = about.real(28) / 1000 if about.int(29) else 0.0
        rows = []
        row = np.dtype([("t", "<u8"), ("v", "<u2" if raw else "<f8", (6,))])
        for kind, _, payload in records:
            if kind == 3:
                table = np.frombuffer(payload[: len(payload) // row.itemsize * row.itemsize], row)
                v = table["v"].astype(float)
                pulls, rates = v[:, :3], v[:, 3:]
                if raw:
                    pulls, rates = (pulls - 32768) * pull_range / 32768 * STANDARD_GRAVITY, (rates - 32768) * rate_range / 32768
                else:
                    pulls, rates = pulls * STANDARD_GRAVITY, np.degrees(rates)
                t = (table["t"] / 1000 - about.signed(24) / 1000) / (1000 if raw else 1) - shift
                rows += np.column_stack([t * 1000, rates, pulls]).tolist()
        described = len(about.text(54).split("_")) >= 20
        table = INSTA_MOUNTS[described]
        size = about.of(19)
        return path, model or None, table.get(model, table[""]), about.real(25) or None, size.int(1), size.int(2), raw, rows

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for pdf in parts:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                found = one(p, bytes(c))
                yield pd.DataFrame([found] if found else [], columns=names)

    found = files.select("path", "content").mapInPandas(fn, schema)
    rows = found.select("path", F.posexplode("samples").alias("i", "_v"))
    return found.drop("samples"), rows.select("path", F.col("i").cast("long").alias("i"), F.col("_v")[0].alias("t_ms"), *(F.col("_v")[k + 1].alias(c) for k, c in enumerate(AXES)))


#: Fixed: endings of files that may hold a video's motion beside it, in this order.
SIDECARS = ("gcsv", "csv", "txt")


def sidecars(paths: DataFrame, videos: Column, endings: tuple[str, ...] = SIDECARS) -> DataFrame:
    """(path, sidecar): for each video the file of the same name whose ending comes first in ``endings``; an
    equi-join on the name without its ending."""
    stem, ending = F.regexp_extract("path", r"^(.*)\.[^./]*$", 1), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    named = paths.select("path", stem.alias("_stem"), F.array_position(F.array(*map(F.lit, endings)), ending).alias("_rank"))
    beside = named.where("_rank > 0").groupBy("_stem").agg(F.min_by("path", F.struct("_rank", "path")).alias("sidecar"))
    return paths.where(videos).select("path", stem.alias("_stem")).join(beside, "_stem", "left").select("path", "sidecar")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, t_ms, gx.., ax..) of all files under a path whose bytes say that they are of a known format;
    formats that hold turns instead of samples are read by ``dji`` and ``camera_turns``."""
    from chronoweave.sources import gcsv

    files = spark.read.format("binaryFile").load(path)
    content = files.select("path", "content").withColumn("format", probe.sniff(F.col("content")))

    def of(kind: str) -> DataFrame:
        return content.where(F.col("format") == kind).select("path", "content")

    made = samples(read(packets(of("gopro"), "gpmd"), gpmf))
    made = made.unionByName(samples(read(packets(of("sony"), "rtmd"), rtmd), None)).unionByName(insta360(of("insta360"))[1])
    logs = gcsv.parse(of("gcsv").select("path", F.decode("content", "UTF-8").alias("text")))[1]
    return made.unionByName(logs.select("path", F.col("row").cast("long").alias("i"), "t_ms", *AXES))
