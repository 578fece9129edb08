"""Queries over cameras' metadata: events are packed into the bytes of a format, and read back by its reader."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.quaternion import Quat
from chronoweave.plans.base import EVENTS, USER, events, query, r, table
from chronoweave.plans.camera import _sql_product
from chronoweave.runtime import ensure_shipped
from chronoweave.sources import telemetry
from chronoweave.sources.telemetry import node
from chronoweave.sources.wire import Message, message

#: Events of a packet.
PER = 16
_N = f"""{EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS whole FROM s),
p AS (SELECT *, CAST(user_id AS VARCHAR) AS path, i // {PER} AS packet, i % {PER} AS k, least(whole - i // {PER} * {PER}, {PER}) AS inside FROM n)"""


def _packed(spark: SparkSession, sf: str, ms: float, encode: Callable[[int, list], bytes], per: int = PER) -> DataFrame:
    """(path, packet, duration_ms, payload): ``per`` events of a user to a packet, by time."""
    ensure_shipped(spark)
    numbered = events(spark, sf).withColumn("packet", F.floor((F.row_number().over(USER.window()) - 1) / per).cast("int"))
    rows = numbered.groupBy(F.col("user_id").cast("string").alias("path"), "packet").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))).alias("rows"))

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = [encode(k, list(x)) for k, x in zip(pdf["packet"], pdf["rows"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "packet": pdf["packet"], "duration_ms": ms, "payload": made})

    return rows.mapInPandas(fn, "path string, packet int, duration_ms double, payload binary")


def _raw(event: int) -> tuple[int, int, int, int, int, int]:
    """Six 16-bit readings of an event."""
    return event % 2001 - 1000, event % 977 - 488, event % 1499 - 749, event % 701 - 350, event % 503 - 251, event % 4001 - 2000


_SQL_RAW = "event_id % 2001 - 1000 AS r0, event_id % 977 - 488 AS r1, event_id % 1499 - 749 AS r2, event_id % 701 - 350 AS r3, event_id % 503 - 251 AS r4, event_id % 4001 - 2000 AS r5"


def _gpmf(packet: int, rows: list) -> bytes:
    """Rates, accelerations (one fewer), orientations and gravity of a packet's events."""
    ids = [x["event_id"] for x in rows]

    def stream(key: str, values: list[tuple], scale: int, name: str, *more: bytes) -> bytes:
        body = b"".join(struct.pack(f">{len(v)}h", *v) for v in values)
        return node("STRM", "", 1, node("STNM", "c", 1, name.encode()) + node("SCAL", "s", 2, struct.pack(">h", scale)) + b"".join(more) + node(key, "s", 2 * len(values[0]), body))

    device = node("DVNM", "c", 1, b"HERO6 Black")
    stamp, mount = node("STMP", "J", 8, struct.pack(">q", 1_000_000 + packet * PER * 5005)), node("ORIN", "c", 1, b"YxZ") + node("ORIO", "c", 1, b"ZXY")
    device += stream("ACCL", [_raw(e)[3:] for e in ids[:-1]], 418, "Accelerometer") if len(ids) > 1 else b""
    device += stream("GYRO", [_raw(e)[:3] for e in ids], 939, "Gyroscope", stamp, mount)
    device += stream("CORI", [(30000 - e % 7000, e % 977, e % 499, e % 251) for e in ids], 32767, "CameraOrientation")
    device += stream("IORI", [(32000, e % 100, 5, -(e % 50)) for e in ids], 32767, "ImageOrientation")
    device += stream("GRAV", [(e % 90, 32000, e % 70) for e in ids], 32767, "Gravity")
    return node("DEVC", "", 1, device)


def _gpmf_read(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.read(_packed(spark, sf, 80.0, _gpmf), telemetry.gpmf)


@query(f"""WITH {_N}, w AS (SELECT path, CASE WHEN max(packet) > 0 THEN max(packet) * {PER} * 5005 / 1000 / greatest(1, any_value(whole) - max_by(inside, packet)) ELSE 80.0 / any_value(whole) END AS step FROM p GROUP BY path),
q AS (SELECT *, {_SQL_RAW} FROM p JOIN w USING (path))
SELECT path, i, round(i * step, 6) AS t_ms, round(degrees(r0 / 939), 5) + 0.0 AS gx, round(degrees(r1 / 939), 5) + 0.0 AS gy, round(degrees(r2 / 939), 5) + 0.0 AS gz,
  CASE WHEN k < inside - 1 THEN round(r3 / 418, 5) + 0.0 ELSE -1000 END AS ax, CASE WHEN k < inside - 1 THEN round(r4 / 418, 5) + 0.0 ELSE -1000 END AS ay, CASE WHEN k < inside - 1 THEN round(r5 / 418, 5) + 0.0 ELSE -1000 END AS az FROM q""")
def gpmf_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of action-camera packets on an even grid over the whole recording."""
    found = telemetry.samples(_gpmf_read(spark, sf))
    pulls = (F.coalesce(r(c, 5), F.lit(-1000.0)).alias(c) for c in ("ax", "ay", "az"))
    return found.select("path", "i", r("t_ms").alias("t_ms"), *(r(c, 5).alias(c) for c in ("gx", "gy", "gz")), *pulls)


def _sql_unit(rest: str, parts: tuple[str, ...], kept: str) -> str:
    """``kept`` and the parts as q0 to q3: of length one, w not negative."""
    w, x, y, z = parts
    return f"""{rest}, a AS (SELECT *, {w} AS w, {x} AS x, {y} AS y, {z} AS z FROM b), d AS (SELECT *, sqrt(w * w + x * x + y * y + z * z) * CASE WHEN w < 0 THEN -1 ELSE 1 END AS len FROM a)
SELECT {kept}, round(w / len, 5) + 0.0 AS q0, round(x / len, 5) + 0.0 AS q1, round(y / len, 5) + 0.0 AS q2, round(z / len, 5) + 0.0 AS q3 FROM d"""


def _unit(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(*kept, *(r(c, 5).alias(f"q{k}") for k, c in enumerate(Quat(*map(F.col, telemetry.PARTS)).canonical().parts)))


_CORI = ("(30000 - event_id % 7000)::DOUBLE", "-(event_id % 977)::DOUBLE", "(event_id % 499)::DOUBLE", "(event_id % 251)::DOUBLE")
_IORI = ("32000::DOUBLE", "-(event_id % 100)::DOUBLE", "5::DOUBLE", "-(event_id % 50)::DOUBLE")


@query(_sql_unit(f"WITH {_N}, b AS (SELECT path, i AS frame, CAST(round_even(i * (1e6 / 25), 0) AS BIGINT) AS t_us, event_id FROM p)", _sql_product(_CORI, _IORI), "path, frame, t_us"))
def gpmf_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Camera times image orientation of each frame, 25 a second."""
    return _unit(telemetry.camera_turns(_gpmf_read(spark, sf), 25.0), "path", "frame", "t_us")


_IMAGE = ("-(event_id % 100)::DOUBLE", "5::DOUBLE", "-(event_id % 50)::DOUBLE", "32000::DOUBLE")


@query(f"""WITH {_N}, b AS (SELECT path, CAST(round_even(i * (1e6 / 25), 0) AS BIGINT) AS t_us, event_id % 90 / 32767 AS vx, 32000 / 32767 AS vy, event_id % 70 / 32767 AS vz, (event_id % 100)::DOUBLE AS w, 5::DOUBLE AS x, -(event_id % 50)::DOUBLE AS y, 32000::DOUBLE AS z FROM p),
d AS (SELECT * REPLACE (w / len AS w, x / len AS x, y / len AS y, z / len AS z) FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS len FROM b))
SELECT path, t_us, round((1 - 2 * (y * y + z * z)) * vx + 2 * (x * y - w * z) * vy + 2 * (x * z + w * y) * vz, 5) + 0.0 AS x,
  round(2 * (x * y + w * z) * vx + (1 - 2 * (x * x + z * z)) * vy + 2 * (y * z - w * x) * vz, 5) + 0.0 AS y,
  round(2 * (x * z - w * y) * vx + 2 * (y * z + w * x) * vy + (1 - 2 * (x * x + y * y)) * vz, 5) + 0.0 AS z FROM d""")
def gpmf_gravity(spark: SparkSession, sf: str) -> DataFrame:
    """Gravity of each frame, turned by the image's orientation."""
    found = _gpmf_read(spark, sf)
    return telemetry.gravity(found, telemetry.camera_turns(found, 25.0)).select("path", "t_us", *(r(c, 5).alias(c) for c in "xyz"))


@query(f"WITH {_N} SELECT DISTINCT path, 'HERO6 Black' AS model, 'ZyX' AS orientation FROM p")
def gpmf_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the axes in the rate stream (Y, -X, Z in the file; Z, X, Y of the output) give the mounting."""
    return telemetry.headers(_gpmf_read(spark, sf)).select("path", "model", "orientation")


def _rtmd(packet: int, rows: list) -> bytes:
    def tag(number: int, body: bytes) -> bytes:
        return struct.pack(">HH", number, len(body)) + body

    def shorts(values: list[tuple]) -> bytes:
        return struct.pack(">ii", len(values), 6) + b"".join(struct.pack(">3h", *v) for v in values)

    ids = [x["event_id"] for x in rows]
    inner = tag(0xE439, struct.pack(">f", 16.0)) + tag(0xE43B, shorts([_raw(e)[:3] for e in ids])) + tag(0xE449, struct.pack(">f", 512.0)) + tag(0xE44B, shorts([_raw(e)[3:] for e in ids]))
    shifts = struct.pack(">ii", len(ids), 10) + b"".join(struct.pack(">i3h", e, *_raw(e)[:3]) for e in ids)
    return b"\x00\x1c" + bytes(26) + struct.pack(">H", 0x060E) + bytes(14) + tag(0x8300, inner) + tag(0x8005, struct.pack(">H", 0xD023)) + tag(0xE43A, b"\x04\x20") + tag(0xE40E, struct.pack(">i", 8300)) + tag(0xE450, shifts)


@query(f"""WITH {_N}, q AS (SELECT *, {_SQL_RAW}, 40.0 * (max(packet) OVER (PARTITION BY path) + 1) / whole AS step FROM p)
SELECT path, i, round(i * step, 6) AS t_ms, round(r0 / 16, 5) + 0.0 AS gx, round(r1 / 16, 5) + 0.0 AS gy, round(r2 / 16, 5) + 0.0 AS gz, round(r3 / 512 * 9.80665, 5) + 0.0 AS ax, round(r4 / 512 * 9.80665, 5) + 0.0 AS ay, round(r5 / 512 * 9.80665, 5) + 0.0 AS az FROM q""")
def rtmd_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of tag-length packets; the track's duration makes the grid."""
    found = telemetry.samples(telemetry.read(_packed(spark, sf, 40.0, _rtmd), telemetry.rtmd), None)
    return found.select("path", "i", r("t_ms").alias("t_ms"), *(r(c, 5).alias(c) for c in telemetry.AXES))


@query(f"WITH {_N} SELECT DISTINCT path, 'YXz' AS orientation, 35.0 AS focal_mm, 8.3 AS readout_ms FROM p")
def rtmd_headers(spark: SparkSession, sf: str) -> DataFrame:
    found = telemetry.headers(telemetry.read(_packed(spark, sf, 40.0, _rtmd), telemetry.rtmd))
    return found.select("path", "orientation", r("focal_mm").alias("focal_mm"), r("readout_ms").alias("readout_ms"))


@query(f"WITH {_N} SELECT path, packet::INTEGER AS packet, k::INTEGER AS k, event_id AS t, event_id % 2001 - 1000 AS x, event_id % 977 - 488 AS y, event_id % 1499 - 749 AS z FROM p")
def sensor_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of packets' sensor-shift tables."""
    tables = F.pandas_udf(lambda x: x.map(lambda b: telemetry.vectors(telemetry._tlv(bytes(b)[28:]).get(0xE450, b""), telemetry.SHIFT_FORMS[0xE450])), "array<array<long>>")
    rows = _packed(spark, sf, 40.0, _rtmd).select("path", "packet", F.posexplode(tables("payload")).alias("k", "v"))
    return rows.select("path", "packet", "k", *(F.col("v")[i].alias(c) for i, c in enumerate(("t", "x", "y", "z"))))


def _dji(packet: int, rows: list) -> bytes:
    """Turns about z by a share of the value; a fifth of them with the other sign."""
    def turn(e: int, value: float) -> bytes:
        s = -1.0 if e % 5 == 0 else 1.0
        return message((1, s * math.cos(value / 2000)), (2, 0.0), (3, 0.0), (4, s * math.sin(value / 2000)))

    pose = message(*((3, turn(x["event_id"], x["value"])) for x in rows), (4, 0.5))
    clip = message((1, message((10, "DJI O3"))), (4, message((1, 20_000_000))), (8, message((1, 1500.0))), (11, message((1, 60.0))))
    unit = message((2, message((1, pose)))) if packet % 2 else message((4, pose))
    return message((1, clip), (2, message((3, message((3, 30.0))))), (3, message((1, message((1, packet), (2, 1_000_000 + packet * 33_000))), (3, unit))))


_RAW = ("sg * cos(value / 2000)", "0.0", "0.0", "sg * sin(value / 2000)")


@query(_sql_unit(f"""WITH {_N}, b AS (SELECT path, packet::INTEGER AS packet, k::INTEGER AS i, CAST(trunc((packet * 33000 / 1000 + (k - 0.5::DOUBLE) / inside * (1000 / 60.0::DOUBLE)) / (30.0::DOUBLE / 60) * 1000) AS BIGINT) AS t_us, value,
  CASE WHEN first_value(event_id) OVER (PARTITION BY path, packet ORDER BY k) % 5 = 0 THEN -1 ELSE 1 END AS sg FROM p)""", _sql_product(("0.0", "0.0", "1.0", "0.0"), _RAW, ("0.5", "-0.5", "-0.5", "0.5")), "path, packet, i, t_us"))
def dji_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of protocol-buffer packets in the camera's axes, each with its own time."""
    return _unit(telemetry.dji(_packed(spark, sf, 33.0, _dji), 30.0)[1], "path", "packet", "i", "t_us")


@query(f"WITH {_N} SELECT DISTINCT path, 'DJI O3' AS model, 30.0 AS frame_rate, 60.0 AS sensor_fps, 40.0 AS readout_ms, 1500.0 AS focal FROM p")
def dji_clips(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.dji(_packed(spark, sf, 33.0, _dji), 30.0)[0].select("path", "model", *(r(c).alias(c) for c in ("frame_rate", "sensor_fps", "readout_ms", "focal")))


def _trailer(packet: int, rows: list) -> bytes:
    """A file whose trailer has an index in every other packet, and is walked backwards in the others."""
    about = message((2, "Insta360 X4"), (19, message((1, 3840), (2, 1920))), (24, 5_000_000), (25, 16.5), (28, 12.0), (29, 1), (62, 1), (65, message((1, 16), (2, 2000))), (54, "_".join(["1.0"] * 21)))
    table = b"".join(struct.pack("<Q6H", x["t"] % 10**9, *(v + 32768 for v in (*_raw(x["event_id"])[3:], *_raw(x["event_id"])[:3]))) for x in rows)
    body, index = b"", b""
    for kind, payload in ((1, about), (3, table)):
        index += struct.pack("<BBII", kind, 1, len(payload), len(body))
        body += payload + struct.pack("<BBI", 1, kind, len(payload))
    if packet % 2:
        body += index + struct.pack("<BBI", 1, 0, len(index))
    return b"video" * 9 + body + bytes(32) + struct.pack("<I", len(body) + telemetry.TRAILER) + bytes(36)


@query(f"""WITH {_N}, q AS (SELECT *, {_SQL_RAW} FROM p)
SELECT path || '/' || packet AS path, k AS i, round((((t % 1000000000)::DOUBLE / 1000 - 5000) / 1000 - 0.012::DOUBLE) * 1000, 5) + 0.0 AS t_ms, round(r0 * 2000 / 32768, 5) + 0.0 AS gx, round(r1 * 2000 / 32768, 5) + 0.0 AS gy, round(r2 * 2000 / 32768, 5) + 0.0 AS gz,
  round(r3 * 16 / 32768 * 9.80665, 5) + 0.0 AS ax, round(r4 * 16 / 32768 * 9.80665, 5) + 0.0 AS ay, round(r5 * 16 / 32768 * 9.80665, 5) + 0.0 AS az FROM q""")
def trailer_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of files with a trailer of records."""
    files = _packed(spark, sf, 1.0, _trailer).select(F.concat_ws("/", "path", F.col("packet").cast("string")).alias("path"), F.col("payload").alias("content"))
    found = telemetry.insta360(files)[1]
    return found.select("path", "i", r("t_ms", 5).alias("t_ms"), *(r(c, 5).alias(c) for c in telemetry.AXES))


@query("SELECT event_id, user_id, round(value, 6) AS value, event_type, 300 - event_id AS less FROM events")
def wire_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Messages written, and read without a schema."""
    e = events(spark, sf).select("event_id", "user_id", "value", "event_type")
    ensure_shipped(spark)

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = [message((1, int(i)), (2, float(v)), (3, k), (4, message((7, int(u)))), (100, 300 - int(i))) for i, u, v, k in pdf.itertuples(index=False)]
            found = [Message(m) for m in made]
            yield pd.DataFrame([(m.int(1), m.of(4).int(7), m.real(2), m.text(3), m.signed(100)) for m in found], columns=["event_id", "user_id", "value", "event_type", "less"])

    return e.mapInPandas(fn, "event_id long, user_id long, value double, event_type string, less long").withColumn("value", r("value"))


_NAMES, _OUT = ("XYZ", "yXz", "ZxY", "zYx", "xyQ"), ("XYZ", "ZXY", "YzX")


def _sql_letter(k: int) -> str:
    return f"CASE WHEN instr(lower(orin), lower(substr(orio, {k}, 1))) > 0 THEN CASE WHEN contains(orin, substr(orio, {k}, 1)) THEN substr('XYZ', instr(lower(orin), lower(substr(orio, {k}, 1))), 1) ELSE lower(substr('XYZ', instr(lower(orin), lower(substr(orio, {k}, 1))), 1)) END END"


@query(f"""WITH a AS (SELECT event_id, {list(_NAMES)}[event_id % 5 + 1] AS orin, {list(_OUT)}[event_id % 3 + 1] AS orio FROM events)
SELECT event_id, coalesce({_sql_letter(1)} || {_sql_letter(2)} || {_sql_letter(3)}, '') AS named, CASE event_id % 4 WHEN 0 THEN 'XYZ' WHEN 1 THEN 'yZx' WHEN 2 THEN '' ELSE 'zXy' END AS by_matrix FROM a""")
def axis_mounting(spark: SparkSession, sf: str) -> DataFrame:
    """Mountings by the axes' names and by matrices."""
    e = events(spark, sf)
    pick = lambda values, n: F.element_at(F.array(*values), (F.col("event_id") % n + 1).cast("int"))
    ways = ([1.0, 0, 0, 0, 1, 0, 0, 0, 1], [0.0, -1, 0, 0, 0, 1, -1, 0, 0], [0.0, 0, 0, 0, 1, 0, 0, 0, 1], [0.0, 0.2, -0.9, 0.8, 0, 0, 0, -0.7, 0])
    named = telemetry.mounted_as(pick(map(F.lit, _NAMES), 5), pick(map(F.lit, _OUT), 3))
    return e.select("event_id", F.coalesce(named, F.lit("")).alias("named"), F.coalesce(telemetry.mounted(pick((F.array(*map(F.lit, m)) for m in ways), 4)), F.lit("")).alias("by_matrix"))


@query("""SELECT 'v/' || p_partkey || '.mp4' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'v/' || p_partkey || '.gcsv' WHEN p_partkey % 2 = 0 THEN 'v/' || p_partkey || '.TXT' ELSE '' END AS sidecar FROM part""")
def sidecar_files(spark: SparkSession, sf: str) -> DataFrame:
    """Videos with the file that holds their motion beside them; some have two, some none."""
    part = table(spark, sf, "part").select(F.concat(F.lit("v/"), F.col("p_partkey").cast("string")).alias("stem"), "p_partkey")
    kinds = F.array_compact(F.array(F.lit(".mp4"), F.when(F.col("p_partkey") % 3 == 0, ".gcsv"), F.when(F.col("p_partkey") % 2 == 0, ".TXT")))
    paths = part.select("stem", F.explode(kinds).alias("kind")).select(F.concat("stem", "kind").alias("path"))
    return telemetry.sidecars(paths, F.col("path").endswith(".mp4")).fillna("", ["sidecar"])
