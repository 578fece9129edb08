import struct

import numpy as np
from pyspark.sql import functions as F

from chronoweave.sources import probe, telemetry
from chronoweave.sources.telemetry import node
from chronoweave.sources.wire import Message, message


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


def movie(codec: bytes, payloads: list[bytes], scale: int = 1000, ticks: int = 40) -> bytes:
    """An MP4 file with one metadata track, a chunk for each sample."""
    data = box(b"ftyp", b"isom")
    at, offsets = len(data) + 8, []
    for p in payloads:
        offsets.append(at)
        at += len(p)
    n = len(payloads)
    table = box(b"stsd", struct.pack(">II", 0, 1) + box(codec, bytes(8)))
    table += box(b"stts", struct.pack(">IIII", 0, 1, n, ticks)) + box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 1, 1))
    table += box(b"stsz", struct.pack(f">III{n}I", 0, 0, n, *map(len, payloads))) + box(b"stco", struct.pack(f">II{n}I", 0, n, *offsets))
    media = box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, scale, n * ticks, 0)) + box(b"minf", box(b"stbl", table))
    return data + box(b"mdat", b"".join(payloads)) + box(b"moov", box(b"trak", box(b"mdia", media)))


def rates(values: list[tuple], *more: bytes) -> bytes:
    stream = node("STNM", "c", 1, b"Gyroscope") + b"".join(more) + node("GYRO", "s", 6, b"".join(struct.pack(">3h", *v) for v in values))
    return node("DEVC", "", 1, node("STRM", "", 1, stream))


def test_files_to_samples(spark, tmp_path):
    payloads = [rates([(k, 2 * k, -k)] * (k + 1)) for k in range(5)]
    (tmp_path / "a.mp4").write_bytes(movie(b"gpmd", payloads) + b"GoPro MET")
    (tmp_path / "b.mp4").write_bytes(b"no movie at all")
    (tmp_path / "c.gcsv").write_text("ANY IMU LOG\ntscale,0.001\ngscale,1\nt,gx,gy,gz\n0,1,2,3\n1,4,5,6\n")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    packets = telemetry.packets(files, "gpmd").collect()
    assert [(p["packet"], p["duration_ms"], bytes(p["payload"])) for p in packets] == [(k, 40.0, p) for k, p in enumerate(payloads)]
    assert telemetry.packets(files, "rtmd").count() == 0
    assert [r["format"] for r in probe.detect(spark, str(tmp_path)).orderBy("path").collect()] == ["gopro", None, "gcsv"]
    got = telemetry.scan(spark, str(tmp_path)).orderBy("path", "i").collect()
    mine = [r for r in got if r["path"].endswith("a.mp4")]
    want = [v for k in range(5) for v in [k] * (k + 1)]
    assert [r["i"] for r in mine] == list(range(15))
    assert np.allclose([r["gx"] for r in mine], np.degrees(want)) and mine[0]["ax"] is None
    assert np.allclose([r["t_ms"] for r in mine], [i * 200 / 15 for i in range(15)])
    assert [(r["t_ms"], r["gz"]) for r in got if r["path"].endswith("c.gcsv")] == [(0.0, 3.0), (1.0, 6.0)]


def packets(spark, rows):
    return spark.createDataFrame([(p, k, ms, bytearray(b) if b is not None else None) for p, k, ms, b in rows], "path string, packet int, duration_ms double, payload binary")


def test_grid_without_stamps_or_durations(spark):
    one, none = rates([(1, 2, 3)] * 4), rates([(1, 2, 3)], node("STMP", "J", 8, struct.pack(">q", 0)))
    found = telemetry.read(packets(spark, [("a", 0, 0.0, one), ("b", 0, 60.0, none), ("b", 1, 60.0, none), ("c", 0, 10.0, b""), ("d", 0, 1.0, None), ("e", 0, 1.0, one[:-3])]), telemetry.gpmf)
    assert {r["path"]: r["step_ms"] for r in telemetry.steps(found).collect()} == {"a": 5.0, "b": 60.0, "c": None, "d": None, "e": None}
    assert telemetry.samples(found).groupBy("path").count().orderBy("path").collect() == [("a", 4), ("b", 2)]
    assert telemetry.camera_turns(found, 30.0).count() == 0 and telemetry.headers(found).count() == 5
    nothing = telemetry.read(packets(spark, []), telemetry.rtmd)
    assert telemetry.samples(nothing).count() == 0 and telemetry.headers(nothing).count() == 0


def test_unequal_orientations_and_still_gravity(spark):
    def stream(key, n):
        return node("STRM", "", 1, node(key, "s", 8, struct.pack(f">{4 * n}h", *([32767, 0, 0, 0] * n))))

    zero = node("STRM", "", 1, node("GRAV", "s", 6, bytes(12)))
    found = telemetry.read(packets(spark, [("a", 0, 1.0, node("DEVC", "", 1, stream("CORI", 2) + stream("IORI", 1))), ("b", 0, 1.0, node("DEVC", "", 1, stream("CORI", 2) + stream("IORI", 2) + zero))]), telemetry.gpmf)
    turns = telemetry.camera_turns(found, 10.0)
    assert [(r["path"], r["t_us"], r["qw"]) for r in turns.orderBy("path", "frame").collect()] == [("b", 0, 1.0), ("b", 100_000, 1.0)]
    assert telemetry.gravity(found, turns).count() == 0


def test_messages():
    data = message((1, -5), (2, 1.5), (3, "xé"), (4, message((1, 7))), (3, b"second"))
    m = Message(data)
    assert (m.signed(1), m.real(2), m.text(3), m.of(4).int(1), m.all(3)[1]) == (-5, 1.5, "xé", 7, b"second")
    assert Message(data[:-2]).all(3) == ["xé".encode()] and Message(b"\x0f\xff").fields == {} and Message().real(2) == 0.0
    assert Message(message((1, struct.pack("<2f", 0.5, 2.0)))).reals(1) == [0.5, 2.0]


def test_small_decoders():
    assert telemetry.decimal16(b"\xd0\x23") == 35 * 10.0**-3 and telemetry.decimal16(b"\x20\x05") == 500.0
    assert telemetry.vectors(struct.pack(">ii", -1, 16), ">4i") == [(-1, -1, -1, -1)] and telemetry.vectors(struct.pack(">ii", 0, 16), ">4i") == []
    assert telemetry.vectors(struct.pack(">ii", 1, 10), ">4i") is None and telemetry.vectors(struct.pack(">ii", 2, 10) + bytes(10), ">i3h") is None and telemetry.vectors(b"", ">4i") is None
    assert telemetry.trailer_records(b"short") == [] and telemetry.trailer_records(bytes(100)) == []


def test_mount_by_model(spark):
    rows = spark.createDataFrame([("HERO6 Black",), ("HERO7 Silver",), ("HERO12",), (None,)], "m string")
    assert [r[0] for r in rows.select(telemetry.model_mount(F.col("m"))).collect()] == ["ZyX", "YXz", None, None]


def test_marks(spark):
    end = b"8db42d694ccc418790edff439fe026bf"
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate((b"x" + end, end + b"x", b"CAM meta", b"djmd CAM meta", b"Non-Real Time Meta", b""))], "k int, b binary")
    assert [r[0] for r in rows.orderBy("k").select(probe.sniff(F.col("b"))).collect()] == ["insta360", None, None, "dji", "sony", None]
