import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import codecs, distortion, scalars
from chronoweave.functions.quaternion import Quat
from chronoweave.operators import asof, filters, keyframes, orientation, robust, scans
from chronoweave.operators.windows import Series
from chronoweave.sources import gcsv, probe

S = Series(("k",), "t", "seq")


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_nearest_ties_and_tolerance(spark):
    probes = frame(spark, [("a", 50, 1), ("a", 20, 2), ("a", 100, 3), ("a", 999, 4), ("b", 5, 5)], "k string, t long, id long")
    samples = frame(spark, [("a", 0, 1, 1.0), ("a", 100, 2, 2.0)], "k string, t long, seq long, v double")
    found = asof.bracket(probes, samples, ["k"], "t", "seq", ["v"], bucket_us=30)
    near = asof.nearest(F.col("lo"), F.col("hi"), F.col("t"), 60)
    got = {r["id"]: r["v"] for r in found.select("id", near["v"].alias("v")).collect()}
    assert got == {1: None, 2: 1.0, 3: 2.0, 4: None, 5: None}


@pytest.mark.parametrize("bucket", [1, 7, 10**9])
def test_bracket_any_bucket(spark, bucket):
    rng = np.random.default_rng(1)
    times = sorted(set(rng.integers(0, 200, 40).tolist()))
    samples = frame(spark, [("a", t, i, float(t)) for i, t in enumerate(times)], "k string, t long, seq long, v double")
    probes = frame(spark, [("a", int(t)) for t in range(-5, 210, 3)], "k string, t long")
    for r in asof.bracket(probes, samples, ["k"], "t", "seq", ["v"], bucket).collect():
        lo, hi = [t for t in times if t <= r["t"]], [t for t in times if t >= r["t"]]
        assert (r["lo"] and r["lo"]["t"]) == (lo[-1] if lo else None)
        assert (r["hi"] and r["hi"]["t"]) == (hi[0] if hi else None)


@pytest.mark.parametrize("block", [3, 50, 10**9])
@pytest.mark.parametrize("reverse", [False, True])
def test_scan_blocks_agree_with_one_pass(spark, block, reverse):
    rng = np.random.default_rng(2)
    data = [(k, int(t), i, float(v)) for k in "ab" for i, (t, v) in enumerate(zip(np.sort(rng.integers(0, 120, 50)), rng.normal(size=50), strict=True))]
    df = frame(spark, data, "k string, t long, seq long, v double")
    alpha = 0.3
    out = scans.scan(df, S, F.lit(1 - alpha), F.col("v") * alpha, F.col("v"), F.col("v"), "q", reverse, block).collect()
    got = {(r["k"], r["seq"]): r["q"] for r in out}
    for k in "ab":
        mine = [d for d in data if d[0] == k]
        mine = mine[::-1] if reverse else mine
        q = mine[0][3]
        for _, _, seq, v in mine:
            q = min(v, alpha * v + (1 - alpha) * q)
            assert math.isclose(got[k, seq], q, abs_tol=1e-9)


def test_scan_of_nothing(spark):
    assert scans.ema(frame(spark, [], "k string, t long, seq long, v double"), S, "v", 0.5).count() == 0


def test_filtfilt_keeps_constants_and_phase():
    assert np.allclose(filters.lowpass(np.full(50, 3.0), 1, 20), 3.0)
    x = np.sin(np.arange(400) / 400 * 2 * np.pi * 4)
    low = filters.lowpass(x, 5, 100)
    assert np.abs(low[50:350] - x[50:350]).max() < 0.05
    assert np.array_equal(filters.lowpass(x, 60, 100), x)
    assert len(filters.lowpass(np.zeros(0), 1, 10)) == 0 and len(filters.lowpass(np.ones(1), 1, 10)) == 1


def test_prefix_product_integration():
    rng = np.random.default_rng(3)
    gyro = rng.normal(size=(101, 3))
    q = orientation.Q0
    for i, w in enumerate(gyro):
        q = orientation.unit(orientation.mul(q, orientation.exp(w * 0.01)))
        assert np.allclose(orientation.simple(gyro, 0.01)[i], q)


@pytest.mark.parametrize("method", ["with_gravity", "mahony", "madgwick", "complementary", "vqf"])
def test_gravity_levels_orientation(method):
    n = 4000
    accel = np.tile([0.0, 0, 9.81], (n, 1))
    q = getattr(orientation, method)(np.zeros((n, 3)), accel, 0.005)
    assert np.allclose(np.linalg.norm(q, axis=1), 1)
    if method in ("with_gravity", "mahony", "vqf"):
        assert orientation.turn(q[-1], np.array([0.0, 0, 1]))[2] > 0.99


def test_smoothers_reduce_motion():
    rng = np.random.default_rng(4)
    q = orientation.simple(rng.normal(size=(300, 3)), 0.05)
    for smooth in (orientation.smooth_plain, orientation.smooth_default):
        out = smooth(q, 20.0)
        move = lambda x: orientation.angle(orientation.mul(orientation.conj(x[:-1]), x[1:])).sum()
        assert move(out) < move(q)
    assert len(orientation.smooth_default(q[:1], 20.0)) == 1


def test_rate_control_halves_and_doubles():
    t = np.arange(1, 101) * 1e5
    assert abs(orientation.rate_control(t, np.full(100, 2.0), 10).sum() - 50) <= 1
    assert abs(orientation.rate_control(t, np.full(100, 0.5), 10).sum() - 200) <= 2


def test_adaptive_ema_gaps():
    x = np.array([np.nan, 10, np.nan, 12, 11])
    out = orientation.adaptive_ema(x, 10, 1.0, 0.1, 1.0)
    assert np.isnan(out[0]) and not np.isnan(out[1:]).any()
    assert np.isnan(orientation.adaptive_ema(np.full(3, np.nan), 10, 1, 0.1, 1)).all()


def test_slerp_double_cover(spark):
    row = spark.range(1).select(*(F.lit(v).alias(n) for n, v in zip("abcd", (1.0, 0.0, 0.0, 0.0), strict=True)))
    a = Quat(*map(F.col, "abcd"))
    q = a.slerp(Quat(*(F.lit(v) for v in (-1.0, 0.0, 0.0, 0.0))), F.lit(0.5))
    assert abs(row.select(q.w.alias("w")).first()["w"]) == pytest.approx(1.0)


def test_distortion_fails_as_null(spark):
    row = spark.range(1)
    x, y = distortion.poly3(-3.0).undistort(F.lit(5.0), F.lit(0.0))
    assert row.select(x.alias("x"), y.alias("y")).first() is not None
    u, v = distortion.Stretch(0.0, 1.0).undistort(F.lit(1.0), F.lit(1.0))
    assert row.select(u.alias("u"), v.alias("v")).first()["u"] is None
    assert distortion.poly3(-0.3).limit() is not None and distortion.poly3(0.3).limit() is None


def test_consensus_ignores_outliers(spark):
    points = [("a", float(x), 2.0 * x + 1) for x in range(8)] + [("a", 3.5, 400.0), ("a", 5.5, -300.0)]
    r = robust.consensus(frame(spark, points, "k string, x double, y double"), ["k"], "x", "y", 5.0, 10.0).first()
    assert r["inliers"] == 8 and r["slope"] == pytest.approx(2.0) and r["intercept"] == pytest.approx(1.0)


def test_keyframe_upsert_snaps(spark):
    keys = frame(spark, [("a", 100, 1.0), ("a", 103, 2.0)], "k string, t long, value double")
    changes = frame(spark, [("a", 101, 9.0), ("a", 500, 5.0)], "k string, t long, value double")
    got = sorted((r["t"], r["value"]) for r in keyframes.upsert(keys, changes, ["k"], "t", "value", 2).collect())
    assert got == [(100, 9.0), (103, 2.0), (500, 5.0)]


@pytest.mark.parametrize("n", [0, 1, 2, 13, 14, 91, 5000])
def test_base91(n):
    data = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    assert codecs.base91_decode(codecs.base91_encode(data)) == data
    assert codecs.open_envelope(codecs.envelope(data)) == data


def test_binary_codecs():
    q = [(1, 1.0, 0.0, 0.0, 0.0), (-5, 0.5, 0.5, 0.5, 0.5)]
    assert codecs.unpack_quaternions(codecs.pack_quaternions(q)) == q
    with pytest.raises(ValueError):
        codecs.unpack_quaternions(codecs.pack_quaternions(q)[:-1])
    value = {"a": [1, -2, 300, 70000, 2**40], "b": {"c": None, "d": True, "e": 1.5, "f": 0.1}, "g": "é" * 30}
    assert codecs.uncbor(codecs.cbor(value)) == value
    assert codecs.cbor(1.5) == bytes.fromhex("f93e00") and codecs.cbor(24) == bytes.fromhex("1818")


def test_merge_rules():
    assert codecs.merge({"a": {"x": 1}, "l": [1], "v": 1}, {"a": {"y": 2}, "l": {"z": 1}, "v": [2]}) == {"a": {"x": 1, "y": 2}, "l": [1, {"z": 1}], "v": [2]}


def test_gcsv_rules(spark):
    text = "CAMERA IMU LOG\r\nversion,1.1\r\ntscale,0.5\r\nt,gx,gy,gz\r\n1,1,2,3\r\n2,1,2,3,4,5,6\r\nbad\r\n"
    files = frame(spark, [("x", text), ("y", "nothing\n1,2,3,4"), ("z", "")], "path string, text string")
    headers, samples = gcsv.parse(files)
    got = sorted(samples.collect(), key=lambda r: r["row"])
    assert [r["t_ms"] for r in got] == [500.0, 1000.0] and got[0]["ax"] is None and got[1]["az"] == 6.0
    assert headers.count() == 1


def test_mp4_sample_table():
    import struct

    def box(kind, body):
        return struct.pack(">I", 8 + len(body)) + kind + body

    stbl = box(b"stsz", struct.pack(">IIIIII", 0, 0, 3, 10, 20, 30)) + box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 2, 1)) + box(b"stco", struct.pack(">IIII", 0, 2, 100, 500)) + box(b"stts", struct.pack(">IIII", 0, 1, 3, 40))
    assert probe.sample_table(stbl, 0, len(stbl)) == [(100, 10, 40), (110, 20, 40), (500, 30, 40)]


def test_labels(spark):
    r = spark.range(1).select(scalars.aspect_label(F.lit(1920), F.lit(1080)).alias("a"), scalars.aspect_label(F.lit(1000), F.lit(700)).alias("b"), scalars.size_label(F.lit(1920), F.lit(1440)).alias("c"), scalars.duration_ms(F.lit("2.5s"), 25.0).alias("d"), scalars.half_even(F.lit(2.5)).alias("e")).first()
    assert tuple(r) == ("16:9", "10:7", "1440p", 2500.0, 2)
