import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import asof, filters, horizon, orientation, scans, splines, stabilise
from chronoweave.operators.frames import PARTS
from chronoweave.operators.windows import Series

S = Series(("k",), "t", "seq")
TURNS = "k string, t long, seq long, qw double, qx double, qy double, qz double"


def about_z(angles, key="a", step=10_000):
    return [(key, i * step, i, math.cos(a / 2), 0.0, 0.0, math.sin(a / 2)) for i, a in enumerate(angles)]


def dense(values):
    """Curvatures of a natural spline from the whole linear system."""
    n = len(values)
    m, d = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = 1, 4, 1
        d[i] = 3 * (values[i + 1] - 2 * values[i] + values[i - 1])
    return np.linalg.solve(m, d)


@pytest.mark.parametrize("n", [1, 2, 3, 60])
def test_natural_spline(spark, n):
    values = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([("a", 7 * i, i, float(v)) for i, v in enumerate(values)] + [("b", 0, 0, 5.0)], "k string, t long, seq long, v double")
    got = splines.natural(df, S, "v").where("k = 'a'").orderBy("seq").collect()
    c = dense(values)
    assert np.allclose([r["c"] for r in got], c) and got[-1]["b"] is None and got[-1]["d"] is None
    assert np.allclose([r["d"] for r in got[:-1]], np.diff(c) / 3)
    assert np.allclose([r["v"] + r["b"] + r["c"] + r["d"] for r in got[:-1]], values[1:])
    if n > 1:
        at = np.array([0.0, 0.5, n - 1.25, n - 1.0])
        k = np.minimum(at.astype(int), n - 2)
        x = at - k
        want = [values[i] + got[i]["b"] * u + got[i]["c"] * u * u + got[i]["d"] * u**3 for i, u in zip(k, x, strict=True)]
        assert np.allclose(splines.knots(np.tile(values, (4, 1)), at), want)


def test_mesh_at_its_knots():
    m = np.random.default_rng(0).normal(size=(4, 6))
    assert all(math.isclose(splines.mesh(m, 10 * c, 5 * r, 50, 15), m[r, c], abs_tol=1e-12) for r in range(4) for c in range(6))


def test_tilt_limits(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("a", int(t), i, float(v)) for i, (t, v) in enumerate(zip(np.cumsum(rng.integers(0, 60_000, 80)), rng.normal(0, 40, 80), strict=True))] + [("b", 0, 0, 9.0)], "k string, t long, seq long, rate double")
    free = horizon.tilts(df, S, 0.2)
    wide = horizon.tilts(free, S, 0.2, limit=1e9, out="wide").collect()
    assert np.allclose([r["tilt"] for r in wide], [r["wide"] for r in wide])
    tight = horizon.tilts(df, S, 0.2, limit=3.0).where("k = 'a'").orderBy("seq").collect()
    steps = [(y["tilt"] - x["tilt"], (y["t"] - x["t"]) / 1e6) for x, y in zip(tight[:-1], tight[1:], strict=True)]
    assert all(abs(d) <= 3.0 * dt + 1e-9 for d, dt in steps if dt > 0)
    assert horizon.tilts(df, S, 0.0).where("k = 'a' and seq > 0 and abs(rate) > 5 and tilt <> rate").count() == 0


def test_roll_rates_across_the_half_turn_and_gaps(spark):
    rows = about_z([3.0, -3.0, 3.0]) + [("a", 2_000_000, 3, 1.0, 0.0, 0.0, 0.0)] + about_z([0.0], "b")
    got = {(r["k"], r["seq"]): r["rate"] for r in horizon.roll_rates(spark.createDataFrame(rows, TURNS), S, 0.0).collect()}
    short = math.degrees(2 * math.pi - 6.0) / 0.01
    assert math.isclose(got["a", 1], short, rel_tol=1e-9) and math.isclose(got["a", 2], -short, rel_tol=1e-9)
    assert got["a", 0] is None and got["a", 3] is None and got["b", 0] is None


def test_lock_ends(spark):
    df = spark.createDataFrame(about_z([0.4, 1.0]), TURNS)
    same = horizon.lock(df, F.lit(0.0), F.lit(30.0)).orderBy("seq").collect()
    assert np.allclose([[abs(r[p]) for p in PARTS] for r in same], [[abs(r[p]) for p in PARTS] for r in df.orderBy("seq").collect()])
    whole = horizon.lock(df, F.lit(100.0), F.lit(0.0), F.lit(10.0)).collect()
    assert all(math.isclose(sum(r[p] ** 2 for p in PARTS), 1.0) for r in whole)
    upright = horizon.lock_by_gravity(df.withColumns({f"o_{p}": F.lit(None).cast("double") for p in PARTS} | {"gx": F.lit(None).cast("double"), "gy": F.lit(None).cast("double")}), F.lit(100.0), F.lit(0.0))
    assert np.allclose([r["qz"] for r in upright.orderBy("seq").collect()], [math.sin(0.2), math.sin(0.5)])


def test_low_passed_turns(spark):
    angles = np.cumsum(np.random.default_rng(5).normal(0, 0.2, 50))
    got = stabilise.lowpass_turns(spark.createDataFrame(about_z(angles) + about_z([1.0, 2.0, 0.5], "b"), TURNS), S, 2.0, 100.0)
    a = got.where("k = 'a'").orderBy("seq").collect()
    w, z = (filters.lowpass(f(angles / 2), 2.0, 100.0) for f in (np.cos, np.sin))
    assert np.allclose([r["qw"] for r in a], w / np.hypot(w, z)) and np.allclose([r["qz"] for r in a], z / np.hypot(w, z))
    assert np.allclose([r["qw"] for r in got.where("k = 'b'").orderBy("seq").collect()], np.cos([0.5, 1.0, 0.25]))


def samples(spark, n=40):
    rng = np.random.default_rng(6)
    rows = [("a", 5000 * i, i, *(float(v) for v in rng.normal(0, 1, 3)), *(float(v) for v in rng.normal(0, 1, 2)), 9.8) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, seq long, gx double, gy double, gz double, ax double, ay double, az double"), rows


def test_methods_and_smoothers_by_number(spark):
    df, rows = samples(spark)
    x = np.array([r[3:] for r in rows])
    t = np.array([r[1] for r in rows], float)
    for method in stabilise.METHODS:
        got = stabilise.integrated(df, S, method).orderBy("seq").collect()
        assert np.allclose([[r[p] for p in PARTS] for r in got], stabilise.METHODS[method](t, x[:, :3], x[:, 3:]))
    turns = stabilise.integrated(df, S, 3).select("k", "t", "seq", *PARTS)
    q = np.array([[r[p] for p in PARTS] for r in turns.orderBy("seq").collect()])
    rate = len(t) / orientation.duration(t)
    for kind, want in ((-4, q), ("none", q), (1, orientation.smooth_default(q, rate)), ("plain", orientation.smooth_plain(q, rate))):
        assert np.allclose([[r[p] for p in PARTS] for r in stabilise.smoothed(turns, S, kind).orderBy("seq").collect()], want)
    held = stabilise.smoothed(turns, S, 9, (10.0, 5.0, 20.0)).select(*PARTS).distinct().collect()
    assert len(held) == 1
    found, angles = stabilise.stabilised(turns, S, "plain")
    back = np.array([[r[p] for p in PARTS] for r in found.orderBy("t").collect()])
    assert np.allclose(back, orientation.mul(orientation.conj(orientation.smooth_plain(q, rate)), q)) and angles.count() == 1


def test_filters_of_channels(spark):
    df, rows = samples(spark)
    holes = df.withColumn("gx", F.when(F.col("seq") != 3, F.col("gx")))
    got = stabilise.prepared(holes, S, "ZxY", (0.5, 0.0, 0.0), cutoff=20.0, rate=200.0).orderBy("seq").collect()
    x = np.array([r[3] for r in rows]) + 0.5
    x[3] = 0.0
    # the input's x, turned, comes out second
    assert np.allclose([r["gy"] for r in got if r["seq"] != 3], -np.delete(filters.lowpass(x, 20.0, 200.0), 3)) and got[3]["gy"] is None
    empty = holes.limit(0)
    assert stabilise.prepared(empty, S, cutoff=20.0, kernel=3, rate=200.0).count() == 0 and stabilise.integrated(empty, S, 5).count() == 0


def test_conversion_without_the_other_method(spark):
    org = spark.createDataFrame(about_z([0.5, 0.6, 0.7]), TURNS)
    got = stabilise.converted(org, org.limit(0), org.limit(0), S).orderBy("seq").collect()
    # the identity stands for what is missing, so the first row becomes the identity
    assert math.isclose(abs(got[0]["qw"]), 1.0) and len(got) == 3


def test_later_than_closest_ties(spark):
    p = spark.createDataFrame([("a", 50, 1), ("a", 0, 2), ("a", 500, 3), ("b", 1, 4)], "k string, t long, id long")
    s = spark.createDataFrame([("a", 40, 1, 1.0), ("a", 60, 2, 2.0), ("a", 70, 3, 3.0)], "k string, t long, seq long, v double")
    got = {r["id"]: r["later"] for r in asof.later_than_closest(p, s, ["k"], "t", "seq", "v", 40, 1).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: None, 4: None}


def test_scan_with_alternating_blocks(spark):
    df = spark.createDataFrame([("a", i, i, float(i % 3)) for i in range(9)], "k string, t long, seq long, v double")
    one, many = (scans.scan(df, S, F.lit(0.25), F.col("v"), out="q", block_us=b).orderBy("seq").collect() for b in (100, 2))
    assert np.allclose([r["q"] for r in one], [r["q"] for r in many])
