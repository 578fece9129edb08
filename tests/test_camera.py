import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import camera, matrix
from chronoweave.functions.quaternion import Quat
from chronoweave.operators import frames, matching, orientation, search


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_distortion_hash_is_that_of_compact_json(spark):
    got = one(spark, camera.distortion_hash((F.lit(24_000_000), F.lit(13_000_000)), F.lit(1), F.lit(0.001), F.array(*map(F.lit, (100, 200, 300)))))[0]
    text = '{"unk1":[24000000,13000000],"unk2":1,"unk3":%r,"unk4":[100,200,300]}' % float(np.float32(0.001))
    assert got == format(zlib.crc32(text.encode()), "x") == "906280fe"


def test_inverse_and_rotation_vector(spark):
    m = matrix.Matrix(tuple(map(F.lit, (2.0, 1.0, 0.0, 0.5, 3.0, 1.0, 0.0, 0.25, 4.0))))
    assert np.allclose(np.reshape(one(spark, *(m @ m.inverse()).m), (3, 3)), np.eye(3))
    none = matrix.Matrix(tuple(map(F.lit, (1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0))))
    assert set(one(spark, *none.inverse().m)) == {None}
    assert np.allclose(one(spark, *matrix.from_quat(Quat(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))).rotation_vector()), 0)


def test_names_and_paths(spark):
    got = one(spark, camera.range_path(F.lit("a.b/clip"), F.lit(1)), camera.range_path(F.lit("a/x.y.mp4"), F.lit(0)), camera.concrete_name(F.lit("f_%03d.png"), F.lit(12345)), camera.is_video(F.lit("https://x/v.MP4")), camera.is_video(F.lit("v.txt")), camera.token_alias(F.lit("unknown")), camera.clean_name(F.lit("_Wide_16:9 4K.json")))
    assert tuple(got) == ("clip-002", "a/x.y-001.mp4", "f_12345.png", True, False, "unknown", "Wide")


def test_sync_inliers_without_points(spark):
    points = spark.createDataFrame([], "k long, t long, offset double")
    overall = spark.createDataFrame([(1, 5.0)], "k long, overall double")
    assert [tuple(r) for r in matching.sync_inliers(points, ["k"], overall).collect()] == [(1, 0, 5.0)]


def test_trim_fill_holds_ends(spark):
    rows = [(1, t, t, math.cos(t / 100), 0.0, 0.0, math.sin(t / 100)) for t in range(0, 100, 10)] + [(2, 5, 5, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, t long, seq long, qw double, qx double, qy double, qz double")
    got = {(r["k"], r["t"]): math.atan2(r["qz"], r["qw"]) * 100 for r in frames.trim_fill(df, ["k"], [(15, 35), (60, 75)]).collect()}
    assert [round(got[1, t]) for t in range(0, 100, 10)] == [20, 20, 20, 30, 40, 50, 60, 70, 70, 70]
    assert frames.trim_fill(df, ["k"], []) is df and round(got[2, 5]) == 0


def test_steps_skip_rows_without_a_rate():
    t = np.array([0, 10_000, 20_000, 20_000, 50_000], float)
    gyro = np.ones((5, 3))
    gyro[1] = np.nan
    mean = 0.05 * 6 / 5 / 5
    assert np.allclose(orientation.steps(t, gyro), [mean, 0, 0.02, mean, 0.03])
    assert np.allclose(orientation.steps(t, gyro, 0.001, False), [mean / 1000, 0, 0.02, 0, 0.03])
    assert len(orientation.steps(t[:0], gyro[:0])) == 0


def test_missing_acceleration_counts_as_a_direction():
    gyro, none, zero = np.zeros((3, 3)), np.full((3, 3), np.nan), np.zeros((3, 3))
    along = lambda axis: np.tile(np.eye(3)[axis], (3, 1))
    for f in (orientation.mahony, orientation.madgwick):
        assert np.allclose(f(gyro, none, 0.01), f(gyro, along(0), 0.01)) and np.allclose(f(gyro, zero, 0.01), f(gyro, along(1), 0.01))


def test_correlation_of_a_constant_signal(spark):
    pairs = spark.createDataFrame([(1, o, 2.0, float(i + o)) for o in (0, 1) for i in range(5)], "k long, offset int, x double, y double")
    assert search.best_by_correlation(pairs, ["k"]).count() == 0


@pytest.mark.parametrize("flipped", [False, True])
def test_row_transform_inverts_the_projection(spark, flipped):
    q = (0.9, 0.1, -0.3, 0.2)
    q = tuple(x / math.sqrt(sum(y * y for y in q)) for x in q)
    schema = "k long, t long, seq long, qw double, qx double, qy double, qz double"
    org, smooth = spark.createDataFrame([(1, 0, 0, *q), (1, 100, 1, *q)], schema), spark.createDataFrame([(1, 0, 0, 1.0, 0.0, 0.0, 0.0)], schema)
    these = spark.createDataFrame([(1, 7, 50, 0.0, 800.0, 900.0, 320.0, 240.0)], "k long, frame long, t long, readout_ms double, fx double, fy double, cx double, cy double")
    got = frames.row_transforms(these, org, smooth, ["k"], 4, flipped=flipped).collect()
    assert len(got) == 1  # no readout: one row
    # the original cancels out, what stays is the smoothed one: the identity
    k = np.array([[800, 0, 320], [0, 900, 240], [0, 0, 1.0]])
    assert np.allclose(np.reshape([got[0][f"m{i}"] for i in range(9)], (3, 3)), np.linalg.inv(k), atol=1e-12)
