"""Queries against their SQL on rows that only larger tables hold."""

import datetime
import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import camera, matrix
from chronoweave.functions.quaternion import Quat
from chronoweave.plans import catalogue
from tests.conftest import rows


def day(n: float) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def same_as_sql(spark, folder, name: str, events: list[tuple]) -> list[str]:
    """Rows of a query over (event_id, ts, user_id, event_type, value), the same as its SQL's."""
    kinds = (("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()))
    columns = [pa.array(c, k) for c, (_, k) in zip(zip(*events, strict=True), kinds, strict=True)]
    pq.write_table(pa.table([*columns, pa.array(["{}"] * len(events))], names=[*(n for n, _ in kinds), "props"]), f"{folder}/events.parquet")
    got = rows(catalogue.QUERIES[name](spark, str(folder)).toPandas())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert got == rows(con.sql(catalogue.ORACLES[name]).df())
    return got


def test_best_run_weighs_late_runs(spark, tmp_path):
    runs = [(7, day(0), 1, "click", 0.02), (3_000_000, day(1), 1, "click", 0.01), (5_000_000, day(2), 1, "view", None), (8, day(1), 2, "view", 0.5), (9, day(2), 2, "view", 0.5)]
    assert same_as_sql(spark, tmp_path, "best_run", runs) == ["(0.01, 7, 1)", "(0.5, 8, 2)"]


@pytest.mark.parametrize("name", ["stream_ema", "stream_rate_control"])
def test_streams_take_series_in_pieces_in_order(spark, tmp_path, name):
    some = np.random.default_rng(3).permutation(200).tolist()
    events = [(i, day(i / 10), i % 2, "click", float(i * 37 % 101)) for i in some]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        if name in catalogue.ORACLES:
            assert len(same_as_sql(spark, tmp_path, name, events)) == 200
        else:
            found = []
            for part, order in enumerate((events, sorted(events))):
                folder = tmp_path / str(part)
                folder.mkdir()
                columns = list(zip(*order, strict=True))
                pq.write_table(pa.table([pa.array(columns[0]), pa.array(columns[1], pa.timestamp("us")), pa.array(columns[2]), pa.array(columns[3]), pa.array(columns[4])], names=["event_id", "ts", "user_id", "event_type", "value"]), folder / "events.parquet")
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if part == 0 else "10000")
                found.append(rows(catalogue.QUERIES[name](spark, str(folder)).toPandas()))
            assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_consensus_line_counts_pairs(spark, tmp_path):
    # three points lie on one level, so three pairs give that line
    values = [78.65, 47.21, 32.95, 4.22, 50.38, 33.52, 16.88, 4.22, 105.51, 19.79, 99.53, 4.22, 85.73, 203.28, 72.39, 48.07, 125.1]
    days = [1.34, 3.61, 5.72, 7.07, 7.79, 8.01, 17.2, 19.75, 20.18, 21.46, 22.61, 25.61, 26.08, 26.11, 27.11, 29.38, 29.98]
    events = [(i, day(d), 1, "signup", v) for i, (d, v) in enumerate(zip(days, values, strict=True))]
    assert len(same_as_sql(spark, tmp_path, "consensus_line", events)) == 1


def test_intrinsics_of_zero(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "intrinsics", [(i, day(i), 1, "click", 0.0) for i in range(10)])
    assert sum(x.startswith("(0.0,") for x in got) == 4
    one = spark.range(1).select(camera.zoom_compensation(F.lit(True), F.lit(0.0), F.lit(2.0))).first()
    assert one[0] == 1.0


def test_max_angles_past_half_a_turn(spark, tmp_path):
    events = [(1, day(4), 1, "click", 900.0), (2, day(4), 2, "click", 1600.0), (3, day(4), 3, "click", 800.0), (5, day(4), 3, "click", 700.0), (6, day(5), 4, "click", 100.0), (10, day(5), 4, "click", 300.0)]
    got = same_as_sql(spark, tmp_path, "max_angles", events)
    assert sum(float(x.strip("()").split(", ")[1]) > 180 for x in got) == 2


def test_rotation_rate_past_half_a_turn(spark, tmp_path):
    values = [0.0, 100.0, 522.0, 522.7, 523.0, 560.21, 800.0, 1045.0, 1568.0, 2500.0]
    same_as_sql(spark, tmp_path, "rotation_rate", [(i + 10 * k, day(i), 1, "click", v) for k in range(5) for i, v in enumerate(np.roll(values, k).tolist())])


def test_rotation_vector_of_half_and_whole_turns(spark):
    def vector(q, near):
        m = matrix.from_quat(Quat(*map(F.lit, q))).rotation_vector(tuple(map(F.lit, near)))
        return np.array(spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(m))).first(), float)

    assert np.allclose(vector((0.0, 0.6, 0.0, -0.8), (-2.0, 0.0, 2.0)), np.array([-0.6, 0, 0.8]) * math.pi)
    assert np.allclose(vector((1.0, 0.0, 0.0, 0.0), (0.0, 6.0, 0.0)), [0, 2 * math.pi, 0])
    assert np.allclose(vector((1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0)), 0)
