"""Sinks: orientation tables as CSV or JSON text, coordinate maps, project documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.quaternion import Quat


def csv_lines(df: DataFrame, t: str = "t_us", parts: tuple[str, ...] = ("qw", "qx", "qy", "qz")) -> DataFrame:
    """(t, line): time and components with ten decimals."""
    return df.select(F.col(t), F.concat_ws(",", F.col(t).cast("string"), *(F.format_string("%.10f", F.col(p)) for p in parts)).alias("line"))


def write_csv(df: DataFrame, path: str, by: str, t: str = "t_us", parts: tuple[str, ...] = ("qw", "qx", "qy", "qz")) -> None:
    """One folder for each series; rows of a file are in time order."""
    rows = df.select(by, t, *(F.format_string("%.10f", F.col(p)).alias(p) for p in parts))
    rows.repartitionByRange(by, t).sortWithinPartitions(by, t).write.partitionBy(by).option("header", True).csv(path)


def stabilised(df: DataFrame, original: tuple[str, ...], correction: tuple[str, ...]) -> Quat:
    """Inverse of correction times the original's inverse; a missing correction is the original."""
    org = Quat(*map(F.col, original))
    corr = Quat(*(F.coalesce(F.col(c), F.col(o)) for c, o in zip(correction, original, strict=True)))
    return (corr * org.inverse()).inverse()


def coordinate_map(df: DataFrame, width: int, height: int, place) -> DataFrame:
    """A row for each pixel: (x, y, sx, sy) with the source point that ``place(x, y)`` gives."""
    n = df.sparkSession.range(width * height)
    x, y = (F.col("id") % width).cast("double"), F.floor(F.col("id") / width).cast("double")
    sx, sy = place(x, y)
    return n.select(x.cast("int").alias("x"), y.cast("int").alias("y"), F.coalesce(sx, F.lit(0.0)).alias("sx"), F.coalesce(sy, F.lit(0.0)).alias("sy"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
