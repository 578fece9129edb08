"""Registered queries over the shared tables, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.plans import camera, lens, motion, project, relational, series, stabilise, streams, telemetry
from chronoweave.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "camera", "flagship", "lens", "motion", "project", "relational", "series", "stabilise", "streams", "telemetry"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's smoothed signal on a regular grid."""
    return series.smooth_on_grid(spark, sf_dir)
