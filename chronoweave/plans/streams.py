"""Streaming queries, run over all that is available and written to files that the query returns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.scalars import micros
from chronoweave.plans.base import query, r, table
from chronoweave.runtime import ensure_shipped, shared_dir
from chronoweave.streaming import streams


def _source(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of files."""
    kinds = table(spark, sf, "events").schema
    rows = spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT epoch_us(s) AS start_us, event_type, n, total FROM w WHERE s + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows that the watermark has closed."""
    out = _run(spark, streams.windowed(_source(spark, sf), "ts", ["event_type"], "value", "6 hours", "1 hour"))
    return out.select(micros(F.col("start").cast("timestamp_ntz")).alias("start_us"), "event_type", "n", r("total", 4).alias("total"))


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m),
g AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM x GROUP BY user_id, run)
SELECT user_id, epoch_us(a) AS first_us, epoch_us(b) AS last_us, n FROM g WHERE b + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = _run(spark, streams.sessions(_source(spark, sf), "ts", ["user_id"], "12 hours", "1 hour"))
    return out.select("user_id", micros(F.col("first").cast("timestamp_ntz")).alias("first_us"), micros(F.col("last").cast("timestamp_ntz")).alias("last_us"), "n")


@query("""WITH RECURSIVE n AS (SELECT user_id, epoch_us(ts) AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
q AS (SELECT user_id, t, i, value AS e FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.t, n.i, 0.8 * q.e + 0.2 * n.value FROM q JOIN n ON n.user_id = q.user_id AND n.i = q.i + 1)
SELECT user_id, t, round(e, 6) AS ema FROM q""")
def stream_ema(spark: SparkSession, sf: str) -> DataFrame:
    """Causal smoothing with one number of state for each series."""
    ensure_shipped(spark)
    out = _run(spark, streams.causal_ema(_source(spark, sf).select("user_id", "ts", "event_id", "value"), "user_id", "ts", "value", 0.2, "event_id"))
    return out.select("user_id", micros(F.col("ts").cast("timestamp_ntz")).alias("t"), r("ema").alias("ema"))


@query()
def stream_rate_control(spark: SparkSession, sf: str) -> DataFrame:
    ensure_shipped(spark)
    rows = _source(spark, sf).select("user_id", (F.unix_micros("ts") - 1704067200000000).alias("t_us"), F.when(F.col("event_id") % 2 == 0, 2.0).otherwise(0.5).alias("speed"))
    return _run(spark, streams.rate_control(rows, "user_id", "t_us", "speed", 1e6 / (4 * 3_600_000_000)))
