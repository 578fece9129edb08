"""Motion logs in the GCSV text format, as a table; files are read by Spark, so any store does.

A file has a magic first line, ``key,value`` lines, a line that starts with ``t,``, then rows
of 4, 7 or 10 numbers: time, rates, and optionally acceleration and magnetic field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a log's first line ends.
MAGIC = " IMU LOG"


def parse(files: DataFrame, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(headers, samples) of whole files as text: headers (path, meta map), samples (path, t_ms, gx.., ax.., mx..).

    Raw values are scaled by the header's tscale (seconds), gscale, ascale and mscale. A
    file without the magic line has neither header nor samples."""
    lines = files.select(F.col(path).alias("path"), F.split(F.regexp_replace(F.col(text), "\r", ""), "\n").alias("lines"))
    good = lines.where(F.endswith(F.btrim(F.element_at("lines", 1)), F.lit(MAGIC)))
    split_at = F.array_position(F.transform("lines", lambda x: x.startswith("t,")), True).cast("int")
    cut = good.withColumn("at", split_at).where("at > 0")
    pairs = F.filter(F.transform(F.slice("lines", F.lit(2), F.col("at") - 2), lambda x: F.split(x, ",", 2)), lambda p: F.size(p) == 2)
    headers = cut.select("path", F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p[0])), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p[0] == k), -1)[1].alias("v")))).alias("meta"), "lines", "at")
    rows = headers.select("path", "meta", F.posexplode(F.slice("lines", F.col("at") + 1, F.size("lines"))).alias("row", "line")).where("trim(line) <> ''")
    v = F.transform(F.split("line", ","), lambda x: F.btrim(x).try_cast("double"))
    scale = lambda k, d: F.coalesce(F.try_element_at("meta", F.lit(k)).try_cast("double"), F.lit(d))
    rows = rows.withColumn("v", v).where(F.size("v").isin(4, 7, 10) & F.col("v")[0].isNotNull())
    named = [(c, 1 + i, "gscale") for i, c in enumerate(("gx", "gy", "gz"))] + [(c, 4 + i, "ascale") for i, c in enumerate(("ax", "ay", "az"))] + [(c, 7 + i, "mscale") for i, c in enumerate(("mx", "my", "mz"))]
    samples = rows.select("path", "row", (F.col("v")[0] * scale("tscale", 0.001) * 1000).alias("t_ms"), *((F.get("v", F.lit(i)) * scale(s, 1.0)).alias(c) for c, i, s in named))
    return headers.select("path", "meta"), samples


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse(files)


def readout_ms(meta: F.Column) -> F.Column:
    """Readout time with its direction: negative from the bottom, 10000 more if sideways."""
    time = F.coalesce(F.try_element_at(meta, F.lit("frame_readout_time")).try_cast("double"), F.lit(0.0))
    way = F.coalesce(F.try_element_at(meta, F.lit("frame_readout_direction")), F.lit("0"))
    return F.when(way.isin("1", "BottomToTop"), -time).when(way.isin("2", "LeftToRight"), time + 10000).when(way.isin("3", "RightToLeft"), -(time + 10000)).otherwise(time)
