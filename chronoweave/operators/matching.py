"""Matching of sync points, flow lines, frames and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along_flow(lines: DataFrame, frame: list[str], angle: str, limit: float = 30.0) -> DataFrame:
    """``lines`` whose direction (degrees) is nearer than ``limit`` to their frame's plain mean.
    The means are one row a frame."""
    means = lines.groupBy(*frame).agg(F.avg(angle).alias("_mean"))
    return lines.join(means, frame).where(F.abs(F.col(angle) - F.col("_mean")) < limit).drop("_mean")


def sync_inliers(points: DataFrame, by: list[str], overall: DataFrame, most: float = 40.0) -> DataFrame:
    """(by, t, offset): points after the start within ``most`` of their series' overall offset
    (``overall``: by, overall), and that offset itself at time 0."""
    known = points.where((F.col("t") > 0) & F.col("offset").isNotNull() & ~F.isnan("offset") & (F.abs("offset") != float("inf")))
    kept = known.join(overall, by).where(F.abs(F.col("offset") - F.col("overall")) <= most).select(*by, "t", "offset")
    return kept.unionByName(overall.select(*by, F.lit(0).cast("long").alias("t"), F.col("overall").alias("offset")))


def weighted_cost(pairs: DataFrame, by: list[str], weights: tuple[float, float, float], total: str = "n") -> DataFrame:
    """(by, cost): mean weighted squared difference of (x0, x1, x2) and (y0, y1, y2) over matched rows
    (y0 not null); infinite unless more than half of the ``total`` rows match."""
    error = sum(((F.col(f"x{i}") - F.col(f"y{i}")) * (F.col(f"x{i}") - F.col(f"y{i}")) * w for i, w in list(enumerate(weights))[1:]), (F.col("x0") - F.col("y0")) * (F.col("x0") - F.col("y0")) * weights[0])
    matched = F.count("y0")
    return pairs.groupBy(*by).agg(F.when(matched > F.max(total) / 2, F.sum(error) / F.when(matched > 0, matched)).otherwise(F.lit(float("inf"))).alias("cost"))


def around(points: DataFrame, samples: DataFrame, by: list[str], value: str, half: int, least: int) -> DataFrame:
    """(by, point, n, mean): samples within ``half`` of each point, for points with ``least`` of them.
    An equi-join on cells of twice that width, of which a point meets two or three."""
    wide = 2 * half
    cells = F.sequence(F.floor((F.col("point") - half) / wide), F.floor((F.col("point") + half) / wide))
    p = points.select(*by, "point", F.explode(cells).alias("_cell"))
    s = samples.select(*by, "t", value, F.floor(F.col("t") / wide).alias("_cell"))
    near = p.join(s, [*by, "_cell"]).where(F.abs(F.col("t") - F.col("point")) <= half)
    return near.groupBy(*by, "point").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= least)


def frames_apart(frames: DataFrame, by: list[str], number: str, distance: int, columns: list[str]) -> DataFrame:
    """Each frame with the columns (as other_...) of the frame ``distance`` numbers later, if there is one."""
    later = frames.select(*by, (F.col(number) - distance).alias(number), *(F.col(c).alias(f"other_{c}") for c in columns))
    return frames.join(later, [*by, number])


def zipped(a: DataFrame, b: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``a`` with the columns (as other_...) of ``b``'s row at the same position of its series, for
    series that have as many rows in both."""
    w, whole = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    left, right = (x.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(whole)) for x in (a, b))
    return left.join(right.select(*by, "_i", "_n", *(F.col(c).alias(f"other_{c}") for c in columns)), [*by, "_i", "_n"]).drop("_i", "_n")


def ranked_at(values: Column, share: float) -> Column:
    """The value at a share of a sorted array, from its low end; null for an empty one."""
    return F.get(F.array_sort(values), F.floor(F.size(values) * share).cast("int"))


def moving_window(df: DataFrame, by: list[str], order: list[str], value: str, half: Column, most: int) -> DataFrame:
    """``df`` with ``low`` and ``smooth``: minimum and Gaussian mean (sigma a third of ``half``) over each
    row's own window of up to ``most`` rows a side; beyond the ends the end's value counts.
    Rows meet their neighbours by position, so a window's width may change from row to row."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("_half", F.least(half, F.lit(most)).cast("int"))
    near = rows.withColumn("_d", F.explode(F.sequence(-F.col("_half"), F.col("_half")))).withColumn("_at", F.greatest(F.lit(1), F.least(F.col("_n"), F.col("_i") + F.col("_d"))))
    other = rows.select(*by, F.col("_i").alias("_at"), F.col(value).alias("_v"))
    weight = F.when(F.col("_half") == 0, 1.0).otherwise(F.exp(-4.5 * F.col("_d") * F.col("_d") / F.greatest(F.col("_half") * F.col("_half"), F.lit(1))))
    found = near.join(other, [*by, "_at"]).groupBy(*by, "_i").agg(F.min("_v").alias("low"), (F.sum(F.col("_v") * weight) / F.sum(weight)).alias("smooth"))
    return rows.join(found, [*by, "_i"]).drop("_i", "_n", "_half")


#: A profile's identifier: what stands before and behind a focal length.
_FOCAL = r"^(.*-)(\d+(?:\.\d+)?)\s*mm(-\d+x\d+@\d+)$"


def near_focal(wanted: DataFrame, profiles: DataFrame, most: float = 1.0) -> DataFrame:
    """``wanted`` (prefix, suffix, focal) with the ``match`` whose identifier has the same prefix and suffix
    and the nearest focal length, at most ``most`` mm away; of equally near ones the first ``id``."""
    key = F.lower("identifier")
    parsed = profiles.select("id", F.regexp_extract(key, _FOCAL, 1).alias("prefix"), F.regexp_extract(key, _FOCAL, 2).try_cast("double").alias("_f"), F.regexp_extract(key, _FOCAL, 3).alias("suffix")).where("_f is not null")
    near = wanted.where("focal > 0").join(parsed, ["prefix", "suffix"]).withColumn("_d", F.abs(F.col("_f") - F.col("focal"))).where(F.col("_d") <= most)
    return near.groupBy(*wanted.columns).agg(F.min_by("id", F.struct("_d", "id")).alias("match"))


def resolved(profiles: DataFrame, overrides: str, columns: list[str]) -> DataFrame:
    """(id, key, columns): one row for each of a profile's interpolation points, an array of
    struct(key, identifier, columns): a column given there, else the named profile's, else the profile's own."""
    points = profiles.select("id", *columns, F.explode(overrides).alias("_o"))
    named = profiles.select(F.col("id").alias("_ref"), *(F.col(c).alias(f"_r_{c}") for c in columns))
    found = points.join(named, F.col("_o.identifier") == F.col("_ref"), "left")
    own = [F.coalesce(F.col(f"_o.{c}"), F.when(F.col("_ref").isNotNull(), F.col(f"_r_{c}")).otherwise(F.col(c))).alias(c) for c in columns]
    return found.select("id", F.round(F.col("_o.key") * 1_000_000).cast("long").alias("key"), *own)


def find_profile(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """``wanted`` (name) with ``found``: the id that is the name, else the first profile (by
    position) whose path contains it. Names that are ids leave before paths are searched."""
    exact = wanted.join(profiles.select(F.col("id").alias("name"), F.lit(True).alias("_hit")), "name", "left")
    done = exact.where("_hit").select("name", F.col("name").alias("found"))
    left = exact.where("_hit is null").select("name").distinct()
    needle = F.translate("name", "\\", "/")
    hits = profiles.join(F.broadcast(left) if left.limit(10_001).count() <= 10_000 else left, F.instr(F.translate("path", "\\", "/"), needle) > 0)
    return done.unionByName(left.join(hits.groupBy("name").agg(F.min_by("id", "position").alias("found")), "name", "left"))
