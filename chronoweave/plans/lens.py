"""Queries on geometry, lens models, catalogues, text helpers, codecs and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import codecs, distortion, scalars
from chronoweave.functions.quaternion import Quat, from_euler, from_rotvec
from chronoweave.operators import catalog, zoom
from chronoweave.plans.base import EVENTS, USER, events, query, r, table
from chronoweave.runtime import ensure_shipped
from chronoweave.sources import export, gcsv


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of normalised length 0 to about 0.6 made of embeddings."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("embedding")[0].cast("double") * 0.5).alias("x"), (F.col("embedding")[1].cast("double") * 0.5).alias("y"))


_POINTS = "p AS (SELECT vec_id, embedding[1]::DOUBLE * 0.5 AS x, embedding[2]::DOUBLE * 0.5 AS y FROM embeddings), a AS (SELECT *, x * x + y * y AS r2, sqrt(x * x + y * y) AS r, atan(sqrt(x * x + y * y)) AS th FROM p)"

_FISHEYE = (0.05, -0.012, 0.004, -0.001)
_SONY = (0.98, 0.02, -0.03, 0.01, -0.002, 0.0005)
MODELS = {
    "fisheye": distortion.fisheye(_FISHEYE),
    "poly3": distortion.poly3(0.08),
    "poly5": distortion.poly5(0.07, -0.02),
    "ptlens": distortion.ptlens(0.01, -0.03, 0.02),
    "sony": distortion.sony(_SONY, (1.1, 0.9)),
    "brown": distortion.BrownConrady((0.1, -0.02, 0.003, 0.01, 0.002, 0.001), (0.001, -0.002), (0.0005, 0.0001, -0.0004, 0.0002)),
    "unified": distortion.UnifiedCamera((0.02, -0.01, 0.002), (0.001, -0.0005), 0.3),
    "stretch": distortion.Stretch(1.25, 0.8),
}


def _radial_sql(name: str, value: str, sx: str = "1", sy: str = "1") -> str:
    return f"SELECT vec_id, '{name}' AS model, x * CASE WHEN r = 0 THEN 1 ELSE ({value}) / r END * {sx} AS dx, y * CASE WHEN r = 0 THEN 1 ELSE ({value}) / r END * {sy} AS dy FROM a"


_FORWARD = " UNION ALL ".join(
    (
        _radial_sql("fisheye", "th * (1 + 0.05 * th ** 2 - 0.012 * th ** 4 + 0.004 * th ** 6 - 0.001 * th ** 8)"),
        _radial_sql("poly3", "r * (1 + 0.08 * r2)"),
        _radial_sql("poly5", "r * (1 + 0.07 * r2 - 0.02 * r2 * r2)"),
        _radial_sql("ptlens", "r * (0.01 * r ** 3 - 0.03 * r2 + 0.02 * r + 1)"),
        _radial_sql("sony", "0.98 * th + 0.02 * th ** 2 - 0.03 * th ** 3 + 0.01 * th ** 4 - 0.002 * th ** 5 + 0.0005 * th ** 6", "1.1", "0.9"),
        """SELECT vec_id, 'brown', x * (1 + 0.1 * r2 - 0.02 * r2 ** 2 + 0.003 * r2 ** 3) / (1 + 0.01 * r2 + 0.002 * r2 ** 2 + 0.001 * r2 ** 3) + 2 * 0.001 * x * y - 0.002 * (r2 + 2 * x * x) + 0.0005 * r2 + 0.0001 * r2 * r2,
  y * (1 + 0.1 * r2 - 0.02 * r2 ** 2 + 0.003 * r2 ** 3) / (1 + 0.01 * r2 + 0.002 * r2 ** 2 + 0.001 * r2 ** 3) + 0.001 * (r2 + 2 * y * y) - 2 * 0.002 * x * y - 0.0004 * r2 + 0.0002 * r2 * r2 FROM a""",
        """SELECT vec_id, 'unified', u * k + 2 * 0.001 * u * v - 0.0005 * (q + 2 * u * u), v * k - 2 * 0.0005 * u * v + 0.001 * (q + 2 * v * v) FROM
  (SELECT *, 1 + 0.02 * q - 0.01 * q ** 2 + 0.002 * q ** 3 AS k FROM (SELECT *, u * u + v * v AS q FROM (SELECT vec_id, x / sqrt(r2 + 1) / (1 / sqrt(r2 + 1) + 0.3) AS u, y / sqrt(r2 + 1) / (1 / sqrt(r2 + 1) + 0.3) AS v FROM a)))""",
        "SELECT vec_id, 'stretch', x * 1.25, y * 0.8 FROM a",
    )
)


def _each_model(points: DataFrame, f) -> DataFrame:
    """A row for each point and model; models are one array, so points are read once."""
    rows = []
    for name, model in MODELS.items():
        x, y = f(model)
        rows.append(F.struct(F.lit(name).alias("model"), x.cast("double").alias("dx"), y.cast("double").alias("dy")))
    return points.select("vec_id", "x", "y", F.explode(F.array(*rows)).alias("m")).select("vec_id", "x", "y", "m.*")


@query(f"WITH {_POINTS} SELECT vec_id, model, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy FROM ({_FORWARD})")
def distortion_forward(spark: SparkSession, sf: str) -> DataFrame:
    found = _each_model(_points(spark, sf), lambda m: m.distort(F.col("x"), F.col("y")))
    return found.select("vec_id", "model", r("dx").alias("dx"), r("dy").alias("dy"))


@query(f"WITH {_POINTS} SELECT vec_id, model, true AS near FROM p CROSS JOIN (SELECT unnest(['fisheye', 'poly3', 'poly5', 'ptlens', 'sony', 'brown', 'unified', 'stretch']) AS model)")
def distortion_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """Undistorting what was distorted gives the point back."""
    once = _each_model(_points(spark, sf), lambda m: m.distort(F.col("x"), F.col("y")))
    back = F.lit(None).cast("struct<x:double,y:double>")
    for name, model in MODELS.items():
        x, y = model.undistort(F.col("dx"), F.col("dy"))
        back = F.when(F.col("model") == name, F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))).otherwise(back)
    far = F.greatest(F.abs(F.col("b.x") - F.col("x")), F.abs(F.col("b.y") - F.col("y")))
    return once.withColumn("b", back).select("vec_id", "model", (far < 1e-4).alias("near"))


@query(f"""WITH {_POINTS}, t AS (SELECT vec_id, r AS target, 0.0::DOUBLE AS th FROM a), s0 AS (SELECT * FROM t)
{''.join(f", s{i + 1} AS (SELECT vec_id, target, CASE WHEN abs(m) < 0 THEN th ELSE th - m END AS th FROM (SELECT *, greatest(least((th * (1 + 0.05 * th ** 2 - 0.012 * th ** 4 + 0.004 * th ** 6 - 0.001 * th ** 8) - target) / (1 + 0.15 * th ** 2 - 0.06 * th ** 4 + 0.028 * th ** 6 - 0.009 * th ** 8), 0.9), -0.9) AS m FROM s{i}))" for i in range(10))}
SELECT a.vec_id, round(a.x * tan(s10.th) / r, 5) + 0.0 AS ux, round(a.y * tan(s10.th) / r, 5) + 0.0 AS uy FROM s10 JOIN a USING (vec_id) WHERE r > 1e-6""")
def fisheye_undistort_newton(spark: SparkSession, sf: str) -> DataFrame:
    x, y = MODELS["fisheye"].undistort(F.col("x"), F.col("y"))
    return _points(spark, sf).select("vec_id", r(x, 5).alias("ux"), r(y, 5).alias("uy"))


VIEWS = {"superview": distortion.DigitalLens(distortion.superview, 1920.0, 1080.0, 4 / 3), "superview6": distortion.DigitalLens(distortion.superview6, 1920.0, 1080.0), "hyperview": distortion.DigitalLens(distortion.hyperview, 1920.0, 1080.0, 14 / 9)}
_PIXELS = "px AS (SELECT p_partkey AS id, (p_partkey * 37) % 1920 / 1920.0::DOUBLE - 0.5 AS u, (p_partkey * 91) % 1080 / 1080.0::DOUBLE - 0.5 AS v FROM part)"


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), ((k * 37) % 1920).cast("double").alias("x"), ((k * 91) % 1080).cast("double").alias("y"))


@query(f"""WITH {_PIXELS}, v AS (
SELECT id, 'superview' AS lens, u * (1.2100393 + u ** 2 * (-1.2758402 + u ** 2 * 1.7751845)) / (4 / 3.0::DOUBLE) AS a, v * (0.9364505 + (0.4465308 - 0.7683315 * v ** 2) * v ** 2 + (-0.3574087 + 1.1584653 * v ** 2 + 0.3529348 * u ** 2) * u ** 2) AS b FROM px
UNION ALL SELECT id, 'superview6', u * (1 - 0.48 * abs(u)) * 0.943396 * (1 + 0.157895 * abs(u * (1 - 0.48 * abs(u)))), v * 0.943396 * (1 + 0.06 * abs(v * 2)) FROM px
UNION ALL SELECT id, 'hyperview', u * (1.5805143 + u ** 2 * (-8.1668825 + u ** 2 * (74.5198746 + u ** 2 * (-451.5002441 + u ** 2 * (1551.2922363 + u ** 2 * (-2735.5422363 + u ** 2 * 1923.1572266))))) + v ** 2 * -0.1086027) / (14 / 9.0::DOUBLE), v * (1.0238225 + v ** 2 * -0.1025671 + u ** 2 * (-0.263993 + u ** 2 * 0.2979266)) FROM px)
SELECT id, lens, round((a + 0.5) * 1920, 3) + 0.0 AS ux, round((b + 0.5) * 1080, 3) + 0.0 AS uy FROM v""")
def digital_lens_views(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for name, lens in VIEWS.items():
        x, y = lens.undistort(F.col("x"), F.col("y"))
        rows.append(F.struct(F.lit(name).alias("lens"), r(x, 3).alias("ux"), r(y, 3).alias("uy")))
    return _pixels(spark, sf).select("id", F.explode(F.array(*rows)).alias("m")).select("id", "m.*")


@query()
def digital_lens_inverse(spark: SparkSession, sf: str) -> DataFrame:
    x, y = VIEWS["superview6"].distort(F.col("x"), F.col("y"))
    u, v = VIEWS["superview6"].undistort(F.col("fx"), F.col("fy"))
    return _pixels(spark, sf).withColumns({"fx": x, "fy": y}).select("id", r("fx", 3).alias("fx"), r("fy", 3).alias("fy"), r(F.greatest(F.abs(u - F.col("x")), F.abs(v - F.col("y"))), 2).alias("error"))


def _quats(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)))
    return e


_E = "e AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(8)) + " FROM embeddings), n AS (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3) AS la, sqrt(e4 * e4 + e5 * e5 + e6 * e6 + e7 * e7) AS lb FROM e), q AS (SELECT vec_id, e0 / la AS aw, e1 / la AS ax, e2 / la AS ay, e3 / la AS az, e4 / lb AS bw, e5 / lb AS bx, e6 / lb AS \"by\", e7 / lb AS bz FROM n WHERE la > 0 AND lb > 0)"


def _a() -> Quat:
    return Quat(*(F.col(f"e{i}") for i in range(4))).normal()


def _b() -> Quat:
    return Quat(*(F.col(f"e{i}") for i in range(4, 8))).normal()


@query(f"""WITH {_E}, m AS (SELECT vec_id, aw * bw - ax * bx - ay * "by" - az * bz AS w, aw * bx + ax * bw + ay * bz - az * "by" AS x, aw * "by" - ax * bz + ay * bw + az * bx AS y, aw * bz + ax * "by" - ay * bx + az * bw AS z FROM q)
SELECT vec_id, round(CASE WHEN w < 0 THEN -w ELSE w END, 6) + 0.0 AS w, round(CASE WHEN w < 0 THEN -x ELSE x END, 6) + 0.0 AS x, round(CASE WHEN w < 0 THEN -y ELSE y END, 6) + 0.0 AS y, round(CASE WHEN w < 0 THEN -z ELSE z END, 6) + 0.0 AS z FROM m""")
def quat_mul_norm(spark: SparkSession, sf: str) -> DataFrame:
    q = (_a() * _b()).canonical()
    return _quats(spark, sf).select("vec_id", *(r(c).alias(n) for n, c in zip("wxyz", q.parts, strict=True)))


@query(f"WITH {_E} SELECT vec_id, round(2 * acos(least(abs(aw * bw + ax * bx + ay * \"by\" + az * bz), 1.0)), 5) AS angle FROM q")
def quat_angle(spark: SparkSession, sf: str) -> DataFrame:
    return _quats(spark, sf).select("vec_id", r((_a().inverse() * _b()).angle(), 5).alias("angle"))


@query(f"""WITH {_E}, d AS (SELECT *, aw * bw + ax * bx + ay * "by" + az * bz AS dot FROM q), f AS (SELECT *, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sg, least(abs(dot), 1.0) AS dd FROM d),
c AS (SELECT *, CASE WHEN dd > 0.9995 THEN 0.7 ELSE sin(0.7 * acos(dd)) / sin(acos(dd)) END AS ka, sg * CASE WHEN dd > 0.9995 THEN 0.3 ELSE sin(0.3 * acos(dd)) / sin(acos(dd)) END AS kb FROM f),
m AS (SELECT vec_id, ka * aw + kb * bw AS w, ka * ax + kb * bx AS x, ka * ay + kb * "by" AS y, ka * az + kb * bz AS z FROM c)
SELECT vec_id, round(w / sqrt(w * w + x * x + y * y + z * z), 5) + 0.0 AS w, round(x / sqrt(w * w + x * x + y * y + z * z), 5) + 0.0 AS x, round(y / sqrt(w * w + x * x + y * y + z * z), 5) + 0.0 AS y, round(z / sqrt(w * w + x * x + y * y + z * z), 5) + 0.0 AS z FROM m""")
def quat_slerp(spark: SparkSession, sf: str) -> DataFrame:
    q = _a().slerp(_b(), F.lit(0.3))
    return _quats(spark, sf).select("vec_id", *(r(c, 5).alias(n) for n, c in zip("wxyz", q.parts, strict=True)))


@query(f"""WITH {_E} SELECT vec_id, round(atan2(2 * (aw * ax + ay * az), 1 - 2 * (ax * ax + ay * ay)), 5) + 0.0 AS roll, round(asin(greatest(least(2 * (aw * ay - az * ax), 1.0), -1.0)), 5) + 0.0 AS pitch,
round(atan2(2 * (aw * az + ax * ay), 1 - 2 * (ay * ay + az * az)), 5) + 0.0 AS yaw, true AS back FROM q""")
def quat_euler(spark: SparkSession, sf: str) -> DataFrame:
    roll, pitch, yaw = _a().euler()
    again = from_euler(roll, pitch, yaw)
    return _quats(spark, sf).select("vec_id", r(roll, 5).alias("roll"), r(pitch, 5).alias("pitch"), r(yaw, 5).alias("yaw"), (F.abs(F.abs(again.dot(_a())) - 1) < 1e-9).alias("back"))


@query(f"""WITH {_E}, v AS (SELECT vec_id, e4 AS vx, e5 AS vy, e6 AS vz FROM e),
t AS (SELECT q.vec_id, aw, ax, ay, az, vx, vy, vz, 2 * (ay * vz - az * vy) AS tx, 2 * (az * vx - ax * vz) AS ty, 2 * (ax * vy - ay * vx) AS tz FROM q JOIN v USING (vec_id))
SELECT vec_id, round(vx + aw * tx + ay * tz - az * ty, 5) + 0.0 AS x, round(vy + aw * ty + az * tx - ax * tz, 5) + 0.0 AS y, round(vz + aw * tz + ax * ty - ay * tx, 5) + 0.0 AS z FROM t""")
def quat_rotate(spark: SparkSession, sf: str) -> DataFrame:
    v = _a().rotate((F.col("e4"), F.col("e5"), F.col("e6")))
    return _quats(spark, sf).select("vec_id", *(r(c, 5).alias(n) for n, c in zip("xyz", v, strict=True)))


@query(f"WITH {_E}, l AS (SELECT vec_id, e0, e1, e2, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS t FROM e) SELECT vec_id, round(cos(t / 2), 6) + 0.0 AS w, round(e0 * sin(t / 2) / t, 6) + 0.0 AS x, round(e1 * sin(t / 2) / t, 6) + 0.0 AS y, round(e2 * sin(t / 2) / t, 6) + 0.0 AS z FROM l")
def quat_from_rotvec(spark: SparkSession, sf: str) -> DataFrame:
    q = from_rotvec(F.col("e0"), F.col("e1"), F.col("e2"))
    return _quats(spark, sf).select("vec_id", *(r(c).alias(n) for n, c in zip("wxyz", q.parts, strict=True)))


@query(f"WITH {_E} SELECT vec_id, round(-(e1 + 0.1), 6) + 0.0 AS x, round(e0 + 0.1, 6) + 0.0 AS y, round(-(e2 + 0.1), 6) + 0.0 AS z FROM e")
def imu_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Bias added, then axes remapped."""
    v = scalars.axis_remap(tuple(F.col(f"e{i}") + 0.1 for i in range(3)), "yXz")
    return _quats(spark, sf).select("vec_id", *(r(c).alias(n) for n, c in zip("xyz", v, strict=True)))


#: How people write cameras, and how profiles do.
ALIASES = (("brass", "alloy"), ("steel", "iron"), ("tin", "alloy metal"))


@query("SELECT p_partkey, translate(replace(replace(replace(lower(p_type || ',' || p_brand), 'brass', 'alloy'), 'steel', 'iron'), 'tin', 'alloy metal'), ',;', '  ') AS expanded FROM part")
def alias_expand(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", scalars.expand(F.concat_ws(",", "p_type", "p_brand"), ALIASES).alias("expanded"))


@query("""SELECT p_partkey, lower(trim(replace(replace(replace(p_brand || '-' || p_name || '--' || p_type || '-' || (p_size * 100)::VARCHAR || 'x' || (p_size * 50)::VARCHAR || '@' || '30' || '-', ' ', ''), '--', '-'), '--', '-'), '- ')) AS identifier FROM part""")
def identifier_normalise(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    made = scalars.identifier(F.col("p_brand"), F.col("p_name"), F.lit(""), F.col("p_type"), size * 100, size * 50, F.lit(30), F.lit(""))
    return table(spark, sf, "part").select("p_partkey", made.alias("identifier"))


@query()
def checksum_crc32(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", scalars.checksum(F.format_string("%.8f", "p_retailprice")).alias("checksum"))


@query("""SELECT p_partkey, CASE WHEN p_size * 200 >= 8000 THEN '8k' WHEN p_size * 200 >= 6000 THEN '6k' WHEN p_size * 200 >= 5000 THEN '5k' WHEN p_size * 200 > 4000 THEN 'C4k' WHEN p_size * 200 >= 3840 THEN '4k'
 WHEN p_size * 200 >= 2700 THEN '2.7k' WHEN p_size * 200 >= 2500 THEN '2.5k' WHEN p_size * 200 >= 2000 THEN '2k' WHEN p_size * 200 >= 1920 THEN '1080p' WHEN p_size * 200 >= 1280 THEN '720p' WHEN p_size * 200 >= 640 THEN '480p' ELSE '' END AS label FROM part""")
def size_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", scalars.size_label(F.col("p_size") * 200, F.lit(1080)).alias("label"))


@query("""WITH p AS (SELECT p_partkey, p_size * 16 AS w, 144 AS h, p_size / 9.0 AS ratio FROM part WHERE p_size > 0), n AS (SELECT * FROM (VALUES (0, 1, 1), (1, 3, 2), (2, 2, 3), (3, 4, 3), (4, 3, 4), (5, 8, 7), (6, 7, 8), (7, 16, 9), (8, 9, 16)) t(k, a, b)),
b AS (SELECT p_partkey, arg_min(a || ':' || b, (abs(ratio - a / b::DOUBLE), k)) AS label, min(abs(ratio - a / b::DOUBLE)) AS d FROM p CROSS JOIN n GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN d < 0.05 THEN label WHEN w // gcd(w, h) >= 20 OR h // gcd(w, h) >= 20 THEN printf('%.1f', ratio::DOUBLE) || ':1' ELSE (w // gcd(w, h)) || ':' || (h // gcd(w, h)) END AS label FROM p JOIN b USING (p_partkey)""")
def aspect_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", scalars.aspect_label(F.col("p_size") * 16, F.lit(144)).alias("label"))




@query("""SELECT p_partkey, lower(p_name) AS name FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a')) AND (contains(lower(p_name), 'e') OR contains(lower(p_type), 'e'))
ORDER BY p_size <> 15, round(p_retailprice * 1000 / 16)::BIGINT % 2, lower(p_name), p_partkey LIMIT 200""")
def lens_search_rank(spark: SparkSession, sf: str) -> DataFrame:
    """All words in the name or the type; favourites first, then by name; at most 200."""
    words = F.array(F.lit("a"), F.lit("e"))
    hits = table(spark, sf, "part").where(catalog.matches(words, [F.col("p_name"), F.col("p_type")]))
    even = F.round(F.col("p_retailprice") * 1000 / 16).cast("long") % 2
    return hits.orderBy(F.col("p_size") != 15, even, F.lower("p_name"), "p_partkey").limit(200).select("p_partkey", F.lower("p_name").alias("name"))


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 24), NOT contains(p_type, 'STEEL'), p_retailprice, p_name, p_partkey) = 1")
def lens_rank_min(spark: SparkSession, sf: str) -> DataFrame:
    keys = [F.abs(F.col("p_size") - 24), ~F.col("p_type").contains("STEEL"), F.col("p_retailprice"), F.col("p_name"), F.col("p_partkey")]
    return catalog.best(table(spark, sf, "part"), ["p_brand"], keys, ["p_partkey"])


@query("""WITH b AS (SELECT p_brand, p_size, p_retailprice, p_partkey FROM part), u AS (SELECT p_brand, p_size, p_retailprice, p_partkey, 0 AS variant FROM b
 UNION ALL SELECT p_brand, p_size + 1, p_retailprice, p_partkey, 1 FROM b UNION ALL SELECT p_brand, p_size, 1.5 * p_retailprice, p_partkey, 2 FROM b)
SELECT p_brand, p_size, p_partkey, CAST(variant AS INTEGER) AS variant, round(p_retailprice, 4) AS p_retailprice FROM u QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY variant, p_partkey) = 1""")
def unnest_settings_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    null = F.lit(None)
    settings = F.array(F.struct((F.col("p_size") + 1).alias("p_size"), null.cast("double").alias("p_retailprice")), F.struct(null.cast("int").alias("p_size"), (F.col("p_retailprice") * 1.5).alias("p_retailprice")))
    rows = catalog.unnest(table(spark, sf, "part").select("p_brand", "p_size", "p_retailprice", "p_partkey", settings.alias("settings")), "settings", ["p_size", "p_retailprice"])
    return catalog.first_wins(rows, ["p_brand", "p_size"], ["variant", "p_partkey"]).select("p_brand", "p_size", "p_partkey", "variant", r("p_retailprice", 4).alias("p_retailprice"))


@query("""WITH x AS (SELECT p_partkey, p_size::DOUBLE AS f, p_retailprice AS v FROM part WHERE p_partkey % 5 = 0), g AS (SELECT f, avg(v) AS v FROM x GROUP BY f), p AS (SELECT p_partkey, p_size + 0.5 AS f FROM part),
l AS (SELECT p.*, g.f AS lf, g.v AS lv FROM p ASOF LEFT JOIN g ON p.f >= g.f), h AS (SELECT l.*, g.f AS hf, g.v AS hv FROM l ASOF LEFT JOIN g ON l.f <= g.f)
SELECT p_partkey, round(coalesce(lv + (hv - lv) * (f - lf) / (hf - lf), lv, hv), 4) AS price FROM h""")
def profile_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles at focal keys, interpolated for a camera between them; a small table of keys as one array."""
    part = table(spark, sf, "part")
    keys = part.where("p_partkey % 5 = 0").groupBy(F.col("p_size").cast("double").alias("f")).agg(F.avg("p_retailprice").alias("v"))
    curve = keys.agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("c"))
    at = F.col("p_size") + 0.5
    lo = F.element_at(F.filter("c", lambda k: k["f"] <= at), -1)
    hi = F.get(F.filter("c", lambda k: k["f"] >= at), F.lit(0))
    rows = part.withColumn("_one", F.lit(1)).join(F.broadcast(curve.withColumn("_one", F.lit(1))), "_one")  # one row: p_size has 50 values at most
    low = F.when(F.size(F.filter("c", lambda k: k["f"] <= at)) > 0, lo)
    found = rows.withColumn("lo", low).withColumn("hi", hi)
    value = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * (at - F.col("lo.f")) / (F.col("hi.f") - F.col("lo.f"))
    return found.select("p_partkey", r(F.coalesce(value, F.col("lo.v"), F.col("hi.v")), 4).alias("price"))


@query("SELECT event_id, CAST(props::JSON ->> '$.k' AS BIGINT) AS k FROM events")
def json_props_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, '{\"k\":' || (props::JSON ->> '$.k') || ',\"list\":[1,2,' || (event_id % 7) || '],\"type\":\"' || event_type || '\"}' AS merged FROM events")
def json_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Objects merge, lists follow one another."""
    ensure_shipped(spark)
    e = table(spark, sf, "events")
    left = F.concat(F.lit('{"list":[1,2],"type":"none","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    right = F.to_json(F.struct(F.array(F.col("event_id") % 7).alias("list"), F.col("event_type").alias("type")))
    return e.select("event_id", codecs.merge_json(left, right).alias("merged"))


@query("SELECT doc_id, md5(text) AS digest, true AS same FROM documents")
def base91_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts through the compressed text envelope and back."""
    ensure_shipped(spark)
    d = table(spark, sf, "documents").select("doc_id", "text", codecs.unzip91(codecs.zip91(F.col("text").cast("binary"))).alias("back"))
    return d.select("doc_id", F.md5("back").alias("digest"), (F.col("back") == F.col("text").cast("binary")).alias("same"))


@query(f"WITH {EVENTS} SELECT event_id, round(value * 0.5, 6) AS gx, round(-value * 0.5, 6) + 0.0 AS gy, round((event_id % 10) * 0.5, 6) AS gz, round(event_id * 1.0, 3) AS t_ms FROM s")
def gcsv_parse(spark: SparkSession, sf: str) -> DataFrame:
    """One log file for each user, written as text and parsed."""
    e = events(spark, sf)
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string"), (-F.col("value")).cast("string"), (F.col("event_id") % 10).cast("string"))
    body = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    head = "CAMERA IMU LOG\nversion,1.1\ntscale,0.001\ngscale,0.5\nt,gx,gy,gz\n"
    _, samples = gcsv.parse(body.select(F.col("user_id").cast("string").alias("path"), F.concat(F.lit(head), F.col("body")).alias("text")))
    return samples.select(F.round("t_ms").cast("long").alias("event_id"), r("gx").alias("gx"), r("gy").alias("gy"), r("gz").alias("gz"), r("t_ms", 3).alias("t_ms"))


@query(f"WITH {EVENTS} SELECT t, t::VARCHAR || ',' || printf('%.10f', value) || ',' || printf('%.10f', value / 4) AS line FROM s")
def export_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("t", "value", (F.col("value") / 4).alias("quarter"))
    return export.csv_lines(e, "t", ("value", "quarter"))


@query(f"""WITH {_E} SELECT vec_id, round(CASE WHEN w < 0 THEN -w ELSE w END, 5) + 0.0 AS w FROM (
SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE bw * aw + bx * ax + "by" * ay + bz * az END AS w FROM q)""")
def export_stabilised(spark: SparkSession, sf: str) -> DataFrame:
    """Original, joined with corrections that some rows lack."""
    rows = _quats(spark, sf)
    org = rows.select("vec_id", *(c.alias(f"a{n}") for n, c in zip("wxyz", _a().parts, strict=True)))
    corr = rows.where("vec_id % 3 <> 0").select("vec_id", *(c.alias(f"b{n}") for n, c in zip("wxyz", _b().parts, strict=True)))
    q = export.stabilised(org, ("aw", "ax", "ay", "az"), ("bw", "bx", "by", "bz")).canonical()
    return org.join(corr, "vec_id", "left").select("vec_id", r(q.w, 5).alias("w"))


@query("""WITH g AS (SELECT x, y, (x - 32) / 40.0::DOUBLE AS u, (y - 18) / 40.0::DOUBLE AS v FROM (SELECT unnest(range(0, 64)) AS x) CROSS JOIN (SELECT unnest(range(0, 36)) AS y))
SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(u * (1 + 0.0837191 * (u * u + v * v)) * 40 + 32, 4) AS sx, round(v * (1 + 0.0837191 * (u * u + v * v)) * 40 + 18, 4) AS sy FROM g""")
def st_map(spark: SparkSession, sf: str) -> DataFrame:
    """Where each output pixel comes from."""
    def place(x: Column, y: Column) -> tuple[Column, Column]:
        u, v = distortion.poly3(0.0837191).distort((x - 32) / 40.0, (y - 18) / 40.0)
        return u * 40 + 32, v * 40 + 18

    return export.coordinate_map(table(spark, sf, "region"), 64, 36, place).select("x", "y", r("sx", 4).alias("sx"), r("sy", 4).alias("sy"))


@query(f"""WITH {EVENTS}, f AS (SELECT event_id, value / 1000 AS a FROM s), k AS (SELECT unnest(range(0, 40)) AS k),
b AS (SELECT event_id, a, CASE k // 10 WHEN 0 THEN k % 10 / 10.0 * 96 WHEN 1 THEN 96 WHEN 2 THEN (1 - k % 10 / 10.0) * 96 ELSE 0 END + 2 AS x, CASE k // 10 WHEN 0 THEN 0 WHEN 1 THEN k % 10 / 10.0 * 52 WHEN 2 THEN 52 ELSE (1 - k % 10 / 10.0) * 52 END + 2 AS y FROM f CROSS JOIN k),
t AS (SELECT event_id, (x - 50) * cos(a) - (y - 28) * sin(a) AS dx, (x - 50) * sin(a) + (y - 28) * cos(a) AS dy FROM b)
SELECT event_id, round(min(greatest(abs(dx), abs(dy) / (56 / 100.0::DOUBLE))) * 2 / 100, 5) AS fov FROM t GROUP BY event_id""")
def border_fov(spark: SparkSession, sf: str) -> DataFrame:
    """Field of view that a turned frame's border leaves."""
    e = events(spark, sf).select("event_id", (F.col("value") / 1000).alias("a"))
    b = zoom.border(e, 100.0, 56.0, 2.0, 11)
    x, y, c, s = F.col("bx") - 50, F.col("by") - 28, F.cos("a"), F.sin("a")
    found = zoom.fov_of_border(b, ["event_id"], x * c - y * s + 50, x * s + y * c + 28, 100.0, 56.0)
    return found.select("event_id", r("fov", 5).alias("fov"))


@query("""SELECT p_partkey, round(y * 219 / 255 + 16, 4) AS y, round((b - y) / (2 * (1 - 0.0722)) * 224 / 255 + 128, 4) AS u, round((r - y) / (2 * (1 - 0.2126)) * 224 / 255 + 128, 4) AS v
FROM (SELECT *, r * 0.2126 + g * 0.7152 + b * 0.0722 AS y FROM (SELECT p_partkey, (p_partkey * 7) % 256 AS r, (p_partkey * 13) % 256 AS g, (p_partkey * 29) % 256 AS b FROM part))""")
def rgb_to_yuv(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    y, u, v = scalars.rgb_to_yuv((k * 7) % 256, (k * 13) % 256, (k * 29) % 256)
    return table(spark, sf, "part").select("p_partkey", r(y, 4).alias("y"), r(u, 4).alias("u"), r(v, 4).alias("v"))


@query("SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size * 1500.0 ELSE p_size * 1000 / 25.0 END, 4) AS ms FROM part")
def duration_parse(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(size.cast("string"), F.lit("ms"))).when(F.col("p_partkey") % 3 == 1, F.concat((size * 1.5).cast("string"), F.lit("s"))).otherwise(size.cast("string"))
    return table(spark, sf, "part").select("p_partkey", r(scalars.duration_ms(text, 25.0), 4).alias("ms"))


@query("SELECT event_id, CAST(round_even(epoch_us(ts) % 100000000 / 1000.0 * 29.97 / 1000, 0) AS BIGINT) AS frame FROM events")
def frame_at_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", scalars.frame_at((F.col("t") % 100000000) / 1000.0, 29.97).alias("frame"))


@query("SELECT p_brand, arg_min(p_partkey, (abs(p_size - 20), p_partkey)) AS p_partkey FROM part WHERE starts_with(p_brand, 'B') GROUP BY p_brand")
def identifier_near_miss(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "part").where(F.col("p_brand").startswith("B"))
    return hits.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(F.abs(F.col("p_size") - 20), "p_partkey")).alias("p_partkey"))


@query("WITH h AS (SELECT *, row_number() OVER (PARTITION BY width ORDER BY p_partkey) AS k FROM (SELECT p_partkey, least(p_size // 5, 9) AS width FROM part)) SELECT p_partkey, width FROM h WHERE k = 1")
def stratified_pick(spark: SparkSession, sf: str) -> DataFrame:
    """One row of each bin."""
    binned = table(spark, sf, "part").select("p_partkey", F.least(F.floor(F.col("p_size") / 5), F.lit(9)).cast("int").alias("width"))
    return binned.groupBy("width").agg(F.min("p_partkey").alias("p_partkey"))


@query(f"""WITH {EVENTS}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s)
SELECT event_id, user_id FROM x WHERE n <= 10 OR i IN (SELECT 0) OR (n > 10 AND CAST(round_even(CAST(round_even(i * 9 / (n - 1)::DOUBLE, 0) AS BIGINT) * (n - 1) / 9.0::DOUBLE, 0) AS BIGINT) = i)""")
def even_subsample(spark: SparkSession, sf: str) -> DataFrame:
    """Ten rows of each series, evenly spaced."""
    w = USER.window()
    rows = events(spark, sf).select("event_id", "user_id", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    near = scalars.half_even(F.col("i") * 9 / (F.col("n") - 1))
    return rows.where((F.col("n") <= 10) | (F.col("i") == 0) | (scalars.half_even(near * (F.col("n") - 1) / 9.0) == F.col("i"))).select("event_id", "user_id")


#: All 48 ways to name three axes with signs.
ORIENTATIONS = tuple("".join(c if s >> i & 1 else c.upper() for i, c in enumerate(p)) for p in ("xyz", "xzy", "yxz", "yzx", "zxy", "zyx") for s in range(8))


@query()
def orientation_guess(spark: SparkSession, sf: str) -> DataFrame:
    """For each vector, the axis naming that brings its first three parts nearest the next three."""
    rows = _quats(spark, sf)
    a, b = tuple(F.col(f"e{i}") for i in range(3)), tuple(F.col(f"e{i}") for i in range(3, 6))
    costs = [F.struct(F.round(sum(((x - y) * (x - y) for x, y in zip(scalars.axis_remap(a, o), b, strict=True)), F.lit(0.0)), 9).alias("cost"), F.lit(o).alias("orientation")) for o in ORIENTATIONS]
    return rows.select("vec_id", F.array_min(F.array(*costs)).alias("best")).select("vec_id", "best.orientation", r("best.cost", 5).alias("cost"))


