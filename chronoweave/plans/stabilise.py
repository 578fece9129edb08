"""Queries over locks, splines, conversions and the chain from samples to corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import asof, frames, horizon, keyframes, splines, stabilise
from chronoweave.operators.windows import Series
from chronoweave.plans.base import EVENTS, HOUR, USER, events, query, r
from chronoweave.plans.camera import _sql_product, _sql_turn
from chronoweave.plans.series import SLOWED

#: Events as a series of motion: an hour is five thousandths of a second.
_FAST = Series(("user_id",), "t", "seq")


def _about(spark: SparkSession, sf: str, axis: int, half) -> DataFrame:
    """An orientation for each event: a turn about an axis by twice ``half``."""
    parts = [F.cos(half), F.lit(0.0), F.lit(0.0), F.lit(0.0)]
    parts[1 + axis] = F.sin(half)
    return events(spark, sf).select("user_id", "t", F.col("event_id").alias("seq"), *(c.alias(p) for c, p in zip(parts, frames.PARTS, strict=True)))


def _shown(df: DataFrame, key: str = "seq") -> DataFrame:
    return df.select(F.col(key).alias("event_id"), *(r(c, 5).alias(f"q{i}") for i, c in enumerate(frames.quat().canonical().parts)))


def _sql_shown(parts: tuple[str, ...], rest: str) -> str:
    w, x, y, z = parts
    return f"""{rest}, a_ AS (SELECT event_id, {w} AS w, {x} AS x, {y} AS y, {z} AS z FROM b), d_ AS (SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END AS sg FROM a_)
SELECT event_id, round(w * sg, 5) + 0.0 AS q0, round(x * sg, 5) + 0.0 AS q1, round(y * sg, 5) + 0.0 AS q2, round(z * sg, 5) + 0.0 AS q3 FROM d_"""


def _sql_level(angle: str, roll: str) -> tuple[str, ...]:
    """The locked orientation of a turn about y by an angle: it looks along (sin, 0, cos)."""
    return _sql_product(_sql_turn(1, "pi() / 2"), _sql_turn(2, "pi() / 2"), _sql_turn(1, f"atan2(0.0, sin({angle}))"), _sql_turn(0, f"asin(greatest(-1.0, least(1.0, -cos({angle}))))"), _sql_turn(2, roll))


def _sql_slerp(a: tuple[str, ...], b: tuple[str, ...], share: str, rest: str) -> str:
    """From ``a`` to ``b``, of a table b with the column event_id."""
    names = ", ".join(f"{p} AS l{k}, {q} AS o{k}" for k, (p, q) in enumerate(zip(a, b, strict=True)))
    dot = " + ".join(f"l{k} * o{k}" for k in range(4))
    mixed = ", ".join(f"l{k} * wa + o{k} * wb AS x{k}" for k in range(4))
    shown = ", ".join(f"round(x{k} / len, 5) + 0.0 AS q{k}" for k in range(4))
    return f"""{rest}, e AS (SELECT event_id, {names} FROM b), f AS (SELECT *, {dot} AS dt FROM e), g AS (SELECT *, acos(least(abs(dt), 1.0)) AS far, CASE WHEN dt < 0 THEN -1 ELSE 1 END AS sg FROM f),
h AS (SELECT *, CASE WHEN abs(dt) > 0.9995 THEN 1 - {share} ELSE sin((1 - {share}) * far) / sin(far) END AS wa, sg * CASE WHEN abs(dt) > 0.9995 THEN {share} ELSE sin({share} * far) / sin(far) END AS wb FROM g),
m AS (SELECT event_id, {mixed} FROM h), n AS (SELECT *, sqrt(x0 * x0 + x1 * x1 + x2 * x2 + x3 * x3) * CASE WHEN x0 < 0 THEN -1 ELSE 1 END AS len FROM m) SELECT event_id, {shown} FROM n"""


_SEEN = f"WITH {EVENTS}, b AS (SELECT event_id, value AS v FROM s WHERE abs(sin(value / 60)) > 1e-3)"
_Y = ("cos(v / 120)", "0.0", "sin(v / 120)", "0.0")


@query(_sql_slerp(_sql_level("v / 60", "radians(15)"), _Y, "0.2::DOUBLE", _SEEN))
def horizon_lock(spark: SparkSession, sf: str) -> DataFrame:
    """Orientations taken by 80 percent towards the same view with a roll of 15 degrees."""
    rows = _about(spark, sf, 1, F.col("value") / 120)
    rows = rows.where(F.abs(2 * F.col("qw") * F.col("qy")) > 1e-3)
    return _shown(horizon.lock(rows, F.lit(80.0), F.lit(15.0)))


@query(_sql_shown(_sql_turn(2, "org + atan2(sin(v), cos(v)) + radians(10)"), f"WITH {EVENTS}, b AS (SELECT event_id, value AS v, value / CASE WHEN event_id % 4 = 0 THEN 100 ELSE 150 END AS org FROM s)"))
def horizon_by_gravity(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed orientations so turned that the originals' gravity stands upright; a quarter has no original."""
    rows = _about(spark, sf, 2, F.col("value") / 200).join(events(spark, sf).select(F.col("event_id").alias("seq"), "value"), "seq")
    there = F.col("seq") % 4 != 0
    half = F.col("value") / 300
    org = (F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))
    rows = rows.withColumns({f"o_{p}": F.when(there, c) for p, c in zip(frames.PARTS, org, strict=True)} | {"gx": F.sin("value"), "gy": F.cos("value")})
    return _shown(horizon.lock_by_gravity(rows, F.lit(100.0), F.lit(10.0)))


@query(f"""WITH RECURSIVE {EVENTS}, m AS (SELECT user_id, event_id, t // {SLOWED} AS u, degrees(atan2(sin(value / 100), cos(value / 100))) AS a, row_number() OVER (PARTITION BY user_id ORDER BY t // {SLOWED}, event_id) AS i FROM s),
d AS (SELECT *, (u - lag(u) OVER w) / 1e6 AS dt, a - lag(a) OVER w AS df FROM m WINDOW w AS (PARTITION BY user_id ORDER BY i)),
e AS (SELECT *, CASE WHEN dt > 0 AND dt < 1 THEN CASE WHEN df > 180 THEN df - 360 WHEN df < -180 THEN df + 360 ELSE df END / dt END AS raw FROM d),
z AS (SELECT user_id, event_id, i, NULL::DOUBLE AS rate, NULL::DOUBLE AS shown, 0.0::DOUBLE AS tilt, 0.0::DOUBLE AS held FROM e WHERE i = 1
 UNION ALL SELECT user_id, event_id, i, rate, shown, tilt + (goal - tilt) * wt, CASE WHEN dt > 0 AND abs((goal - held) * wt) > 900 * dt THEN held + sign(goal - held) * 900 * dt ELSE held + (goal - held) * wt END FROM (
  SELECT *, CASE WHEN abs(shown) > 5 THEN shown * 0.5 ELSE 0 END AS goal FROM (SELECT user_id, event_id, i, dt, tilt, held, CASE WHEN raw IS NULL THEN before ELSE coalesce(before * (1 - wt) + raw * wt, raw) END AS rate, CASE WHEN raw IS NOT NULL THEN coalesce(before * (1 - wt) + raw * wt, raw) END AS shown, wt
   FROM (SELECT e.*, z.rate AS before, z.tilt, z.held, e.dt / (0.5 + e.dt) AS wt FROM z JOIN e ON e.user_id = z.user_id AND e.i = z.i + 1))))
SELECT event_id, round(coalesce(shown, 0), 4) + 0.0 AS rate, round(tilt, 4) + 0.0 AS tilt, round(held, 4) + 0.0 AS held FROM z""")
def roll_tilt(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed rates of roll, and the tilt that follows them, free and with a limit to its change."""
    rows = _about(spark, sf, 2, F.col("value") / 200).withColumn("t", F.expr(f"t div {SLOWED}"))
    found = horizon.roll_rates(rows, _FAST, 0.5)
    found = horizon.tilts(found, _FAST, 0.5, multiplier=0.5)
    found = horizon.tilts(found, _FAST, 0.5, multiplier=0.5, limit=900.0, out="held")
    return found.select(F.col("seq").alias("event_id"), r(F.coalesce("rate", F.lit(0.0)), 4).alias("rate"), r("tilt", 4).alias("tilt"), r("held", 4).alias("held"))


@query(f"""WITH RECURSIVE {EVENTS}, m AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, lag(value) OVER w - 2 * value + lead(value) OVER w AS bend, lead(value) OVER w AS up FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
f AS (SELECT user_id, i, 0.0::DOUBLE AS mu, 0.0::DOUBLE AS z FROM m WHERE i = 1 UNION ALL SELECT m.user_id, m.i, CASE WHEN m.i < m.n THEN 1 / (4 - f.mu) ELSE 0 END, CASE WHEN m.i < m.n THEN (3 * m.bend - f.z) / (4 - f.mu) ELSE 0 END FROM f JOIN m ON m.user_id = f.user_id AND m.i = f.i + 1),
c AS (SELECT f.user_id, f.i, 0.0::DOUBLE AS c FROM f JOIN m ON m.user_id = f.user_id AND m.i = f.i WHERE f.i = m.n UNION ALL SELECT f.user_id, f.i, f.z - f.mu * c.c FROM c JOIN f ON f.user_id = c.user_id AND f.i = c.i - 1)
SELECT m.event_id, round(m.value + (m.up - m.value - (d.c + 2 * c.c) / 3) / 2 + c.c / 4 + (d.c - c.c) / 3 / 8, 5) + 0.0 AS middle FROM m JOIN c ON c.user_id = m.user_id AND c.i = m.i JOIN c d ON d.user_id = m.user_id AND d.i = m.i + 1""")
def natural_spline(spark: SparkSession, sf: str) -> DataFrame:
    """A natural cubic spline through each user's values, half-way to the next one."""
    found = splines.natural(events(spark, sf), USER, "value").where("b is not null")
    return found.select("event_id", r(F.col("value") + F.col("b") / 2 + F.col("c") / 4 + F.col("d") / 8, 5).alias("middle"))


def _sql_knots(a0: str, a1: str, a2: str, u: str) -> str:
    c = f"(0.75 * (({a2}) - 2 * ({a1}) + ({a0})))"
    return f"CASE WHEN {u} < 1 THEN ({a0}) + (({a1}) - ({a0}) - {c} / 3) * {u} + {c} / 3 * {u} * {u} * {u} ELSE ({a1}) + (({a2}) - ({a1}) - 2 * {c} / 3) * ({u} - 1) + {c} * ({u} - 1) * ({u} - 1) - {c} / 3 * ({u} - 1) * ({u} - 1) * ({u} - 1) END"


@query(f"""WITH a AS (SELECT event_id, value AS v, event_id % 7 AS k, event_id % 97 / 48.5 AS ux, event_id % 37 / 18.5 AS uy FROM events),
l AS (SELECT *, {_sql_knots("v", "k", "v + k", "ux")} AS r0, {_sql_knots("k", "v / 2", "3", "ux")} AS r1, {_sql_knots("2", "k * k", "v", "ux")} AS r2 FROM a)
SELECT event_id, round({_sql_knots("r0", "r1", "r2", "uy")}, 5) + 0.0 AS value FROM l""")
def mesh_surface(spark: SparkSession, sf: str) -> DataFrame:
    """A correction mesh of three by three, at a point of a picture of 97 x 37."""
    v, k = F.col("value"), (F.col("event_id") % 7).cast("double")
    rows = F.array(F.array(v, k, v + k), F.array(k, v / 2, F.lit(3.0)), F.array(F.lit(2.0), k * k, v))
    x, y = (F.col("event_id") % 97).cast("double"), (F.col("event_id") % 37).cast("double")
    return events(spark, sf).select("event_id", r(splines.mesh_at(rows, x, y, 97.0, 37.0), 5).alias("value"))


def _sql_after(kind: str, alias: str, source: str, share: str) -> str:
    return f"SELECT {source}.*, coalesce(c.value / {share}, 0) AS {alias} FROM {source} ASOF LEFT JOIN (SELECT * FROM s WHERE event_type = '{kind}') c ON {source}.user_id = c.user_id AND {source}.t <= c.t"


@query(f"""WITH {EVENTS}, b AS ({_sql_after("click", "h", "s", "200")}) SELECT event_id, round(cos(h), 5) + 0.0 AS qw, round(sin(h), 5) + 0.0 AS qz FROM b""")
def turn_at_or_after(spark: SparkSession, sf: str) -> DataFrame:
    """The first orientation at or after a time; none counts as the identity."""
    rows = events(spark, sf).select("user_id", "t", "event_id")
    clicks = _kind(spark, sf, "click", 200)
    return stabilise.at_or_after(rows, clicks, ["user_id"], "", "t", "seq").select("event_id", r("qw", 5).alias("qw"), r("qz", 5).alias("qz"))


def _kind(spark: SparkSession, sf: str, kind: str, share: float) -> DataFrame:
    named = events(spark, sf).where(F.col("event_type") == kind).select(F.col("event_id").alias("seq"))
    return _about(spark, sf, 2, F.col("value") / share).join(named, "seq", "left_semi")


@query(f"""WITH RECURSIVE {EVENTS}, x AS ({_sql_after("click", "hn", "s", "200")}), y AS ({_sql_after("view", "hi", "x", "1000")}),
m AS (SELECT *, hn + hi - value / 400 AS h, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM y),
z AS (SELECT user_id, event_id, i, value, cos(h) AS w, sin(h) AS z FROM m WHERE i = 1
 UNION ALL SELECT user_id, event_id, i, value, a / len, b / len FROM (SELECT *, sqrt(a * a + b * b) AS len FROM (SELECT *, w * wa + cos(h) * wb AS a, z * wa + sin(h) * wb AS b FROM (
  SELECT *, CASE WHEN abs(dt) > 0.9995 THEN 0.995 ELSE sin(0.995 * far) / sin(far) END AS wa, sg * CASE WHEN abs(dt) > 0.9995 THEN 0.005 ELSE sin(0.005 * far) / sin(far) END AS wb FROM (
   SELECT *, acos(least(abs(dt), 1.0)) AS far, CASE WHEN dt < 0 THEN -1 ELSE 1 END AS sg FROM (SELECT m.*, z.w, z.z, z.w * cos(m.h) + z.z * sin(m.h) AS dt FROM z JOIN m ON m.user_id = z.user_id AND m.i = z.i + 1)))))),
n AS (SELECT event_id, w * cos(value / 400) - z * sin(value / 400) AS qw, w * sin(value / 400) + z * cos(value / 400) AS qz FROM z)
SELECT event_id, round(abs(qw), 5) AS q0, 0.0 AS q1, 0.0 AS q2, round(CASE WHEN qw < 0 THEN -qz ELSE qz END, 5) + 0.0 AS q3 FROM n""")
def method_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """A recording's own orientations moved to those of another method."""
    org = _about(spark, sf, 2, F.col("value") / 400)
    return _shown(stabilise.converted(org, _kind(spark, sf, "click", 200), _kind(spark, sf, "view", 1000), _FAST))


_TURNED = "v / 60 + radians(5)"
_LOCKED = _sql_level(_TURNED, "0.0")


@query(_sql_shown(_sql_product(("l0", "-l1", "-l2", "-l3"), _Y), f"WITH {EVENTS}, a AS (SELECT event_id, value AS v FROM s WHERE abs(sin(value / 60 + radians(5))) > 1e-3), b AS (SELECT *, {', '.join(f'{p} AS l{k}' for k, p in enumerate(_LOCKED))} FROM a)"))
def correction_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Orientations turned, locked, not smoothed; the correction back to the originals."""
    org = _about(spark, sf, 1, F.col("value") / 120)
    # a turn by 5 degrees more: the sine of the whole angle, from its half
    c, s = F.cos(F.radians(F.lit(5.0))), F.sin(F.radians(F.lit(5.0)))
    sine, cosine = 2 * F.col("qw") * F.col("qy"), F.col("qw") * F.col("qw") - F.col("qy") * F.col("qy")
    org = org.where(F.abs(sine * c + cosine * s) > 1e-3)
    made = stabilise.stabilised(org, _FAST, "none", (5.0, 0.0, 0.0), 100.0)[0]
    return _shown(made.join(org.select("user_id", "t", "seq"), ["user_id", "t"]))


@query(f"""WITH {EVENTS}, d AS (SELECT user_id, (max(t) / 1000.0::DOUBLE - min(t) / 1000.0::DOUBLE) * ((count(*) + 1) / count(*)) AS span, CASE WHEN user_id % 2 = 0 THEN 1000.0 ELSE 0 END AS given FROM s GROUP BY user_id)
SELECT user_id, round(CASE WHEN span > 0 AND abs(span - given) > 0.01 THEN span ELSE given END, 3) AS duration_ms FROM d""")
def repaired_duration(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    found = stabilise.durations(e, ["user_id"], "t", F.when(F.col("user_id") % 2 == 0, 1000.0).otherwise(0.0))
    return found.select("user_id", r("duration_ms", 3).alias("duration_ms"))


@query(f"""WITH RECURSIVE {EVENTS}, m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s),
g AS (SELECT a.event_id, list_sort(list(CASE WHEN b.value IS NULL THEN 0 ELSE b.value + 2 END)) AS near FROM m a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) LEFT JOIN m b ON b.user_id = a.user_id AND b.i = a.i + d GROUP BY a.event_id),
h AS (SELECT m.*, near[2] AS once FROM m JOIN g USING (event_id)),
k AS (SELECT a.event_id, list_sort(list(coalesce(b.once, 0))) AS near FROM h a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) LEFT JOIN h b ON b.user_id = a.user_id AND b.i = a.i + d GROUP BY a.event_id)
SELECT event_id, round(-near[2], 6) + 0.0 AS gy FROM k""")
def prepared_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with a bias, renamed axes and a median taken twice: the second rate is minus the first one."""
    e = events(spark, sf)
    zero = {c: F.lit(0.0) for c in ("gy", "gz", "ax", "ay", "az")}
    rows = e.withColumns({"gx": F.col("value"), **zero})
    # the filter is odd, so its sign may be turned before or behind it
    found = stabilise.prepared(rows, USER, "YxZ", (2.0, 0.0, 0.0), kernel=3)
    return found.select("event_id", r("gy").alias("gy"))


@query()
def low_passed_turns(spark: SparkSession, sf: str) -> DataFrame:
    """No plain SQL for a filter of both directions; tests compare it with a direct form."""
    return _shown(stabilise.lowpass_turns(_about(spark, sf, 2, F.col("value") / 400), _FAST, 1.0, 10.0))


@query(f"""WITH {EVENTS}, k AS (SELECT user_id, t, value FROM s WHERE event_type = 'purchase'), p AS (SELECT user_id, event_id, t FROM s WHERE event_type = 'click'), o AS (SELECT user_id, t, value * 1000000 AS off FROM s WHERE event_type = 'view'),
a AS (SELECT p.*, o.t AS lt, o.off AS lv FROM p ASOF LEFT JOIN o ON p.user_id = o.user_id AND p.t >= o.t), b AS (SELECT a.*, o.t AS ht, o.off AS hv FROM a ASOF LEFT JOIN o ON a.user_id = o.user_id AND a.t <= o.t),
c AS (SELECT *, CASE WHEN ht = lt THEN 0.0 ELSE (t - lt) / (ht - lt)::DOUBLE END AS u FROM b), d AS (SELECT user_id, event_id, CAST(round_even(t + coalesce(lv * (1 - u) + hv * u, lv, hv, 0), 0) AS BIGINT) AS t FROM c),
f AS (SELECT d.*, k.t AS lt, k.value AS lv FROM d ASOF LEFT JOIN k ON d.user_id = k.user_id AND d.t >= k.t), g AS (SELECT f.*, k.t AS ht, k.value AS hv FROM f ASOF LEFT JOIN k ON f.user_id = k.user_id AND f.t <= k.t),
h AS (SELECT *, CASE WHEN ht = lt THEN 0.0 ELSE (t - lt) / (ht - lt)::DOUBLE END AS u FROM g) SELECT event_id, t, round(coalesce(lv * (1 - u) + hv * u, lv, hv), 4) AS value FROM h""")
def keyframe_at_sensor_time(spark: SparkSession, sf: str) -> DataFrame:
    """Keyframes at times of the sensor: its offset to the video is looked up first."""
    e = events(spark, sf)
    of = lambda kind: e.where(F.col("event_type") == kind)
    offsets = of("view").select("user_id", "t", "event_id", (F.col("value") * 1_000_000).alias("value"))
    keys = of("purchase").select("user_id", "event_id", "t", "value", F.lit("none").alias("easing"))
    found = keyframes.value_at_sensor(of("click").select("user_id", "event_id", "t"), keys, offsets, ["user_id"], "t", "event_id")
    return found.select("event_id", "t", r("value", 4).alias("value"))


@query(f"""WITH {EVENTS}, c AS (SELECT user_id, t, value, lead(value, 2) OVER (PARTITION BY user_id ORDER BY t) AS then_ FROM s WHERE event_type = 'click'), p AS (SELECT * FROM s WHERE event_type = 'purchase'),
a AS (SELECT p.event_id, p.user_id, p.t, c.t AS lt, c.then_ AS lv FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.t >= c.t), b AS (SELECT a.*, c.t AS ht, c.then_ AS hv FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.t <= c.t)
SELECT event_id, round(coalesce(CASE WHEN ht IS NULL OR t - lt <= ht - t THEN CASE WHEN t - lt <= {6 * HOUR} THEN lv END WHEN ht - t <= {6 * HOUR} THEN hv END, -1), 6) AS value FROM b""")
def closest_then_later(spark: SparkSession, sf: str) -> DataFrame:
    """The sample two rows behind the one closest to a time, if that is near enough."""
    e = events(spark, sf)
    samples = e.where("event_type = 'click'").select("user_id", "t", "event_id", "value")
    found = asof.later_than_closest(e.where("event_type = 'purchase'").select("user_id", "event_id", "t"), samples, ["user_id"], "t", "event_id", "value", 6 * HOUR, 2)
    return found.select("event_id", r(F.coalesce("later", F.lit(-1.0))).alias("value"))
