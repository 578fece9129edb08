"""Queries over per-user event series."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.quaternion import Quat
from chronoweave.operators import asof, filters, keyframes, orientation, ranges, robust, scans, search, windows, zoom
from chronoweave.plans.base import EVENTS, HOUR, USER, events, query, r


def _of_kind(e: DataFrame, kind: str, *names: str) -> DataFrame:
    return e.where(F.col("event_type") == kind).select("user_id", "event_id", "t", *names)


_ASOF = f"""WITH {EVENTS}, p AS (SELECT * FROM s WHERE event_type = 'purchase'),
c AS (SELECT user_id, t, value FROM s WHERE event_type = '%s')
SELECT p.event_id, p.user_id, p.t, coalesce(c.t, -1) AS near_t, round(c.value, 6) AS near_value
FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.t %s c.t"""


def _near(spark: SparkSession, sf: str, kind: str, side: str) -> DataFrame:
    e = events(spark, sf)
    found = asof.bracket(_of_kind(e, "purchase"), _of_kind(e, kind, "value"), ["user_id"], "t", "event_id", ["value"])
    return found.select("event_id", "user_id", "t", F.coalesce(F.col(f"{side}.t"), F.lit(-1)).alias("near_t"), r(f"{side}.value").alias("near_value"))


@query(_ASOF % ("click", ">="))
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, "click", "lo")


@query(_ASOF % ("view", "<="))
def asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, "view", "hi")


@query(f"""WITH {EVENTS}, p AS (SELECT * FROM s WHERE event_type = 'purchase'),
c AS (SELECT user_id, t, value FROM s WHERE event_type = 'click'),
a AS (SELECT p.event_id, p.user_id, p.t, c.t AS lt, c.value AS lv FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.t >= c.t),
b AS (SELECT a.*, c.t AS ht, c.value AS hv FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.t <= c.t),
d AS (SELECT *, coalesce(t - lt, 4611686018427387904) AS da, coalesce(ht - t, 4611686018427387904) AS db FROM b)
SELECT event_id, user_id, t,
  coalesce(CASE WHEN t - lt = 0 THEN lt WHEN da < db AND da < {HOUR} THEN lt WHEN db < da AND db < {HOUR} THEN ht END, -1) AS near_t,
  round(CASE WHEN t - lt = 0 THEN lv WHEN da < db AND da < {HOUR} THEN lv WHEN db < da AND db < {HOUR} THEN hv END, 6) AS near_value FROM d""")
def asof_nearest_strict(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    found = asof.bracket(_of_kind(e, "purchase"), _of_kind(e, "click", "value"), ["user_id"], "t", "event_id", ["value"])
    near = found.withColumn("n", asof.nearest(F.col("lo"), F.col("hi"), F.col("t"), HOUR))
    return near.select("event_id", "user_id", "t", F.coalesce(F.col("n.t"), F.lit(-1)).alias("near_t"), r("n.value").alias("near_value"))


def _grid(e: DataFrame, step: int) -> DataFrame:
    """Multiples of ``step`` within each user's time."""
    span = e.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return span.select("user_id", F.explode(F.sequence(F.ceil(F.col("a") / step), F.floor(F.col("b") / step))).alias("k")).select("user_id", (F.col("k") * step).alias("t"))


_GRID = f"""g AS (SELECT user_id, unnest(range(CAST(ceil(min(t) / {6 * HOUR}.0) AS BIGINT), CAST(floor(max(t) / {6 * HOUR}.0) AS BIGINT) + 1)) * {6 * HOUR} AS t FROM s GROUP BY user_id),
l AS (SELECT g.user_id, g.t, s.t AS lt, s.value AS lv FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.t >= s.t),
b AS (SELECT l.*, s.t AS ht, s.value AS hv FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.t <= s.t),
x AS (SELECT *, CASE WHEN ht = lt THEN 0.0 ELSE (t - lt) / (ht - lt)::DOUBLE END AS u FROM b)"""


def _on_grid(spark: SparkSession, sf: str, values: dict) -> DataFrame:
    e = events(spark, sf)
    samples = e.select("user_id", "t", "event_id", *(c.alias(n) for n, c in values.items()))
    return asof.bracket(_grid(e, 6 * HOUR), samples, ["user_id"], "t", "event_id", list(values))


@query(f"WITH {EVENTS}, {_GRID} SELECT user_id, t, round(lv * (1 - u) + hv * u, 6) AS value FROM x")
def bracket_lerp(spark: SparkSession, sf: str) -> DataFrame:
    found = _on_grid(spark, sf, {"value": F.col("value")})
    return found.select("user_id", "t", r(asof.lerp(F.col("lo"), F.col("hi"), F.col("t"), "value")).alias("value"))


_SLERP = """, q AS (SELECT *, cos(lv / 200) AS aw, sin(lv / 200) AS az, cos(hv / 200) AS bw0, sin(hv / 200) AS bz0 FROM x),
d AS (SELECT *, CASE WHEN aw * bw0 + az * bz0 < 0 THEN -1 ELSE 1 END AS sg, abs(aw * bw0 + az * bz0) AS dt FROM q),
f AS (SELECT *, CASE WHEN dt > 0.9995 THEN 1 - u ELSE sin((1 - u) * acos(least(dt, 1.0))) / sin(acos(least(dt, 1.0))) END AS a,
  sg * CASE WHEN dt > 0.9995 THEN u ELSE sin(u * acos(least(dt, 1.0))) / sin(acos(least(dt, 1.0))) END AS b FROM d),
m AS (SELECT *, a * aw + b * bw0 AS w, a * az + b * bz0 AS z FROM f)"""


@query(f"WITH {EVENTS}, {_GRID}{_SLERP} SELECT user_id, t, round(w / sqrt(w * w + z * z), 6) + 0.0 AS qw, round(z / sqrt(w * w + z * z), 6) + 0.0 AS qz FROM m")
def bracket_slerp(spark: SparkSession, sf: str) -> DataFrame:
    half = F.col("value") / 200
    found = _on_grid(spark, sf, {"qw": F.cos(half), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(half)})
    found = asof.with_slerp(found, ("qw", "qx", "qy", "qz"))
    return found.select("user_id", "t", r("qw").alias("qw"), r("qz").alias("qz"))


@query(f"""WITH {EVENTS}, fr AS (SELECT user_id, event_id, t, unnest(range(0, 9)) AS y FROM s WHERE event_type = 'signup'),
g AS (SELECT user_id, event_id, y, t + y * 2000000 AS t FROM fr),
l AS (SELECT g.*, s.t AS lt, s.value AS lv FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.t >= s.t),
b AS (SELECT l.*, s.t AS ht, s.value AS hv FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.t <= s.t),
x AS (SELECT *, CASE WHEN ht IS NULL OR ht = lt THEN 0.0 ELSE (t - lt) / (ht - lt)::DOUBLE END AS u FROM (SELECT * REPLACE (coalesce(hv, lv) AS hv, coalesce(lv, hv) AS lv) FROM b)){_SLERP}
SELECT event_id, y, round(w / sqrt(w * w + z * z), 6) + 0.0 AS qw, round(z / sqrt(w * w + z * z), 6) + 0.0 AS qz FROM m""")
def rolling_shutter_rows(spark: SparkSession, sf: str) -> DataFrame:
    """An orientation for each image row of a frame, read out from top to bottom."""
    e = events(spark, sf)
    rows = _of_kind(e, "signup").withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long")))).withColumn("t", F.col("t") + F.col("y") * 2_000_000)
    half = F.col("value") / 200
    samples = e.select("user_id", "t", "event_id", F.cos(half).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"))
    found = asof.bracket(rows, samples, ["user_id"], "t", "event_id", ["qw", "qx", "qy", "qz"])
    found = asof.with_slerp(found, ("qw", "qx", "qy", "qz"))
    return found.select("event_id", "y", r("qw").alias("qw"), r("qz").alias("qz"))


@query(f"""WITH {EVENTS}, k AS (SELECT user_id, t, value, CASE event_id % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'out' WHEN 2 THEN 'inout' ELSE 'none' END AS e FROM s WHERE event_type = 'purchase'),
p AS (SELECT user_id, event_id, t FROM s WHERE event_type = 'click'),
a AS (SELECT p.*, k.t AS lt, k.value AS lv, k.e AS le FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.t >= k.t),
b AS (SELECT a.*, k.t AS ht, k.value AS hv, k.e AS he FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.t <= k.t),
x AS (SELECT *, CASE WHEN ht = lt THEN 0.0 ELSE (t - lt) / (ht - lt)::DOUBLE END AS u, le IN ('out', 'inout') AS o, he IN ('in', 'inout') AS i FROM b),
y AS (SELECT *, CASE WHEN o AND i THEN (1 - cos(pi() * u)) / 2 WHEN i THEN sin(u * pi() / 2) WHEN o THEN 1 - cos(u * pi() / 2) ELSE u END AS w FROM x)
SELECT event_id, user_id, t, round(coalesce(lv * (1 - w) + hv * w, lv, hv), 6) AS value FROM y""")
def keyframe_eased(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    easing = F.element_at(F.array(*map(F.lit, ("in", "out", "inout", "none"))), (F.col("event_id") % 4 + 1).cast("int"))
    keys = _of_kind(e, "purchase", "value", easing.alias("easing"))
    found = keyframes.value_at(_of_kind(e, "click"), keys, ["user_id"], "t", "event_id")
    return found.select("event_id", "user_id", "t", r("value").alias("value"))


@query(f"WITH {EVENTS} SELECT user_id, t, coalesce(lag(t) OVER w, -1) AS previous, coalesce(lead(t) OVER w, -1) AS next FROM s WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY t)")
def keyframe_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    found = keyframes.neighbours(_of_kind(events(spark, sf), "purchase").drop("event_id"), ["user_id"], "t")
    return found.fillna(-1, ["previous", "next"])


@query(f"""WITH {EVENTS}, k AS (SELECT user_id, t, value FROM s WHERE event_type = 'purchase')
SELECT user_id, json_group_object(t::VARCHAR, value) IS NOT NULL AS has_json, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id""")
def keyframe_json(spark: SparkSession, sf: str) -> DataFrame:
    """Curves written as JSON and read back."""
    keys = _of_kind(events(spark, sf), "purchase", "value")
    j = keyframes.as_json(keys, ["user_id"], "t", ["value"])
    back = j.withColumn("m", F.from_json("json", "map<string,struct<value:double>>"))
    total = F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v["value"])
    return back.select("user_id", F.col("json").isNotNull().alias("has_json"), F.size("m").cast("long").alias("n"), r(total, 4).alias("total"))


@query(f"""WITH {EVENTS}, m AS (SELECT *, CASE WHEN t - lag(t) OVER w > {24 * HOUR} OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
x AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM m)
SELECT user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM x GROUP BY user_id, run HAVING min(t) < max(t)""")
def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return windows.gap_sessions(events(spark, sf), USER, 24 * HOUR)


@query(f"""WITH {EVENTS}, n AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM s),
x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS li, last_value(v IGNORE NULLS) OVER a AS lv,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS hi, first_value(v IGNORE NULLS) OVER b AS hv FROM n
  WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, user_id, round(CASE WHEN v IS NOT NULL THEN v ELSE lv + (hv - lv) * ((i - li) / (hi - li)::DOUBLE) END, 6) AS value FROM x""")
def gap_fill_linear(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return e.select("event_id", "user_id", r(windows.fill_gaps(USER, "v")).alias("value"))


@query(f"WITH {EVENTS} SELECT event_id, user_id, t + coalesce(CAST(floor((lead(t) OVER w - t) / 2.0) AS BIGINT), 0) AS t FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def midpoint_restamp(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "user_id", windows.midpoint(USER).alias("t"))


@query(f"WITH {EVENTS} SELECT event_id, user_id, round(CASE WHEN t > lag(t) OVER w THEN (value - lag(value) OVER w) / ((t - lag(t) OVER w) / 1e6) END, 6) + 0.0 AS rate FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def angular_rate(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "user_id", r(windows.rate(USER, "value")).alias("rate"))


@query(f"WITH {EVENTS} SELECT event_id, user_id, round(min(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS low FROM s")
def rolling_min_edge(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "user_id", r(windows.rolling_min(USER, "value", 3)).alias("low"))


_EDGE = "coalesce({f}(value, {k}) OVER w, {e}(value) OVER u)"


def _conv_sql(weights: list[float], source: str = "s") -> str:
    half = len(weights) // 2
    terms = []
    for k, w in enumerate(weights):
        o = k - half
        x = "value" if o == 0 else _EDGE.format(f="lag" if o < 0 else "lead", k=abs(o), e="first_value" if o < 0 else "last_value")
        terms.append(f"{w!r} * {x}")
    return f"""SELECT event_id, user_id, round({' + '.join(terms)}, 6) AS value FROM {source}
WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id), u AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


@query(f"WITH {EVENTS} " + _conv_sql(windows.gaussian(3, 7 / 6)))
def gaussian_conv_edge(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "user_id", r(windows.convolve(USER, "value", windows.gaussian(3, 7 / 6))).alias("value"))


@query(f"""WITH {EVENTS}, m AS (SELECT event_id, user_id, t, min(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM s) """ + _conv_sql(windows.gaussian(2, 5 / 6), "m"))
def dynamic_zoom(spark: SparkSession, sf: str) -> DataFrame:
    out = zoom.dynamic(events(spark, sf), USER, "value", 0.5, 10.0, "fov")
    return out.select("event_id", "user_id", r("fov").alias("value"))


@query(f"""WITH {EVENTS}, n AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM s)
SELECT a.event_id, a.user_id, round(max(a.v) * 0.25 + 0.75 * (sum(exp(-((b.i - a.i) * (b.i - a.i)) / (2 * 1.5 * 1.5)) * b.v) FILTER (WHERE b.v IS NOT NULL) / sum(exp(-((b.i - a.i) * (b.i - a.i)) / (2 * 1.5 * 1.5))) FILTER (WHERE b.v IS NOT NULL)), 6) AS value
FROM n a JOIN n b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 3 AND a.i + 3 GROUP BY a.event_id, a.user_id""")
def gaussian_nullable(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return e.select("event_id", "user_id", r(windows.smooth_nullable(USER, "v", 3, 1.5, 0.75)).alias("value"))


def _median_sql(source: str) -> str:
    return f"""(SELECT event_id, user_id, t, list_sort(list_concat(list(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
  list_resize([]::DOUBLE[], CAST(5 - count(*) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT), 0.0)))[3] AS value FROM {source})"""


@query(f"WITH {EVENTS} SELECT event_id, user_id, round(value, 6) AS value FROM {_median_sql(_median_sql('s'))}")
def rolling_median_double(spark: SparkSession, sf: str) -> DataFrame:
    once = events(spark, sf).withColumn("value", windows.median_filter(USER, "value", 5))
    return once.select("event_id", "user_id", r(windows.median_filter(USER, "value", 5)).alias("value"))


def _rec(first: str, step: str, order: str, source: str = "s", out: str = "q", extra: str = "") -> str:
    """A recursion along each user's rows."""
    return f"""n_{out} AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS i_{out} FROM {source}),
r_{out} AS (SELECT n.*, {first} AS {out}{extra} FROM n_{out} n WHERE i_{out} = 1
  UNION ALL SELECT n.*, {step} AS {out}{extra} FROM r_{out} p JOIN n_{out} n ON n.user_id = p.user_id AND n.i_{out} = p.i_{out} + 1)"""


_FORWARD, _BACK = "t, event_id", "t DESC, event_id DESC"


@query(f"WITH RECURSIVE {EVENTS}, {_rec('n.value', '0.8 * p.q + 0.2 * n.value', _FORWARD)} SELECT event_id, user_id, round(q, 6) AS ema FROM r_q")
def ema_forward(spark: SparkSession, sf: str) -> DataFrame:
    return scans.ema(events(spark, sf), USER, "value", 0.2).select("event_id", "user_id", r("ema").alias("ema"))


_BOTH = f"WITH RECURSIVE {EVENTS}, {_rec('n.value', '0.8 * p.f + 0.2 * n.value', _FORWARD, out='f')}, {_rec('n.f', '0.8 * p.q + 0.2 * n.f', _BACK, 'r_f')}"


@query(f"{_BOTH} SELECT event_id, user_id, round(q, 6) AS ema FROM r_q")
def ema_bidirectional(spark: SparkSession, sf: str) -> DataFrame:
    return scans.ema_both(events(spark, sf), USER, "value", 0.2).select("event_id", "user_id", r("ema").alias("ema"))


@query(f"WITH RECURSIVE {EVENTS}, {_rec('n.value', 'least(n.value, 0.2718281 * n.value + (1 - 0.2718281) * p.b)', _BACK, out='b')}, {_rec('n.b', 'least(n.b, 0.2718281 * n.b + (1 - 0.2718281) * p.q)', _FORWARD, 'r_b')} SELECT event_id, user_id, round(q, 4) AS envelope FROM r_q")
def envelope_follower(spark: SparkSession, sf: str) -> DataFrame:
    return scans.envelope(events(spark, sf), USER, "value", 0.2718281).select("event_id", "user_id", r("envelope", 4).alias("envelope"))


@query()
def envelope_zoom(spark: SparkSession, sf: str) -> DataFrame:
    return zoom.followed(events(spark, sf), USER, "value", 0.5, 10.0).select("event_id", "user_id", r("fov").alias("fov"))


@query()
def adaptive_ema(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    out = scans.per_series(e, USER, lambda p: {"smooth": orientation.adaptive_ema(p["v"].to_numpy(float), 10.0, 3.0, 0.15, 1.5)}, {"smooth": "double"})
    return out.select("event_id", "user_id", r(F.nanvl("smooth", F.lit(None))).alias("smooth"))


@query()
def butterworth_filtfilt(spark: SparkSession, sf: str) -> DataFrame:
    out = scans.per_series(events(spark, sf), USER, lambda p: {"low": filters.lowpass(p["value"].to_numpy(float), 1.0, 10.0)}, {"low": "double"})
    return out.select("event_id", "user_id", r("low").alias("low"))


@query()
def butterworth_causal(spark: SparkSession, sf: str) -> DataFrame:
    out = scans.per_series(events(spark, sf), USER, lambda p: {"low": filters.lowpass(p["value"].to_numpy(float), 1.0, 10.0, False)}, {"low": "double"})
    return out.select("event_id", "user_id", r("low").alias("low"))


#: An hour of the series stands for five thousandths of a second of motion.
SLOWED = 720_000


def _motion(pdf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times (microseconds), rates (rad/s) and acceleration made of a user's values."""
    v = pdf["value"].to_numpy(float)
    gyro = np.stack([np.sin(v), np.cos(v), np.sin(v / 7)], 1)
    return pdf["t"].to_numpy(float) / SLOWED, gyro, np.stack([np.sin(v / 50), np.cos(v / 30) / 4, 9.81 + np.sin(v) / 10], 1)


_Q = {"qw": "double", "qx": "double", "qy": "double", "qz": "double"}


def _oriented(spark: SparkSession, sf: str, fn) -> DataFrame:
    out = scans.per_series(events(spark, sf), USER, lambda p: dict(zip(_Q, np.asarray(fn(*_motion(p))).T, strict=True)), _Q)
    q = Quat(*map(F.col, _Q)).canonical()
    return out.select("event_id", "user_id", *(r(c, 5).alias(n) for n, c in zip(_Q, q.parts, strict=True)))


def _sql_steps(lead: str, repair: bool, step: str) -> str:
    """Recursive SQL over a user's rows: ``step`` makes (nw, nx, ny, nz) of the state (w, x, y, z), the
    rate (gx, gy, gz), the direction of acceleration (ux, uy, uz), dt and the time since the start."""
    dt = "CASE WHEN raw > 0 THEN raw ELSE mean END" if repair else "raw"
    return f"""WITH RECURSIVE {EVENTS}, m AS (SELECT *, t / {SLOWED}::DOUBLE / 1e6 AS sec, row_number() OVER u AS i, sin(value) AS gx, cos(value) AS gy, sin(value / 7) AS gz,
  sin(value / 50) AS ax, cos(value / 30) / 4 AS ay, 9.81 + sin(value) / 10 AS az FROM s WINDOW u AS (PARTITION BY user_id ORDER BY t, event_id)),
d AS (SELECT *, (max(sec) OVER p - min(sec) OVER p) * (count(*) OVER p + 1) / count(*) OVER p / count(*) OVER p AS mean, min(sec) OVER p AS s0, lag(sec) OVER (PARTITION BY user_id ORDER BY i) AS before, sqrt(ax * ax + ay * ay + az * az) AS an FROM m WINDOW p AS (PARTITION BY user_id)),
e AS (SELECT *, coalesce(sec - before, mean * {lead}) AS raw, ax / an AS ux, ay / an AS uy, az / an AS uz FROM d),
f AS (SELECT *, {dt} AS dt FROM e), g AS (SELECT *, sum(dt) OVER (PARTITION BY user_id ORDER BY i) AS since FROM f),
z AS (SELECT user_id, event_id, 0::BIGINT AS i, sqrt(0.5) AS w, sqrt(0.5) AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM g WHERE i = 1
  UNION ALL SELECT user_id, event_id, i, nw / len, nx / len, ny / len, nz / len FROM (SELECT *, sqrt(nw * nw + nx * nx + ny * ny + nz * nz) AS len FROM (
    {step.replace("STATE", "(SELECT g.*, z.w, z.x, z.y, z.z FROM z JOIN g ON g.user_id = z.user_id AND g.i = z.i + 1)")}))),
n AS (SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END AS sg FROM z WHERE i > 0)
SELECT event_id, user_id, round(w * sg, 5) + 0.0 AS qw, round(x * sg, 5) + 0.0 AS qx, round(y * sg, 5) + 0.0 AS qy, round(z * sg, 5) + 0.0 AS qz FROM n"""


#: The state turned by a rotation vector (rx, ry, rz) times dt.
_SQL_TURN = """SELECT *, w * ew - x * ex - y * ey - z * ez AS nw, w * ex + x * ew + y * ez - z * ey AS nx, w * ey - x * ez + y * ew + z * ex AS ny, w * ez + x * ey - y * ex + z * ew AS nz
FROM (SELECT *, cos(h / 2) AS ew, rx * k AS ex, ry * k AS ey, rz * k AS ez FROM (SELECT *, CASE WHEN h > 1e-12 THEN sin(h / 2) / h * dt ELSE 0.5 * dt END AS k FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) * dt AS h FROM (%s))))"""
#: The state moved along a derivative (half the product with a rate, less a step).
_SQL_MOVE = """SELECT *, w + dt * (0.5 * (-x * rx - y * ry - z * rz) - bw) AS nw, x + dt * (0.5 * (w * rx + y * rz - z * ry) - bx) AS nx, y + dt * (0.5 * (w * ry - x * rz + z * rx) - "by") AS ny, z + dt * (0.5 * (w * rz + x * ry - y * rx) - bz) AS nz FROM (%s)"""


@query(_sql_steps("1", True, _SQL_TURN % "SELECT *, gx AS rx, gy AS ry, gz AS rz FROM STATE"))
def integrate_gyro(spark: SparkSession, sf: str) -> DataFrame:
    return _oriented(spark, sf, lambda t, g, a: orientation.simple(g, orientation.steps(t, g)))


@query(_sql_steps("1", True, _SQL_TURN % """SELECT *, gx + c * (m00 * px + m10 * py) AS rx, gy + c * (m01 * px + m11 * py) AS ry, gz + c * (m02 * px + m12 * py) AS rz FROM (
  SELECT *, m10 * ux + m11 * uy + m12 * uz AS px, -(m00 * ux + m01 * uy + m02 * uz) AS py, CASE WHEN since < 15 THEN 10.0 ELSE 0.6 END AS c FROM (
  SELECT *, 1 - 2 * (y * y + z * z) AS m00, 2 * (x * y - w * z) AS m01, 2 * (x * z + w * y) AS m02, 2 * (x * y + w * z) AS m10, 1 - 2 * (x * x + z * z) AS m11, 2 * (y * z - w * x) AS m12 FROM STATE))"""))
def integrate_gravity(spark: SparkSession, sf: str) -> DataFrame:
    return _oriented(spark, sf, lambda t, g, a: orientation.with_gravity(g, a, orientation.steps(t, g)))


@query(_sql_steps("0.001", False, _SQL_MOVE % """SELECT *, gx + 0.5 * (uy * vz - uz * vy) AS rx, gy + 0.5 * (uz * vx - ux * vz) AS ry, gz + 0.5 * (ux * vy - uy * vx) AS rz, 0 AS bw, 0 AS bx, 0 AS "by", 0 AS bz FROM (
  SELECT *, 2 * (x * z - w * y) AS vx, 2 * (w * x + y * z) AS vy, 1 - 2 * (x * x + y * y) AS vz FROM STATE)"""))
def integrate_mahony(spark: SparkSession, sf: str) -> DataFrame:
    return _oriented(spark, sf, lambda t, g, a: orientation.mahony(g, a, orientation.steps(t, g, 0.001, False)))


@query(_sql_steps("0.001", False, _SQL_MOVE % """SELECT *, gx AS rx, gy AS ry, gz AS rz, 0.02 * d0 / dn AS bw, 0.02 * d1 / dn AS bx, 0.02 * d2 / dn AS "by", 0.02 * d3 / dn AS bz FROM (SELECT *, sqrt(d0 * d0 + d1 * d1 + d2 * d2 + d3 * d3) AS dn FROM (
  SELECT *, -2 * y * f0 + 2 * x * f1 AS d0, 2 * z * f0 + 2 * w * f1 - 4 * x * f2 AS d1, -2 * w * f0 + 2 * z * f1 - 4 * y * f2 AS d2, 2 * x * f0 + 2 * y * f1 AS d3 FROM (
  SELECT *, 2 * (x * z - w * y) - ux AS f0, 2 * (w * x + y * z) - uy AS f1, 1 - 2 * (x * x + y * y) - uz AS f2 FROM STATE)))"""))
def integrate_madgwick(spark: SparkSession, sf: str) -> DataFrame:
    return _oriented(spark, sf, lambda t, g, a: orientation.madgwick(g, a, orientation.steps(t, g, 0.001, False)))


@query()
def integrate_complementary(spark: SparkSession, sf: str) -> DataFrame:
    return _oriented(spark, sf, lambda t, g, a: orientation.complementary(g, a, orientation.steps(t, g)))


def _mean_step(t: np.ndarray) -> float:
    return orientation.duration(t) / max(len(t), 1)


@query()
def integrate_vqf(spark: SparkSession, sf: str) -> DataFrame:
    """One sample time for all rows, as the filter asks for."""
    return _oriented(spark, sf, lambda t, g, a: orientation.vqf(g, a, _mean_step(t) or 1.0))


def _smoothed(spark: SparkSession, sf: str, fn) -> DataFrame:
    return _oriented(spark, sf, lambda t, g, a: fn(orientation.simple(g, orientation.steps(t, g)), 1 / (_mean_step(t) or 1.0)))


@query()
def smooth_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _smoothed(spark, sf, orientation.smooth_plain)


@query()
def smooth_default(spark: SparkSession, sf: str) -> DataFrame:
    return _smoothed(spark, sf, orientation.smooth_default)


@query(f"""WITH {EVENTS}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, max(value) OVER (PARTITION BY user_id) AS top FROM s)
SELECT event_id, user_id, round(CASE WHEN i >= floor(n * 0.25) AND i <= ceil(n * 0.6) THEN value ELSE top END, 6) AS value FROM x""")
def trim_mask_fill_max(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "user_id", r(zoom.trim_mask(USER, "value", 0.25, 0.6)).alias("value"))


#: 2024-01-03 to 05 and 2024-01-10 to 12.
_RANGES = ((1704240000000000, 1704412800000000), (1704844800000000, 1705017600000000))


@query(f"""WITH {EVENTS} SELECT event_id, user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS position FROM s
WHERE t BETWEEN {_RANGES[0][0]} AND {_RANGES[0][1]} OR t BETWEEN {_RANGES[1][0]} AND {_RANGES[1][1]}""")
def trim_concat_reindex(spark: SparkSession, sf: str) -> DataFrame:
    kept = events(spark, sf).where(ranges.inside(F.col("t"), _RANGES))
    return kept.select("event_id", "user_id", "t", F.row_number().over(USER.window()).cast("long").alias("position"))


@query(f"""WITH {EVENTS} SELECT event_id, CASE WHEN t BETWEEN {_RANGES[0][0]} AND {_RANGES[0][1]} THEN t - {_RANGES[0][0]} ELSE t - {_RANGES[1][0]} + {_RANGES[0][1] - _RANGES[0][0]} END AS t FROM s
WHERE t BETWEEN {_RANGES[0][0]} AND {_RANGES[0][1]} OR t BETWEEN {_RANGES[1][0]} AND {_RANGES[1][1]}""")
def trim_rebase(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where(ranges.inside(F.col("t"), _RANGES)).select("event_id", ranges.rebase(F.col("t"), _RANGES).alias("t"))


@query(f"""WITH RECURSIVE {EVENTS}, b AS (SELECT *, t - min(t) OVER (PARTITION BY user_id) AS x, CASE WHEN event_id % 2 = 0 THEN 2.0 ELSE 0.5 END AS sp FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, (x - coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY t, event_id), 0)) / sp AS st FROM b),
m AS (SELECT *, CASE WHEN st / {4 * HOUR} >= 1.5 THEN greatest(1, CAST(round_even(st / {4 * HOUR}.0, 0) AS BIGINT)) ELSE 1 END AS c FROM n),
r AS (SELECT user_id, event_id, i, st AS ramp, CASE WHEN st >= {2 * HOUR} THEN c ELSE 0 END AS copies, CASE WHEN st >= {2 * HOUR} THEN c ELSE 0 END * {4 * HOUR}::DOUBLE AS done FROM m WHERE i = 1
 UNION ALL SELECT m.user_id, m.event_id, m.i, r.ramp + m.st, CASE WHEN r.ramp + m.st >= r.done + {2 * HOUR} THEN m.c ELSE 0 END, r.done + CASE WHEN r.ramp + m.st >= r.done + {2 * HOUR} THEN m.c ELSE 0 END * {4 * HOUR}::DOUBLE
 FROM r JOIN m ON m.user_id = r.user_id AND m.i = r.i + 1)
SELECT event_id, user_id, CAST(copies AS BIGINT) AS copies FROM r""")
def rate_control(spark: SparkSession, sf: str) -> DataFrame:
    """Frames dropped or repeated at a speed, for an output row every four hours."""
    def copies(p):
        t = p["t"].to_numpy()
        return {"copies": orientation.rate_control((t - t.min()).astype(float), np.where(p["event_id"] % 2 == 0, 2.0, 0.5), 1e6 / (4 * HOUR))}

    return scans.per_series(events(spark, sf), USER, copies, {"copies": "long"}).select("event_id", "user_id", "copies")


@query(f"WITH {EVENTS} SELECT user_id, round(coalesce(-avg(value) FILTER (WHERE t > {_RANGES[0][0]} AND t < {_RANGES[1][0]}), 0), 6) + 0.0 AS bias FROM s GROUP BY user_id")
def bias_window(spark: SparkSession, sf: str) -> DataFrame:
    inside = (F.col("t") > _RANGES[0][0]) & (F.col("t") < _RANGES[1][0])
    return events(spark, sf).groupBy("user_id").agg(r(F.coalesce(-F.avg(F.when(inside, F.col("value"))), F.lit(0.0))).alias("bias"))


@query(f"WITH {EVENTS} SELECT user_id, round(count(*) / ((max(t) - min(t)) / 1e6 * (count(*) + 1) / count(*)), 9) AS rate FROM s GROUP BY user_id HAVING max(t) > min(t)")
def sample_rate(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count(F.lit(1))
    span = (F.max("t") - F.min("t")) / 1e6
    return events(spark, sf).groupBy("user_id").agg(F.round(n / (span * (n + 1) / n), 9).alias("rate"), span.alias("span")).where("span > 0").drop("span")


_DAYS = "(t - 1704067200000000) / 86400000000.0"


def _days(e: DataFrame) -> DataFrame:
    return e.withColumn("day", (F.col("t") - 1704067200000000) / 86400000000.0)


@query(f"WITH {EVENTS} SELECT user_id, round(regr_slope(value, {_DAYS}), 5) + 0.0 AS slope, round(regr_intercept(value, {_DAYS}), 5) + 0.0 AS intercept, count(*) AS n FROM s GROUP BY user_id")
def line_fit(spark: SparkSession, sf: str) -> DataFrame:
    return robust.line(_days(events(spark, sf)), ["user_id"], "day", "value").select("user_id", r("slope", 5).alias("slope"), r("intercept", 5).alias("intercept"), "n")


@query(f"""WITH {EVENTS}, d AS (SELECT user_id, {_DAYS} AS x, value AS y FROM s), f AS (SELECT user_id, regr_slope(y, x) AS m, regr_intercept(y, x) AS k FROM d GROUP BY user_id)
SELECT user_id, round(max(x) - min(x), 6) AS span, round(max(abs(y - (m * x + k))), 4) AS worst, count(*) >= 3 AND abs(max(m) * (max(x) - min(x))) >= 15 AND max(abs(y - (m * x + k))) <= 250 AS drifts
FROM d JOIN f USING (user_id) GROUP BY user_id""")
def drift_test(spark: SparkSession, sf: str) -> DataFrame:
    found = robust.drift(_days(events(spark, sf)), ["user_id"], "day", "value", 15.0, 250.0)
    return found.select("user_id", r("span").alias("span"), r("worst", 4).alias("worst"), "drifts")


@query(f"""WITH {EVENTS}, d AS (SELECT user_id, {_DAYS} AS x, value AS y FROM s WHERE event_type = 'signup'),
l AS (SELECT a.user_id, (b.y - a.y) / (b.x - a.x) AS m, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS k FROM d a JOIN d b ON a.user_id = b.user_id AND b.x > a.x),
sc AS (SELECT l.user_id, m, k, count(*) FILTER (WHERE abs(y - (m * x + k)) < 25) AS n, sum(CASE WHEN abs(y - (m * x + k)) < 25 THEN (y - (m * x + k)) ** 2 ELSE 0 END) AS loss
  FROM l JOIN d ON l.user_id = d.user_id WHERE abs(m) < 20 GROUP BY l.user_id, m, k),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, loss, m, k) = 1)
SELECT d.user_id, round(regr_slope(y, x), 4) + 0.0 AS slope, round(regr_intercept(y, x), 4) + 0.0 AS intercept, count(*) AS inliers
FROM best JOIN d ON best.user_id = d.user_id WHERE abs(y - (m * x + k)) < 25 GROUP BY d.user_id""")
def consensus_line(spark: SparkSession, sf: str) -> DataFrame:
    d = _days(events(spark, sf)).where("event_type = 'signup'")
    found = robust.consensus(d, ["user_id"], "day", "value", 25.0, 20.0, each_pair=True)
    return found.select("user_id", r("slope", 4).alias("slope"), r("intercept", 4).alias("intercept"), "inliers")


def _hourly(e: DataFrame, kind: str) -> DataFrame:
    rows = e.where(F.col("event_type") == kind).withColumn("slot", F.floor(F.col("t") / (6 * HOUR)))
    return rows.groupBy("user_id", "slot").agg(F.avg("value").alias("value"))


_ALIGN = f"""WITH {EVENTS}, a AS (SELECT user_id, t // {6 * HOUR} AS slot, avg(value) AS x FROM s WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT user_id, t // {6 * HOUR} AS slot, avg(value) AS y FROM s WHERE event_type = 'view' GROUP BY 1, 2),
o AS (SELECT unnest(range(-8, 9)) AS off), p AS (SELECT a.user_id, off, x, y FROM a CROSS JOIN o JOIN b ON a.user_id = b.user_id AND b.slot = a.slot + off)"""


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return search.align(_hourly(e, "click"), _hourly(e, "view"), ["user_id"], "slot", "value", 8)


@query(f"""{_ALIGN}, c AS (SELECT user_id, off, avg((x - y) * (x - y)) AS cost, count(*) AS n FROM p GROUP BY user_id, off HAVING count(*) >= 3)
SELECT user_id, CAST(off AS INTEGER) AS "offset", round(cost, 4) AS cost, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cost, off) = 1""")
def offset_sse_grid(spark: SparkSession, sf: str) -> DataFrame:
    return search.best_by_error(_aligned(spark, sf), ["user_id"], 3).select("user_id", "offset", r("cost", 4).alias("cost"), "n")


@query(f"""{_ALIGN}, c AS (SELECT user_id, off, corr(x, y) AS rr, count(*) AS n FROM p GROUP BY user_id, off HAVING count(*) >= 4)
SELECT user_id, CAST(off AS INTEGER) AS "offset", round(rr, 5) + 0.0 AS r, n FROM c WHERE rr IS NOT NULL AND NOT isnan(rr) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rr DESC, off) = 1""")
def offset_corr_grid(spark: SparkSession, sf: str) -> DataFrame:
    return search.best_by_correlation(_aligned(spark, sf), ["user_id"], 4).select("user_id", "offset", r("r", 5).alias("r"), "n")


@query(f"""WITH {EVENTS}, v AS (SELECT event_type, CAST(floor(value * value) AS BIGINT) AS d FROM s),
x AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM v)
SELECT event_type, CAST(sum(d) FILTER (WHERE i <= CAST(floor(n * 0.9::DOUBLE) AS BIGINT)) AS BIGINT) AS total, max(n) AS n FROM x GROUP BY event_type""")
def trimmed_distance(spark: SparkSession, sf: str) -> DataFrame:
    return search.trimmed_sum(events(spark, sf), ["event_type"], F.col("value") * F.col("value"))


@query()
def stft_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a user's series by how well they serve to synchronise."""
    def rank(p):
        x = p["value"].to_numpy(float)
        out = np.zeros(len(x))
        got = filters.sync_rank(filters.stft_bands(x, 64.0))
        at = np.arange(len(got)) * 16 + 32
        out[at] = got
        return {"rank": out}

    out = scans.per_series(events(spark, sf), USER, rank, {"rank": "double"})
    return out.where("rank > 0").select("event_id", "user_id", r("rank", 3).alias("rank"))


@query(f"""WITH {EVENTS}, x AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS b FROM s)
SELECT event_id, user_id, round(value, 6) AS value FROM x WHERE value >= 50 AND (a IS NULL OR value > a) AND (b IS NULL OR value >= b)""")
def nms_peaks(spark: SparkSession, sf: str) -> DataFrame:
    marked = events(spark, sf).withColumn("peak", windows.peaks(USER, "value", 4, 50.0))
    return marked.where("peak").select("event_id", "user_id", r("value").alias("value"))


@query(f"WITH {EVENTS} SELECT event_id, user_id, round(min(value) OVER (PARTITION BY user_id), 6) AS fov FROM s")
def static_zoom_broadcast_min(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "user_id", r(zoom.static(USER, "value")).alias("fov"))


@query(f"WITH {EVENTS} SELECT event_id, round(CASE WHEN value < 40 THEN 1.5 * least(value / 40, 0.9) ELSE 1.5 END, 6) AS lim FROM s")
def max_zoom_limit_once(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", r(zoom.limit_once(F.col("value"), F.lit(1.5), 40.0, 1)).alias("lim"))


@query(f"""WITH {EVENTS}, x AS (SELECT event_id, user_id, row_number() OVER w AS i, lag(value) OVER w AS p0, value AS p1, lead(value) OVER w AS p2, lead(value, 2) OVER w AS p3 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
y AS (SELECT *, coalesce(p0, 2 * p1 - p2) AS a, coalesce(p3, 2 * p2 - p1) AS d FROM x WHERE p2 IS NOT NULL)
SELECT event_id, user_id, round(0.5 * (2 * p1 + (p2 - a) * 0.37 + (2 * a - 5 * p1 + 4 * p2 - d) * 0.37 * 0.37 + (3 * p1 - a - 3 * p2 + d) * 0.37 * 0.37 * 0.37), 4) + 0.0 AS value FROM y""")
def catmull_rom(spark: SparkSession, sf: str) -> DataFrame:
    from chronoweave.functions.scalars import catmull_rom as segment

    w = USER.window()
    e = events(spark, sf).select("event_id", "user_id", F.lag("value").over(w).alias("p0"), F.col("value").alias("p1"), F.lead("value").over(w).alias("p2"), F.lead("value", 2).over(w).alias("p3"))
    return e.where("p2 is not null").select("event_id", "user_id", r(segment(F.col("p0"), F.col("p1"), F.col("p2"), F.col("p3"), F.lit(0.37)), 4).alias("value"))


@query(_BOTH + f""", z AS (SELECT user_id, event_id, t, q AS value FROM r_q), {_GRID.replace(' s.', ' z.').replace('JOIN s ', 'JOIN z ').replace('= s.', '= z.').replace(', s.', ', z.')}
SELECT user_id, t, round(lv * (1 - u) + hv * u, 5) AS value FROM x""")
def smooth_on_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: each user's smoothed signal on a regular grid."""
    e = events(spark, sf)
    smooth = scans.ema_both(e, USER, "value", 0.2).select("user_id", "t", "event_id", "ema")
    found = asof.bracket(_grid(e, 6 * HOUR), smooth, ["user_id"], "t", "event_id", ["ema"])
    return found.select("user_id", "t", r(asof.lerp(F.col("lo"), F.col("hi"), F.col("t"), "ema"), 5).alias("value"))


@query(f"""WITH {EVENTS}, k AS (SELECT user_id, t, value FROM s WHERE event_type = 'purchase'), e AS (SELECT user_id, min(t) + 1 AS a, max(t) - 1 AS b, count(*) AS n FROM k GROUP BY user_id),
p AS (SELECT s.user_id, s.event_id, CASE WHEN e.n < 2 THEN s.t ELSE greatest(least(s.t, b), a) END AS t, e.n FROM s LEFT JOIN e USING (user_id) WHERE event_type = 'click'),
l AS (SELECT p.*, k.t AS lt, k.value AS lv FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.t >= k.t),
h AS (SELECT l.*, k.t AS ht, k.value AS hv FROM l ASOF LEFT JOIN k ON l.user_id = k.user_id AND l.t <= k.t)
SELECT event_id, round(coalesce(lv * (1 - CASE WHEN ht = lt THEN 0 ELSE (t - lt) / (ht - lt)::DOUBLE END) + hv * CASE WHEN ht = lt THEN 0 ELSE (t - lt) / (ht - lt)::DOUBLE END, lv, hv, 0), 6) + 0.0 AS value FROM h""")
def offset_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Linear look-up clamped just inside the ends; one key is constant, none is zero."""
    e = events(spark, sf)
    keys = _of_kind(e, "purchase", "value")
    ends = keys.groupBy("user_id").agg((F.min("t") + 1).alias("a"), (F.max("t") - 1).alias("b"), F.count(F.lit(1)).alias("n"))
    probes = _of_kind(e, "click").join(ends, "user_id", "left")
    at = F.when(F.col("n") >= 2, F.greatest(F.least("t", "b"), F.col("a"))).otherwise(F.col("t"))
    found = asof.bracket(probes.withColumn("t", at).select("user_id", "event_id", "t"), keys, ["user_id"], "t", "event_id", ["value"])
    return found.select("event_id", r(F.coalesce(asof.lerp(F.col("lo"), F.col("hi"), F.col("t"), "value"), F.lit(0.0))).alias("value"))


