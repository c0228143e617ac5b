"""Queries: detectors, merging, catalogue, descriptors, supports, screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramplake.config import DAY_US, Protocol
from ramplake.functions import paths
from ramplake.operators.chunks import cut_lineage
from ramplake.operators import detect as dt, folds, joins, timegrid as tg
from ramplake.plans import base
from ramplake.plans.base import SQL_RAW, SQL_SCALED, SQL_WIN
from ramplake.plans.joins import SQL_SESSIONS, sessions
from ramplake.plans.registry import query, rounded

U = ["unit"]
# Hourly bins: horizons of 1, 2 and 4 bins, one day of history, two bins of context.
HOURLY = Protocol(resolution_minutes=60, history_minutes=720, composite_gap_minutes=60, composite_max_minutes=480)

SQL_RUNS = SQL_SCALED + """,
ri AS (SELECT unit, b, x, split, b - row_number() OVER (PARTITION BY unit, split ORDER BY b) AS g FROM scaled WHERE ok),
runs AS (SELECT unit, b, x, split, min(b) OVER (PARTITION BY unit, split, g) AS run_start, max(b) OVER (PARTITION BY unit, split, g) AS run_end FROM ri),
r AS (SELECT * FROM runs WHERE run_end > run_start)"""
_MOVES = ", ".join(f"CASE WHEN b - {n} >= run_start THEN x - lag(x, {n}) OVER w END AS m{n}, CASE WHEN b - {2 * n - 1} >= run_start THEN avg(x) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) - avg(x) OVER (w ROWS BETWEEN {2 * n - 1} PRECEDING AND {n} PRECEDING) END AS s{n}" for n in (1, 2, 4))
SQL_MOVES = SQL_RUNS + f""",
mv AS (SELECT *, {_MOVES} FROM r WINDOW w AS (PARTITION BY unit, run_start ORDER BY b)),
tl AS (SELECT *, {", ".join(f"CASE WHEN b - {12 + n} >= run_start THEN quantile_cont(m{n}, 0.05) OVER h END AS lo{n}, CASE WHEN b - {12 + n} >= run_start THEN quantile_cont(m{n}, 0.95) OVER h END AS hi{n}" for n in (1, 2, 4))} FROM mv WINDOW h AS (PARTITION BY unit, run_start ORDER BY b ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
hits AS ({" UNION ALL ".join([f"SELECT unit, split, run_start, run_end, 'threshold_{60 * n}min' AS config, b - {n} AS a, b AS e, sign(m{n})::INT AS sign FROM mv WHERE abs(m{n}) >= 0.2::DOUBLE" for n in (1, 2, 4)] + [f"SELECT unit, split, run_start, run_end, 'mean_shift_{60 * n}min', b - {2 * n - 1}, b, sign(s{n})::INT FROM mv WHERE abs(s{n}) >= 0.2::DOUBLE" for n in (1, 2, 4)] + [f"SELECT unit, split, run_start, run_end, 'financial_tail_{60 * n}min', b - {n}, b, sign(m{n})::INT FROM tl WHERE (m{n} < lo{n} OR m{n} > hi{n}) AND abs(m{n}) >= 0.1::DOUBLE" for n in (1, 2, 4)])}),
hn AS (SELECT *, CASE WHEN lag(sign) OVER w = sign AND a <= lag(e) OVER w THEN 0 ELSE 1 END AS new FROM hits WINDOW w AS (PARTITION BY unit, run_start, config ORDER BY e)),
hg AS (SELECT *, sum(new) OVER (PARTITION BY unit, run_start, config ORDER BY e) AS g FROM hn),
ev AS (SELECT unit, split, run_start, run_end, config, sign, min(a) AS a, max(e) AS e FROM hg GROUP BY unit, split, run_start, run_end, config, sign, g)"""
MOVING = [f"{k}_{m}min" for k in ("threshold", "financial_tail", "mean_shift") for m in (60, 120, 240)]


def runs(spark, sf):
    return dt.detection_runs(base.scaled(spark, sf), U)


def moving(spark, sf, configs=MOVING):
    return dt.detect(runs(spark, sf), U, HOURLY, configs)


def _register(kind):
    configs = [c for c in MOVING if c.startswith(kind)]

    @query(f"detect_{kind}", SQL_MOVES + f"\nSELECT unit, split, config, a, e, sign::BIGINT AS sign FROM ev WHERE config LIKE '{kind}%'")
    def _(spark, sf):
        return rounded(moving(spark, sf, configs).select("unit", "split", "config", "a", "e", "sign"))


for _kind in ("threshold", "financial_tail", "mean_shift"):
    _register(_kind)


@query("merge_signed", SQL_MOVES + "\nSELECT config, count(*) AS merged, sum(e - a)::BIGINT AS bins, (SELECT count(*) FROM hits h WHERE h.config = ev.config) AS hits FROM ev GROUP BY config")
def _(spark, sf):
    hits = dt.moving_hits(runs(spark, sf), U, HOURLY, ("threshold", "financial_tail", "mean_shift"))
    merged = dt.merge_signed(hits, U, 7).groupBy("config").agg(F.count("*").alias("merged"), F.sum(F.col("e") - F.col("a")).alias("bins"))
    return merged.join(hits.groupBy("config").agg(F.count("*").alias("hits")), "config")


# the swinging door as a recursion over the bins of each run
_SWING = SQL_RUNS + """,
rn AS MATERIALIZED (SELECT * FROM r)"""
SQL_SDA = _SWING.replace("WITH raw", "WITH RECURSIVE raw") + """,
st AS (SELECT unit, split, run_start, run_end, b, x, b AS s, x AS xs, '-Infinity'::DOUBLE AS lo, 'Infinity'::DOUBLE AS hi, NULL::BIGINT AS done_s, NULL::DOUBLE AS done_x FROM rn WHERE b = run_start
 UNION ALL
 SELECT unit, split, run_start, run_end, b, x, CASE WHEN nl >= nh - 1e-12 THEN b ELSE s END, CASE WHEN nl >= nh - 1e-12 THEN x ELSE xs END, CASE WHEN nl >= nh - 1e-12 THEN '-Infinity'::DOUBLE ELSE nl END, CASE WHEN nl >= nh - 1e-12 THEN 'Infinity'::DOUBLE ELSE nh END, CASE WHEN nl >= nh - 1e-12 THEN s END, CASE WHEN nl >= nh - 1e-12 THEN xs END
 FROM (SELECT q.*, st.s, st.xs, greatest(st.lo, (q.x - st.xs - 0.025::DOUBLE) / (q.b - st.s)) AS nl, least(st.hi, (q.x - st.xs + 0.025::DOUBLE) / (q.b - st.s)) AS nh FROM st JOIN rn q ON q.unit = st.unit AND q.run_start = st.run_start AND q.b = st.b + 1)),
seg AS (SELECT unit, split, run_start, done_s AS start, b AS "end", done_x AS x_start, x AS x_end FROM st WHERE done_s IS NOT NULL UNION ALL SELECT unit, split, run_start, s, b, xs, x FROM st WHERE b = run_end AND s < b)
"""


@query("swinging_door_segments", SQL_SDA + 'SELECT unit, split, run_start, start, "end", round(x_end - x_start, 6) AS change FROM seg')
def _(spark, sf):
    seg = folds.fold_segments(runs(spark, sf), U, "swing", epsilon=0.025)
    return rounded(seg.select("unit", "split", "run_start", "start", "end", (F.col("x_end") - F.col("x_start")).alias("change")))


@query("detect_swinging_door", SQL_SDA + "SELECT unit, split, start AS a, \"end\" AS e, sign(x_end - x_start)::BIGINT AS sign FROM seg WHERE abs(x_end - x_start) >= 0.2::DOUBLE")
def _(spark, sf):
    return rounded(dt.detect(runs(spark, sf), U, HOURLY, ["sda_florita2013_0.025"]).select("unit", "split", "a", "e", "sign"))


@query("detect_optimized_swinging_door")
def _(spark, sf):
    return rounded(dt.detect(runs(spark, sf), U, HOURLY, [f"opsda_cui2015_{m}min_0.025" for m in (60, 120, 240)]).select("unit", "split", "config", "a", "e", "sign"))


SQL_CORRIDOR = _SWING.replace("WITH raw", "WITH RECURSIVE raw") + """,
st AS (SELECT unit, split, run_start, run_end, b, x, b AS s, x AS xs, '-Infinity'::DOUBLE AS lo, 'Infinity'::DOUBLE AS hi, NULL::BIGINT AS done_s, NULL::DOUBLE AS done_x, NULL::DOUBLE AS px FROM rn WHERE b = run_start
 UNION ALL
 SELECT unit, split, run_start, run_end, b, x, CASE WHEN brk THEN b - 1 ELSE s END, CASE WHEN brk THEN pv ELSE xs END, CASE WHEN brk THEN x - pv - 0.1::DOUBLE ELSE greatest(lo, (x - xs - 0.1::DOUBLE) / (b - s)) END, CASE WHEN brk THEN x - pv + 0.1::DOUBLE ELSE least(hi, (x - xs + 0.1::DOUBLE) / (b - s)) END, CASE WHEN brk THEN s END, CASE WHEN brk THEN xs END, pv
 FROM (SELECT q.*, st.s, st.xs, st.lo, st.hi, st.x AS pv, (q.x - st.xs) / (q.b - st.s) < st.lo - 1e-12 OR (q.x - st.xs) / (q.b - st.s) > st.hi + 1e-12 AS brk FROM st JOIN rn q ON q.unit = st.unit AND q.run_start = st.run_start AND q.b = st.b + 1)),
seg AS (SELECT unit, split, run_start, done_s AS start, b - 1 AS "end", done_x AS x_start, px AS x_end FROM st WHERE done_s IS NOT NULL UNION ALL SELECT unit, split, run_start, s, b, xs, x FROM st WHERE b = run_end AND s < b)
"""


@query("detect_endpoint_corridor", SQL_CORRIDOR + "SELECT unit, split, start AS a, \"end\" AS e, sign(x_end - x_start)::BIGINT AS sign FROM seg WHERE abs(x_end - x_start) >= 0.2::DOUBLE")
def _(spark, sf):
    return rounded(dt.detect(runs(spark, sf), U, HOURLY, ["endpoint_corridor_0.100"]).select("unit", "split", "a", "e", "sign"))


@query("detect_adaptive_corridor")
def _(spark, sf):
    return rounded(dt.detect(runs(spark, sf), U, HOURLY, ["adaptive_corridor"]).select("unit", "split", "a", "e", "sign", "epsilon", "history_n", "history_mode"))


SQL_DESC = SQL_MOVES + """,
pe AS (SELECT * FROM ev WHERE config = 'threshold_120min'),
nd AS (SELECT pe.unit, pe.a, pe.e, pe.run_start, pe.run_end, r.b, r.x FROM pe JOIN r ON r.unit = pe.unit AND r.run_start = pe.run_start AND r.b BETWEEN pe.a - 2 AND pe.e + 2),
en AS (SELECT *, x - lag(x) OVER w AS d1, x - 2 * lag(x) OVER w + lag(x, 2) OVER w AS d2 FROM nd WHERE b BETWEEN a AND e WINDOW w AS (PARTITION BY unit, run_start, a, e ORDER BY b)),
ax AS (SELECT unit, run_start, a, e, max(CASE WHEN b = a THEN x END) AS xa, max(CASE WHEN b = e THEN x END) AS xe FROM nd GROUP BY 1, 2, 3, 4),
cx AS (SELECT unit, run_start, a, e, avg(CASE WHEN b < a THEN x END) AS pre, avg(CASE WHEN b > e THEN x END) AS post, count(*) FILTER (WHERE b < a) = 2 AND count(*) FILTER (WHERE b > e) = 2 AS whole FROM nd GROUP BY 1, 2, 3, 4),
ds AS (SELECT unit, run_start, a, e, any_value(xa) AS xa, any_value(xe) AS xe, max(x) - min(x) AS power_range, sum(abs(d1)) AS total_variation, max(abs(d1)) AS rate, coalesce(sum(abs(d2)), 0) AS curvature_l1, max(abs(x - (xa + (xe - xa) * (b - a) / (e - a)))) AS chord, arg_min(b, (x, b)) AS b_min, arg_max(b, (x, -b)) AS b_max FROM en JOIN ax USING (unit, run_start, a, e) GROUP BY 1, 2, 3, 4)"""


def _described(spark, sf):
    r = runs(spark, sf)
    return dt.describe(dt.detect(r, U, HOURLY, ["threshold_120min"]), r, U, HOURLY)


@query("describe_event", SQL_DESC + """
SELECT unit, a, e, round(xe - xa, 6) AS amplitude, round(power_range, 6) AS power_range, round(total_variation, 6) AS total_variation, round(rate, 6) AS max_abs_rate_per_hour, round(curvature_l1, 6) AS curvature_l1, round(chord, 6) AS max_abs_chord_residual, b_min, b_max,
 round(CASE WHEN whole THEN pre END, 6) AS pre_mean, round(CASE WHEN whole THEN post END, 6) AS post_mean, whole AS context_complete, (e - a)::DOUBLE AS duration_hours FROM ds JOIN cx USING (unit, run_start, a, e)""")
def _(spark, sf):
    return rounded(_described(spark, sf).select("unit", "a", "e", "amplitude", "power_range", "total_variation", "max_abs_rate_per_hour", "curvature_l1", "max_abs_chord_residual", "b_min", "b_max", "pre_mean", "post_mean", "context_complete", "duration_hours"))


@query("event_shape", SQL_DESC + """,
sp AS (SELECT unit, run_start, a, e, k, CASE WHEN k < 4 THEN a - 2 + 0.5::DOUBLE * k WHEN k < 21 THEN a + (e - a) * (k - 4) / 16.0::DOUBLE ELSE e + 0.5::DOUBLE * (k - 20) END AS p FROM cx, (SELECT unnest(range(25)) AS k) WHERE whole),
vv AS (SELECT s.unit, s.run_start, s.a, s.e, k, sum(x * greatest(1 - abs(b - p), 0)) AS v FROM sp s JOIN nd USING (unit, run_start, a, e) GROUP BY 1, 2, 3, 4, 5),
zz AS (SELECT v.*, v - xa AS d, max(abs(v - xa)) OVER (PARTITION BY unit, run_start, a, e) AS top FROM vv v JOIN ax USING (unit, run_start, a, e))
SELECT unit, a, e, k, round(d / top, 3) AS v FROM zz WHERE top > 0""")
def _(spark, sf):
    return rounded(_described(spark, sf).filter("shape IS NOT NULL").select("unit", "a", "e", F.posexplode("shape").alias("k", "v")), 3)


SQL_COMP = SQL_MOVES + """,
ld AS (SELECT *, lead(a) OVER w AS c, lead(e) OVER w AS d, lead(sign) OVER w AS other FROM ev WINDOW w AS (PARTITION BY unit, run_start, config ORDER BY a, e)),
cp AS (SELECT * FROM ld WHERE sign * other < 0 AND d > e AND c - e <= 1 AND d - a <= 8),
tn AS (SELECT cp.unit, cp.split, cp.run_start, cp.config, cp.a, cp.e, cp.c, cp.d, cp.sign, arg_max(r.b, (r.x * cp.sign, -r.b)) AS turn, arg_max(r.x, (r.x * cp.sign, -r.b)) AS xt, max(CASE WHEN r.b = cp.a THEN r.x END) AS xa, max(CASE WHEN r.b = cp.d THEN r.x END) AS xd FROM cp JOIN r ON r.unit = cp.unit AND r.b BETWEEN cp.a AND cp.d GROUP BY ALL),
comp AS (SELECT DISTINCT ON (unit, run_start, config, a, d, turn) * FROM tn WHERE turn > a AND turn < d AND least(abs(xt - xa), abs(xd - xt)) >= 0.1::DOUBLE ORDER BY unit, run_start, config, a, d, turn, e, c)"""


@query("composite_events", SQL_COMP + "\nSELECT unit, split, config, a, d AS e, turn AS turning, CASE WHEN sign > 0 THEN 'inverted_v' ELSE 'v' END AS event_kind, sign(xd - xa)::BIGINT AS sign, e AS first_end, c AS second_start FROM comp")
def _(spark, sf):
    r = runs(spark, sf)
    out = dt.composites(dt.detect(r, U, HOURLY, MOVING), r, U, HOURLY)
    return rounded(out.select("unit", "split", "config", "a", "e", "turning", "event_kind", "sign", "first_end", "second_start"))


@query("build_catalog", SQL_COMP + """,
cat AS (SELECT unit, split, config, 'primitive' AS event_level, CASE WHEN sign > 0 THEN 'rise' ELSE 'fall' END AS event_kind, a, e FROM ev UNION ALL SELECT unit, split, config, 'composite', CASE WHEN sign > 0 THEN 'inverted_v' ELSE 'v' END, a, d FROM comp)
SELECT event_level, event_kind, concat_ws(':', 'farm', unit, 'r60_h720_c120_a0.2_q0.05_f0.1_e0.025', 'training_q995', split, config, event_level, event_kind, a, e) AS event_id FROM cat""")
def _(spark, sf):
    return dt.build_catalog(base.scaled(spark, sf), U, HOURLY, site="farm", configurations=MOVING).select("event_level", "event_kind", "event_id")


@query("catalog_audit", SQL_COMP + """,
n AS (SELECT unit, count(*) AS c FROM (SELECT unit FROM ev UNION ALL SELECT unit FROM comp) GROUP BY 1)
SELECT s.unit, count(*) AS rows, count(*) FILTER (WHERE ok) AS valid_rows, min(b) AS first_b, max(b) AS last_b, any_value(coalesce(c, 0)) AS candidates FROM scaled s LEFT JOIN n USING (unit) GROUP BY s.unit""")
def _(spark, sf):
    data = base.scaled(spark, sf)
    cat = dt.build_catalog(data, U, HOURLY, site="farm", configurations=MOVING)
    return dt.catalog_audit(data, cat, U).drop("complete_shapes")


@query("threshold_sensitivity", SQL_WIN + """,
lab AS (SELECT n.b, t.thr, (max(up) >= t.thr - 1e-12)::INT + 2 * (max(down) >= t.thr - 1e-12)::INT AS cls, coalesce(min(CASE WHEN k > 0 AND down >= t.thr - 1e-12 THEN k - 1 END), 16) AS arr FROM node_run n, (VALUES (0.15::DOUBLE), (0.2::DOUBLE), (0.25::DOUBLE), (0.3::DOUBLE)) t(thr) GROUP BY 1, 2)
SELECT thr, count(*) AS windows, round(avg((l.cls = w.y)::INT), 6) AS class_match, round(avg((l.arr = w.arr)::INT), 6) AS arrival_match FROM lab l JOIN win w USING (b) GROUP BY thr""")
def _(spark, sf):
    win = paths.with_excursions(base.windows(spark, sf), "path").select("y", "arr", "ups", "downs")
    lab = win.withColumn("thr", F.explode(F.array(*[F.lit(t) for t in (0.15, 0.2, 0.25, 0.3)])))
    lab = lab.select("y", "arr", "thr", paths.class_at(F.col("thr")).alias("cls"), paths.passage_at(F.col("thr")).alias("arrival"))
    return rounded(lab.groupBy("thr").agg(F.count("*").alias("windows"), F.avg((F.col("cls") == F.col("y")).cast("int")).alias("class_match"), F.avg((F.col("arrival") == F.col("arr")).cast("int")).alias("arrival_match")))


@query("event_supports", """WITH raw AS (SELECT user_id AS unit, epoch_us(ts) AS us, event_type AS method FROM events), p AS (SELECT unit, us, CASE WHEN us - lag(us) OVER w > 14400000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new, method FROM raw WINDOW w AS (PARTITION BY unit ORDER BY us)),
g AS (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY us) AS s FROM p)
SELECT unit, min(us) - 7200000000 AS start, max(us) + 7200000000 AS "end", count(*) AS anchor_count, string_agg(DISTINCT method, ';' ORDER BY method) AS methods FROM g GROUP BY unit, s""")
def _(spark, sf):
    ev = base.raw_events(spark, sf).select(F.col("user_id").alias("unit"), "us", F.col("unit").alias("method"))
    return dt.event_supports(ev, U, "us", "method", 14400000000, 7200000000)


@query("support_components", SQL_SESSIONS + """, pad AS (SELECT unit, start - 3600000000 AS start, "end" + 3600000000 AS "end" FROM iv),
o AS (SELECT unit, start, max("end") OVER (PARTITION BY unit ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pad)
SELECT unit, count(*) FILTER (WHERE reach IS NULL OR start > reach) AS components FROM o GROUP BY unit""")
def _(spark, sf):
    all3 = sessions(spark, sf, 2).unionByName(sessions(spark, sf, 4)).unionByName(sessions(spark, sf, 8))
    padded = all3.select("unit", (F.col("start") - 3600000000).alias("start"), (F.col("end") + 3600000000).alias("end"))
    return dt.support_components(padded, U)


@query("lifecycle_vectors", SQL_MOVES + """,
pe AS (SELECT DISTINCT unit, a, e FROM ev WHERE config = 'threshold_120min'),
gp AS (SELECT pe.unit, pe.a, pe.e, count(s.x) = pe.e - pe.a + 9 AS whole FROM pe JOIN scaled s ON s.unit = pe.unit AND s.b BETWEEN pe.a - 4 AND pe.e + 4 GROUP BY 1, 2, 3),
sp AS (SELECT unit, a, e, k, CASE WHEN k < 4 THEN a - 4 + k WHEN k < 13 THEN a + (e - a) * (k - 4) / 8.0::DOUBLE ELSE e + k - 12 END AS p FROM gp, (SELECT unnest(range(17)) AS k) WHERE whole),
vv AS (SELECT sp.unit, a, e, k, sum(x * greatest(1 - abs(b - p), 0)) AS v FROM sp JOIN scaled s ON s.unit = sp.unit AND s.b BETWEEN a - 4 AND e + 4 GROUP BY 1, 2, 3, 4),
v0 AS (SELECT *, v - first_value(v) OVER (PARTITION BY unit, a, e ORDER BY k) AS d FROM vv), nn AS (SELECT *, d / max(abs(d)) OVER (PARTITION BY unit, a, e) AS z FROM v0),
st AS (SELECT *, z - lag(z) OVER (PARTITION BY unit, a, e ORDER BY k) AS dz FROM nn)
SELECT unit, a, e, round(sum(abs(dz)), 5) AS total_variation FROM st GROUP BY 1, 2, 3""")
def _(spark, sf):
    ev = moving(spark, sf, ["threshold_120min"])
    return rounded(dt.lifecycle_vectors(ev, base.scaled(spark, sf), U).select("unit", "a", "e", "total_variation"), 5)


@query("stratified_screens", SQL_SCALED + """,
c AS (SELECT unit, b, x, CASE WHEN count(x) OVER f = 5 THEN max(x) OVER f - min(x) OVER f END AS spread, CASE WHEN count(x) OVER f = 5 THEN avg(x) OVER f END AS lev, lead(x, 2) OVER w - lag(x, 2) OVER w AS net FROM scaled WINDOW w AS (PARTITION BY unit ORDER BY b), f AS (PARTITION BY unit ORDER BY b ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
s AS (SELECT unit, 'steady' AS stratum FROM c WHERE spread <= 0.04::DOUBLE AND lev > 0.1::DOUBLE UNION ALL SELECT unit, 'rising' FROM c WHERE net >= 0.2::DOUBLE UNION ALL SELECT unit, 'falling' FROM c WHERE net <= -0.2::DOUBLE UNION ALL SELECT unit, 'turning' FROM c WHERE spread >= 0.2::DOUBLE AND abs(net) <= 0.35::DOUBLE * spread UNION ALL SELECT unit, 'random' FROM c WHERE x IS NOT NULL)
SELECT unit, stratum, count(*) AS n FROM s GROUP BY 1, 2""")
def _(spark, sf):
    return dt.screens(base.scaled(spark, sf), U).groupBy("unit", "stratum").agg(F.count("*").alias("n"))


@query("spaced_quota_sample")
def _(spark, sf):
    return dt.spaced_sample(dt.screens(base.scaled(spark, sf), U), U, {"turning": 20, "rising": 20, "random": 20}, 4)


@query("population_groups", SQL_COMP + """,
iv AS (SELECT DISTINCT unit, 'composite' AS lev, a, d AS e FROM comp UNION SELECT DISTINCT unit, 'primitive', a, e FROM ev),
w AS (SELECT unit, b // 12 AS id, min(b) // 12 * 12 AS s, min(b) // 12 * 12 + 12 AS t FROM scaled GROUP BY 1, 2),
c AS (SELECT w.unit, w.id, count(*) FILTER (WHERE lev = 'composite' AND a >= s AND e <= t) AS ci, count(*) FILTER (WHERE lev = 'primitive' AND a >= s AND e <= t) AS pi, count(lev) AS o FROM w LEFT JOIN iv ON iv.unit = w.unit AND a < t AND e > s GROUP BY 1, 2)
SELECT unit, CASE WHEN ci > 0 THEN 'complete_composite' WHEN pi > 0 THEN 'complete_primitive' WHEN o > 0 THEN 'partial_only' ELSE 'none' END AS population, count(*) AS windows FROM c GROUP BY 1, 2""")
def _(spark, sf):
    data = base.scaled(spark, sf)
    r = dt.detection_runs(data, U)
    ev = cut_lineage(dt.detect(r, U, HOURLY, MOVING))
    interval = lambda d: d.select("unit", F.col("a").alias("start"), F.col("e").alias("end")).distinct().withColumn("id", F.concat_ws("-", "start", "end"))
    windows = data.select("unit", F.floor(F.col("b") / 12).alias("id")).distinct().select("unit", "id", (F.col("id") * 12).alias("start"), (F.col("id") * 12 + 12).alias("end"))
    first = joins.window_event_counts(windows, interval(dt.composites(ev, r, U, HOURLY)), U).select("unit", "id", "start", "end", F.col("n_inside").alias("ci"), F.col("n_overlap").alias("co"))
    both = joins.window_event_counts(first, interval(ev), U).withColumn("o", F.col("co") + F.col("n_overlap"))
    return both.withColumn("population", dt.population_group("ci", "n_inside", "o")).groupBy("unit", "population").agg(F.count("*").alias("windows"))
