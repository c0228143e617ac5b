"""Queries: bins, grids, lags, rolling frames, runs, splits, histories, targets, fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramplake.operators import timegrid as tg
from ramplake.plans import base
from ramplake.plans.base import SQL_FARM, SQL_RAW, SQL_SCALED, SQL_SERIES, SQL_WIN
from ramplake.plans.registry import query, rounded

U = ["unit"]


@query("process_class_support", SQL_WIN + """
SELECT split, y, count(*) AS windows, count(*) FILTER (WHERE arr < 16) AS down_events, sum(arr)::BIGINT AS arr_sum FROM win GROUP BY split, y""")
def flagship(spark, sf, minutes=base.BIN):
    win = base.windows(spark, sf, minutes)
    return rounded(win.groupBy("split", "y").agg(
        F.count("*").alias("windows"), F.count_if(F.col("arr") < 16).alias("down_events"), F.sum("arr").alias("arr_sum")))


@query("regularize_min_count", SQL_SERIES + "\nSELECT unit, b, round(x, 6) AS x, ok, n::BIGINT AS n FROM series")
def _(spark, sf):
    return rounded(base.series(spark, sf).select("unit", "b", "x", "ok", F.col("n").cast("long").alias("n")))


@query("regularize_strict", SQL_SERIES + """,
native AS (SELECT unit, b, x, ok FROM series WHERE n > 0),
strict AS (SELECT unit, b // 4 AS b4, count(*) FILTER (WHERE n > 0) AS n_valid, count(*) AS n_total, avg(x) AS m FROM series GROUP BY 1, 2)
SELECT unit, b4 AS b, n_valid, n_valid = 4 AND n_total = 4 AS ok, CASE WHEN n_valid = 4 AND n_total = 4 THEN round(m, 6) END AS x FROM strict""")
def _(spark, sf):
    hourly = base.series(spark, sf).withColumn("us", tg.bin_label("b", 60))
    return rounded(tg.regularize(hourly, U, "us", "x", "ok", 240, native_minutes=60, order="b").select("unit", "b", "n_valid", "ok", "x"))


@query("regularize_end_labelled", SQL_SERIES + """,
strict AS (SELECT unit, (b - 1) // 4 AS b, count(x) AS n_valid, count(*) AS n_total FROM series GROUP BY 1, 2)
SELECT unit, count(*) AS bins, count(*) FILTER (WHERE n_valid = 4 AND n_total = 4) AS usable, count(*) FILTER (WHERE NOT (n_valid = 4 AND n_total = 4)) AS partial, 0::BIGINT AS duplicate_rows FROM strict GROUP BY unit""")
def _(spark, sf):
    hourly = base.series(spark, sf).withColumn("us", tg.bin_label("b", 60))
    out = tg.regularize(hourly, U, "us", "x", "ok", 240, native_minutes=60, position="end", order="b")
    return out.groupBy("unit").agg(F.count("*").alias("bins"), F.count_if("ok").alias("usable"), F.count_if(~F.col("ok")).alias("partial"), F.sum("duplicate_rows").alias("duplicate_rows"))


_RES = SQL_RAW + """
SELECT unit, {b} AS b, round({agg}, 6) AS x, ({b} + {lab}) * 7200000000 AS label_us FROM raw GROUP BY ALL"""


@query("resample_mean_left", _RES.format(b="us // 7200000000", agg="avg(v)", lab=0))
def _(spark, sf):
    return rounded(tg.resample(base.raw_events(spark, sf), U, "us", "v", 120))


@query("resample_mean_right_closed", _RES.format(b="(us - 1) // 7200000000", agg="avg(v)", lab=1))
def _(spark, sf):
    return rounded(tg.resample(base.raw_events(spark, sf), U, "us", "v", 120, closed="right", label="right"))


@query("resample_last", _RES.format(b="us // 7200000000", agg="arg_max(v, us)", lab=0))
def _(spark, sf):
    return rounded(tg.resample(base.raw_events(spark, sf), U, "us", "v", 120, "last"))


@query("resample_first", _RES.format(b="us // 7200000000", agg="arg_min(v, us)", lab=0))
def _(spark, sf):
    return rounded(tg.resample(base.raw_events(spark, sf), U, "us", "v", 120, "first"))


@query("resample_max", _RES.format(b="us // 7200000000", agg="max(v)", lab=0))
def _(spark, sf):
    return rounded(tg.resample(base.raw_events(spark, sf), U, "us", "v", 120, "max"))


_NEIGH = """,
near AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN b END) OVER (PARTITION BY unit ORDER BY b ROWS UNBOUNDED PRECEDING) AS pb,
  min(CASE WHEN x IS NOT NULL THEN b END) OVER (PARTITION BY unit ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb FROM {src}),
filled AS (SELECT n.unit, n.b, n.x AS x_raw, n.pb, n.nb, p.x AS px, q.x AS nx, CASE WHEN n.pb = n.nb THEN p.x ELSE p.x + (q.x - p.x) * (n.b - n.pb) / (n.nb - n.pb) END AS line
  FROM near n LEFT JOIN {src} p ON p.unit = n.unit AND p.b = n.pb LEFT JOIN {src} q ON q.unit = n.unit AND q.b = n.nb)"""


@query("resample_interpolate", SQL_SERIES + """,
fine AS (SELECT g.unit, g.b, s.x FROM (SELECT unit, unnest(range(min(b) * 2, max(b) * 2 + 1)) AS b FROM series GROUP BY unit) g
  LEFT JOIN series s ON s.unit = g.unit AND s.b * 2 = g.b)""" + _NEIGH.format(src="fine") + """
SELECT unit, b, round(coalesce(x_raw, line), 6) AS x FROM filled""")
def _(spark, sf):
    return rounded(tg.resample_interpolate(base.series(spark, sf), U, 2).select("unit", "b", "x"))


@query("gap_fill_linear", SQL_SERIES + _NEIGH.format(src="series") + """
SELECT unit, b, round(x_raw, 6) AS x_raw, round(coalesce(x_raw, CASE WHEN least(b - pb, nb - b) <= 2 AND pb IS NOT NULL AND nb IS NOT NULL THEN line END), 6) AS x,
 x_raw IS NULL AND coalesce(least(b - pb, nb - b) <= 2 AND pb IS NOT NULL AND nb IS NOT NULL, false) AS gap_filled FROM filled""")
def _(spark, sf):
    return rounded(tg.gap_fill(base.series(spark, sf), U, "linear", 2).select("unit", "b", "x_raw", "x", "gap_filled"))


@query("gap_fill_ffill", SQL_SERIES + _NEIGH.format(src="series") + """
SELECT unit, b, round(coalesce(x_raw, CASE WHEN b - pb <= 1 THEN px END), 6) AS x, x_raw IS NULL AND coalesce(b - pb <= 1, false) AS gap_filled FROM filled""")
def _(spark, sf):
    return rounded(tg.gap_fill(base.series(spark, sf), U, "ffill", 1).select("unit", "b", "x", "gap_filled"))


@query("fill_flags", SQL_SERIES + _NEIGH.format(src="series") + """
SELECT b, max((x_raw IS NULL AND coalesce(b - pb <= 1, false))::INT)::BIGINT AS flag_any, sum((x_raw IS NULL AND coalesce(b - pb <= 1, false))::INT)::BIGINT AS filled_units FROM filled GROUP BY b""")
def _(spark, sf):
    out = tg.gap_fill(base.series(spark, sf), U, "ffill", 1)
    flag = F.col("gap_filled").cast("int")
    return rounded(out.groupBy("b").agg(F.max(flag).alias("flag_any"), F.sum(flag).alias("filled_units")))


@query("kalman_smooth_fill", SQL_SERIES.replace("WITH raw", "WITH RECURSIVE raw", 1) + """,
placed AS (SELECT unit, b, x, max(CASE WHEN x IS NOT NULL THEN b END) OVER (PARTITION BY unit ORDER BY b) AS p, min(CASE WHEN x IS NOT NULL THEN b END) OVER (PARTITION BY unit ORDER BY b DESC) AS n FROM series),
fixed AS (SELECT unit, var_pop(x) AS v, arg_min(x, b) FILTER (WHERE x IS NOT NULL) AS head, min(b) AS b0, max(b) AS b1 FROM series GROUP BY unit),
forth AS (
  SELECT unit, b0 - 1 AS b, b1, v, head AS l, 0.0::DOUBLE AS t, v * 100 + 1 AS c11, 0.0::DOUBLE AS c12, v * 100 + 1 AS c22 FROM fixed
  UNION ALL
  SELECT unit, b, b1, v, CASE WHEN x IS NULL THEN pl ELSE pl + p11 / s * (x - pl) END, CASE WHEN x IS NULL THEN t ELSE t + p12 / s * (x - pl) END,
    CASE WHEN x IS NULL THEN p11 ELSE p11 - p11 / s * p11 END, CASE WHEN x IS NULL THEN p12 ELSE p12 - p11 / s * p12 END, CASE WHEN x IS NULL THEN p22 ELSE p22 - p12 / s * p12 END
  FROM (
    SELECT f.unit, f.b + 1 AS b, f.b1, f.v, r.x, f.l + f.t AS pl, f.t, f.c11 + 2 * f.c12 + f.c22 + 0.05::DOUBLE * f.v AS p11, f.c12 + f.c22 AS p12, f.c22 + 0.005::DOUBLE * f.v AS p22,
      f.c11 + 2 * f.c12 + f.c22 + 0.05::DOUBLE * f.v + 0.1::DOUBLE * f.v AS s
    FROM forth f JOIN series r ON r.unit = f.unit AND r.b = f.b + 1)),
maps AS (
  SELECT unit, b, b1, l, t, l + t AS al, ((c11 + c12) * p22 - c12 * p12) / det AS g11, (c12 * p11 - (c11 + c12) * p12) / det AS g12, ((c12 + c22) * p22 - c22 * p12) / det AS g21, (c22 * p11 - (c12 + c22) * p12) / det AS g22
  FROM (SELECT *, p11 * p22 - p12 * p12 AS det FROM (SELECT *, c11 + 2 * c12 + c22 + 0.05::DOUBLE * v AS p11, c12 + c22 AS p12, c22 + 0.005::DOUBLE * v AS p22 FROM forth))),
back AS (
  SELECT unit, b, l AS sl, t AS st FROM maps WHERE b = b1
  UNION ALL
  SELECT m.unit, m.b, m.l + g11 * (k.sl - al) + g12 * (k.st - m.t), m.t + g21 * (k.sl - al) + g22 * (k.st - m.t) FROM back k JOIN maps m ON m.unit = k.unit AND m.b = k.b - 1)
SELECT unit, b, round(x, 6) AS x_raw, round(CASE WHEN x IS NULL AND n - p - 1 <= 2 THEN sl ELSE x END, 6) AS x, coalesce(x IS NULL AND n - p - 1 <= 2, false) AS gap_filled FROM placed JOIN back USING (unit, b)""")
def _(spark, sf):
    return rounded(tg.kalman_fill(base.series(spark, sf), U, 2))


@query("gap_guarded_diff", SQL_SERIES + """,
obs AS (SELECT unit, b, x FROM series WHERE ok)
SELECT unit, b, round(CASE WHEN b - lag(b, 1) OVER w = 1 THEN x - lag(x, 1) OVER w END, 6) AS diff_1, round(CASE WHEN b - lag(b, 3) OVER w = 3 THEN x - lag(x, 3) OVER w END, 6) AS diff_3
FROM obs WINDOW w AS (PARTITION BY unit ORDER BY b)""")
def _(spark, sf):
    obs = base.series(spark, sf).filter("ok")
    return rounded(tg.gap_guarded_diff(obs, U).select("unit", "b", "diff_1", "diff_3"))


@query("rolling_mean_std", SQL_SERIES + """
SELECT unit, b, round(CASE WHEN count(x) OVER w >= 1 THEN avg(x) OVER w END, 5) AS roll_mean_3, round(CASE WHEN count(x) OVER w >= 2 THEN coalesce(stddev_samp(x) OVER w, 0) ELSE 0 END, 5) AS roll_std_3
FROM series WINDOW w AS (PARTITION BY unit ORDER BY b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return rounded(tg.rolling(base.series(spark, sf), U).select("unit", "b", "roll_mean_3", "roll_std_3"), 5)


@query("ramp_abs_rolling", SQL_SERIES + """,
st AS (SELECT unit, b, coalesce(abs(x - lag(x) OVER (PARTITION BY unit ORDER BY b)), 0) AS ramp_abs FROM series)
SELECT unit, b, round(ramp_abs, 6) AS ramp_abs, round(avg(ramp_abs) OVER w, 6) AS ramp_mean_6, round(max(ramp_abs) OVER w, 6) AS ramp_max_6
FROM st WINDOW w AS (PARTITION BY unit ORDER BY b ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return rounded(tg.ramp_abs(base.series(spark, sf), U).select("unit", "b", "ramp_abs", "ramp_mean_6", "ramp_max_6"))


_RUNS = """,
isl AS (SELECT *, b - row_number() OVER (PARTITION BY unit ORDER BY b) AS g FROM series WHERE {cond}),
runs AS (SELECT unit, min(b) AS run_start, max(b) AS run_end, count(*) AS len FROM isl GROUP BY unit, g)"""


@query("valid_runs", SQL_SERIES + _RUNS.format(cond="ok") + "\nSELECT unit, run_start, run_end, len AS bins FROM runs")
def _(spark, sf):
    runs = tg.valid_runs(base.series(spark, sf), U).filter("ok")
    return runs.groupBy("unit", "run_start", "run_end").agg(F.count("*").alias("bins"))


@query("run_length_flags", SQL_SERIES + _RUNS.format(cond="x <= 45") + """
SELECT unit, (SELECT count(*) FROM runs r WHERE r.unit = s.unit AND len >= 3) AS long_runs_n, sum(CASE WHEN EXISTS (SELECT 1 FROM runs r WHERE r.unit = s.unit AND s.b BETWEEN run_start AND run_end AND len >= 3) THEN 1 ELSE 0 END)::BIGINT AS long_bins FROM series s GROUP BY unit""")
def _(spark, sf):
    out = tg.run_length_flags(base.series(spark, sf), U, F.col("x") <= 45, 3)
    starts = tg.windowed(out, U, "b", 1, 0, lambda w: {"_s": F.col("long_run") & ~F.coalesce(F.lag("long_run", 1).over(w), F.lit(False))})
    return starts.groupBy("unit").agg(F.count_if("_s").alias("long_runs_n"), F.count_if("long_run").alias("long_bins"))


@query("chronological_split_span", SQL_SCALED + "\nSELECT split, count(*) AS n, min(b) AS first_b, max(b) AS last_b FROM splitted GROUP BY split")
def _(spark, sf):
    out = tg.chronological_split(base.series(spark, sf))
    return out.groupBy("split").agg(F.count("*").alias("n"), F.min("b").alias("first_b"), F.max("b").alias("last_b"))


@query("chronological_split_rows", SQL_SERIES + """,
g AS (SELECT min(b) AS lo, max(b) - min(b) + 1 AS total FROM series)
SELECT CASE WHEN b < lo + floor(total * 0.6::DOUBLE) THEN 'train' WHEN b < lo + floor(total * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(b) AS first_b, max(b) AS last_b FROM series, g GROUP BY 1""")
def _(spark, sf):
    out = tg.chronological_split(base.series(spark, sf), by="rows")
    return out.groupBy("split").agg(F.count("*").alias("n"), F.min("b").alias("first_b"), F.max("b").alias("last_b"))


@query("purged_masks", SQL_SCALED + """,
bb AS (SELECT DISTINCT b, c1, c2 FROM series, cuts),
m AS (SELECT 'history' AS rule, b, CASE WHEN b + 4 < c1 THEN 'train' WHEN b - 24 >= c1 AND b + 4 < c2 THEN 'validation' WHEN b - 24 >= c2 THEN 'test' END AS split FROM bb
 UNION ALL SELECT 'lead', b, CASE WHEN b + 4 < c1 THEN 'train' WHEN b - 36 >= c1 AND b + 4 < c2 THEN 'validation' WHEN b - 36 >= c2 THEN 'test' END FROM bb
 UNION ALL SELECT 'margin', b, CASE WHEN b < c1 - 4 THEN 'train' WHEN b >= c1 + 4 AND b < c2 - 4 THEN 'validation' WHEN b >= c2 + 4 THEN 'test' END FROM bb)
SELECT rule, split, count(*) AS n, min(b) AS first_b FROM m GROUP BY 1, 2""")
def _(spark, sf):
    data = base.series(spark, sf)
    c1, c2 = tg.split_cuts(data)
    bins = data.select("b").distinct()
    rules = [tg.purged(bins, c1, c2, r, 4, 24, 12).withColumn("rule", F.lit(r)) for r in ("history", "lead", "margin")]
    out = rules[0].unionByName(rules[1]).unionByName(rules[2])
    return out.groupBy("rule", "split").agg(F.count("*").alias("n"), F.min("b").alias("first_b"))


@query("lead_shift", SQL_FARM + """
SELECT t.b, l.lead, round(i.x, 6) AS x FROM farm t, (VALUES (1), (4), (8)) l(lead), farm i WHERE i.b = t.b - l.lead AND t.x IS NOT NULL""".replace("l.lead,", "l.lead::BIGINT AS lead,"))
def _(spark, sf):
    farm = base.farm(spark, sf)
    out = tg.lead_shift(farm.filter("x IS NOT NULL").select("site", "b"), farm, ["site"], base.LEADS, ["x"])
    return rounded(out.select("b", "lead", "x"))


@query("history_vector", SQL_FARM + """,
h AS (SELECT b, list(x) OVER (ORDER BY b ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS v, count(x) OVER (ORDER BY b ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS c FROM farm)
SELECT b, round(v[1], 6) AS oldest, round(v[16], 6) AS newest, round(list_sum(v), 5) AS total FROM h WHERE c = 16""")
def _(spark, sf):
    out = tg.history_vector(base.farm(spark, sf), ["site"]).filter("history IS NOT NULL")
    h = F.col("history")
    total = h[0]
    for i in range(1, 16):
        total = total + h[i]
    return rounded(out.select("b", h[0].alias("oldest"), h[15].alias("newest"), F.round(total, 5).alias("total")))


@query("history_vector_padded", SQL_FARM + """,
h AS (SELECT b, min_by(x, b) FILTER (WHERE x IS NOT NULL) OVER w AS oldest, sum(x) OVER w AS s, count(x) OVER w AS c FROM farm WINDOW w AS (ORDER BY b ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
SELECT b, round(oldest, 6) AS oldest, round(s + (16 - c) * oldest, 5) AS total FROM h WHERE c > 0""")
def _(spark, sf):
    out = tg.history_vector(base.farm(spark, sf), ["site"], pad=True).filter("history IS NOT NULL")
    total = F.aggregate("history", F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select("b", F.col("history")[0].alias("oldest"), F.round(total, 5).alias("total")))


@query("target_path", SQL_WIN + """
SELECT b, round(max(CASE WHEN k = 0 THEN x END), 6) AS first_x, round(max(CASE WHEN k = 16 THEN x END), 6) AS last_x, round(sum(x), 5) AS total FROM node GROUP BY b""")
def _(spark, sf):
    out = tg.target_path(base.farm(spark, sf), ["site"])
    return rounded(out.select("b", F.col("path")[0].alias("first_x"), F.col("path")[16].alias("last_x"),
                              F.round(F.aggregate("path", F.lit(0.0), lambda a, v: a + v), 5).alias("total")))


@query("process_class_first_passage", SQL_WIN + """,
ups AS (SELECT b, coalesce(min(CASE WHEN k > 0 AND up >= 0.3::DOUBLE - 1e-12 THEN k - 1 END), 16) AS arr_up FROM node_run GROUP BY b)
SELECT b, y::BIGINT AS y, arr::BIGINT AS arr, arr_up::BIGINT AS arr_up, split FROM win JOIN ups USING (b)""")
def _(spark, sf):
    from ramplake.functions import paths
    win = base.windows(spark, sf).withColumn("arr_up", paths.first_passage("path", base.THR, "up"))
    return rounded(win.select("b", "y", "arr", "arr_up", "split"))


@query("horizon_targets", SQL_SERIES + """
SELECT unit, b, round(CASE WHEN count(x) OVER (p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 THEN avg(x) OVER (p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END, 6) AS target_x_01,
 round(CASE WHEN count(x) OVER (p ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) = 3 THEN avg(x) OVER (p ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) END, 6) AS target_x_02
FROM series WINDOW p AS (PARTITION BY unit ORDER BY b)""")
def _(spark, sf):
    out = tg.horizon_targets(base.series(spark, sf), U, 2, 2, 3)
    return rounded(out.select("unit", "b", "target_x_01", "target_x_02"))


@query("vector_targets", SQL_SERIES + """,
uv AS (SELECT unit, b, x * cos(n) AS u, CASE WHEN n % 3 > 0 THEN x * sin(n) END AS v FROM series)
SELECT unit, b, round(CASE WHEN count(u) OVER f = 2 AND count(v) OVER f = 2 THEN avg(u) OVER f END, 6) AS target_u_01, round(CASE WHEN count(u) OVER f = 2 AND count(v) OVER f = 2 THEN avg(v) OVER f END, 6) AS target_v_01
FROM uv WINDOW f AS (PARTITION BY unit ORDER BY b ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""")
def _(spark, sf):
    uv = base.series(spark, sf).select("unit", "b", (F.col("x") * F.cos("n")).alias("u"), F.when(F.col("n") % 3 > 0, F.col("x") * F.sin("n")).alias("v"))
    out = tg.horizon_targets(uv, U, 1, 2, 2, ("u", "v"))
    return rounded(out.select("unit", "b", "target_u_01", "target_v_01"))


@query("point_target", SQL_SERIES + """,
obs AS (SELECT unit, b, x FROM series WHERE ok)
SELECT unit, b, round(CASE WHEN lead(b, 4) OVER w - b = 4 THEN lead(x, 4) OVER w END, 6) AS target FROM obs WINDOW w AS (PARTITION BY unit ORDER BY b)""")
def _(spark, sf):
    return rounded(tg.point_target(base.series(spark, sf).filter("ok"), U, 4).select("unit", "b", "target"))


_SAMPLE = SQL_FARM + """,
flagged AS (SELECT b, x IS NOT NULL AS input_ok, count(x) OVER (ORDER BY b ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) = 6 AS target_ok,
 coalesce(x < 0.2::DOUBLE, false) AS outage, coalesce(abs(x - lag(x) OVER (ORDER BY b)) >= 0.3::DOUBLE, false) AS high_ramp FROM farm),
wide AS (SELECT b, count(*) OVER wh = 18 AS is_contiguous, count(*) FILTER (WHERE input_ok) OVER bk = 12 AS is_input_complete, target_ok AS is_target_complete,
 bool_or(outage) OVER wh AS window_outage, bool_or(high_ramp) OVER wh AS window_high_ramp FROM flagged
 WINDOW wh AS (ORDER BY b ROWS BETWEEN 11 PRECEDING AND 6 FOLLOWING), bk AS (ORDER BY b ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
samples AS (SELECT *, is_contiguous AND is_input_complete AND is_target_complete AND NOT window_outage AS eligible FROM wide
 WHERE b BETWEEN (SELECT min(b) + 11 FROM farm) AND (SELECT max(b) - 6 FROM farm))"""


def _samples(spark, sf):
    farm = base.farm(spark, sf)
    flags = lambda w: {
        "input_ok": F.col("x").isNotNull(),
        "target_ok": F.count("x").over(w.rangeBetween(1, 6)) == 6,
        "outage": F.coalesce(F.col("x") < 0.2, F.lit(False)),
        "high_ramp": F.coalesce(F.abs(F.col("x") - F.lag("x", 1).over(w)) >= 0.3, F.lit(False)),
    }
    data = tg.windowed(farm, ["site"], "b", 1, 6, flags)
    return tg.sample_index(data, ["site"], 12, 6, "input_ok", "target_ok", ("outage", "high_ramp"))


@query("sample_index", _SAMPLE + "\nSELECT * FROM samples")
def _(spark, sf):
    return _samples(spark, sf).select("b", "is_contiguous", "is_input_complete", "is_target_complete", "window_outage", "window_high_ramp", "eligible")


@query("window_filter", _SAMPLE + """
SELECT CASE WHEN NOT is_contiguous THEN 'gap' WHEN NOT is_input_complete THEN 'input' WHEN NOT is_target_complete THEN 'target' ELSE 'kept' END AS reason, count(*) AS windows FROM samples GROUP BY 1""")
def _(spark, sf):
    return tg.window_filter(_samples(spark, sf), "avg")


@query("window_filter_point", _SAMPLE + """
SELECT CASE WHEN NOT is_contiguous THEN 'gap' WHEN NOT is_input_complete THEN 'input' ELSE 'kept' END AS reason, count(*) AS windows FROM samples GROUP BY 1""")
def _(spark, sf):
    return tg.window_filter(_samples(spark, sf), "point")


@query("stage_stats", SQL_RAW + """,
st AS (SELECT (us - lag(us) OVER (ORDER BY us)) / 60000000 AS step FROM (SELECT DISTINCT us FROM raw))
SELECT (SELECT count(*) FROM raw) AS n_rows, (SELECT count(DISTINCT us) FROM raw) AS n_times, (SELECT count(DISTINCT unit) FROM raw) AS n_units,
 (SELECT min(us) FROM raw) AS first_us, (SELECT max(us) FROM raw) AS last_us, round(quantile_cont(step, 0.5), 6) AS cadence_minutes, round(max(step), 6) AS max_gap_minutes,
 max(step) > 3 * quantile_cont(step, 0.5) AS gap_warning FROM st""")
def _(spark, sf):
    return rounded(tg.stage_stats(base.raw_events(spark, sf), "us", "unit"))


@query("lag_alignment", SQL_SERIES + """,
ab AS (SELECT unit, b, x, coalesce(n, 0) AS n FROM series),
l AS (SELECT unnest(range(-2, 3)) AS lag),
c AS (SELECT a.unit, l.lag, corr(a.x, z.n) AS corr FROM ab a, l, ab z WHERE z.unit = a.unit AND z.b = a.b - l.lag GROUP BY 1, 2)
SELECT unit, lag, round(corr, 6) AS corr, lag = first_value(lag) OVER (PARTITION BY unit ORDER BY corr DESC, lag) AS is_best FROM c""")
def _(spark, sf):
    data = base.series(spark, sf).withColumn("n", F.col("n").cast("double"))
    return rounded(tg.lag_alignment(data, U, "x", "n"))


@query("week_and_maturity", SQL_RAW + """
SELECT epoch_us(date_trunc('week', make_timestamp(us))) AS week_us, us // 86400000000 * 86400000000 AS day_us, count(*) AS n,
 min(us + 14460000000) AS first_fixed, max(ceil((us + 14400000000) / 3600000000)::BIGINT * 3600000000 + 60000000) AS last_hourly FROM raw GROUP BY 1, 2""")
def _(spark, sf):
    raw = base.raw_events(spark, sf)
    return raw.groupBy(tg.monday_floor_us(F.col("us")).alias("week_us"), (F.floor(F.col("us") / 86400000000) * 86400000000).alias("day_us")).agg(
        F.count("*").alias("n"), F.min(tg.maturity_us(F.col("us"))).alias("first_fixed"), F.max(tg.maturity_us(F.col("us"), "hour")).alias("last_hourly"))


@query("daily_persistence", SQL_SERIES + """
SELECT s.unit, s.b, round(p.x, 6) AS daily_1, round(q.x, 6) AS daily_4 FROM series s LEFT JOIN series p ON p.unit = s.unit AND p.b = s.b + 1 - 24 LEFT JOIN series q ON q.unit = s.unit AND q.b = s.b + 4 - 24""")
def _(spark, sf):
    return rounded(tg.daily_persistence(base.series(spark, sf), U, 24, (1, 4)).select("unit", "b", "daily_1", "daily_4"))


@query("wind_history_trend", SQL_FARM + """,
h AS (SELECT b, x, lag(x, 4) OVER (ORDER BY b) AS back, count(x) OVER (ORDER BY b ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS c, avg(x) OVER (ORDER BY b ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS m FROM farm)
SELECT b, round(m, 6) AS hist_mean, round(x - back, 6) AS trend FROM h WHERE c = 16""")
def _(spark, sf):
    out = tg.history_vector(base.farm(spark, sf), ["site"]).filter("history IS NOT NULL")
    h = F.col("history")
    return rounded(out.select("b", (F.aggregate(h, F.lit(0.0), lambda a, v: a + v) / 16).alias("hist_mean"), (h[15] - h[11]).alias("trend")))


@query("scale_and_farm_aggregate", SQL_FARM + "\nSELECT b, round(x, 6) AS x, units FROM farm")
def _(spark, sf):
    return rounded(base.farm(spark, sf).select("b", "x", "units"))


@query("fit_scale", SQL_SCALED + "\nSELECT unit, round(scale, 6) AS scale FROM scale")
def _(spark, sf):
    from ramplake.operators.detect import fit_scale
    return rounded(fit_scale(tg.chronological_split(base.series(spark, sf)), U))


# the five unit series stand for the wind components and the heat flux of one site; temperature and pressure are made of them
_FIELDS = {
    "u10": "click", "v10": "view", "u100": "error", "v100": "purchase", "sshf": "signup"}


@query("window_physics", SQL_SERIES + """,
hourly AS (
  SELECT b, u10, v10, u100, v100, 1234.567::DOUBLE * sshf AS sshf, u10 + v100 AS t2m, 1000 * v10 AS sp FROM (
    SELECT b, """ + ", ".join(f"max(x) FILTER (WHERE unit = '{u}') AS {f}" for f, u in _FIELDS.items()) + """ FROM series GROUP BY b)),
nodes AS (SELECT q, k, q + k AS place FROM (SELECT unnest(range(4 * (SELECT min(b) FROM hourly), 4 * (SELECT max(b) + 1 FROM hourly))) AS q), range(17) AS r(k)),
placed AS (
  SELECT q, k, """ + ", ".join(f"CASE WHEN place % 4 = 0 THEN l.{f} ELSE l.{f} * (1 - (place % 4) / 4.0::DOUBLE) + r.{f} * ((place % 4) / 4.0::DOUBLE) END AS {f}" for f in ("u10", "v10", "u100", "v100", "t2m", "sp")) + """
  FROM nodes n LEFT JOIN hourly l ON l.b = n.place // 4 LEFT JOIN hourly r ON r.b = n.place // 4 + 1),
flux AS (
  SELECT q, CASE WHEN count(h.sshf) = 16 THEN avg(h.sshf) / 3600 END AS heat FROM nodes n LEFT JOIN hourly h ON h.b = n.place // 4 + 1 WHERE k < 16 GROUP BY q),
whole AS (
  SELECT q, k, CASE WHEN k IN (0, 16) THEN 0.5::DOUBLE ELSE 1 END AS w, sqrt(u100 ** 2 + v100 ** 2) AS speed, sqrt((u100 - u10) ** 2 + (v100 - v10) ** 2) AS shear, u100, v100, t2m, sp FROM placed),
ends AS (SELECT a.q, z.speed - a.speed AS wind, sqrt((z.u100 - a.u100) ** 2 + (z.v100 - a.v100) ** 2) AS vector, z.t2m - a.t2m AS warm, (z.sp - a.sp) / 100 AS press
  FROM whole a JOIN whole z ON a.q = z.q AND a.k = 0 AND z.k = 16),
means AS (SELECT q, CASE WHEN count(shear) = 17 THEN sum(w * shear) / 16 END AS shear, CASE WHEN count(speed) = 17 THEN sum(w * speed) / 16 END AS speed FROM whole GROUP BY q)
SELECT m.q, round(shear, 6) AS shear, round(heat, 6) AS heat, round(speed, 6) AS speed100, round(wind, 6) AS wind_delta, round(vector, 6) AS vector_delta,
  round(warm, 6) AS temperature_delta, round(press, 6) AS pressure_delta_hpa FROM means m JOIN flux USING (q) JOIN ends USING (q)""")
def _(spark, sf):
    from ramplake.operators.physics import window_physics

    fields = {f: F.max(F.when(F.col("unit") == u, F.col("x"))).alias(f) for f, u in _FIELDS.items()}
    wide = base.series(spark, sf).groupBy("b").agg(*fields.values()).withColumn("site", F.lit("farm"))
    hourly = wide.withColumns({"t2m": F.col("u10") + F.col("v100"), "sp": 1000 * F.col("v10"), "sshf": 1234.567 * F.col("sshf")})
    starts = wide.select("site", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: 4 * F.col("b") + k)).alias("q"))
    return rounded(window_physics(hourly, starts, ["site"]).drop("site"))
