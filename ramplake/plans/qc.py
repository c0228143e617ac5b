"""Queries: quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramplake.operators import qc, timegrid as tg
from ramplake.plans import base
from ramplake.plans.base import SQL_FARM, SQL_SCALED, SQL_SERIES
from ramplake.plans.registry import load, query, rounded

_CURVE = """WITH d AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity AS wind, l_extendedprice AS power, floor(l_quantity / 5)::BIGINT AS bin FROM lineitem),
c AS (SELECT l_suppkey, bin, count(*) AS n, quantile_cont(power, 0.5) AS med, quantile_cont(power, 0.25) AS q25, quantile_cont(power, 0.75) AS q75 FROM d WHERE wind >= 3 GROUP BY 1, 2),
m AS (SELECT l_suppkey, bin, quantile_cont(abs(power - med), 0.5) AS mad FROM d JOIN c USING (l_suppkey, bin) WHERE wind >= 3 GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad WHEN q75 > q25 THEN (q75 - q25) / 1.349::DOUBLE END AS sigma FROM c JOIN m USING (l_suppkey, bin)),
o AS (SELECT d.*, coalesce(n >= 20 AND (power < med - 1.5::DOUBLE * sigma OR power > med + 1.8::DOUBLE * sigma), false) AS outlier FROM d LEFT JOIN s ON s.l_suppkey = d.l_suppkey AND s.bin = d.bin AND wind >= 3)
"""


def _curve(spark, sf):
    li = load(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("wind"), F.col("l_extendedprice").alias("power"))
    return qc.power_curve_outliers(li, "l_suppkey", "wind", "power", wind_min=3.0, width=5.0, min_n=20, k_low=1.5, k_high=1.8)


@query("power_curve_outliers", _CURVE + "SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE outlier) AS dropped, round(sum(power) FILTER (WHERE NOT outlier), 2) AS kept_power FROM o GROUP BY 1")
def _(spark, sf):
    return rounded(_curve(spark, sf).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if("outlier").alias("dropped"), F.sum(F.when(~F.col("outlier"), F.col("power"))).alias("kept_power")), 2)


@query("power_curve_mask", _CURVE + "SELECT bin, count(*) AS n, count(*) FILTER (WHERE NOT outlier) AS n_power, round(avg(power) FILTER (WHERE NOT outlier), 3) AS mean_power FROM o GROUP BY 1")
def _(spark, sf):
    masked = qc.mask_outliers(_curve(spark, sf), ["power"]).withColumn("bin", F.floor(F.col("wind") / 5))
    return rounded(masked.groupBy("bin").agg(F.count("*").alias("n"), F.count("power").alias("n_power"), F.avg("power").alias("mean_power")), 3)


_OBS = SQL_SERIES + ",\nobs AS (SELECT unit, b, x, n FROM series WHERE ok)"


def _obs(spark, sf):
    return base.series(spark, sf).filter("ok").select("unit", "b", "x", "n")


def _flag():
    return (F.col("x") <= 60) & (F.col("n") >= 1)


@query("drop_farm_outage", _OBS + """, bad AS (SELECT b FROM obs GROUP BY b HAVING count(*) FILTER (WHERE x <= 60 AND n >= 1) = count(DISTINCT unit))
SELECT unit, count(*) AS n, round(sum(x), 4) AS total FROM obs WHERE b NOT IN (SELECT b FROM bad) GROUP BY 1""")
def _(spark, sf):
    return rounded(qc.drop_farm_outage(_obs(spark, sf), "b", "unit", _flag()).groupBy("unit").agg(F.count("*").alias("n"), F.sum("x").alias("total")), 4)


@query("tag_farm_outage", _OBS + """, c AS (SELECT b, count(*) FILTER (WHERE x <= 60 AND n >= 1) >= 5 AS farm_outage FROM obs GROUP BY b)
SELECT unit, b, x <= 60 AND n >= 1 AS unit_outage, farm_outage FROM obs JOIN c USING (b)""")
def _(spark, sf):
    return qc.tag_farm_outage(_obs(spark, sf), "b", "unit", _flag(), F.lit(5)).select("unit", "b", "unit_outage", "farm_outage")


@query("min_units_filter", _OBS + "\nSELECT b, count(*) AS n FROM obs WHERE b IN (SELECT b FROM obs GROUP BY b HAVING count(DISTINCT unit) >= 4) GROUP BY b")
def _(spark, sf):
    return qc.min_units(_obs(spark, sf), "b", "unit", 4).groupBy("b").agg(F.count("*").alias("n"))


def unit_sites(spark, sf):
    names = base.raw_events(spark, sf).select("unit").distinct()
    return names.select(F.col("unit").alias("id"), (F.ascii("unit") * 0.01).alias("lat"), (F.length("unit") * 0.013).alias("lon"))


@query("impute_missing_unit", _OBS + """, us AS (SELECT DISTINCT unit, ascii(unit) * 0.01::DOUBLE AS lat, length(unit) * 0.013::DOUBLE AS lon FROM obs),
nn AS (SELECT * FROM (SELECT a.unit AS src, z.unit AS dst, row_number() OVER (PARTITION BY a.unit ORDER BY sqrt((a.lat - z.lat) ** 2 + (a.lon - z.lon) ** 2), z.unit) AS r FROM us a JOIN us z ON a.unit <> z.unit) WHERE r <= 2),
t AS (SELECT b FROM obs GROUP BY b HAVING count(DISTINCT unit) = 4), miss AS (SELECT t.b, us.unit FROM t, us WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.b = t.b AND o.unit = us.unit)),
added AS (SELECT m.b, m.unit, avg(o.x) AS x FROM miss m JOIN nn ON nn.src = m.unit JOIN obs o ON o.b = m.b AND o.unit = nn.dst GROUP BY 1, 2)
SELECT b, unit, round(x, 6) AS x, false AS imputed FROM obs UNION ALL SELECT b, unit, round(x, 6), true FROM added""")
def _(spark, sf):
    return rounded(qc.impute_missing_unit(_obs(spark, sf), "b", "unit", unit_sites(spark, sf), ["x"], present=4).select("b", "unit", "x", "imputed"))


@query("missing_units_antijoin", _OBS + "\nSELECT g.b, g.unit FROM series g WHERE NOT ok AND b IN (SELECT b FROM obs)")
def _(spark, sf):
    obs = _obs(spark, sf)
    return qc.missing_units(obs, "b", "unit", obs.select("unit"), obs.select("b").distinct())


@query("drop_high_ramp", _OBS + """, farm AS (SELECT b, sum(x) AS p FROM obs GROUP BY b), r AS (SELECT b, abs(p - lag(p) OVER (ORDER BY b)) > 150 AND b - lag(b) OVER (ORDER BY b) = 1 AS bad FROM farm)
SELECT unit, count(*) AS n FROM obs WHERE b NOT IN (SELECT b FROM r WHERE bad) GROUP BY unit""")
def _(spark, sf):
    return qc.drop_high_ramp(_obs(spark, sf), "b", "x", 150.0).groupBy("unit").agg(F.count("*").alias("n"))


@query("tag_high_ramp_quantile", SQL_FARM + """, d AS (SELECT b, abs(x - lag(x) OVER (ORDER BY b)) AS s FROM farm)
SELECT b, coalesce(s >= (SELECT quantile_cont(s, 0.95) FROM d), false) AS high_ramp FROM d""")
def _(spark, sf):
    return qc.tag_high_ramp(base.farm(spark, sf), ["site"]).select("b", "high_ramp")


@query("farm_features", SQL_SERIES + """, farm AS (SELECT b, coalesce(sum(x), 0) AS power, avg(n) AS wind, count(x) AS complete_units, count(*) AS rows FROM series GROUP BY b)
SELECT b, round(power, 5) AS power, round(wind, 5) AS wind, complete_units, rows, round(power - lag(power) OVER w, 5) AS power_diff_1, round(power - lag(power, 3) OVER w, 5) AS power_diff_3,
 round(avg(power) OVER (ORDER BY b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 5) AS power_mean_3, round(power / (wind + 1), 5) AS power_ratio FROM farm WINDOW w AS (ORDER BY b)""")
def _(spark, sf):
    return rounded(qc.farm_features(base.series(spark, sf), "b", "x", "n"), 5)


@query("gap_free_train_stats", SQL_SCALED + """
SELECT round(avg(x), 6) AS mean_x, round(greatest(stddev_pop(x), 1e-6), 6) AS std_x, round(avg(n), 6) AS mean_n, round(greatest(stddev_pop(n), 1e-6), 6) AS std_n, round(quantile_cont(x, 0.995), 6) AS power_scale FROM scaled WHERE split = 'train' AND ok""")
def _(spark, sf):
    train = base.scaled(spark, sf).filter("split = 'train' AND ok")
    return rounded(qc.gap_free_train_stats(train, ["x", "n"]))


@query("unit_features", _OBS + """
SELECT unit, b, round(x / (n + 1), 6) AS ratio, round(CASE WHEN b - lag(b) OVER w = 1 THEN x - lag(x) OVER w END, 6) AS diff_1 FROM obs WINDOW w AS (PARTITION BY unit ORDER BY b)""")
def _(spark, sf):
    from ramplake.functions.scalar import safe_ratio
    out = tg.gap_guarded_diff(_obs(spark, sf), ["unit"], (1,)).withColumn("ratio", safe_ratio(F.col("x"), F.col("n")))
    return rounded(out.select("unit", "b", "ratio", "diff_1"))
