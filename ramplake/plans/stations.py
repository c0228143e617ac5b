"""Queries: station networks. Orders of a customer's nation on a day give the product of a made-up station."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramplake.operators import stations as st
from ramplake.operators.chunks import cut_lineage
from ramplake.plans.registry import load, query, rounded
from ramplake.plans.scalar import SQL_SITES, sites

LAT, LON = 30.2, 110.3
_HAV = "2 * 6371000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h))"
SQL_ST = "WITH " + SQL_SITES + f""",
pr AS (SELECT o_orderdate::DATE - DATE '1970-01-01' AS t, c_nationkey AS station_id, avg(o_totalprice) AS value, count(*) AS n, avg(c_acctbal) AS bal FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
gm AS (SELECT id AS station_id, lat, lon, elev, {_HAV} AS distance_m, atan2(sin(dl) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(dl)) AS to_farm_rad, elev - 0 AS elevation_diff_m FROM
 (SELECT *, radians(lat) AS p1, radians({LAT}::DOUBLE) AS p2, radians({LON}::DOUBLE) - radians(lon) AS dl, sin((radians({LAT}::DOUBLE) - radians(lat)) / 2) ** 2 + cos(radians(lat)) * cos(radians({LAT}::DOUBLE)) * sin((radians({LON}::DOUBLE) - radians(lon)) / 2) ** 2 AS h FROM sites)),
nt AS (SELECT count(DISTINCT t) AS n FROM pr),
cv AS (SELECT gm.*, coalesce(c, 0) / (SELECT n FROM nt) AS coverage FROM gm LEFT JOIN (SELECT station_id, count(DISTINCT t) AS c FROM pr GROUP BY 1) USING (station_id)),
fl AS (SELECT pr.*, value / 50000 * cos(value / 50000) AS u100, value / 50000 * sin(value / 50000) AS v100 FROM pr),
al AS (SELECT fl.*, coverage, distance_m, exp(-distance_m / 350000) AS dw, greatest(cos(to_farm_rad - atan2(v100, u100)), 0) ** 2 AS align, to_farm_rad FROM fl JOIN cv USING (station_id)),
wt AS (SELECT *, (coverage >= 0.05::DOUBLE)::INT * coverage * dw * align AS w FROM al)"""


def product(spark, sf):
    o = load(spark, sf, "orders").join(load(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    t = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    daily = o.groupBy(t.alias("t"), F.col("c_nationkey").alias("station_id")).agg(F.avg("o_totalprice").alias("price"), F.count("*").alias("n"))
    meta = sites(spark, sf).withColumnRenamed("id", "station_id").drop("z0")
    out = st.normalize_stations(daily, meta, "price")
    a = F.col("value") / 50000
    return out.withColumns({"u100": a * F.cos(a), "v100": a * F.sin(a)}), meta


def _geo(spark, sf):
    prod, meta = product(spark, sf)
    prod = cut_lineage(prod)
    times = prod.agg(F.countDistinct("t")).scalar()
    return prod, st.coverage(prod, st.station_geo(meta, LAT, LON), times), times


@query("normalize_stations", SQL_ST + "\nSELECT pr.station_id, t, round(value, 4) AS value, 1.0::DOUBLE AS quality, 1.0::DOUBLE AS available, lat FROM pr JOIN sites ON id = pr.station_id")
def _(spark, sf):
    return rounded(product(spark, sf)[0].select("station_id", "t", F.round("value", 4).alias("value"), "quality", "available", "lat"))


@query("station_geometry", SQL_ST + "\nSELECT station_id, round(distance_m, 2) AS distance_m, round(to_farm_rad, 6) AS to_farm_rad, elevation_diff_m FROM gm")
def _(spark, sf):
    meta = sites(spark, sf).withColumnRenamed("id", "station_id")
    return rounded(st.station_geo(meta, LAT, LON).select("station_id", F.round("distance_m", 2).alias("distance_m"), "to_farm_rad", "elevation_diff_m"))


@query("station_coverage", SQL_ST + "\nSELECT station_id, round(coverage, 6) AS coverage FROM cv")
def _(spark, sf):
    return rounded(_geo(spark, sf)[1].select("station_id", "coverage"))


@query("flow_direction", SQL_ST + "\nSELECT station_id, count(*) AS n, round(avg(atan2(v100, u100)), 6) AS mean_dir FROM fl GROUP BY 1")
def _(spark, sf):
    return rounded(st.flow_direction(product(spark, sf)[0]).groupBy("station_id").agg(F.count("*").alias("n"), F.avg("flow_rad").alias("mean_dir")))


_GRAD = SQL_ST + """,
c0 AS (SELECT quantile_cont(lat, 0.5) AS la, quantile_cont(lon, 0.5) AS lo FROM pr JOIN sites ON id = station_id),
xy AS (SELECT t, 6371.0::DOUBLE * cos(radians(la)) * radians(lon - lo) AS x, 6371.0::DOUBLE * radians(lat - la) AS y, value AS z FROM pr JOIN sites ON id = station_id, c0),
sm AS (SELECT t, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM xy GROUP BY t),
gr AS (SELECT t, n, xx * yy - xy * xy AS det, (xz * yy - yz * xy) / nullif(xx * yy - xy * xy, 0) AS gx, (yz * xx - xz * xy) / nullif(xx * yy - xy * xy, 0) AS gy FROM sm)"""


@query("spatial_gradient_direction", _GRAD + "\nSELECT t, CASE WHEN n >= 3 AND abs(det) > 1e-9 THEN round(gx / sqrt(gx * gx + gy * gy), 5) ELSE 0 END AS proxy_u, CASE WHEN n >= 3 AND abs(det) > 1e-9 THEN round(gy / sqrt(gx * gx + gy * gy), 5) ELSE 0 END AS proxy_v, (n >= 3 AND abs(det) > 1e-9)::DOUBLE AS proxy_available FROM gr")
def _(spark, sf):
    return rounded(st.gradient_direction(product(spark, sf)[0]), 5)


@query("select_nearest_stations", SQL_ST + """, rk AS (SELECT *, row_number() OVER (ORDER BY distance_m, station_id) AS rank FROM cv),
ks AS (SELECT CASE WHEN avg(coverage) FILTER (WHERE rank <= 10) >= 0.2::DOUBLE THEN 10 WHEN avg(coverage) FILTER (WHERE rank <= 15) >= 0.2::DOUBLE THEN 15 ELSE 20 END AS k FROM rk)
SELECT station_id, rank, k::BIGINT AS k FROM rk, ks WHERE rank <= k""")
def _(spark, sf):
    return rounded(st.select_nearest(_geo(spark, sf)[1], 0.2).select("station_id", "rank", "k"))


def _upwind(spark, sf):
    prod, meta, times = _geo(spark, sf)
    prod = st.flow_direction(prod)
    return prod, meta, times


@query("select_upwind_stations", SQL_ST + """, mn AS (SELECT station_id, sum(align) / (SELECT n FROM nt) AS alignment FROM al GROUP BY 1),
sc AS (SELECT cv.station_id, coverage, coalesce(alignment, 0) AS alignment, distance_m, (coverage >= 0.05::DOUBLE)::INT * coverage * coalesce(alignment, 0) * exp(-distance_m / 350000) AS score FROM cv LEFT JOIN mn USING (station_id))
SELECT station_id, round(score, 8) AS score FROM sc WHERE score > 0 ORDER BY sc.score DESC, coverage DESC, alignment DESC, distance_m, station_id LIMIT 10""")
def _(spark, sf):
    prod, meta, times = _upwind(spark, sf)
    return rounded(st.select_upwind(prod, meta, times, threshold=0.05).select("station_id", "score"), 8)


_FALLBACK = SQL_ST + """, mn AS (SELECT station_id, sum(align) / (SELECT n FROM nt) AS alignment FROM al GROUP BY 1),
ps AS (SELECT cv.station_id, coverage, coalesce(alignment, 0) AS alignment, distance_m, coverage * coalesce(alignment, 0) * exp(-distance_m / 350000) AS possible FROM cv LEFT JOIN mn USING (station_id)),
th AS (SELECT CASE WHEN count(*) FILTER (WHERE coverage >= 0.8::DOUBLE AND possible > 0) >= 4 THEN 0.8::DOUBLE ELSE 0.05::DOUBLE END AS threshold FROM ps)
SELECT station_id, round(possible, 8) AS score FROM ps, th WHERE coverage >= threshold AND possible > 0 ORDER BY possible DESC, coverage DESC, alignment DESC, distance_m, station_id LIMIT 10"""


@query("select_upwind_fallback", _FALLBACK)
def _(spark, sf):
    prod, meta, times = _upwind(spark, sf)
    return rounded(st.select_upwind(prod, meta, times).select("station_id", "score"), 8)


def _weighted(spark, sf):
    prod, meta, times = _upwind(spark, sf)
    return st.upwind_weights(prod, meta.withColumn("distance_weight", F.exp(-F.col("distance_m") / 350000.0)), 0.05)


@query("upwind_weights", SQL_ST + "\nSELECT station_id, t, round(align, 6) AS upwind_alignment, round(w, 8) AS upwind_weight FROM wt")
def _(spark, sf):
    return _weighted(spark, sf).select("station_id", "t", F.round("upwind_alignment", 6).alias("upwind_alignment"), F.round("upwind_weight", 8).alias("upwind_weight"))


@query("station_features", SQL_ST + """
SELECT station_id, t, round(CASE WHEN t - lag(t, 1) OVER w = 1 THEN value - lag(value, 1) OVER w ELSE 0 END, 4) AS diff_1, round(CASE WHEN t - lag(t, 3) OVER w = 3 THEN value - lag(value, 3) OVER w ELSE 0 END, 4) AS diff_3,
 round(avg(value) OVER f, 3) AS mean_3, round(stddev_pop(value) OVER f, 3) AS std_3 FROM pr WINDOW w AS (PARTITION BY station_id ORDER BY t), f AS (PARTITION BY station_id ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    out = st.station_features(product(spark, sf)[0].select("station_id", "t", "value", "available"))
    return out.select("station_id", "t", F.round("diff_1", 4).alias("diff_1"), F.round("diff_3", 4).alias("diff_3"), F.round("mean_3", 3).alias("mean_3"), F.round("std_3", 3).alias("std_3"))


def _prior(weight):
    return SQL_ST + f""",
rw AS (SELECT *, {weight} AS raw FROM wt), w2 AS (SELECT *, CASE WHEN sum(raw) OVER (PARTITION BY t) > 0 THEN raw ELSE 1 END AS ww FROM rw),
pp AS (SELECT t, sum(u100 * ww) / sum(ww) AS u, sum(v100 * ww) / sum(ww) AS v, count(*) AS n, avg((w > 0)::INT) AS share, sum(ww) AS sw FROM w2 GROUP BY t)
SELECT t, round(u, 6) AS u, round(v, 6) AS v, round(sqrt(u * u + v * v), 6) AS speed, round((0.5::DOUBLE + 0.5::DOUBLE * share) * (0.5::DOUBLE + 0.5::DOUBLE * least(sw / n, 1)), 6) AS confidence, n AS stations FROM pp"""


_PCOLS = ("t", "u", "v", "speed", "confidence", "stations")


@query("network_prior_mean", _prior("1.0::DOUBLE"))
def _(spark, sf):
    return rounded(st.network_prior(_weighted(spark, sf), "mean").select(*_PCOLS))


@query("network_prior_topk", _prior("CASE WHEN row_number() OVER (PARTITION BY t ORDER BY w DESC, station_id) <= 3 THEN w ELSE 0 END"))
def _(spark, sf):
    return rounded(st.network_prior(_weighted(spark, sf), "topk", 3).select(*_PCOLS))


@query("network_prior_upwind", _prior("w"))
def _(spark, sf):
    return rounded(st.network_prior(_weighted(spark, sf), "upwind").select(*_PCOLS))


_PHYSICS = SQL_ST + """,
w2 AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY t) > 0 THEN w ELSE 1 END AS ww FROM wt),
zs AS (SELECT *, CASE WHEN count(value) OVER p >= 2 AND stddev_pop(value) OVER p >= 1e-6 THEN greatest(least((value - avg(value) OVER p) / stddev_pop(value) OVER p, 3), -3) ELSE 0 END
 * (0.25::DOUBLE + 0.75::DOUBLE * dw) * (0.35::DOUBLE + 0.65::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * align)) * (0.5::DOUBLE + 0.5::DOUBLE * coalesce(ww / nullif(max(ww) OVER p, 0), 0)) AS sg FROM w2 WINDOW p AS (PARTITION BY t)),
gg AS (SELECT t, sum(u100 * ww) / sum(ww) AS u0, sum(v100 * ww) / sum(ww) AS v0, sum(sg * cos(to_farm_rad)) AS gu, sum(sg * sin(to_farm_rad)) AS gv, sum(abs(sg)) AS ga, count(*) AS n, avg((w > 0)::INT) AS share, sum(ww) AS sw FROM zs GROUP BY t),
nn AS (SELECT *, sqrt(gu * gu + gv * gv) AS norm, sqrt(u0 * u0 + v0 * v0) AS sp FROM gg),
aa AS (SELECT *, least(norm / greatest(ga, 1e-6), 1) AS strength, gu / greatest(norm, 1e-6) AS du, gv / greatest(norm, 1e-6) AS dv FROM nn),
ag AS (SELECT *, CASE WHEN sp > 1e-6 THEN greatest((u0 * du + v0 * dv) / sp, 0) ELSE 0 END AS agree FROM aa),
mx AS (SELECT *, CASE WHEN norm > 1e-6 THEN least(greatest(0.15::DOUBLE + 0.55::DOUBLE * strength * (0.5::DOUBLE + 0.5::DOUBLE * agree), 0.15), 0.7) ELSE 0 END AS mix, CASE WHEN sp > 1e-6 THEN sp ELSE 1 END AS target,
 CASE WHEN norm > 1e-6 THEN 0.6::DOUBLE + 0.4::DOUBLE * strength * (0.5::DOUBLE + 0.5::DOUBLE * agree) ELSE 0.6 END AS extra FROM ag),
uv AS (SELECT *, (1 - mix) * u0 + mix * du * target AS u, (1 - mix) * v0 + mix * dv * target AS v FROM mx)
SELECT t, round(u, 6) AS u, round(v, 6) AS v, round(sqrt(u * u + v * v), 6) AS speed, round(least((0.5::DOUBLE + 0.5::DOUBLE * share) * (0.5::DOUBLE + 0.5::DOUBLE * least(sw / n, 1)) * extra, 1), 6) AS confidence, n AS stations FROM uv"""


@query("network_prior_physics", _PHYSICS)
def _(spark, sf):
    return rounded(st.network_prior(_weighted(spark, sf), "physics").select(*_PCOLS))


_TRUTH = SQL_ST + """, tr AS (SELECT t, max(u100) AS tu, min(v100) AS tv FROM fl GROUP BY t), mp AS (SELECT t, avg(u100) AS u, avg(v100) AS v FROM fl GROUP BY t),
er AS (SELECT *, abs(degrees(atan2(sin(atan2(v, u) - atan2(tv, tu)), cos(atan2(v, u) - atan2(tv, tu))))) AS err FROM mp JOIN tr USING (t))"""


def _truth(spark, sf):
    prod = product(spark, sf)[0]
    return prod.groupBy("t").agg(F.max("u100").alias("u"), F.min("v100").alias("v"))


@query("prior_vs_truth", _TRUTH + "\nSELECT count(*) AS n, round(avg(err), 5) AS mae_deg, round(quantile_cont(err, 0.5), 5) AS median_deg, round(quantile_cont(err, 0.9), 5) AS p90_deg, round(corr(u, tu), 5) AS corr_u, round(corr(v, tv), 5) AS corr_v FROM er")
def _(spark, sf):
    return rounded(st.prior_vs_truth(st.network_prior(_weighted(spark, sf), "mean"), _truth(spark, sf)), 5)


@query("calibrated_prior_ridge", _TRUTH + """, r AS (SELECT u, v, tu AS y FROM er WHERE t % 2 = 0), s AS (SELECT count(*) AS n, sum(u) AS su, sum(v) AS sv, sum(u * u) + 1 AS uu, sum(v * v) + 1 AS vv, sum(u * v) AS uv, sum(y) AS y, sum(u * y) AS uy, sum(v * y) AS vy FROM r),
d AS (SELECT *, n * (uu * vv - uv * uv) - su * (su * vv - uv * sv) + sv * (su * uv - uu * sv) AS det FROM s),
c AS (SELECT (y * (uu * vv - uv * uv) - su * (uy * vv - uv * vy) + sv * (uy * uv - uu * vy)) / det AS c0, (n * (uy * vv - uv * vy) - y * (su * vv - uv * sv) + sv * (su * vy - uy * sv)) / det AS c1, (n * (uu * vy - uy * uv) - su * (su * vy - uy * sv) + y * (su * uv - uu * sv)) / det AS c2 FROM d)
SELECT t, round(c0 + c1 * u + c2 * v, 4) AS calibrated FROM er, c WHERE t % 2 = 1""")
def _(spark, sf):
    prior = st.network_prior(_weighted(spark, sf), "mean").select("t", "u", "v")
    both = cut_lineage(prior.join(_truth(spark, sf).select("t", F.col("u").alias("y")), "t"))
    fitted = st.ridge_fit(both.filter("t % 2 = 0"), ["u", "v"], "y", 1.0)
    return rounded(st.ridge_apply(both.filter("t % 2 = 1"), fitted, ["u", "v"], "calibrated").select("t", "calibrated"), 4)
