"""Queries: joins, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ramplake.config import DAY_US
from ramplake.operators import joins, timegrid as tg
from ramplake.plans import base
from ramplake.plans.base import SQL_FARM, SQL_RAW, SQL_SERIES, SQL_WIN
from ramplake.plans.registry import load, query, rounded


@query("equi_left_join_coalesced", """SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END, c_acctbal), 2) AS measure, c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def _(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("measure"))
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("measure"), "c_nationkey")
    return rounded(joins.coalesce_join(o, c, ["k"]).select("o_orderkey", "measure", "c_nationkey"), 2)


@query("equi_inner_join", """SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def _(spark, sf):
    li = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"))
    names = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name")
    return rounded(li.join(names, "s_suppkey").groupBy("n_name").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), 2)


@query("calendar_grid_join", SQL_SERIES + "\nSELECT unit, count(*) AS bins, count(x) AS observed, count(*) - count(x) AS gaps FROM series GROUP BY unit")
def _(spark, sf):
    return base.series(spark, sf).groupBy("unit").agg(F.count("*").alias("bins"), F.count("x").alias("observed"), F.count_if(F.col("x").isNull()).alias("gaps"))


@query("day_lagged_join", """WITH d AS (SELECT o_orderdate::DATE AS day, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round(mean_price, 4) AS mean_price FROM lineitem LEFT JOIN d ON l_shipdate::DATE = day + 1""")
def _(spark, sf):
    daily = load(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("mean_price"))
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return rounded(joins.day_lagged(li, daily, "l_shipdate", "day", ["mean_price"]).drop("l_shipdate"), 4)


@query("resampled_feature_join", SQL_SERIES + """, f AS (SELECT us // 10800000000 AS b3, max(v) AS m FROM raw WHERE unit = 'error' GROUP BY 1)
SELECT unit, b, round(coalesce(m, 0), 6) AS f_value, (m IS NOT NULL)::BIGINT AS f_available, (m IS NULL)::BIGINT AS f_missing FROM series LEFT JOIN f ON b3 * 3 = b""")
def _(spark, sf):
    feature = tg.resample(base.raw_events(spark, sf).filter("unit = 'error'"), [], "us", "v", 180, "max").withColumn("b", F.col("b") * 3)
    return rounded(joins.feature_join(base.series(spark, sf).select("unit", "b"), feature, ["b"], "x", "f"))


_ASOF = SQL_RAW + """, l AS (SELECT event_id, user_id % 10 AS k, us FROM raw WHERE unit = 'click'), r AS (SELECT user_id % 10 AS k, us, v FROM raw WHERE unit = 'view'),
bf AS (SELECT l.event_id, l.k, l.us, r.us AS t, r.v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.us >= r.us), af AS (SELECT l.event_id, r.us AS t, r.v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.us <= r.us),
pick AS (SELECT bf.event_id, bf.k, bf.us, CASE WHEN bf.t IS NOT NULL AND (af.t IS NULL OR bf.us - bf.t <= af.t - bf.us) THEN bf.t ELSE af.t END AS t, CASE WHEN bf.t IS NOT NULL AND (af.t IS NULL OR bf.us - bf.t <= af.t - bf.us) THEN bf.v ELSE af.v END AS v FROM bf JOIN af USING (event_id)),
near AS (SELECT event_id, k, us, CASE WHEN abs(t - us) <= 7200000000 THEN t END AS match_us, CASE WHEN abs(t - us) <= 7200000000 THEN v END AS match_v FROM pick)
"""


def _stream(spark, sf, unit):
    return base.raw_events(spark, sf).filter(F.col("unit") == unit).select("event_id", (F.col("user_id") % 10).alias("k"), "us", "v")


@query("asof_nearest", _ASOF + "SELECT event_id, match_us, round(match_v, 4) AS match_v FROM near")
def _(spark, sf):
    left = _stream(spark, sf, "click").drop("v")
    return rounded(joins.asof_nearest(left, _stream(spark, sf, "view"), ["k"], "us", "v", 7200000000).select("event_id", "match_us", "match_v"), 4)


@query("detector_semi_join", _ASOF + """, e AS (SELECT user_id % 10 AS k, us FROM raw WHERE unit = 'error')
SELECT event_id FROM near n WHERE match_us IS NOT NULL AND EXISTS (SELECT 1 FROM e WHERE e.k = n.k AND e.us BETWEEN n.us - 7200000000 AND n.us + 7200000000)""")
def _(spark, sf):
    left = _stream(spark, sf, "click").drop("v")
    return joins.common_events(left, [_stream(spark, sf, "view"), _stream(spark, sf, "error")], ["k"], "us", 7200000000).select("event_id")


@query("hourly_interpolation_join", SQL_SERIES + """, nd AS (SELECT unit, b, q, b * 3600000000 + q * 900000000::BIGINT AS us FROM series, (VALUES (0), (1), (2), (3)) t(q))
SELECT nd.unit, us, round(CASE WHEN q = 0 THEN a.x ELSE a.x * (1 - q / 4.0::DOUBLE) + z.x * (q / 4.0::DOUBLE) END, 6) AS x FROM nd LEFT JOIN series a ON a.unit = nd.unit AND a.b = nd.b LEFT JOIN series z ON z.unit = nd.unit AND z.b = nd.b + 1""")
def _(spark, sf):
    hourly = base.series(spark, sf).select("unit", tg.bin_label("b", 60).alias("us"), "x")
    quarter = F.explode(F.array(*[F.lit(q) for q in range(4)])).alias("q")
    nodes = hourly.select("unit", "us", quarter).select("unit", (F.col("us") + F.col("q").cast("long") * 900000000).alias("us"))
    return rounded(joins.interpolate_hourly(nodes, hourly, ["unit"], "us", ["x"]))


@query("irregular_interpolation_join", SQL_RAW + """, l AS (SELECT event_id, us FROM raw WHERE unit = 'click'), r AS (SELECT us, v FROM raw WHERE unit = 'view'),
bf AS (SELECT l.event_id, l.us, r.us AS t0, r.v AS v0 FROM l ASOF LEFT JOIN r ON l.us >= r.us), af AS (SELECT l.event_id, r.us AS t1, r.v AS v1 FROM l ASOF LEFT JOIN r ON l.us <= r.us)
SELECT event_id, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (us - t0) / (t1 - t0) END, 4) AS v FROM bf JOIN af USING (event_id)""")
def _(spark, sf):
    nodes = _stream(spark, sf, "click").select("event_id", "us")
    return rounded(joins.interpolate_irregular(nodes, _stream(spark, sf, "view"), [], "us", "v").select("event_id", "v"), 4)


@query("forecast_vintage_guard", SQL_RAW + """, g AS (SELECT unit, (us - user_id * 1800000000 - (us - 86400000000)) / 3600000000 AS m FROM raw)
SELECT unit, count(*) FILTER (WHERE m > 0) AS accepted, count(*) FILTER (WHERE m <= 0) AS rejected, round(min(m), 4) AS min_margin FROM g GROUP BY unit""")
def _(spark, sf):
    out = joins.vintage_guard(base.raw_events(spark, sf), F.col("us"), F.col("us") - F.col("user_id") * 1800000000)
    return rounded(out.groupBy("unit").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.min("margin_hours").alias("min_margin")), 4)


# Intervals: user sessions under three gap rules are three "configs".
SQL_SESSIONS = """WITH raw AS (SELECT user_id AS unit, epoch_us(ts) AS us FROM events), g AS (SELECT unnest([2, 4, 8]) AS gap),
m AS (SELECT gap, unit, us, CASE WHEN us - lag(us) OVER w <= gap * 3600000000 THEN 0 ELSE 1 END AS new FROM raw, g WINDOW w AS (PARTITION BY gap, unit ORDER BY us)),
s AS (SELECT *, sum(new) OVER (PARTITION BY gap, unit ORDER BY us) AS sid FROM m),
iv AS (SELECT 'gap' || gap AS config, unit, min(us) AS start, max(us) AS "end", 'gap' || gap || ':' || unit || ':' || min(us) AS id FROM s GROUP BY gap, unit, sid HAVING max(us) > min(us))
"""


def sessions(spark, sf, gap_hours):
    """Event sessions per user; touching at exactly the gap stays one session."""
    from ramplake.operators.detect import gap_sessions
    ev = base.raw_events(spark, sf).select(F.col("user_id").alias("unit"), "us")
    out = gap_sessions(ev, ["unit"], "us", gap_hours * 3600000000).filter("end > start")
    name = f"gap{gap_hours}"
    return out.select(F.lit(name).alias("config"), "unit", "start", "end", F.concat_ws(":", F.lit(name), "unit", "start").alias("id"))


@query("interval_overlap_join_iou", SQL_SESSIONS + """, o AS (SELECT a.unit, a.id AS a_id, z.id AS b_id, least(a."end", z."end") - greatest(a.start, z.start) AS ov, a."end" - a.start AS la, z."end" - z.start AS lb FROM iv a JOIN iv z ON a.unit = z.unit AND a.config = 'gap2' AND z.config = 'gap8' WHERE least(a."end", z."end") > greatest(a.start, z.start))
SELECT unit, a_id, b_id, round(ov / (la + lb - ov), 6) AS iou FROM o WHERE ov / (la + lb - ov) >= 0.3::DOUBLE""")
def _(spark, sf):
    out = joins.overlap_scores(sessions(spark, sf, 2), sessions(spark, sf, 8), ["unit"], 0.3)
    return rounded(out.select("unit", "a_id", "b_id", "iou"))


@query("interval_overlap_join_containment", SQL_SESSIONS + """, o AS (SELECT a.unit, a.id AS a_id, z.id AS b_id, least(a."end", z."end") - greatest(a.start, z.start) AS ov, a."end" - a.start AS la, z."end" - z.start AS lb FROM iv a JOIN iv z ON a.unit = z.unit AND a.config = 'gap2' AND z.config = 'gap8' WHERE least(a."end", z."end") > greatest(a.start, z.start))
SELECT unit, a_id, b_id, round(ov / least(la, lb), 6) AS score FROM o WHERE ov / least(la, lb) >= 0.9::DOUBLE""")
def _(spark, sf):
    out = joins.overlap_scores(sessions(spark, sf, 2), sessions(spark, sf, 8), ["unit"], 0.9, "containment")
    return rounded(out.select("unit", "a_id", "b_id", "score"))


@query("window_event_containment", SQL_SESSIONS + """, w AS (SELECT unit, us // 86400000000 AS d, us // 86400000000 * 86400000000 AS s, (us // 86400000000 + 1) * 86400000000 AS e FROM raw GROUP BY ALL),
c AS (SELECT w.unit, w.d, count(*) FILTER (WHERE start >= s AND "end" <= e) AS n_inside, count(id) AS n_overlap FROM w LEFT JOIN iv ON iv.unit = w.unit AND config = 'gap4' AND start < e AND "end" > s GROUP BY 1, 2)
SELECT unit, d AS id, n_inside, n_overlap, CASE WHEN n_inside > 0 THEN 'complete' WHEN n_overlap > 0 THEN 'partial' ELSE 'none' END AS relation FROM c""")
def _(spark, sf):
    day = F.floor(F.col("us") / DAY_US)
    days = base.raw_events(spark, sf).select(F.col("user_id").alias("unit"), day.alias("id")).distinct()
    windows = days.select("unit", "id", (F.col("id") * DAY_US).alias("start"), ((F.col("id") + 1) * DAY_US).alias("end"))
    return joins.window_event_counts(windows, sessions(spark, sf, 4), ["unit"]).select("unit", "id", "n_inside", "n_overlap", "relation")


SQL_UNITS = """sites AS (SELECT s_suppkey AS id, 30 + (s_suppkey * 7 % 101) * 0.01::DOUBLE + sin(s_suppkey) * 0.003::DOUBLE AS lat, 110 + (s_suppkey * 11 % 103) * 0.013::DOUBLE + cos(s_suppkey) * 0.003::DOUBLE AS lon,
 10.0::DOUBLE * (s_suppkey * 3 % 25) AS elev, 0.01::DOUBLE * (1 + s_suppkey % 5) AS z0 FROM supplier)"""


def units(spark, sf):
    """Suppliers at made-up coordinates."""
    k = F.col("s_suppkey")
    return load(spark, sf, "supplier").select(
        k.alias("id"), (30 + (k * 7 % 101) * 0.01 + F.sin(k) * 0.003).alias("lat"), (110 + (k * 11 % 103) * 0.013 + F.cos(k) * 0.003).alias("lon"),
        (10.0 * (k * 3 % 25)).alias("elev"), (0.01 * (1 + k % 5)).alias("z0"))


_KNN = "WITH " + SQL_UNITS + """, p AS (SELECT a.id AS src, z.id AS dst, sin((radians(z.lat) - radians(a.lat)) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(z.lat)) * sin((radians(z.lon) - radians(a.lon)) / 2) ** 2 AS h,
 radians(a.lat) AS p1, radians(z.lat) AS p2, radians(z.lon) - radians(a.lon) AS dl, z.elev - a.elev AS de, sqrt(a.z0 * z.z0) AS rough FROM sites a JOIN sites z ON a.id <> z.id),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (SELECT *, 2 * 6371000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)) AS dist FROM p))
"""


@query("nearest_units_graph", _KNN + "SELECT src, dst, rank, round(dist, 3) AS distance_m FROM k WHERE rank <= 6")
def _(spark, sf):
    return rounded(joins.nearest_units(units(spark, sf), 6).select("src", "dst", "rank", "distance_m"), 3)


@query("edge_enrichment", _KNN + "SELECT src, dst, round(atan2(sin(dl) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(dl)), 6) AS bearing_rad, de AS elevation_diff_m, round(rough, 6) AS roughness_pair, round(exp(-dist / 1500), 6) AS wake_prior FROM k WHERE rank <= 6")
def _(spark, sf):
    s = units(spark, sf)
    return rounded(joins.enrich_edges(joins.nearest_units(s, 6), s).select("src", "dst", "bearing_rad", "elevation_diff_m", "roughness_pair", "wake_prior"))


_CAL = SQL_WIN + """, feat AS (SELECT n.b, w.y, any_value(w.split) AS split, max(CASE WHEN k = 0 THEN x END) AS s0, max(CASE WHEN k = 16 THEN x END) - max(CASE WHEN k = 0 THEN x END) AS net, max(x) - min(x) AS rg FROM node n JOIN win w USING (b) GROUP BY n.b, w.y),
cand AS (SELECT a.b AS ab, z.b AS bb, a.y FROM feat a JOIN feat z ON a.y = z.y AND {side} AND abs(a.b - z.b) >= 24 AND abs(a.s0 - z.s0) <= 0.1::DOUBLE AND abs(a.net - z.net) <= 0.1::DOUBLE AND abs(a.rg - z.rg) <= 0.1::DOUBLE AND least(abs(a.b % 24 - z.b % 24), 24 - abs(a.b % 24 - z.b % 24)) <= 3),
pr AS (SELECT ab, bb, c.y, sqrt(avg((p.x - q.x) ** 2)) AS distance FROM cand c JOIN node p ON p.b = ab JOIN node q ON q.b = bb AND q.k = p.k GROUP BY 1, 2, 3)
SELECT y::BIGINT AS y, ab AS a_id, bb AS b_id, round(distance, 6) AS distance FROM pr WHERE distance <= 0.15::DOUBLE"""


def _caliper_rows(spark, sf):
    return base.windows(spark, sf).select("y", "split", F.col("b").alias("id"), (F.col("b") * 3600000000).alias("us"), "path")


@query("caliper_pairs_self", _CAL.format(side="a.b < z.b"))
def _(spark, sf):
    return rounded(joins.caliper_pairs(_caliper_rows(spark, sf), None, ["y"], rmse=0.15).select("y", "a_id", "b_id", "distance"))


@query("caliper_pairs_two_groups", _CAL.format(side="a.split = 'train' AND z.split = 'test'"))
def _(spark, sf):
    rows = _caliper_rows(spark, sf)
    return rounded(joins.caliper_pairs(rows.filter("split = 'train'"), rows.filter("split = 'test'"), ["y"], rmse=0.15).select("y", "a_id", "b_id", "distance"))


@query("prediction_alignment_check", """WITH a AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2), z AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS q FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE z.q IS NULL) AS left_only, count(*) FILTER (WHERE a.q IS NULL) AS right_only, count(*) FILTER (WHERE abs(a.q - z.q) > 0.001) AS mismatched, count(*) AS keys FROM a FULL JOIN z USING (l_orderkey, l_linenumber)""")
def _(spark, sf):
    q = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    other = q.filter("l_linenumber <> 1").withColumn("q", F.col("q") + F.when(F.col("l_linenumber") == 2, 1).otherwise(0))
    return joins.alignment_check(q.filter("l_linenumber <> 7"), other, ["l_orderkey", "l_linenumber"], "q")


@query("rows_by_refit_snapshots", SQL_RAW + """, u AS (SELECT unnest(range(2800, 3000)) * 604800000000 + 345600000000 AS update_us)
SELECT update_us, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM raw JOIN u ON us >= update_us - 56 * 86400000000 AND us + 14460000000 <= update_us GROUP BY 1""")
def _(spark, sf):
    return joins.training_rows(base.raw_events(spark, sf), "us").groupBy("update_us").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("stable_multi_key_top", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_suppkey, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    return rounded(li.orderBy(F.desc("l_extendedprice"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").limit(25).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))


@query("top_k_per_group", "SELECT unit, r, event_id, v FROM (SELECT event_type AS unit, event_id, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5")
def _(spark, sf):
    w = W.partitionBy("unit").orderBy(F.desc("v"), "event_id")
    salted = W.partitionBy("unit", "_salt").orderBy(F.desc("v"), "event_id")
    ev = base.raw_events(spark, sf).select("unit", "event_id", "v").withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    best = ev.withColumn("r", F.row_number().over(salted)).filter("r <= 5")
    return best.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("unit", F.col("r").cast("long").alias("r"), "event_id", "v")


@query("arg_min_max_row", SQL_SERIES + "\nSELECT unit, arg_max(b, (x, b)) AS b_max, arg_min(b, (x, b)) AS b_min FROM series WHERE ok GROUP BY unit")
def _(spark, sf):
    s = F.struct("x", "b")
    return base.series(spark, sf).filter("ok").groupBy("unit").agg(F.max_by("b", s).alias("b_max"), F.min_by("b", s).alias("b_min"))


@query("union_aligned_columns", "SELECT source, count(*) AS n, round(sum(balance), 2) AS balance, count(nation) AS with_nation FROM (SELECT 'c' AS source, c_acctbal AS balance, c_nationkey AS nation FROM customer UNION ALL SELECT 's', s_acctbal, NULL FROM supplier) GROUP BY 1")
def _(spark, sf):
    c = load(spark, sf, "customer").select(F.lit("c").alias("source"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    s = load(spark, sf, "supplier").select(F.lit("s").alias("source"), F.col("s_acctbal").alias("balance"))
    return rounded(c.unionByName(s, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.sum("balance").alias("balance"), F.count("nation").alias("with_nation")), 2)


_SETS = SQL_SERIES + ", a AS (SELECT DISTINCT b FROM series WHERE ok AND unit = 'click'), z AS (SELECT DISTINCT b FROM series WHERE ok AND unit = 'view')\n"


@query("common_windows_intersection", _SETS + "SELECT b FROM a INTERSECT SELECT b FROM z")
def _(spark, sf):
    s = base.series(spark, sf).filter("ok")
    return s.filter("unit = 'click'").select("b").intersect(s.filter("unit = 'view'").select("b"))


@query("window_difference", _SETS + "SELECT b FROM a EXCEPT SELECT b FROM z")
def _(spark, sf):
    s = base.series(spark, sf).filter("ok")
    return s.filter("unit = 'click'").select("b").subtract(s.filter("unit = 'view'").select("b"))


@query("distinct_keep_first", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, arg_min(l_quantity, (l_partkey, l_suppkey, l_extendedprice)) AS l_quantity FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    first = F.min_by(F.struct("l_partkey", "l_quantity"), F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("r")
    return li.groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "r.l_partkey", "r.l_quantity")


@query("distinct_intervals", SQL_SESSIONS + 'SELECT DISTINCT unit, start, "end" FROM iv')
def _(spark, sf):
    all3 = [sessions(spark, sf, g).select("unit", "start", "end") for g in (2, 4, 8)]
    return all3[0].union(all3[1]).union(all3[2]).distinct()


@query("deterministic_sample", "SELECT event_id FROM (SELECT event_id, md5('41-' || event_id) AS h FROM events) ORDER BY h, event_id LIMIT 500")
def _(spark, sf):
    ev = load(spark, sf, "events").select("event_id", F.md5(F.concat(F.lit("41-"), F.col("event_id").cast("string"))).alias("h"))
    return ev.orderBy("h", "event_id").limit(500).select("event_id")
