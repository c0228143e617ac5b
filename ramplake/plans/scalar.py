"""Queries: geometry, calendar terms, safe arithmetic, path features, settlement, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramplake.functions import economics as ec, encoding as en, geo, paths, scalar as sc
from ramplake.operators import timegrid as tg
from ramplake.operators.chunks import exact_quantiles
from ramplake.plans import base
from ramplake.plans.base import SQL_RAW, SQL_SCALED, SQL_WIN
from ramplake.plans.registry import load, query, rounded

# Made-up coordinates for the 25 nations; suppliers inherit them.
SQL_SITES = """sites AS (SELECT n_nationkey AS id, 30 + (n_nationkey * 7 % 25) * 0.02::DOUBLE AS lat, 110 + (n_nationkey * 11 % 25) * 0.03::DOUBLE AS lon,
 10.0::DOUBLE * (n_nationkey * 3 % 25) AS elev, 0.01::DOUBLE * (1 + n_nationkey % 5) AS z0 FROM nation)"""


def sites(spark, sf):
    k = F.col("n_nationkey")
    return load(spark, sf, "nation").select(
        k.alias("id"), (30 + (k * 7 % 25) * 0.02).alias("lat"), (110 + (k * 11 % 25) * 0.03).alias("lon"),
        (10.0 * (k * 3 % 25)).alias("elev"), (0.01 * (1 + k % 5)).alias("z0"))


_PAIR = "WITH " + SQL_SITES + """,
pairs AS (SELECT a.id AS src, b.id AS dst, radians(a.lat) AS p1, radians(b.lat) AS p2, radians(b.lon) - radians(a.lon) AS dl FROM supplier s JOIN sites a ON a.id = s.s_nationkey JOIN sites b ON b.id = s.s_suppkey % 25)
"""


def _site_pairs(spark, sf):
    s = sites(spark, sf)
    a = s.select(F.col("id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = s.select(F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    sup = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 25).alias("dst"))
    return sup.join(a, "src").join(b, "dst")


@query("haversine_distance", _PAIR + """SELECT src, dst, round(2 * 6371000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres
FROM (SELECT src, dst, sin((p2 - p1) / 2) ** 2 + cos(p1) * cos(p2) * sin(dl / 2) ** 2 AS h FROM pairs)""")
def _(spark, sf):
    return rounded(_site_pairs(spark, sf).select("src", "dst", geo.haversine_m("lat1", "lon1", "lat2", "lon2").alias("metres")), 3)


@query("bearing", _PAIR + "SELECT src, dst, round(atan2(sin(dl) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(dl)), 6) AS bearing FROM pairs WHERE src <> dst")
def _(spark, sf):
    return rounded(_site_pairs(spark, sf).filter("src <> dst").select("src", "dst", geo.bearing_rad("lat1", "lon1", "lat2", "lon2").alias("bearing")))


@query("circular_difference", SQL_RAW + "\nSELECT event_id, round(abs(degrees(atan2(sin(v - user_id), cos(v - user_id)))), 6) AS diff_deg FROM raw")
def _(spark, sf):
    return rounded(base.raw_events(spark, sf).select("event_id", geo.circular_diff_deg(F.col("v"), F.col("user_id").cast("double")).alias("diff_deg")))


@query("wind_components", """SELECT l_orderkey, l_linenumber, round(-(l_quantity / 3.6::DOUBLE) * sin(radians(l_suppkey * 3.6::DOUBLE)), 6) AS u, round(-(l_quantity / 3.6::DOUBLE) * cos(radians(l_suppkey * 3.6::DOUBLE)), 6) AS v,
 round(l_quantity / 3.6::DOUBLE, 6) AS speed FROM lineitem""")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    u, v = geo.wind_uv(F.col("l_quantity"), F.col("l_suppkey") * 3.6)
    out = li.select("l_orderkey", "l_linenumber", u.alias("u"), v.alias("v")).withColumn("speed", geo.speed_dir(F.col("u"), F.col("v"))["speed"])
    return rounded(out)


@query("speed_direction", SQL_RAW + """,
uv AS (SELECT event_id, cos(v) * v AS u, sin(v) * v AS w FROM raw)
SELECT event_id, round(sqrt(u * u + w * w), 6) AS speed, round(w / sqrt(u * u + w * w), 6) AS dir_sin, round(u / sqrt(u * u + w * w), 6) AS dir_cos FROM uv""")
def _(spark, sf):
    uv = base.raw_events(spark, sf).select("event_id", (F.cos("v") * F.col("v")).alias("u"), (F.sin("v") * F.col("v")).alias("w"))
    d = geo.speed_dir(F.col("u"), F.col("w"))
    return rounded(uv.select("event_id", *[d[k].alias(k) for k in ("speed", "dir_sin", "dir_cos")]))


@query("parse_coordinates", """SELECT s_suppkey, round((CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END) * (30 + s_suppkey % 40 + (s_suppkey % 60) / 60.0::DOUBLE + (s_suppkey % 59) / 3600.0::DOUBLE), 6) AS degrees, round(s_acctbal, 2) AS elevation FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    sign = F.when(k % 3 == 0, "-").otherwise("")
    text = F.concat(sign, (30 + k % 40).cast("string"), F.lit("°"), (k % 60).cast("string"), F.lit("′"), (k % 59).cast("string"), F.lit('"'))
    sup = load(spark, sf, "supplier")
    elev = F.concat(F.col("s_acctbal").cast("string"), F.lit(" m"))
    return rounded(sup.select("s_suppkey", geo.parse_degrees(text).alias("degrees"), F.round(geo.parse_elevation(F.regexp_replace(elev, " ", "")), 2).alias("elevation")))


_H = "((extract(hour FROM ts) + extract(minute FROM ts) / 60.0::DOUBLE))"


@query("calendar_week", f"""SELECT event_id, round(sin(2 * pi() * {_H} / 24), 6) AS hour_sin, round(cos(2 * pi() * {_H} / 24), 6) AS hour_cos,
 round(sin(2 * pi() * (isodow(ts) - 1 + {_H} / 24) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1 + {_H} / 24) / 7), 6) AS dow_cos FROM events""")
def _(spark, sf):
    ev = load(spark, sf, "events")
    return rounded(ev.select("event_id", *[c.alias(n) for n, c in sc.calendar_harmonics(F.col("ts")).items()]))


@query("calendar_quarter_local", f"""SELECT event_id, round(sin(2 * pi() * {_H} / 24), 6) AS hour_sin, round(cos(2 * pi() * {_H} / 24), 6) AS hour_cos,
 round(sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE), 6) AS doy_cos,
 (minute(ts) // 15 = 1)::BIGINT AS quarter_1, (minute(ts) // 15 = 2)::BIGINT AS quarter_2, (minute(ts) // 15 = 3)::BIGINT AS quarter_3
FROM (SELECT event_id, ts + INTERVAL 8 HOUR AS ts FROM events)""")
def _(spark, sf):
    ev = load(spark, sf, "events")
    return rounded(ev.select("event_id", *[c.alias(n) for n, c in sc.calendar_harmonics(F.col("ts"), "quarter", "Asia/Shanghai").items()]))


@query("future_calendar", f"""SELECT event_id, round(sin(2 * pi() * {_H} / 24), 6) AS hour_sin, round(cos(2 * pi() * (isodow(ts) - 1 + {_H} / 24) / 7), 6) AS dow_cos FROM (SELECT event_id, ts + INTERVAL 720 MINUTE AS ts FROM events)""")
def _(spark, sf):
    cal = sc.future_calendar(F.col("ts"), 720)
    return rounded(load(spark, sf, "events").select("event_id", cal["hour_sin"].alias("hour_sin"), cal["dow_cos"].alias("dow_cos")))


@query("safe_ratio", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount - 0.05::DOUBLE <> 0 THEN l_tax / (l_discount - 0.05::DOUBLE) END, 6) AS ratio FROM lineitem")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", sc.safe_ratio(F.col("l_tax"), F.col("l_discount"), -0.05).alias("ratio")))


@query("missing_indicators", """SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey % 4 > 0 THEN s_acctbal END AS s_acctbal, (s_nationkey % 4 = 0)::BIGINT AS s_acctbal_missing FROM supplier""")
def _(spark, sf):
    sup = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_nationkey") % 4 > 0, F.col("s_acctbal")).alias("s_acctbal"))
    return rounded(sc.missing_indicators(sup, ["s_suppkey"]))


@query("stability_bins", """WITH l AS (SELECT s_suppkey, greatest(least((s_acctbal - 4500) / 8, 500), -500) AS v FROM supplier),
k AS (SELECT s_suppkey, CASE WHEN abs(v) >= 1 THEN v END AS v FROM l), z AS (SELECT s_suppkey, v, greatest(least(v / 200, 1), -1) AS s FROM k)
SELECT s_suppkey, round(s, 6) AS l_scaled, CASE WHEN v IS NULL OR abs(s) >= 1 THEN 0.5::DOUBLE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l_grade, CASE WHEN abs(s) < 0.25::DOUBLE THEN 0 WHEN abs(s) < 0.5::DOUBLE THEN 1 WHEN abs(s) < 1 THEN 2 ELSE 3 END::BIGINT AS l_bin FROM z""")
def _(spark, sf):
    sup = load(spark, sf, "supplier")
    return rounded(sup.select("s_suppkey", *[c.alias(n) for n, c in sc.stability_bins((F.col("s_acctbal") - 4500) / 8).items()]))


@query("drop_unstable", "SELECT count(*) AS kept FROM (SELECT (s_acctbal - 4500) / 8 AS l, s_nationkey FROM supplier) WHERE s_nationkey = 3 OR abs(l) >= 100")
def _(spark, sf):
    sup = load(spark, sf, "supplier").select(F.when(F.col("s_nationkey") != 3, (F.col("s_acctbal") - 4500) / 8).alias("l"))
    return sc.drop_unstable(sup, "l", 100.0).agg(F.count("*").alias("kept"))


@query("speed_buckets", """WITH m AS (SELECT l_suppkey, l_shipdate, avg(l_quantity) / 3 AS v FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, epoch_us(l_shipdate) AS us, (v >= 0 AND v < 5)::BIGINT AS bucket_0, (v >= 5 AND v < 10)::BIGINT AS bucket_1, (v >= 10 AND v < 15)::BIGINT AS bucket_2, (v >= 15)::BIGINT AS bucket_3, round(ln(1 + v), 6) AS log_speed FROM m""")
def _(spark, sf):
    m = load(spark, sf, "lineitem").groupBy("l_suppkey", F.unix_micros("l_shipdate").alias("us")).agg((F.avg("l_quantity") / 3).alias("v"))
    return rounded(m.select("l_suppkey", "us", *[c.alias(n) for n, c in sc.speed_bucket(F.col("v"), [0.0, 5.0, 10.0, 15.0]).items()]))


_NODE = SQL_WIN + ",\nstats AS (SELECT b, sum(x) / 17 AS m, max(x) - min(x) AS r, max(CASE WHEN k = 0 THEN x END) AS x0, max(CASE WHEN k = 16 THEN x END) AS x16, min(x) AS lo, max(x) AS hi FROM node GROUP BY b)\n"


@query("issue_context", _NODE + """SELECT b, round(x0, 6) AS f0, round(x0 * x0, 6) AS f1, round((x16 - x0) / 5, 6) AS f2, round(-(x16 - x0) / 5, 6) AS f3, round(m / 20, 6) AS f4, round(r / 10, 6) AS f5, round(x0 * (x16 - x0) / 5, 6) AS f6 FROM stats""")
def _(spark, sf):
    win = base.windows(spark, sf).withColumn("back", F.reverse("path"))
    c = win.select("b", paths.issue_context(F.col("path")[0], "path", "back").alias("c"))
    return rounded(c.select("b", *[F.col("c")[i].alias(f"f{i}") for i in range(7)]))


@query("coarse_excess_variation", _NODE + """, coarse AS (SELECT b, k, x, x - lag(x) OVER (PARTITION BY b ORDER BY k) AS d FROM node WHERE (k + b) % 4 = 0 OR k IN (0, 16))
SELECT c.b, round(greatest(sum(abs(d)) - abs(any_value(x16) - any_value(x0)), 0) / 10, 6) AS excess FROM coarse c JOIN stats s USING (b) GROUP BY c.b""")
def _(spark, sf):
    return rounded(base.windows(spark, sf).select("b", paths.coarse_excess_variation("path", F.pmod("b", F.lit(4))).alias("excess")))


@query("sorted_interior", SQL_WIN + """, r AS (SELECT b, CASE WHEN k IN (0, 16) THEN k ELSE row_number() OVER (PARTITION BY b, k IN (0, 16) ORDER BY x) END AS pos, x FROM node)
SELECT b, pos, round(x, 6) AS x FROM r""")
def _(spark, sf):
    out = base.windows(spark, sf).select("b", F.posexplode(paths.sorted_interior("path")).alias("pos", "x"))
    return rounded(out)


@query("residual_summary", _NODE + "SELECT b, round(m / 5, 6) AS r0, round(x0 / 5, 6) AS r1, round(x16 / 5, 6) AS r2, round(lo / 5, 6) AS r3, round(hi / 5, 6) AS r4, round((x16 - x0) / 5, 6) AS r5, round(r / 5, 6) AS r6 FROM stats")
def _(spark, sf):
    out = base.windows(spark, sf).select("b", paths.residual_summary("path").alias("r"))
    return rounded(out.select("b", *[F.col("r")[i].alias(f"r{i}") for i in range(7)]))


@query("response_features", _NODE + "SELECT b, 29::BIGINT AS width, round(x0 / 20, 6) AS first_node, round(m / 20, 6) AS level, round((x16 - x0) / 5, 6) AS net, round(r / 10, 6) AS range_term FROM stats")
def _(spark, sf):
    known = F.array(*[F.lit(float(i)) for i in range(9)])
    out = base.windows(spark, sf).select("b", paths.response_features(known, "path").alias("f"))
    return rounded(out.select("b", F.size("f").alias("width"), F.col("f")[9].alias("first_node"), F.col("f")[26].alias("level"), F.col("f")[27].alias("net"), F.col("f")[28].alias("range_term")))


@query("path_summary", SQL_WIN + """, mem AS (SELECT b, b // 24 AS day, split FROM win), s AS (SELECT m.day, n.b, avg(x) AS mean_x, max(x) - min(x) AS range_x, max(CASE WHEN k = 16 THEN x END) - max(CASE WHEN k = 0 THEN x END) AS net, max(CASE WHEN k = 0 THEN x END) AS x0, max(CASE WHEN k = 16 THEN x END) AS x16 FROM mem m JOIN node n USING (b) GROUP BY 1, 2)
SELECT day, round(avg(mean_x) / 20, 6) AS level, round(avg(range_x) / 10, 6) AS range_mean, round(avg(net) / 5, 6) AS net_mean, round(quantile_cont(range_x, 0.1) / 10, 6) AS range_q10, round(quantile_cont(range_x, 0.9) / 10, 6) AS range_q90, round(avg(x0) / 20, 6) AS first_node, round(avg(x16) / 20, 6) AS last_node FROM s GROUP BY day""")
def _(spark, sf):
    from ramplake.operators.scoring import path_summary
    members = base.windows(spark, sf).withColumn("day", F.floor(F.col("b") / 24))
    return rounded(path_summary(members, ["day"], "path"))


@query("node_summary", SQL_WIN + "\nSELECT b, round(avg(x), 6) AS mean_x, round(stddev_pop(x), 6) AS std_x, round(max(CASE WHEN k = 0 THEN x END), 6) AS first_x, round(max(CASE WHEN k = 16 THEN x END), 6) AS last_x FROM node GROUP BY b")
def _(spark, sf):
    from ramplake.operators.scoring import node_summary
    return rounded(node_summary(base.windows(spark, sf), ["b"], "path", "x"))


@query("fixed_projection", SQL_WIN + """, z AS (SELECT n.b, n.k, n.x, (n.x - s.m) / s.sd AS z FROM node n JOIN (SELECT k, avg(x) AS m, stddev_pop(x) AS sd FROM node JOIN win USING (b) WHERE split = 'train' GROUP BY k) s USING (k))
SELECT b, round(sum(z * (((k * 3 + 1) % 5) - 2)), 5) AS p0, round(sum(z * (((k * 3 + 2) % 5) - 2)), 5) AS p1 FROM z GROUP BY b""")
def _(spark, sf):
    from ramplake.operators.scoring import fit_standardizer, standardize
    win = base.windows(spark, sf)
    matrix = [[float((k * 3 + 1 + j) % 5 - 2) for j in range(2)] for k in range(17)]
    z = standardize(win, fit_standardizer(win.filter("split = 'train'"), "path", 17), "path", 17, "z")
    out = z.select("b", sc.fixed_projection(F.col("z"), matrix).alias("p"))
    return rounded(out.select("b", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1")), 5)


def _noise(k):
    one = lambda p: f"((('0x' || substr(sha256(concat_ws('-', '41', b::VARCHAR, '{k}', '{p}')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    return f"round(sqrt(-2 * ln({one('a')})) * cos(2 * pi() * {one('b')}), 6) AS z{k}"


@query("timestamp_noise", SQL_WIN + f"\nSELECT b, {_noise(0)}, {_noise(1)} FROM win")
def _(spark, sf):
    out = base.windows(spark, sf).select("b", sc.timestamp_noise(F.col("b"), 2).alias("z"))
    return rounded(out.select("b", F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1")))


@query("named_ablation_arm", SQL_WIN + "\nSELECT b, arm, round(sum(x), 6) AS total FROM node, (VALUES ('ends', 0), ('ends', 16), ('middle', 8), ('quarter', 4), ('quarter', 12)) a(arm, pos) WHERE k = pos GROUP BY ALL")
def _(spark, sf):
    arms = {"ends": [0, 16], "middle": [8], "quarter": [4, 12]}
    win = base.windows(spark, sf)
    cols = F.array(*[F.struct(F.lit(n).alias("arm"), F.aggregate(sc.named_subset(F.col("path"), p), F.lit(0.0), lambda a, v: a + v).alias("total")) for n, p in arms.items()])
    out = win.select("b", F.explode(cols).alias("a")).select("b", "a.arm", "a.total")
    return rounded(out)


@query("tail_probability_features", "WITH p AS (SELECT doc_id, n_chars / (n_chars + 1000.0::DOUBLE) AS p FROM documents) SELECT doc_id, round(ln(greatest(least(p, 1), 1e-6)), 6) AS log_p, round(ln(greatest(least(1 - p, 1), 1e-6)), 6) AS log_q FROM p")
def _(spark, sf):
    p = F.col("n_chars") / (F.col("n_chars") + 1000.0)
    out = load(spark, sf, "documents").select("doc_id", paths.log_prob(F.array(p, 1 - p)).alias("l"))
    return rounded(out.select("doc_id", F.col("l")[0].alias("log_p"), F.col("l")[1].alias("log_q")))


# actual = quantity, schedule = the supplier's mean quantity, prices around the unit price
SQL_SETTLE = """WITH m AS (SELECT l_suppkey, avg(l_quantity) AS scheduled FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, l_linenumber, l_quantity AS actual, scheduled, l_extendedprice / l_quantity AS contract, l_extendedprice / l_quantity * (1 + l_tax) AS buy, l_extendedprice / l_quantity * (1 - l_discount) AS sell, l_returnflag, l_linestatus, l_suppkey FROM lineitem JOIN m USING (l_suppkey)),
c AS (SELECT *, greatest(-(actual - scheduled) * 0.5::DOUBLE, 0) * buy - greatest((actual - scheduled) * 0.5::DOUBLE, 0) * sell AS net FROM s)
"""


def settlement(spark, sf):
    li = load(spark, sf, "lineitem")
    schedule = li.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("scheduled"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.join(schedule, "l_suppkey").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("actual"), "scheduled",
        price.alias("contract"), (price * (1 + F.col("l_tax"))).alias("buy"), (price * (1 - F.col("l_discount"))).alias("sell"))


def _settle_cols(*names):
    return [F.col(n) for n in names]


@query("imbalance_cashflow", SQL_SETTLE + """SELECT l_orderkey, l_linenumber, l_suppkey, round((actual - scheduled) * 0.5::DOUBLE, 4) AS deviation_mwh, round(greatest(-(actual - scheduled) * 0.5::DOUBLE, 0) * buy, 4) AS shortfall_purchase,
 round(greatest((actual - scheduled) * 0.5::DOUBLE, 0) * sell, 4) AS surplus_sale, round(net, 4) AS net_imbalance_cost FROM c""")
def _(spark, sf):
    cash = ec.imbalance_cashflow(*_settle_cols("actual", "scheduled", "buy", "sell"))
    return rounded(settlement(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", *[c.alias(n) for n, c in cash.items()]), 4)


@query("excess_error_energy", SQL_SETTLE + "SELECT l_suppkey, round(sum(greatest(abs(actual - scheduled) - 5, 0) * 0.5::DOUBLE), 4) AS energy FROM c GROUP BY 1")
def _(spark, sf):
    e = ec.excess_error_energy(F.col("actual"), F.col("scheduled"), 5.0, 0.5)
    return rounded(settlement(spark, sf).groupBy("l_suppkey").agg(F.sum(e).alias("energy")), 4)


@query("settlement_opportunity_cost", SQL_SETTLE + "SELECT l_suppkey, round(sum(net + (actual - scheduled) * 0.5::DOUBLE * contract), 2) AS cost FROM c GROUP BY 1")
def _(spark, sf):
    e = ec.settlement_opportunity_cost(*_settle_cols("actual", "scheduled", "contract", "buy", "sell"))
    return rounded(settlement(spark, sf).groupBy("l_suppkey").agg(F.sum(e).alias("cost")), 2)


@query("complete_revenue", SQL_SETTLE + "SELECT l_suppkey, round(sum(scheduled * contract * 0.5::DOUBLE - net), 2) AS revenue FROM c GROUP BY 1")
def _(spark, sf):
    e = ec.complete_revenue(*_settle_cols("actual", "scheduled", "contract", "buy", "sell"))
    return rounded(settlement(spark, sf).groupBy("l_suppkey").agg(F.sum(e).alias("revenue")), 2)


@query("two_sided_settlement_price", SQL_SETTLE + """SELECT l_returnflag, l_linestatus, round(sum(CASE WHEN l_returnflag = 'A' THEN buy ELSE sell END * (CASE WHEN (l_linestatus = 'F') = (actual < scheduled) THEN 1 + k ELSE 1 - k END)), 2) AS price_sum
FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS k FROM c) GROUP BY ALL""")
def _(spark, sf):
    word = lambda cond, a, b: F.when(cond, a).otherwise(b)
    price = ec.two_sided_price(
        F.col("buy"), F.col("sell"), word(F.col("l_linestatus") == "F", "positive", "negative"), word(F.col("l_returnflag") == "A", "up", "down"),
        word(F.col("actual") < F.col("scheduled"), "negative", "positive"), F.lit(0.1), F.lit(0.05))
    return rounded(settlement(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(F.sum(price).alias("price_sum")), 2)


SQL_SHAPE = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
m AS (SELECT vec_id, max(abs(v)) AS top FROM e GROUP BY 1), shp AS (SELECT e.vec_id, label, i, v / top AS x FROM e JOIN m USING (vec_id))
"""


def shapes(spark, sf):
    emb = load(spark, sf, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return emb.select("vec_id", F.col("label").cast("long").alias("label"), x.alias("raw")).withColumn(
        "x", F.transform("raw", lambda v: v / F.array_max(F.transform("raw", lambda z: F.abs(z))))).drop("raw")


def _field(sign_sql):
    return SQL_SHAPE + f""", p AS (SELECT a.vec_id, a.i, b.i AS j, {sign_sql} AS g FROM shp a JOIN shp b USING (vec_id))
SELECT vec_id, count(*) AS cells, round(sum(g), 4) AS total, round(sum(g * g), 4) AS energy, round(sum(g * (i * 64 + j + 1)) / 4096, 4) AS placed FROM p GROUP BY vec_id"""


def _field_summary(spark, sf, fn):
    out = shapes(spark, sf).select("vec_id", fn(F.col("x")).alias("g"))
    cells = out.select("vec_id", F.posexplode("g").alias("pos", "v"))
    return rounded(cells.groupBy("vec_id").agg(F.count("*").alias("cells"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("energy"), (F.sum(F.col("v") * (F.col("pos") + 1)) / 4096).alias("placed")), 4)


@query("gasf_field", _field("a.x * b.x - sqrt(greatest(1 - a.x * a.x, 0)) * sqrt(greatest(1 - b.x * b.x, 0))"))
def _(spark, sf):
    return _field_summary(spark, sf, en.gasf)


@query("gadf_field", _field("sqrt(greatest(1 - a.x * a.x, 0)) * b.x - a.x * sqrt(greatest(1 - b.x * b.x, 0))"))
def _(spark, sf):
    return _field_summary(spark, sf, en.gadf)


@query("polarity_bit", SQL_SHAPE + "SELECT vec_id, sign(arg_max(x, (abs(x), -i)))::DOUBLE AS bit FROM shp GROUP BY 1")
def _(spark, sf):
    return shapes(spark, sf).select("vec_id", en.polarity(F.col("x")).alias("bit"))


@query("invert_gasf", SQL_SHAPE + "SELECT vec_id, i::BIGINT AS i, round(x, 6) AS x FROM shp")
def _(spark, sf):
    s = shapes(spark, sf).withColumn("g", en.gasf(F.col("x"))).withColumn("bit", en.polarity(F.col("x")))
    return rounded(s.select("vec_id", F.posexplode(en.invert_gasf(F.col("g"), F.col("bit"), 64)).alias("i", "x")))


@query("dct_coefficients", SQL_SHAPE + """, w AS (SELECT vec_id, i - 4 AS i, x FROM shp WHERE i BETWEEN 4 AND 20), kk AS (SELECT unnest(range(6)) AS k)
SELECT vec_id, k, round(sum(x * sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / 17.0::DOUBLE) * cos(pi() * k * (2 * i + 1) / 34)), 6) AS c FROM w, kk GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(shapes(spark, sf).select("vec_id", F.posexplode(en.dct2_ortho(F.col("x"), 17, 4, 6)).alias("k", "c")))


@query("quantile_map", """WITH q AS (SELECT unnest(range(20)) / 19.0::DOUBLE AS p), ref AS (SELECT row_number() OVER (ORDER BY p) AS i, p, (SELECT quantile_cont(n_chars::DOUBLE, p) FROM documents) AS xq, (SELECT quantile_cont(l_quantity, p) FROM lineitem) AS yq FROM q),
seg AS (SELECT i, xq, yq, lead(xq) OVER (ORDER BY i) AS xn, lead(yq) OVER (ORDER BY i) AS yn FROM ref), d AS (SELECT doc_id, n_chars::DOUBLE AS x FROM documents),
hit AS (SELECT doc_id, x, max(i) AS i FROM d JOIN seg ON x >= xq GROUP BY 1, 2)
SELECT doc_id, round(CASE WHEN s.xn IS NULL THEN yq WHEN s.xn = s.xq THEN yq ELSE yq + (yn - yq) / (xn - xq) * (x - xq) END, 5) AS mapped FROM hit h JOIN seg s USING (i)""".replace("(SELECT quantile_cont(n_chars::DOUBLE, p) FROM documents)", "list_extract((SELECT quantile_cont(n_chars::DOUBLE, %s) FROM documents), row_number() OVER (ORDER BY p))" % [i / 19 for i in range(20)]).replace("(SELECT quantile_cont(l_quantity, p) FROM lineitem)", "list_extract((SELECT quantile_cont(l_quantity, %s) FROM lineitem), row_number() OVER (ORDER BY p))" % [i / 19 for i in range(20)]))
def _(spark, sf):
    probs = {f"q{i:02d}": i / 19 for i in range(20)}
    docs = load(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x"))
    xq, yq = exact_quantiles(docs, [], "x", probs), exact_quantiles(load(spark, sf, "lineitem"), [], "l_quantity", probs)
    table = lambda t: t.select(F.array(*sorted(probs)).alias("a")).scalar()
    mapped = docs.withColumns({"_x": table(xq), "_y": table(yq)})
    return rounded(mapped.select("doc_id", sc.interpolate_table(F.col("x"), F.col("_x"), F.col("_y"), 20).alias("mapped")), 5)


@query("wind_state", SQL_SCALED + """, tr AS (SELECT unit, b, split, x - lag(x, 4) OVER (PARTITION BY unit ORDER BY b) AS trend FROM scaled),
q AS (SELECT unit, quantile_cont(trend, 0.25) AS lo, quantile_cont(trend, 0.75) AS hi FROM tr WHERE split = 'train' GROUP BY 1)
SELECT unit, CASE WHEN trend IS NULL THEN 'missing' WHEN trend <= lo THEN 'falling' WHEN trend >= hi THEN 'rising' ELSE 'middle' END AS state, count(*) AS n FROM tr JOIN q USING (unit) GROUP BY 1, 2""")
def _(spark, sf):
    from ramplake.operators.scoring import train_state
    data = tg.gap_guarded_diff(base.scaled(spark, sf), ["unit"], (4,)).withColumnRenamed("diff_4", "trend")
    return train_state(data, ["unit"], "trend").groupBy("unit", "state").agg(F.count("*").alias("n"))


@query("regime_groups", """WITH a AS (SELECT s_suppkey, s_acctbal / 100 - 45 AS heat, s_acctbal AS shear FROM supplier), t AS (SELECT quantile_cont(shear, 1 / 3.0::DOUBLE) AS q1, quantile_cont(shear, 2 / 3.0::DOUBLE) AS q2 FROM a)
SELECT s_suppkey, CASE WHEN heat <= -20 THEN -1 WHEN heat >= 20 THEN 1 ELSE 0 END::BIGINT AS heat_group, CASE WHEN shear <= q1 THEN 0 WHEN shear <= q2 THEN 1 ELSE 2 END::BIGINT AS shear_group FROM a, t""".replace("quantile_cont(shear, 1 / 3.0::DOUBLE)", "quantile_cont(shear, %r)" % (1 / 3)).replace("quantile_cont(shear, 2 / 3.0::DOUBLE)", "quantile_cont(shear, %r)" % (2 / 3)))
def _(spark, sf):
    a = load(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100 - 45).alias("heat"), F.col("s_acctbal").alias("shear"))
    t = exact_quantiles(a, [], "shear", {"q1": 1 / 3, "q2": 2 / 3})
    q1, q2 = t.select("q1").scalar(), t.select("q2").scalar()
    return rounded(a.select("s_suppkey", F.when(F.col("heat") <= -20, -1).when(F.col("heat") >= 20, 1).otherwise(0).alias("heat_group"),
                            F.when(F.col("shear") <= q1, 0).when(F.col("shear") <= q2, 1).otherwise(2).alias("shear_group")))
