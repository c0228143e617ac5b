"""Queries: fitting and forecasting jobs. Forests and solvers have no SQL twin; closed forms have one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramplake.functions import paths
from ramplake.operators import joins, models as md, timegrid as tg
from ramplake.operators.chunks import cut_lineage
from ramplake.operators.stations import ridge_apply
from ramplake.plans import base
from ramplake.plans.base import SQL_SCALED, SQL_WIN
from ramplake.plans.registry import load, query, rounded
from ramplake.plans.scalar import shapes

BUDGET = {"trees": 150, "depth": 16, "leaf": 32}


def samples(spark, sf):
    """id, b, us, split, y, arr, anchor, delta, path, x: 16 past values and the hour, per complete window."""
    hist = tg.history_vector(base.farm(spark, sf), ["site"]).filter("history IS NOT NULL").select((F.col("b") + 1).alias("b"), "history")
    win = base.windows(spark, sf).join(hist, "b")
    hour = F.array(F.sin(F.col("b") * 0.2617993877991494), F.cos(F.col("b") * 0.2617993877991494))
    anchor = F.col("history")[15]
    return cut_lineage(win.select(
        F.col("b").alias("id"), "b", (F.col("b") * 3600000000).alias("us"), "split", "y", "arr", anchor.alias("anchor"), F.transform("path", lambda v: v - anchor).alias("delta"),
        "path", "history", F.concat("history", hour).alias("x")))


def _split(rows):
    return rows.filter("split = 'train'"), rows.filter("split <> 'train'")


@query("state_forest")
def _(spark, sf):
    train, rest = _split(samples(spark, sf))
    out = md.forest_probabilities(md.forest(train, "y", **BUDGET), rest, "p", 4)
    return rounded(out.select("id", "y", *[F.col("p")[k].alias(f"p{k}") for k in range(4)]))


@query("timing_forest")
def _(spark, sf):
    train, rest = _split(samples(spark, sf))
    out = md.timing_forest(train, rest)
    return rounded(out.select("id", "arr", F.col("q")[0].alias("q0"), F.aggregate("q", F.lit(0.0), lambda a, v: a + v).alias("total")))


@query("joint_timing_forest")
def _(spark, sf):
    train, rest = _split(samples(spark, sf))
    return rounded(md.joint_forest(train, rest, **BUDGET).select("id", "arr", F.col("p17")[16].alias("no_event"), F.aggregate("p17", F.lit(0.0), lambda a, v: a + v).alias("total")))


@query("tree_complexity")
def _(spark, sf):
    return md.tree_complexity(md.forest(_split(samples(spark, sf))[0], "y", **BUDGET))


@query("forest_leaf_totals", SQL_WIN + """,
h AS (SELECT b + 1 AS b FROM (SELECT b, count(x) OVER (ORDER BY b ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS c FROM farm) WHERE c = 16),
kinds AS (SELECT unnest(range((SELECT max(y) FROM win JOIN h USING (b) WHERE split = 'train') + 1)) AS class),
seen AS (SELECT y, count(*) AS n FROM win JOIN h USING (b) WHERE split = 'train' GROUP BY y)
SELECT t.tree, k.class, coalesce(n, 0)::BIGINT AS rows FROM range(150) AS t(tree), kinds k LEFT JOIN seen ON y = k.class""")
def _(spark, sf):
    return md.leaf_totals(md.forest(_split(samples(spark, sf))[0], "y", **BUDGET))


@query("trajectory_forest_heads")
def _(spark, sf):
    """Every horizon's change and the whole geometry at the published budget, a row for each window and node."""
    train, rest = _split(samples(spark, sf))
    out = md.trajectory_forest(train, rest, **BUDGET)
    nodes = out.select("id", "anchor", F.posexplode(F.arrays_zip("forest", "delta")).alias("node", "v"))
    return rounded(nodes.select("id", "node", F.col("v.forest").alias("change"), (F.col("anchor") + F.col("v.forest")).alias("level"), (F.col("v.forest") - F.col("v.delta")).alias("error")))


@query("trajectory_regressors")
def _(spark, sf):
    train, rest = _split(samples(spark, sf))
    out = md.trajectory_regressors(train, rest, [0, 16], trees=5, depth=4)
    return rounded(out.select("id", "ridge_0", "forest_0", "boosted_0", "blend_0", "blend_16"))


def _members(spark, sf):
    rows = samples(spark, sf)
    train, rest = _split(rows)
    model = md.forest(train, "y", **BUDGET)
    draws = cut_lineage(md.draw_neighbours(model, train, rest))
    return rows, draws, cut_lineage(md.scenario_paths(draws, rest, train))


@query("leaf_neighbour_draws")
def _(spark, sf):
    return _members(spark, sf)[1]


@query("scenario_class_shares")
def _(spark, sf):
    shares = md.class_shares(_members(spark, sf)[2], base.THR)
    return rounded(shares.select("id", *[F.col("p")[k].alias(f"p{k}") for k in range(4)], F.col("p17")[16].alias("no_event")))


@query("shuffled_member_control")
def _(spark, sf):
    shares = md.class_shares(md.shuffled_members(_members(spark, sf)[2]), base.THR)
    return rounded(shares.select("id", *[F.col("p")[k].alias(f"p{k}") for k in range(4)]))


@query("rank_assigned_ranges")
def _(spark, sf):
    members = _members(spark, sf)[2]
    wider = members.select("id", "member", ((F.array_max("path") - F.array_min("path")) * 1.2).alias("sample"))
    out = md.reshape_range(members, md.rank_assign(members, wider))
    return rounded(out.select("id", "member", (F.array_max("path") - F.array_min("path")).alias("new_range"), "lift", "flat"))


@query("local_wind_mixture")
def _(spark, sf):
    rows, _, members = _members(spark, sf)
    known = rows.select("id", F.slice("history", 1, 9).alias("known"))
    coefficients = [[0.1 * ((i * 7 + k * 3) % 5 - 2) for i in range(29)] for k in range(4)]
    out = md.wind_mixture(members, known, coefficients, [0.0, 0.1, -0.1, 0.0])
    return rounded(out.select("id", *[F.col("p")[k].alias(f"p{k}") for k in range(4)]))


def _calibration(spark, sf, label, classes, need, mixture):
    fc = base.forecasts(spark, sf).withColumn("us", F.col("b") * 3600000000).withColumn("label", F.col(label))
    rows = cut_lineage(fc.withColumn("x", paths.log_prob("p")).select("arm", "lead", "b", "us", "label", "x", "y"))
    # refits every three days, because the data spans one month
    fits = joins.training_rows(rows.filter(F.col("label") < classes), "us", 20, 3 * 86_400_000_000, 0)
    keys = ["arm", "lead", "update_us"]
    fitted = md.rolling_map(fits, keys, classes, 0.01, least=60, need=need)
    target = rows.withColumn("update_us", F.floor(F.col("us") / 259200000000) * 259200000000)
    return md.apply_map(target, fitted, keys, mixture)


@query("rolling_multinomial_map")
def _(spark, sf):
    out = _calibration(spark, sf, "y", 4, "all", 0)
    return rounded(out.select("arm", "lead", "b", "kind", *[F.col("p")[k].alias(f"p{k}") for k in range(4)]), 4)


@query("rolling_timing_map")
def _(spark, sf):
    out = _calibration(spark, sf, "arr", 16, "three", 16)
    return rounded(out.select("arm", "lead", "b", "kind", F.col("p")[0].alias("q0"), F.aggregate("p", F.lit(0.0), lambda a, v: a + v).alias("total")), 4)


@query("feature_arms")
def _(spark, sf):
    from functools import reduce
    rows = samples(spark, sf).select("id", "us", "split", F.col("history").alias("power"), F.col("path").alias("weather"))
    parts = [d.select(F.lit(n).alias("arm"), "id", F.size("x").alias("width"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total")) for n, d in md.feature_arms(rows).items()]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


_AR = SQL_SCALED + """,
p AS (SELECT unit, split, b, x, lead(x) OVER (PARTITION BY unit ORDER BY b) AS y FROM scaled), m AS (SELECT unit, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS c FROM p WHERE split = 'train' AND x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
k AS (SELECT unit, c / vx AS a1, my - c / vx * mx AS b1 FROM m)
SELECT unit, h::BIGINT AS h, round(pow(a1, h), 6) AS a, round(b1 * (1 - pow(a1, h)) / (1 - a1), 6) AS b_h FROM k, (SELECT unnest(range(1, 5)) AS h)"""


def _lagged(spark, sf):
    return tg.windowed(base.scaled(spark, sf), ["unit"], "b", 1, 4, lambda w: {"y_1": F.lead("x", 1).over(w), "y_4": F.lead("x", 4).over(w), "x_lag": F.lag("x", 1).over(w)})


@query("ar1_recursive", _AR)
def _(spark, sf):
    return rounded(md.ar1_coefficients(_lagged(spark, sf).filter("split = 'train'"), ["unit"], "x", "y_1", 4))


def _lag_sql(h):
    return f"""SELECT {h}::BIGINT AS h, round(avg(e), 6) AS mae, count(*) AS n FROM (SELECT abs(c0 + c1 * x + c2 * x_lag - y{h}) AS e FROM p, (
 SELECT (y * (uu * vv - uv * uv) - su * (uy * vv - uv * vy) + sv * (uy * uv - uu * vy)) / det AS c0, (n * (uy * vv - uv * vy) - y * (su * vv - uv * sv) + sv * (su * vy - uy * sv)) / det AS c1, (n * (uu * vy - uy * uv) - su * (su * vy - uy * sv) + y * (su * uv - uu * sv)) / det AS c2 FROM
 (SELECT *, n * (uu * vv - uv * uv) - su * (su * vv - uv * sv) + sv * (su * uv - uu * sv) AS det FROM (SELECT count(*) AS n, sum(x) AS su, sum(x_lag) AS sv, sum(x * x) + 1 AS uu, sum(x_lag * x_lag) + 1 AS vv, sum(x * x_lag) AS uv, sum(y{h}) AS y, sum(x * y{h}) AS uy, sum(x_lag * y{h}) AS vy FROM p WHERE split = 'train' AND y{h} IS NOT NULL AND x IS NOT NULL AND x_lag IS NOT NULL)))
 WHERE split = 'test' AND y{h} IS NOT NULL AND x IS NOT NULL AND x_lag IS NOT NULL)"""


@query("direct_lag_ridge", SQL_SCALED + ",\np AS (SELECT unit, split, x, lag(x) OVER w AS x_lag, lead(x) OVER w AS y1, lead(x, 4) OVER w AS y4 FROM scaled WINDOW w AS (PARTITION BY unit ORDER BY b))\n" + _lag_sql(1) + " UNION ALL " + _lag_sql(4))
def _(spark, sf):
    data = cut_lineage(_lagged(spark, sf).filter("x IS NOT NULL AND x_lag IS NOT NULL"))
    fits = md.direct_ridge(data.filter("split = 'train'"), ["x", "x_lag"], "y", (1, 4), 1.0)
    parts = []
    for h, fitted in fits.items():
        out = ridge_apply(data.filter(f"split = 'test' AND y_{h} IS NOT NULL"), fitted, ["x", "x_lag"], "f")
        parts.append(out.agg(F.lit(h).cast("long").alias("h"), F.avg(F.abs(F.col("f") - F.col(f"y_{h}"))).alias("mae"), F.count("*").alias("n")))
    return rounded(parts[0].unionByName(parts[1]))


@query("direct_arx")
def _(spark, sf):
    data = _lagged(spark, sf).withColumn("wind", F.col("n").cast("double")).filter("x IS NOT NULL AND y_1 IS NOT NULL")
    data = cut_lineage(md.arx_features(data, "x", "wind", F.timestamp_micros(F.col("b") * 3600000000)))
    feats = ["root_power", "root_wind", "wind", "hour_sin", "hour_cos"]
    fitted = md.direct_ridge(data.filter("split = 'train'"), feats, "y", (1,), 1.0)[1]
    out = ridge_apply(data.filter("split = 'test'"), fitted, feats, "f")
    return rounded(out.select("unit", "b", "f", F.col("x").alias("persistence")))


_POINT = "WITH pt AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS y, l_quantity * (1 + l_tax - l_discount) AS f FROM lineitem)"
_Q20 = [i / 19 for i in range(20)]
_TAIL = _POINT + f""",
tq AS (SELECT quantile_cont(f, {_Q20}) AS pq, quantile_cont(y, {_Q20}) AS aq FROM pt WHERE f >= 40),
k AS (SELECT unnest(pq) AS xq, unnest(aq) AS yq, generate_subscripts(pq, 1) AS i FROM tq), sg AS (SELECT i, xq, yq, lead(xq) OVER (ORDER BY i) AS xn, lead(yq) OVER (ORDER BY i) AS yn FROM k),
ht AS (SELECT pt.*, (SELECT max(i) FROM sg WHERE xq <= pt.f) AS i FROM pt),
tm AS (SELECT ht.*, CASE WHEN f >= 40 THEN least(greatest(0.5::DOUBLE * f + 0.5::DOUBLE * CASE WHEN xn IS NULL OR xn = xq THEN yq ELSE yq + (yn - yq) / (xn - xq) * (f - xq) END, 0), 52) ELSE least(greatest(f, 0), 52) END AS g FROM ht LEFT JOIN sg USING (i))"""


def _points(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("y"), (F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("f"))


@query("tail_cdf_match", _TAIL + "\nSELECT l_suppkey, count(*) AS n, round(sum(g), 4) AS total, round(avg(abs(g - y)), 6) AS mae FROM tm GROUP BY 1")
def _(spark, sf):
    out = md.tail_cdf_match(_points(spark, sf), "y", "f", 40.0, alpha=0.5, cap=52.0)
    return rounded(out.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("f"), 4).alias("total"), F.avg(F.abs(F.col("f") - F.col("y"))).alias("mae")))


_BAND = """bn AS (SELECT *, least(floor(f / 6.5::DOUBLE), 7)::INT AS bin FROM {src}), bq AS (SELECT bin, count(*) AS n, quantile_cont(y - f, 0.1) AS lo, quantile_cont(y - f, 0.9) AS hi FROM bn GROUP BY 1), gq AS (SELECT quantile_cont(y - f, 0.1) AS glo, quantile_cont(y - f, 0.9) AS ghi FROM bn),
bd AS (SELECT bn.*, f + CASE WHEN n >= {least} THEN lo ELSE glo END AS p10, f + CASE WHEN n >= {least} THEN hi ELSE ghi END AS p90 FROM bn JOIN bq USING (bin), gq)
SELECT l_suppkey, count(*) AS n, round(sum(p10), 3) AS low, round(sum(p90), 3) AS high FROM bd GROUP BY 1"""
_PROBS = {"p10": 0.1, "p90": 0.9}


def _band_totals(out):
    return rounded(out.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("p10").alias("low"), F.sum("p90").alias("high")), 3)


@query("residual_quantile_bands", _POINT + ",\n" + _BAND.format(src="pt", least=7400))
def _(spark, sf):
    return _band_totals(md.residual_bands(_points(spark, sf), "y", "f", _PROBS, 8, 7400, 52.0))


@query("postprocess_tail_then_bands", _TAIL + ",\nt2 AS (SELECT * EXCLUDE (f, g), g AS f FROM tm),\n" + _BAND.format(src="t2", least=100))
def _(spark, sf):
    return _band_totals(md.postprocess(_points(spark, sf), "y", "f", tail_min=40.0, probs=_PROBS, bins=8, least=100, alpha=0.5, cap=52.0))


def _shape_split(spark, sf):
    s = cut_lineage(shapes(spark, sf))
    return s, s.filter("vec_id % 5 < 3")


@query("pca_coordinates")
def _(spark, sf):
    s, train = _shape_split(spark, sf)
    out = md.pca_coordinates(train, s, "x", 6)
    # signs are arbitrary, sizes are not
    return rounded(out.select("vec_id", *[F.abs(F.col("pca")[k]).alias(f"c{k}") for k in range(6)]), 4)


@query("kmeans_clusters")
def _(spark, sf):
    s, train = _shape_split(spark, sf)
    return md.kmeans_labels(train, s, "x", 5).select("vec_id", "label", "cluster")


@query("mixture_clusters")
def _(spark, sf):
    s, train = _shape_split(spark, sf)
    low = md.pca_coordinates(train, s, "x", 3)
    return md.mixture_labels(low.filter("vec_id % 5 < 3"), low, "pca", 3).select("vec_id", "label", "cluster")


@query("sampled_medoids")
def _(spark, sf):
    s, _ = _shape_split(spark, sf)
    return md.sampled_medoids(s, "vec_id", "x", 5)[0].select("vec_id", "label", "cluster")
