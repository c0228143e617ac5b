"""Queries: one-to-one matching, components, pair catalogue, balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramplake.functions import paths
from ramplake.operators import bootstrap as bs, joins, match
from ramplake.operators.chunks import cut_lineage
from ramplake.plans import base
from ramplake.plans.base import SQL_WIN
from ramplake.plans.joins import SQL_SESSIONS, _CAL, _caliper_rows, sessions
from ramplake.plans.registry import query, rounded

U = ["unit"]

_EDGES = SQL_SESSIONS.replace("WITH raw", "WITH RECURSIVE raw") + """,
ov AS (SELECT a.unit, a.config AS config_a, z.config AS config_b, a.id AS a_id, z.id AS b_id, a.start AS sa, z.start AS sb, least(a."end", z."end") - greatest(a.start, z.start) AS ov, a."end" - a.start AS la, z."end" - z.start AS lb, least(a.start, z.start) AS s, greatest(a."end", z."end") AS e FROM iv a JOIN iv z ON a.unit = z.unit AND a.config < z.config WHERE least(a."end", z."end") > greatest(a.start, z.start)),
ed AS (SELECT *, ov / (la + lb - ov) AS iou FROM ov WHERE ov / (la + lb - ov) >= 0.3::DOUBLE)"""
# the sequential scan over sorted edges, as a recursion
_GREEDY = """,
od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {o}) AS i FROM {e}),
rc AS (SELECT {g}, 0::BIGINT AS i, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub, NULL::VARCHAR AS pa, NULL::VARCHAR AS pb FROM od GROUP BY {g}
 UNION ALL SELECT {q}, o.i, CASE WHEN list_contains(ua, o.a_id::VARCHAR) OR list_contains(ub, o.b_id::VARCHAR) THEN ua ELSE list_append(ua, o.a_id::VARCHAR) END, CASE WHEN list_contains(ua, o.a_id::VARCHAR) OR list_contains(ub, o.b_id::VARCHAR) THEN ub ELSE list_append(ub, o.b_id::VARCHAR) END,
 CASE WHEN list_contains(ua, o.a_id::VARCHAR) OR list_contains(ub, o.b_id::VARCHAR) THEN NULL ELSE o.a_id::VARCHAR END, CASE WHEN list_contains(ua, o.a_id::VARCHAR) OR list_contains(ub, o.b_id::VARCHAR) THEN NULL ELSE o.b_id::VARCHAR END FROM rc JOIN od o ON {j} AND o.i = rc.i + 1),
gm AS (SELECT * FROM rc WHERE pa IS NOT NULL)"""
_G3 = _GREEDY.format(g="unit, config_a, config_b", q="o.unit, o.config_a, o.config_b", o="iou DESC, abs(sa - sb), a_id, b_id", e="ed", j="o.unit = rc.unit AND o.config_a = rc.config_a AND o.config_b = rc.config_b")


def _all_sessions(spark, sf):
    return cut_lineage(sessions(spark, sf, 2).unionByName(sessions(spark, sf, 4)).unionByName(sessions(spark, sf, 8)))


@query("match_greedy", _EDGES + _G3 + "\nSELECT unit, pa AS a_id, pb AS b_id FROM gm WHERE config_a = 'gap2' AND config_b = 'gap8'")
def _(spark, sf):
    out = match.match_greedy(cut_lineage(sessions(spark, sf, 2)), cut_lineage(sessions(spark, sf, 8)), U, 0.3)
    return out.select("unit", "a_id", "b_id")


@query("match_maximum_iou")
def _(spark, sf):
    out = match.match_maximum(cut_lineage(sessions(spark, sf, 2)), cut_lineage(sessions(spark, sf, 8)), U, 0.3)
    return rounded(out.select("unit", "a_id", "b_id", "iou"))


@query("overlap_components", _EDGES + """,
e2 AS (SELECT unit, a_id, b_id, s, e FROM ed WHERE config_a = 'gap2' AND config_b = 'gap8'), nd AS MATERIALIZED (SELECT unit, a_id AS u, b_id AS v FROM e2 UNION SELECT unit, b_id, a_id FROM e2),
rch AS (SELECT unit, u, u AS r FROM nd UNION SELECT nd.unit, rch.u, nd.v FROM rch JOIN nd ON nd.unit = rch.unit AND nd.u = rch.r),
lb AS (SELECT unit, u, min(r) AS label FROM rch GROUP BY 1, 2)
SELECT e2.unit, count(DISTINCT a_id) AS n_left, count(DISTINCT b_id) AS n_right, min(s) AS start, max(e) AS "end" FROM e2 JOIN lb ON lb.unit = e2.unit AND lb.u = e2.a_id GROUP BY e2.unit, label""")
def _(spark, sf):
    edges = joins.overlap_scores(cut_lineage(sessions(spark, sf, 2)), cut_lineage(sessions(spark, sf, 8)), U, 0.3)
    out = match.component_table(cut_lineage(edges), U)
    return out.select("unit", F.size("left_ids").cast("long").alias("n_left"), F.size("right_ids").cast("long").alias("n_right"), "start", "end")


@query("pair_catalog_coverage", _EDGES + _G3 + """,
cf AS (SELECT unit, config, count(*) AS n FROM iv GROUP BY 1, 2), gr AS (SELECT a.unit, a.config AS config_a, z.config AS config_b, a.n AS left_n, z.n AS right_n FROM cf a JOIN cf z ON a.unit = z.unit AND a.config < z.config), hh AS (SELECT unit, config_a, config_b, count(*) AS pairs FROM gm GROUP BY 1, 2, 3)
SELECT unit, config_a, config_b, left_n, right_n, coalesce(pairs, 0) AS pairs, round(coalesce(pairs, 0) / left_n, 6) AS left_coverage, round(coalesce(pairs, 0) / right_n, 6) AS right_coverage FROM gr LEFT JOIN hh USING (unit, config_a, config_b)""")
def _(spark, sf):
    _, coverage = match.pair_catalog(_all_sessions(spark, sf), U, 0.3)
    return rounded(coverage.select("unit", "config_a", "config_b", "left_n", "right_n", "pairs", "left_coverage", "right_coverage"))


_CP = _CAL.format(side="a.split = 'train' AND z.split = 'test'").replace("WITH raw", "WITH RECURSIVE raw", 1)
_CP = _CP[: _CP.rindex("\nSELECT")] + ",\npc AS (SELECT y, ab AS a_id, bb AS b_id, distance FROM pr WHERE distance <= 0.15::DOUBLE)"
_GD = _GREEDY.format(g="y", q="o.y", o="distance, a_id, b_id", e="pc", j="o.y = rc.y")


def _disjoint(spark, sf):
    rows = cut_lineage(_caliper_rows(spark, sf))
    pairs = joins.caliper_pairs(rows.filter("split = 'train'"), rows.filter("split = 'test'"), ["y"], rmse=0.15)
    return rows, match.greedy_pairs(pairs, ["y"], F.struct("distance", "a_id", "b_id"))


@query("greedy_disjoint_pairs", _CP + _GD + "\nSELECT y::BIGINT AS y, pa::BIGINT AS a_id, pb::BIGINT AS b_id FROM gm")
def _(spark, sf):
    return rounded(_disjoint(spark, sf)[1].select("y", "a_id", "b_id"))


_SIDES = _CP + _GD + """,
er AS (SELECT n.b, max(x) - min(x) AS err, max(CASE WHEN k = 0 THEN x END) AS p0, max(CASE WHEN k = 16 THEN x END) AS p16, max(CASE WHEN k = 16 THEN x END) - max(CASE WHEN k = 0 THEN x END) AS net FROM node n GROUP BY n.b),
ot AS (SELECT pa::BIGINT AS a, pb::BIGINT AS z, ea.err AS fa, eb.err AS fb FROM gm JOIN er ea ON ea.b = pa::BIGINT JOIN er eb ON eb.b = pb::BIGINT WHERE abs(ea.err - eb.err) > 1e-9),
sd AS (SELECT 'high' AS side, CASE WHEN fa > fb THEN a ELSE z END AS b, abs(fa - fb) AS gap FROM ot UNION ALL SELECT 'low', CASE WHEN fa > fb THEN z ELSE a END, abs(fa - fb) FROM ot),
lf AS (SELECT side, unnest(['p0', 'p16', 'net']) AS feature, unnest([p0, p16, net]) AS v FROM sd JOIN er USING (b)),
mm AS (SELECT feature, avg(v) FILTER (WHERE side = 'high') AS hm, avg(v) FILTER (WHERE side = 'low') AS lm, sqrt((var_pop(v) FILTER (WHERE side = 'high') + var_pop(v) FILTER (WHERE side = 'low')) / 2) AS sc FROM lf GROUP BY feature)
"""


def _sided(spark, sf):
    rows, pairs = _disjoint(spark, sf)
    x = F.col("path")
    feats = rows.select(F.col("id"), paths.spread(paths.nodes("path")).alias("err"), x[0].alias("p0"), x[16].alias("p16"), (x[16] - x[0]).alias("net"), "us")
    err = lambda p: feats.select(F.col("id").alias(f"{p}_id"), F.col("err").alias(f"err_{p}"))
    both = cut_lineage(match.orient(pairs.join(err("a"), "a_id").join(err("b"), "b_id"), "err_a", "err_b"))
    side = lambda s: both.select(F.col(s).alias("id"), F.lit(s).alias("side"), "gap")
    return both, side("high").unionByName(side("low")).join(feats, "id").withColumn("block", bs.block_id(F.col("us"), 7))


@query("orient_pairs", _SIDES + "SELECT CASE WHEN fa > fb THEN a ELSE z END AS high, CASE WHEN fa > fb THEN z ELSE a END AS low, round(abs(fa - fb), 6) AS gap FROM ot")
def _(spark, sf):
    return rounded(_sided(spark, sf)[0].select("high", "low", "gap"))


@query("balance_smd", _SIDES + "SELECT feature, round(hm, 6) AS high_mean, round(lm, 6) AS low_mean, round(CASE WHEN sc > 1e-12 THEN (hm - lm) / sc WHEN abs(hm - lm) > 1e-12 THEN 'Infinity'::DOUBLE ELSE 0 END, 5) AS smd FROM mm")
def _(spark, sf):
    out = match.balance(_sided(spark, sf)[1], [], "side", ["p0", "p16", "net"])
    return rounded(out.withColumn("smd", F.round("smd", 5)))


@query("support_record", _SIDES + """SELECT 'all' AS cohort, count(*) FILTER (WHERE side = 'high') AS pairs, count(DISTINCT CASE WHEN side = 'high' THEN b // 168 END) AS high_blocks, count(DISTINCT CASE WHEN side = 'low' THEN b // 168 END) AS low_blocks, (SELECT round(max(abs((hm - lm) / sc)), 5) FROM mm) AS max_abs_smd, round(quantile_cont(gap, 0.5), 6) AS median_gap,
 count(*) FILTER (WHERE side = 'high') >= 20 AND least(count(DISTINCT CASE WHEN side = 'high' THEN b // 168 END), count(DISTINCT CASE WHEN side = 'low' THEN b // 168 END)) >= 1 AND (SELECT max(abs((hm - lm) / sc)) FROM mm) <= 0.5::DOUBLE AS accepted FROM sd""")
def _(spark, sf):
    sides = cut_lineage(_sided(spark, sf)[1].withColumn("cohort", F.lit("all")))
    smd = match.balance(sides, ["cohort"], "side", ["p0", "p16", "net"])
    out = match.support_record(sides, ["cohort"], smd, 20, 1, 0.5)
    return rounded(out.withColumn("max_abs_smd", F.round("max_abs_smd", 5)))
