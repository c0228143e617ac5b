"""Queries: decisions, selection, fusion, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramplake.functions import losses as ls
from ramplake.operators import bootstrap as bs, decide as dc, scoring
from ramplake.operators.chunks import cut_lineage
from ramplake.plans import base
from ramplake.plans.base import SQL_FC, SQL_LOSS
from ramplake.plans.registry import half_away, query, rounded
from ramplake.plans.scoring import SQL_BOOT, class_long, design

GRID = [i / 20 for i in range(1, 20)]
RATIOS = [2.0, 5.0]

SQL_DEC = SQL_FC + """,
r AS (SELECT arm, lead, split, round(p[3] + p[4], 9) AS pd, arr < 16 AS ev, b FROM fc),
g AS (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS t), k AS (SELECT unnest([2.0::DOUBLE, 5.0::DOUBLE]) AS ratio),
cn AS (SELECT arm, lead, t, count(*) FILTER (WHERE pd >= t AND NOT ev) AS fa, count(*) FILTER (WHERE pd < t AND ev) AS ms, count(*) FILTER (WHERE pd >= t) AS al, count(*) AS n FROM r, g WHERE split = 'validation' GROUP BY 1, 2, 3),
ch AS (SELECT arm, lead, ratio, arg_min(t, (fa + ratio * ms, t)) AS threshold, min(fa + ratio * ms) / any_value(n) AS cost FROM cn, k GROUP BY 1, 2, 3),
fq AS (SELECT arm, lead, avg(ev::INT) AS f FROM r WHERE split = 'train' GROUP BY 1, 2),
co AS (SELECT arm, lead, ratio, any_value(f) AS f, avg(ev::INT) AS event_rate, count(*) AS n FROM r JOIN fq USING (arm, lead), k WHERE split = 'test' GROUP BY 1, 2, 3),
cs AS (SELECT arm, lead, ratio, n, event_rate, ratio * event_rate AS never, 1 - event_rate AS always, CASE WHEN f * ratio >= 1 - f THEN 1 - event_rate ELSE ratio * event_rate END AS train_frequency, least(ratio * event_rate, 1 - event_rate) AS best_constant FROM co),
dt AS (SELECT arm, lead, ratio, threshold, avg(CASE WHEN pd >= threshold AND NOT ev THEN 1 WHEN pd < threshold AND ev THEN ratio ELSE 0 END) AS fc_cost, avg((pd >= threshold)::INT) AS alert_rate FROM r JOIN ch USING (arm, lead) WHERE split = 'test' GROUP BY 1, 2, 3, 4)
"""


def _rows(spark, sf):
    fc = base.forecasts(spark, sf)
    return fc.select("arm", F.col("lead").cast("long").alias("lead"), "split", "b", F.round(F.col("p")[2] + F.col("p")[3], 9).alias("pd"), (F.col("arr") < 16).alias("ev"))


K = ["arm", "lead"]


@query("decision_cost", SQL_DEC + "SELECT arm, lead, ratio, round(sum(CASE WHEN pd >= 0.5::DOUBLE AND NOT ev THEN 1 WHEN pd < 0.5::DOUBLE AND ev THEN ratio ELSE 0 END), 4) AS cost FROM r, k GROUP BY 1, 2, 3")
def _(spark, sf):
    rows = _rows(spark, sf).withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in RATIOS])))
    return rounded(rows.groupBy(*K, "ratio").agg(F.sum(dc.decision_cost(F.col("pd"), F.col("ev"), F.lit(0.5), F.col("ratio"))).alias("cost")), 4)


@query("threshold_counts", SQL_DEC + "SELECT arm, lead, t AS threshold, fa AS false_alarms, ms AS misses, al AS alarms, n FROM cn")
def _(spark, sf):
    return dc.threshold_counts(_rows(spark, sf).filter("split = 'validation'"), K, "pd", "ev", GRID)


@query("select_threshold", SQL_DEC + "SELECT arm, lead, ratio, threshold, round(cost, 6) AS cost FROM ch")
def _(spark, sf):
    return rounded(dc.select_threshold(_rows(spark, sf).filter("split = 'validation'"), K, "pd", "ev", GRID, RATIOS))


@query("constant_policies", SQL_DEC + "SELECT arm, lead, ratio, n, round(event_rate, 6) AS event_rate, round(never, 6) AS never, round(always, 6) AS always, round(train_frequency, 6) AS train_frequency, round(best_constant, 6) AS best_constant FROM cs")
def _(spark, sf):
    rows = _rows(spark, sf)
    return rounded(dc.constant_policies(rows.filter("split = 'train'"), rows.filter("split = 'test'"), K, "ev", RATIOS))


@query("constant_policy_by_validation", SQL_DEC + """, va AS (SELECT arm, lead, avg(ev::INT) AS v FROM r WHERE split = 'validation' GROUP BY 1, 2)
SELECT arm, lead, ratio, round(CASE WHEN ratio * v <= 1 - v THEN never ELSE always END, 6) AS validation_choice FROM cs JOIN va USING (arm, lead)""")
def _(spark, sf):
    rows = cut_lineage(_rows(spark, sf))
    part = lambda name: rows.filter(F.col("split") == name)
    out = dc.constant_policies(part("train"), part("test"), K, "ev", RATIOS, part("validation"))
    return rounded(out.select(*K, "ratio", "validation_choice"))


@query("decision_table", SQL_DEC + "SELECT arm, lead, ratio, threshold, round(fc_cost, 6) AS forecast_cost, round(alert_rate, 6) AS alert_rate, round(100 * (1 - fc_cost / nullif(best_constant, 0)), 4) AS reduction_vs_constant_pct, round(100 * (1 - fc_cost / nullif(never, 0)), 4) AS reduction_vs_never_pct FROM dt JOIN cs USING (arm, lead, ratio)")
def _(spark, sf):
    rows = cut_lineage(_rows(spark, sf))
    test = rows.filter("split = 'test'")
    chosen = dc.select_threshold(rows.filter("split = 'validation'"), K, "pd", "ev", GRID, RATIOS)
    out = dc.decision_table(test, K, "pd", "ev", chosen, dc.constant_policies(rows.filter("split = 'train'"), test, K, "ev", RATIOS))
    pct = ["reduction_vs_constant_pct", "reduction_vs_never_pct"]
    return rounded(out.select(*K, "ratio", "threshold", "forecast_cost", "alert_rate", *[F.round(c, 4).alias(c) for c in pct]))


_BLEND = SQL_FC + """,
bl AS (SELECT a.lead, a.b, a.split, a.y, w, [(1 - w) * a.p[1] + w * z.p[1], (1 - w) * a.p[2] + w * z.p[2], (1 - w) * a.p[3] + w * z.p[3], (1 - w) * a.p[4] + w * z.p[4]] AS p FROM fc a JOIN fc z ON a.b = z.b AND a.lead = z.lead AND a.arm = 'hour' AND z.arm = 'trans', (SELECT unnest(range(11)) / 10.0::DOUBLE AS w)),
sc AS (SELECT lead, w, avg((p[4] - (y = 3)::INT) ** 2) AS return_brier, avg((p[1] - (y = 0)::INT) ** 2 + (p[2] - (y = 1)::INT) ** 2 + (p[3] - (y = 2)::INT) ** 2 + (p[4] - (y = 3)::INT) ** 2) AS multiclass_brier FROM bl WHERE split = 'validation' GROUP BY 1, 2)
"""


def _blend_scores(spark, sf):
    fc = base.forecasts(spark, sf).filter("split = 'validation'")
    side = lambda arm, name: fc.filter(F.col("arm") == arm).select("lead", "b", "y", F.col("p").alias(name))
    grid = dc.blend_grid(side("hour", "pa").join(side("trans", "pz").drop("y"), ["lead", "b"]), "pa", "pz")
    loss = ls.class_losses(F.col("y"), F.col("blend"))
    return grid.groupBy(F.col("lead").cast("long").alias("lead"), "weight").agg(F.avg(loss["return_brier"]).alias("return_brier"), F.avg(loss["multiclass_brier"]).alias("multiclass_brier"))


@query("blend_weight_grid", _BLEND + "SELECT lead, w AS weight, round(return_brier, 6) AS return_brier, round(multiclass_brier, 6) AS multiclass_brier FROM sc")
def _(spark, sf):
    return rounded(_blend_scores(spark, sf))


@query("select_constrained", _BLEND + """SELECT lead, w AS weight, round(return_brier, 6) AS return_brier, round(multiclass_brier, 6) AS multiclass_brier FROM (SELECT s.*, row_number() OVER (PARTITION BY s.lead ORDER BY round(s.return_brier, 9), s.w) AS r FROM sc s JOIN sc z ON z.lead = s.lead AND z.w = 0 WHERE s.multiclass_brier <= z.multiclass_brier + 0.02::DOUBLE) WHERE r = 1""")
def _(spark, sf):
    scores = cut_lineage(_blend_scores(spark, sf))
    baseline = scores.filter("weight = 0").select("lead", F.col("multiclass_brier").alias("_base"))
    guarded = scores.join(baseline, "lead").withColumn("_key", F.round("return_brier", 9))
    return rounded(dc.select_constrained(guarded, ["lead"], "_key", "multiclass_brier", F.col("_base"), ["weight"], 0.02).drop("_base", "_key"))


@query("select_lambda", SQL_LOSS + """,
lm AS (SELECT CASE arm WHEN 'freq' THEN 1.0::DOUBLE WHEN 'hour' THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END AS strength, round(avg(conditional_rps), 9) AS score FROM tl WHERE split = 'validation' GROUP BY 1)
SELECT strength, round(score, 6) AS score FROM lm ORDER BY lm.score, strength DESC LIMIT 1""")
def _(spark, sf):
    # not from the long losses: they have no row for an arm without an event, which is a candidate all the same
    fc = base.forecasts(spark, sf).filter("split = 'validation'")
    loss = ls.timing_losses(F.col("arr"), F.col("q"), F.col("p")[2] + F.col("p")[3])["conditional_rps"]
    strength = F.when(F.col("arm") == "freq", 1.0).when(F.col("arm") == "hour", 0.1).otherwise(0.01)
    scores = fc.groupBy(strength.alias("strength")).agg(half_away(F.avg(loss), 1e9).alias("score"))
    return rounded(dc.select_lambda(scores, "score", "strength"))


@query("target_aligned_route", SQL_FC + "\nSELECT a.lead, a.b, a.y::BIGINT AS y, round(a.p[4], 6) AS p3, round(z.q[1], 6) AS q0, 0.0::DOUBLE AS state_gap FROM fc a JOIN fc z ON z.b = a.b AND z.lead = a.lead AND a.arm = 'trans' AND z.arm = 'hour'")
def _(spark, sf):
    out = dc.target_route(cut_lineage(base.forecasts(spark, sf)), "trans", "hour", ["lead", "b"])
    return rounded(out.select(F.col("lead").cast("long").alias("lead"), "b", "y", F.col("p")[3].alias("p3"), F.col("q")[0].alias("q0"), "state_gap"))
