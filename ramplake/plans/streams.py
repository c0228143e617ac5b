"""Queries: streaming replays of ``events``; the SQL is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramplake.plans import base
from ramplake.plans.base import SQL_RAW, SQL_SERIES
from ramplake.plans.registry import query, rounded
from ramplake.sources.writers import scratch
from ramplake.streaming import streams as sm

HOUR_US = 3_600_000_000


def _events(spark, sf):
    ev = sm.stream_table(spark, sf, "events")
    return ev.select(F.col("event_type").alias("unit"), "ts", F.col("value").alias("v"), "user_id", "event_id")


@query("stream_regularize", SQL_SERIES + "\nSELECT unit, b, round(x, 6) AS x, n, true AS ok FROM bins WHERE (b + 1) * 3600000000 <= (SELECT max(us) FROM raw) - 7200000000")
def _(spark, sf):
    return rounded(sm.run_available(sm.streaming_regularize(_events(spark, sf), ["unit"], "ts", "v", 60, "2 hours"), "bins"))


def _bins_stream(spark, sf, drop_missing):
    """Regular bins written once and streamed back, as a second stage would read them."""
    path = scratch(spark, "series")
    data = base.series(spark, sf).select("unit", "b", "x")
    (data.filter("x IS NOT NULL") if drop_missing else data).repartition(4, "unit").write.parquet(path)
    return spark.readStream.schema("unit string, b bigint, x double").parquet(path)


@query("stream_causal_fill", SQL_SERIES + """,
near AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN b END) OVER (PARTITION BY unit ORDER BY b ROWS UNBOUNDED PRECEDING) AS pb FROM series)
SELECT n.unit, n.b, round(CASE WHEN n.b - n.pb <= 1 THEN p.x END, 6) AS x, n.x IS NULL AND coalesce(n.b - n.pb <= 1, false) AS gap_filled FROM near n LEFT JOIN series p ON p.unit = n.unit AND p.b = n.pb""")
def _(spark, sf):
    return rounded(sm.run_available(sm.causal_fill(_bins_stream(spark, sf, False), "unit", 1), "filled"))


@query("stream_online_doors", SQL_SERIES.replace("WITH raw", "WITH RECURSIVE raw") + """,
ri AS (SELECT unit, b, x, b - row_number() OVER (PARTITION BY unit ORDER BY b) AS g FROM series WHERE ok),
rn AS MATERIALIZED (SELECT unit, b, x, min(b) OVER (PARTITION BY unit, g) AS run_start, max(b) OVER (PARTITION BY unit, g) AS run_end, max(b) OVER (PARTITION BY unit) AS final FROM ri),
st AS (SELECT unit, run_start, run_end, final, b, x, b AS s, x AS xs, '-Infinity'::DOUBLE AS lo, 'Infinity'::DOUBLE AS hi, NULL::BIGINT AS done_s, NULL::DOUBLE AS done_x FROM rn WHERE b = run_start
 UNION ALL SELECT unit, run_start, run_end, final, b, x, CASE WHEN nl >= nh - 1e-12 THEN b ELSE s END, CASE WHEN nl >= nh - 1e-12 THEN x ELSE xs END, CASE WHEN nl >= nh - 1e-12 THEN '-Infinity'::DOUBLE ELSE nl END, CASE WHEN nl >= nh - 1e-12 THEN 'Infinity'::DOUBLE ELSE nh END, CASE WHEN nl >= nh - 1e-12 THEN s END, CASE WHEN nl >= nh - 1e-12 THEN xs END
 FROM (SELECT q.*, st.s, st.xs, greatest(st.lo, (q.x - st.xs - 5::DOUBLE) / (q.b - st.s)) AS nl, least(st.hi, (q.x - st.xs + 5::DOUBLE) / (q.b - st.s)) AS nh FROM st JOIN rn q ON q.unit = st.unit AND q.run_start = st.run_start AND q.b = st.b + 1))
SELECT unit, done_s AS start, b AS "end", round(done_x, 6) AS x_start, round(x, 6) AS x_end FROM st WHERE done_s IS NOT NULL UNION ALL SELECT unit, s, b, round(xs, 6), round(x, 6) FROM st WHERE b = run_end AND s < b AND run_end < final""")
def _(spark, sf):
    return rounded(sm.run_available(sm.online_doors(_bins_stream(spark, sf, True), "unit", 5.0), "doors"))


@query("stream_maturity_join", SQL_RAW + """
SELECT f.event_id AS forecast_id, o.event_id AS outcome_id FROM raw f JOIN raw o ON f.user_id = o.user_id AND f.unit = 'click' AND o.unit = 'view' AND o.us >= f.us + 14460000000 AND o.us <= f.us + 18060000000""")
def _(spark, sf):
    ev = _events(spark, sf)
    f = ev.filter("unit = 'click'").select("user_id", F.col("ts").alias("issue"), F.col("event_id").alias("forecast_id"))
    o = _events(spark, sf).filter("unit = 'view'").select("user_id", F.col("ts").alias("known"), F.col("event_id").alias("outcome_id"))
    return sm.run_available(sm.maturity_join(f, o, "user_id", "issue", "known").select("forecast_id", "outcome_id"), "mature")


@query("stream_event_supports", SQL_RAW + """,
p AS (SELECT unit, us, CASE WHEN us - lag(us) OVER w <= 14400000000 THEN 0 ELSE 1 END AS new FROM (SELECT user_id AS unit, us FROM raw) WINDOW w AS (PARTITION BY unit ORDER BY us)), g AS (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY us) AS s FROM p)
SELECT unit, min(us) AS start, max(us) AS "end", count(*) AS anchor_count FROM g GROUP BY unit, s HAVING max(us) + 14400000000 <= (SELECT max(us) FROM raw) - 3600000000""")
def _(spark, sf):
    ev = _events(spark, sf).select(F.col("user_id").alias("unit"), "ts")
    return sm.run_available(sm.streaming_supports(ev, ["unit"], "ts", "1 hour"), "supports")


@query("stream_rolling_scores", SQL_RAW + """,
sl AS (SELECT unit, v, unnest(range((us - 345600000000) // 604800000000 - 7, (us - 345600000000) // 604800000000 + 1)) * 604800000000 + 345600000000 AS start FROM (SELECT unit, v, us + 0 AS us FROM raw))
SELECT unit, start, round(avg(v), 6) AS score, count(*) AS n FROM sl WHERE start + 56 * 86400000000 <= (SELECT max(us) FROM raw) - 3600000000 GROUP BY 1, 2""".replace("+ 345600000000 AS start", "AS start").replace("(us - 345600000000)", "us"))
def _(spark, sf):
    return rounded(sm.run_available(sm.rolling_scores(_events(spark, sf), ["unit"], "ts", "v", "1 hour"), "scores"))


@query("stream_alerts", SQL_RAW + """,
th AS (SELECT unit, avg(v) AS threshold, 5.0::DOUBLE AS ratio FROM raw GROUP BY unit)
SELECT unit, count(*) FILTER (WHERE v >= threshold) AS alerts, round(sum(CASE WHEN v >= threshold AND user_id % 2 = 1 THEN 1 WHEN v < threshold AND user_id % 2 = 0 THEN ratio ELSE 0 END), 4) AS cost FROM raw JOIN th USING (unit) GROUP BY unit""")
def _(spark, sf):
    frozen = base.raw_events(spark, sf).groupBy("unit").agg(F.avg("v").alias("threshold"), F.lit(5.0).alias("ratio"))
    ev = _events(spark, sf).withColumn("event", F.col("user_id") % 2 == 0)
    out = sm.run_available(sm.alerts(ev, frozen, ["unit"], "v", "event").select("unit", "alert", "cost"), "alerts")
    return rounded(out.groupBy("unit").agg(F.count_if("alert").alias("alerts"), F.sum("cost").alias("cost")), 4)
