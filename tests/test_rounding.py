"""Rounded results that used to hang on the last bit of a sum."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ramplake.operators import qc, timegrid as tg
from ramplake.plans import base
from ramplake.plans.registry import rounded

MIXED = [0.3, 1e16, 0.1, -1e16, 0.7, 0.2]


def test_rounds_like_sql(spark):
    values = [0.5146875, 1.0000005, 2.0000005, -0.0000005, 41.02281249999999, 41.0228125, 1e300, -7.25, 0.0, float("inf"), float("nan")]
    values += [k / 3200 for k in range(1, 4000, 7)]
    got = rounded(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")).orderBy("k").collect()
    want = duckdb.sql(f"SELECT round(unnest({[str(v) for v in values]}::DOUBLE[]), 6)").fetchall()
    assert [str(r.v + 0.0) for r in got] == [str(w + 0.0) for (w,) in want]
    null = rounded(spark.createDataFrame([(1, None)], "k int, v double")).first()
    assert null.v is None


@pytest.mark.parametrize("parts", [1, 3, 6])
def test_bin_mean_adds_in_the_given_order(spark, parts):
    """F3, F4, F6, F7, F8, F13, F14"""
    rows = [("a", k * 1_000_000, v, k) for k, v in enumerate(MIXED)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: -r[2]), "unit string, us long, v double, k long").repartition(parts, "v")
    total = 0.0
    for v in MIXED:
        total += v
    got = tg.regularize(df, ["unit"], "us", "v", None, 60, order="k").first()
    assert got.x == total / len(MIXED) and got.n_total == len(MIXED)


@pytest.mark.parametrize("parts", [1, 5])
def test_events_of_one_instant_are_samples(spark, tmp_path, parts):
    """F1 to F9: the series counts every event, also those of one unit that share a microsecond, as its SQL does"""
    minutes = [1, 2, 2, 2, 70, 70, 130, 130, 190]
    values = [1.0, 2.0, 6.0, None, 3.0, 8.0, 5.0, 5.0, 4.0]
    rows = [(k, m, u, v) for u in ("a", "b") for k, (m, v) in enumerate(zip(minutes, values))]
    events = spark.createDataFrame([(k + 100 * (u == "b"), 7, u, v, m * 60_000_000 + 1) for k, m, u, v in rows], "event_id long, user_id long, event_type string, value double, us long")
    events.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us").repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    got = base.series(spark, str(tmp_path)).orderBy("unit", "b")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(base.SQL_SERIES + " SELECT unit, b, x, ok, n FROM series ORDER BY unit, b").fetchall()
    assert [tuple(r) for r in got.select("unit", "b", "x", "ok", "n").collect()] == want
    assert [(w[2], w[4]) for w in want[:4]] == [(3.0, 4), (5.5, 2), (5.0, 2), (4.0, 1)]


def test_repeated_native_samples_stay_invalid(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0), ("a", 1, 4.0)], "unit string, us long, v double")
    got = {r: tg.regularize(df, ["unit"], "us", "v", None, 60, repeats=r).first() for r in ("invalid", "samples")}
    assert (got["invalid"].x, got["invalid"].n_total, got["invalid"].duplicate_rows) == (4.0, 2, 2)
    assert (got["samples"].x, got["samples"].n_total, got["samples"].duplicate_rows) == (7.0 / 3, 3, 0)
    with pytest.raises(ValueError):
        tg.regularize(df, ["unit"], "us", "v", None, 60, repeats="first")


@pytest.mark.parametrize("parts", [1, 3, 6])
def test_farm_sum_has_one_order(spark, parts):
    """F2"""
    df = spark.createDataFrame([(0, v, 1) for v in MIXED] + [(1, None, 1)], "b long, x double, n long").repartition(parts, "x")
    total = 0.0
    for v in sorted(MIXED):
        total += v
    first, empty = qc.farm_features(df, "b", "x", "n").orderBy("b").collect()
    assert first.power == total and first.complete_units == len(MIXED)
    assert empty.power == 0.0 and empty.complete_units == 0
