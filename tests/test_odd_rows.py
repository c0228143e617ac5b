"""Rows and values that SQL has where nothing was measured."""

import pytest

import __spark_entry__ as entry_module
from harness import compare, connect
from pyspark.sql import functions as F
from ramplake.functions import geo, scalar
from ramplake.operators import decide

LARGER = "/root/testdata/sf0.1"


def test_no_direction_without_speed(spark):
    """F11"""
    d = geo.speed_dir(F.col("u"), F.col("v"))
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, -2.0), (3, None, 1.0)], "k int, u double, v double")
    still, moving, unknown = df.select("k", *[c.alias(n) for n, c in d.items()]).orderBy("k").collect()
    assert still.speed == 0 and still.dir_sin != still.dir_sin and still.dir_cos != still.dir_cos
    assert moving.speed == 2 and moving.dir_sin == -1
    assert unknown.dir_sin is None and unknown.dir_cos is None


def test_neutral_length_is_scaled_like_the_longest(spark):
    """F12"""
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, -300.0), (4, 20.0)], "k int, v double")
    rows = df.select("k", *[c.alias(n) for n, c in scalar.stability_bins(F.col("v")).items()]).orderBy("k").collect()
    assert [(r.l_scaled, r.l_grade, r.l_bin) for r in rows] == [(1.0, 0.5, 3), (1.0, 0.5, 3), (-1.0, 0.5, 3), (0.1, 1.0, 0)]


def test_strength_without_score_comes_last(spark):
    """F9"""
    scores = lambda *rows: decide.select_lambda(spark.createDataFrame(rows, "strength double, score double"), "score", "strength").first()
    assert tuple(scores((1.0, None), (0.1, 0.5), (0.01, 0.5))) == (0.1, 0.5)
    assert tuple(scores((0.1, None), (1.0, None))) == (1.0, None)


@pytest.mark.parametrize("name", "speed_direction stability_bins select_lambda auc_block_draws paired_score_rows".split())
def test_larger_tables(spark, name):
    """in the larger tables the farm has no event in some splits, and there are still winds and neutral lengths"""
    verdict, _, _ = compare(spark, connect(LARGER), entry_module.queries()[name], entry_module.oracle_sql()[name], LARGER)
    assert verdict == "ok", verdict
