"""Missing values through bounds and the rules that use them."""

import math

from pyspark.sql import functions as F

from ramplake.functions import clip, economics, losses
from ramplake.operators.decide import decision_cost
from ramplake.sources import readers


def test_bounds_keep_missing_values(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (-2.0,), (0.5,), (7.0,)], "x double")
    got = [r[0] for r in rows.select(clip.clip(F.col("x"), 0.0, 1.0)).collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [0.0, 0.5, 1.0]


def test_unknown_forecast_has_no_cost(spark):
    rows = spark.createDataFrame([(None, True), (0.9, None), (0.9, False), (0.1, True)], "p double, e boolean")
    assert [r[0] for r in rows.select(decision_cost(F.col("p"), F.col("e"), F.lit(0.5), F.lit(4.0))).collect()] == [None, None, 1.0, 4.0]


def test_bad_readings_are_left_out_and_columns_are_found_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("turbine_id,datetime,wind_speed,power\n1,2020-01-01 00:00:00,abc,5\n1,2020-01-01 00:01:00,4,bad\n1,2020-01-01 00:02:00,4,5\n")
    (tmp_path / "b.csv").write_text("power,wind_speed,datetime,turbine_id\n8,3,2020-01-01 00:03:00,2\n")
    (tmp_path / "c.csv").write_text("something,else\n1,2\n")
    got = readers.read_scada_csv(spark, str(tmp_path)).collect()
    assert sorted((r["turbine_id"], r["wind_speed_1min"], r["power_1min_inst"]) for r in got) == [("1", 4.0, 5.0), ("2", 3.0, 8.0)]
