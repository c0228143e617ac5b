"""Late rows of the streaming rules: a bin that has been decided isn't decided again."""

import os

import pandas as pd

from ramplake.streaming import streams


def in_two_batches(spark, folder, first, second):
    for k, rows in enumerate((first, second)):
        path = f"{folder}/{k}.parquet"
        pd.DataFrame(rows, columns=["unit", "b", "x"]).astype({"b": "int64", "x": "float64"}).to_parquet(path)
        os.utime(path, (1_700_000_000 + 100 * k,) * 2)
    return spark.readStream.schema("unit string, b long, x double").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_fill_never_takes_a_later_value(spark, tmp_path):
    df = in_two_batches(spark, tmp_path, [("a", 0, 1.0), ("a", 3, 4.0)], [("a", 2, None), ("a", 1, 9.0), ("a", 4, None)])
    got = {(r["b"], r["x"], r["gap_filled"]) for r in streams.run_available(streams.causal_fill(df, "unit", 2), "fill").collect()}
    assert got == {(0, 1.0, False), (3, 4.0, False), (4, 4.0, True)}


def test_late_row_is_no_break(spark, tmp_path):
    df = in_two_batches(spark, tmp_path, [("a", b, 0.0) for b in range(4)], [("a", 1, 50.0), ("a", 4, 0.0), ("a", 6, 1.0)])
    got = {(r["start"], r["end"]) for r in streams.run_available(streams.online_doors(df, "unit", 0.1), "doors").collect()}
    assert got == {(0, 4)}
