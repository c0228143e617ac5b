import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ramplake.operators.chunks import equal_chunks, exact_quantiles, running, windowed
from ramplake.operators.joins import asof_nearest


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(size=n).round(2)
    return pd.DataFrame({"k": rng.choice(["hot", "hot", "hot", "a", "b"], n), "b": np.arange(n) + 1000, "x": np.where(rng.random(n) < 0.2, np.nan, x)})


def test_running_matches_pandas(spark, rows):
    df = spark.createDataFrame(rows).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    out = running(df, ["k"], "b", {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x"))}, size=16)
    out = running(out, ["k"], "b", {"nx": ("last", F.col("x"))}, size=16, reverse=True).toPandas().sort_values(["k", "b"])
    ref = rows.sort_values(["k", "b"])
    g = ref.groupby("k")["x"]
    np.testing.assert_allclose(out["s"], ref["x"].fillna(0).groupby(ref["k"]).cumsum(), atol=1e-9)
    np.testing.assert_allclose(out["l"].astype(float), g.ffill(), atol=1e-12)
    np.testing.assert_allclose(out["nx"].astype(float), g.bfill(), atol=1e-12)
    np.testing.assert_allclose(out["m"].astype(float), g.transform(lambda s: s.ffill().cummax()), atol=1e-12)


def test_windowed_matches_one_partition(spark, rows):
    df = spark.createDataFrame(rows.drop(columns="k")).withColumn("k", F.lit(1))
    cols = lambda w: {"c": F.count("x").over(w.rangeBetween(-9, 4)), "p": F.lag("b", 3).over(w)}
    a = windowed(df, ["k"], "b", 9, 4, cols, size=16).toPandas().sort_values("b").reset_index(drop=True)
    b = windowed(df, ["k"], "b", 9, 4, cols, size=10**9).toPandas().sort_values("b").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("accuracy", [20, 20000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.where(rng.random(9000) < 0.7, "hot", "cold"), "x": np.where(rng.random(9000) < 0.4, 7.0, rng.exponential(5, 9000).round(3))})
    probs = {"q0": 0.0, "q25": 0.25, "q5": 0.5, "q995": 0.995, "q1": 1.0}
    out = exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", probs, accuracy).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for n, p in probs.items():
            assert out.loc[k, n] == pytest.approx(np.quantile(g["x"], p), abs=1e-9), (k, n)


@pytest.fixture
def many_chunks(spark):
    """Small tables are not merged into one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def crowded(seed, n, day=86_400_000_000):
    """One key has nine rows in ten, all of them in one day."""
    rng = np.random.default_rng(seed)
    hot = pd.DataFrame({"k": "hot", "t": rng.choice(day // 1000, n * 9 // 10, replace=False) * 1000 + 5 * day})
    rest = pd.DataFrame({"k": rng.choice(["a", "b"], n // 10), "t": rng.choice(400, n // 10) * day})
    return pd.concat([hot, rest.drop_duplicates()]).assign(v=lambda f: np.arange(len(f), dtype=float))


def test_a_busy_day_of_one_key_is_many_chunks(spark, many_chunks):
    rows = crowded(1, 8000)
    placed = equal_chunks(spark.createDataFrame(rows), ["k"], "t")
    sizes = [r["count"] for r in placed.groupBy("_chunk").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 3 * len(rows) / 16 and sum(sizes) == len(rows)
    out = running(placed, ["k"], "t", {"s": ("sum", F.col("v")), "l": ("last", F.col("t"))}, chunk="_chunk", strict=True).toPandas().sort_values(["k", "t"])
    ref = rows.sort_values(["k", "t"])
    np.testing.assert_allclose(out["s"], ref.groupby("k")["v"].cumsum() - ref["v"])
    before = ref.groupby("k")["t"].shift()
    assert (out["l"].isna().to_numpy() == before.isna().to_numpy()).all() and np.array_equal(out["l"].dropna().astype("int64"), before.dropna().astype("int64"))


def test_asof_of_crowded_sides_equals_pandas(spark, many_chunks):
    left, right = crowded(2, 4000).drop(columns="v"), crowded(3, 3000)
    got = asof_nearest(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "v", 50_000_000).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = []
    for k, t in left.sort_values(["k", "t"]).itertuples(index=False):
        times = np.sort(right.loc[right["k"] == k, "t"].to_numpy())
        at = np.searchsorted(times, t)
        near = [x for x in times[max(0, at - 1) : at + 1] if abs(x - t) <= 50_000_000]
        want.append(min(near, key=lambda x: (abs(x - t), x)) if near else None)
    assert [None if np.isnan(x) else int(x) for x in got["match_us"].astype(float)] == want
