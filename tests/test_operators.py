"""Small exact cases and properties for operators without a SQL twin, and for edge rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ramplake.functions import losses as ls, paths
from ramplake.operators import bootstrap as bs, detect as dt, joins, models as md, qc, scoring, stations as stn, timegrid as tg

MIN = 60_000_000


def test_regularize_rules(spark):
    """End labels, a duplicate and a missing sample: only whole bins are usable."""
    stamps = [15, 30, 45, 60, 75, 75, 90, 105, 120, 135, 150, 180]
    df = spark.createDataFrame([("u", m * MIN, float(i), True) for i, m in enumerate(stamps)], "unit string, us long, v double, good boolean")
    out = {r.b: r for r in tg.regularize(df, ["unit"], "us", "v", "good", 60, native_minutes=15, position="end").collect()}
    assert out[0].ok and out[0].x == pytest.approx(1.5)
    assert not out[1].ok and out[1].x is None and out[1].duplicate_rows == 2
    assert not out[2].ok and out[2].n_total == 3


@pytest.mark.parametrize("path,cls,first", [
    ([0.0, 0.5] + [0.5] * 15, 1, 16), ([0.5, 0.0] + [0.0] * 15, 2, 0), ([0.0, 0.5, 0.0] + [0.0] * 14, 3, 1), ([0.1] * 17, 0, 16), ([0.5, 0.3] + [0.3] * 15, 2, 0)])
def test_class_and_passage(spark, path, cls, first):
    row = spark.createDataFrame([(path,)], "path array<double>").select(paths.process_class("path", 0.2).alias("c"), paths.first_passage("path", 0.2).alias("a")).first()
    assert (row.c, row.a) == (cls, first)


def test_gap_fill_runs(spark):
    x = [None, 1.0, None, 3.0, None, None, 6.0, None, None, None, 10.0, None]
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate(x)], "unit string, b long, x double")
    lin = [r.x for r in tg.gap_fill(df, ["unit"], "linear", 1).orderBy("b").collect()]
    assert lin == [None, 1, 2, 3, 4, 5, 6, 7, None, 9, 10, None]
    ff = [r.x for r in tg.gap_fill(df, ["unit"], "ffill", 1).orderBy("b").collect()]
    assert ff == [None, 1, 1, 3, 3, None, 6, 6, None, None, 10, 10]
    kal = tg.kalman_fill(df, ["unit"], 2).orderBy("b").toPandas()
    assert list(kal["gap_filled"]) == [False, False, True, False, True, True, False, False, False, False, False, False]


def smoothed_by_matrices(y, variance, first, q_level=0.05, q_trend=0.005, r=0.1):
    """Level of the whole series: filter forward, smoother backward, in matrices."""
    step, noise = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([q_level * variance, q_trend * variance])
    state, cov = np.array([first, 0.0]), np.eye(2) * (variance * 100 + 1)
    priors, posts = [], []
    for v in y:
        state, cov = step @ state, step @ cov @ step.T + noise
        priors.append((state, cov))
        if np.isfinite(v):
            gain = cov[:, 0] / (cov[0, 0] + r * variance)
            state, cov = state + gain * (v - state[0]), cov - np.outer(gain, cov[0])
        posts.append((state, cov))
    later, out = posts[-1][0], [posts[-1][0][0]]
    for (state, cov), (ahead, spread) in zip(posts[-2::-1], priors[:0:-1]):
        later = state + cov @ step.T @ np.linalg.inv(spread) @ (later - ahead)
        out.append(later[0])
    return np.array(out[::-1])


@pytest.mark.parametrize("size", [7, 400, 10**6])
def test_kalman_is_exact_for_any_chunk_size(spark, size):
    rng = np.random.default_rng(2)
    n = 1200
    frames, want = [], {}
    for unit in "uv":
        x = 5 + np.cumsum(rng.normal(0, 0.3, n))
        x[rng.random(n) < 0.1] = np.nan
        x[300:700] = np.nan  # chunks without any value
        want[unit] = x, smoothed_by_matrices(x, float(np.nanvar(x)), float(x[np.isfinite(x)][0]))
        frames.append(pd.DataFrame({"unit": unit, "b": np.arange(n) - 50, "x": x}))
    flat = pd.DataFrame({"unit": "flat", "b": range(9), "x": [2.0, 2.0, np.nan, 2.0, np.nan, np.nan, 2.0, 2.0, 2.0]})
    none = pd.DataFrame({"unit": "none", "b": range(3), "x": [np.nan] * 3})
    df = spark.createDataFrame(pd.concat([*frames, flat, none])).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = tg.kalman_fill(df, ["unit"], 500, size=size).orderBy("unit", "b").toPandas()
    for unit, (x, level) in want.items():
        mine = got[got["unit"] == unit]
        filled = mine["gap_filled"].to_numpy(bool)
        inner = np.flatnonzero(np.isfinite(x))
        assert filled.sum() == np.isnan(x[inner[0] : inner[-1]]).sum() > 400
        np.testing.assert_allclose(mine["x"].to_numpy(float)[filled], level[filled], atol=1e-9)
    assert got[got["unit"] == "flat"]["x"].tolist() == [2.0] * 9 and not got[got["unit"] == "none"]["gap_filled"].any()


def test_power_curve_min_count_and_zero_mad(spark):
    flat = [("u", 5.0, 10.0)] * 38 + [("u", 5.0, 11.0), ("u", 5.0, 50.0)]
    few = [("v", 5.0, float(i % 3)) for i in range(38)] + [("v", 5.0, 99.0)]
    df = spark.createDataFrame(flat + few, "unit string, wind double, power double")
    out = qc.power_curve_outliers(df, "unit", "wind", "power").filter("outlier").collect()
    assert out == []  # no spread at all in u, too few rows in v
    wide = spark.createDataFrame([("u", 5.0, float(i % 5)) for i in range(60)] + [("u", 5.0, 99.0)], "unit string, wind double, power double")
    assert [r.power for r in qc.power_curve_outliers(wide, "unit", "wind", "power").filter("outlier").collect()] == [99.0]


def test_losses_by_hand(spark):
    q = [1 / 16] * 16
    row = spark.createDataFrame([(3, 2, [0.1, 0.2, 0.3, 0.4], q), (0, 16, [1.0, 0.0, 0.0, 0.0], q)], "y int, arr int, p array<double>, q array<double>")
    c, t = ls.class_losses(F.col("y"), F.col("p")), ls.timing_losses(F.col("arr"), F.col("q"), F.col("p")[2] + F.col("p")[3])
    a, b = row.select(*[v.alias(k) for k, v in {**c, **t}.items()]).collect()
    assert a.return_brier == pytest.approx(0.36) and a.multiclass_brier == pytest.approx(0.01 + 0.04 + 0.09 + 0.36)
    cdf = np.cumsum(q)
    cdf[-1] = 1
    truth = np.arange(16) >= 2
    assert a.conditional_rps == pytest.approx(np.mean((cdf[:-1] - truth[:-1]) ** 2)) and a.conditional_median_mae == 15 * 5
    assert a.joint_rps == pytest.approx(np.mean((cdf * 0.7 - truth) ** 2))
    assert b.conditional_rps is None and b.joint_rps == 0 and b.log_loss == 0


def test_crps(spark):
    m, y = [0.2, 0.9, 0.4], 0.5
    got = spark.createDataFrame([(m, y)], "m array<double>, y double").select(ls.crps(F.col("m"), F.col("y"), 3).alias("c")).first().c
    pair = np.mean([abs(a - b) for a in m for b in m]) / 2
    assert got == pytest.approx(np.mean([abs(a - y) for a in m]) - pair)


def test_identical_arms_give_zero(spark):
    rows = [("a", i, i // 7, float(i % 5) + 0.1) for i in range(21)] + [("r", i, i // 7, float(i % 5) + 0.1) for i in range(21)]
    df = spark.createDataFrame(rows, "arm string, b long, block long, loss double").withColumn("lead", F.lit(1))
    pos = bs.dense_blocks(df)
    w = bs.block_weights(pos, 200)
    assert w.groupBy("draw").agg(F.sum("w").alias("s")).filter("s <> 3").count() == 0
    out = bs.paired_reduction(bs.pair_arms(df, "a", "r", ["lead"]), ["lead"], w, pos).first()
    assert (out.reduction_pct, out.low, out.high, out.valid_draws) == (0.0, 0.0, 0.0, 200)


@pytest.mark.parametrize("partitions", ["4", "16"])
def test_auc_draws_match_weighted_definition(spark, monkeypatch, partitions):
    monkeypatch.setattr(bs, "DRAWS_AT_ONCE", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many score ranges
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        auc_draws_match(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def auc_draws_match(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"lead": 1, "block": rng.integers(0, 4, 80), "y": rng.integers(0, 2, 80), "s": rng.integers(0, 9, 80) / 10})
    df = spark.createDataFrame(pdf)
    pos = bs.dense_blocks(df)
    w = bs.block_weights(pos, 12)
    got = bs.auc_draws(df, ["lead"], "y", "s", w, pos).toPandas().set_index("draw")["value"]
    wt = w.toPandas().pivot(index="draw", columns="pos", values="w").fillna(0)
    p, n = pdf[pdf.y == 1], pdf[pdf.y == 0]
    for d in wt.index:
        wp, wn = wt.loc[d].reindex(p.block).to_numpy(), wt.loc[d].reindex(n.block).to_numpy()
        gain = (p.s.to_numpy()[:, None] > n.s.to_numpy()) + 0.5 * (p.s.to_numpy()[:, None] == n.s.to_numpy())
        assert got[d] == pytest.approx((wp[:, None] * wn * gain).sum() / (wp.sum() * wn.sum()))


def test_spaced_sample_is_the_sequential_one(spark):
    import hashlib
    rng = np.random.default_rng(4)
    rows = [("u" if i % 3 else "v", int(b), s) for i, b in enumerate(rng.choice(400, 150, replace=False)) for s in ("x", "y") if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "unit string, b long, stratum string")
    quotas = {"x": 12, "y": 30}
    got = {(r.unit, r.b, r.stratum) for r in dt.spaced_sample(df, ["unit"], quotas, 6).collect()}
    used, want = {}, set()
    for s, quota in quotas.items():
        order = sorted((hashlib.md5(f"41-{u}-{s}-{b}".encode()).hexdigest(), u, b) for u, b, t in rows if t == s)
        count = 0
        for _, u, b in order:
            if count == quota:
                break
            if all(abs(b - o) >= 6 for o in used.get(u, [])):
                used.setdefault(u, []).append(b)
                want.add((u, b, s))
                count += 1
    assert got == want


def test_softmax_fit_is_stationary():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 3)), rng.integers(0, 4, 300)
    w = md.softmax_fit(x, y, 4, 0.01)
    xb = np.hstack([x, np.ones((300, 1))])
    p = np.exp(xb @ w)
    p /= p.sum(axis=1, keepdims=True)
    grad = xb.T @ (p - np.eye(4)[y]) / 300 + 0.01 * np.vstack([w[:3], np.zeros((1, 4))])
    assert np.abs(grad).max() < 1e-7


def test_rank_assign_and_reshape(spark):
    rng = np.random.default_rng(6)
    members = [(1, m, (2 + rng.random(17)).tolist()) for m in range(6)] + [(1, 6, [2.0] * 17)]
    df = spark.createDataFrame(members, "id long, member int, path array<double>")
    samples = spark.createDataFrame([(1, m, float(v)) for m, v in enumerate([3, 1, 2, 0.5, 5, 4, 0.1])], "id long, member int, sample double")
    ranked = md.rank_assign(df, samples)
    out = md.reshape_range(df, ranked).toPandas().set_index("member")
    old = {m: max(p) - min(p) for _, m, p in members}
    new = {m: max(p) - min(p) for m, p in out["path"].items()}
    assert sorted(old, key=old.get) == sorted(new, key=new.get) and sorted(round(v, 9) for v in new.values()) == [0.1, 0.5, 1, 2, 3, 4, 5]
    assert out.loc[6, "flat"] and all(min(p) >= 0 for p in out["path"])
    for m, p in out["path"].items():
        assert out.loc[m, "lift"] == pytest.approx(np.mean(p) - np.mean(members[m][2]), abs=1e-9)


def test_gradient_needs_three_stations_and_spread(spark):
    rows = [(1, s, float(v), 1.0, la, lo) for s, v, la, lo in [(1, 1, 30.0, 110.0), (2, 2, 30.1, 110.0), (3, 1, 30.0, 110.1)]]
    rows += [(2, s, 1.0, 1.0, 30.0 + s * 0.1, 110.0 + s * 0.1) for s in (1, 2, 3)] + [(3, s, 1.0, 1.0, 30.0, 110.0 + s) for s in (1, 2)]
    df = spark.createDataFrame(rows, "t long, station_id long, value double, available double, lat double, lon double")
    out = {r.t: r for r in stn.gradient_direction(df).collect()}
    assert out[1].proxy_v == pytest.approx(1.0) and abs(out[1].proxy_u) < 1e-9
    assert out[2].proxy_available == 0 and out[3].proxy_available == 0


def test_neighbour_draws_come_from_the_shared_leaf(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": np.arange(200), "y": rng.integers(0, 3, 200), "x": [r.tolist() for r in rng.normal(size=(200, 3))]})
    df = spark.createDataFrame(pdf)
    model = md.forest(df, "y", trees=4, depth=3, leaf=5)
    cases = df.filter("id < 40")
    draws = md.draw_neighbours(model, df, cases)
    leaf = md.leaf_rows(model, df, ["id"])
    a = draws.join(leaf, ["id", "tree"]).withColumnRenamed("leaf", "mine")
    both = a.join(leaf.select(F.col("id").alias("donor_id"), "tree", "leaf"), ["donor_id", "tree"])
    assert draws.count() == 160 and both.filter("mine <> leaf").count() == 0 and both.count() == 160


def test_interpolation_outside(spark):
    hour = 3_600_000_000
    src = spark.createDataFrame([("u", 10 * hour, 1.0), ("u", 11 * hour, 3.0)], "unit string, us long, v double")
    nodes = spark.createDataFrame([("u", 10 * hour), ("u", 10 * hour + hour // 4), ("u", 11 * hour), ("u", 11 * hour + 1)], "unit string, us long")
    assert [r.v for r in joins.interpolate_hourly(nodes, src, ["unit"], "us", ["v"]).orderBy("us").collect()] == [1.0, 1.5, 3.0, None]
    assert [r.v for r in joins.interpolate_irregular(nodes, src, ["unit"], "us", "v", "clamp").orderBy("us").collect()] == [1.0, 1.5, 3.0, 3.0]


def test_reliability_edges_hold_their_lower_end(spark):
    nan = float("nan")
    rows = [(0.0, 0), (0.2, 1), (0.5, 1), (0.9, 0), (1.0, 1), (1.2, 1), (-0.1, 0), (nan, 1), (None, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    counts = lambda edges: {(r["bin_low"], r["bin_high"]): r["n"] for r in scoring.reliability_between(df, [], "p", "y", edges).collect()}
    assert counts([0.0, 0.2, 0.5, 1.0]) == {(0.0, 0.2): 1, (0.2, 0.5): 1, (0.5, 1.0): 3}
    assert counts([0.2, 0.5, 0.9]) == {(0.2, 0.5): 1, (0.5, 0.9): 1}  # an upper edge below one isn't in its bin
    assert scoring.reliability_between(df.filter("false"), [], "p", "y", [0.0, 1.0]).collect() == []
