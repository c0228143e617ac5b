"""Sliding quantiles against numpy, and their cost."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ramplake.operators.chunks import with_halo
from ramplake.operators.sliding import WaveletMatrix, add_trailing_quantiles, trailing_quantiles


def test_every_rank_of_every_stretch():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        ranks = rng.permutation(n)
        matrix = WaveletMatrix(ranks)
        for low in range(n):
            for high in range(low + 1, n + 1):
                k = np.arange(high - low)
                assert matrix.smallest(np.full(len(k), low), np.full(len(k), high), k).tolist() == sorted(ranks[low:high].tolist())


def by_numpy(index, values, back, probs):
    out = np.full((len(index), len(probs)), np.nan)
    for i, b in enumerate(index):
        window = values[(index >= b - back) & (index < b)]
        if len(window) == back and np.isfinite(window).all():
            out[i] = np.quantile(window, probs)
    return out


def series(n, seed=1):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=n).round(1)  # many ties
    values[rng.random(n) < 0.02] = np.nan
    index = np.arange(n)
    keep = rng.random(n) > 0.01
    return index[keep], values[keep]


def test_trailing_quantiles_equal_numpy():
    index, values = series(900)
    for back, probs in ((1, [0.5]), (7, [0.0, 0.3, 1.0]), (24, [0.05, 0.95])):
        np.testing.assert_allclose(trailing_quantiles(index, values, back, probs), by_numpy(index, values, back, probs), atol=1e-12)


def test_chunks_and_keys(spark):
    frames = []
    for seed, unit in enumerate("ab"):
        index, values = series(700, seed)
        frames.append(pd.DataFrame({"unit": unit, "b": index - 100, "v": values, "n": pd.array([None] * len(index), "Int64")}))
    df = spark.createDataFrame(pd.concat(frames), "unit string, b long, v double, n long").withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = add_trailing_quantiles(with_halo(df, "b", 12, 0, 50), ["unit"], "b", {"q": "v"}, 12, [0.1, 0.9]).filter("_own").orderBy("unit", "b").toPandas()
    want = np.concatenate([by_numpy(f["b"].to_numpy(), f["v"].to_numpy(float), 12, [0.1, 0.9]) for f in frames])
    mine = np.array([[np.nan] * 2 if q is None else q for q in got["q"]], float)
    np.testing.assert_allclose(mine, want, atol=1e-12)
    assert np.isfinite(want).any() and len(got) == sum(map(len, frames))


def test_cost_does_not_grow_with_the_window():
    values = np.random.default_rng(3).normal(size=200_000)
    index = np.arange(len(values))

    def seconds(back):
        start = time.perf_counter()
        trailing_quantiles(index, values, back, [0.05, 0.95])
        return time.perf_counter() - start

    seconds(10)
    assert seconds(50_000) < 4 * seconds(50) + 0.5
