"""An exact local-linear-trend smoother as a parallel scan over chunks.

A filter step is an element (A, b, C, eta, J) and steps combine associatively, so a chunk of a series is one element
whatever state it starts from. Elements of chunks are combined in order, a few numbers a chunk, which gives every chunk the
true state before its first bin; the chunks then filter side by side. Backward the same: a chunk's smoother is an affine map
from the smoothed state behind it, maps are composed from the end, and every chunk finishes from the true state. Nothing is
cut off and no bin is read by two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ramplake.operators.chunks import cut_lineage

STEP = np.array([[1.0, 1.0], [0.0, 1.0]])
LEAST = 1e-8


def noises(variance: float, q_level: float, q_trend: float, r: float) -> tuple[float, float, float]:
    return tuple(max(q * variance, LEAST) for q in (q_level, q_trend, r))


def combined(first: tuple, second: tuple) -> tuple:
    """The element of two neighbouring stretches, for stacks of them."""
    a, b, c, eta, j = first
    a2, b2, c2, eta2, j2 = second
    turn = lambda x: np.swapaxes(x, -1, -2)
    times = lambda m, v: (m @ v[..., None])[..., 0]
    inner = a2 @ np.linalg.inv(np.eye(2) + c @ j2)
    outer = turn(a) @ np.linalg.inv(np.eye(2) + j2 @ c)
    return inner @ a, times(inner, b + times(c, eta2)) + b2, inner @ c @ turn(a2) + c2, times(outer, eta2 - times(j2, b)) + eta, outer @ j2 @ a + j


def element(y: np.ndarray, noise: tuple[float, float, float]) -> tuple:
    """The element of a stretch of measures, missing ones as NaN; pairs of neighbours are combined until one is left."""
    n, q, seen = len(y), np.diag(noise[:2]), np.isfinite(y)
    s = q[0, 0] + noise[2]
    gain = q[:, 0] / s
    hold = np.eye(2) - np.outer(gain, [1.0, 0.0])
    pick = lambda with_it, without: np.where(seen.reshape(-1, *[1] * np.ndim(without)), with_it, without)
    value = np.where(seen, y, 0.0)
    parts = (
        pick(hold @ STEP, STEP), value[:, None] * gain * seen[:, None], pick(hold @ q, q),
        (value * seen / s)[:, None] * STEP[0], pick(np.outer(STEP[0], STEP[0]) / s, np.zeros((2, 2))))
    while n > 1:
        even = n // 2 * 2
        met = combined(tuple(x[0:even:2] for x in parts), tuple(x[1:even:2] for x in parts))
        parts = tuple(np.concatenate([x, old[even:]]) for x, old in zip(met, parts))
        n = len(parts[0])
    return tuple(x[0] for x in parts)


def packed(e: tuple) -> list[float]:
    return np.concatenate([np.ravel(x) for x in e]).tolist()


def unpacked(v) -> tuple:
    v = np.asarray(v, float)
    return v[:4].reshape(2, 2), v[4:6], v[6:10].reshape(2, 2), v[10:12], v[12:16].reshape(2, 2)


def filtered(y: np.ndarray, state: np.ndarray, noise: tuple[float, float, float]) -> np.ndarray:
    """Filter from a state (level, trend, their covariances 11, 12, 22): a row of five for the time before, then each bin."""
    level, trend, c11, c12, c22 = state.tolist()
    q1, q2, r = noise
    out = [(level, trend, c11, c12, c22)]
    for value in y.tolist():
        level += trend
        c11, c12, c22 = c11 + 2 * c12 + c22 + q1, c12 + c22, c22 + q2
        if value == value:
            g1, g2, miss = c11 / (c11 + r), c12 / (c11 + r), value - level
            level, trend = level + g1 * miss, trend + g2 * miss
            c11, c12, c22 = c11 - g1 * c11, c12 - g1 * c12, c22 - g2 * c12
        out.append((level, trend, c11, c12, c22))
    return np.array(out)


def backward(post: np.ndarray, noise: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the affine map (G, g) from the smoothed (level, trend) of the next bin to its own."""
    c11, c12, c22 = post[:, 2], post[:, 3], post[:, 4]
    p11, p12, p22 = c11 + 2 * c12 + c22 + noise[0], c12 + c22, c22 + noise[1]
    spread = np.stack([np.stack([c11 + c12, c12], -1), np.stack([c12 + c22, c22], -1)], -2)
    prior = np.stack([np.stack([p22, -p12], -1), np.stack([-p12, p11], -1)], -2) / (p11 * p22 - p12 * p12)[:, None, None]
    gain = spread @ prior
    ahead = post[:, :2] @ STEP.T
    return gain, post[:, :2] - (gain @ ahead[..., None])[..., 0]


def smoothed(data: DataFrame, keys: list[str], q_level: float, q_trend: float, r: float, size: int) -> DataFrame:
    """Adds ``level`` to rows of keys, b, x, _var (variance of the series), _first (its first value) and _fill, of which
    the first three columns and _fill come back. Rows of a series are successive steps; without spread the level is _first."""
    kinds = dict(data.dtypes)
    at = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _chunk long"
    rows = data.withColumn("_chunk", F.floor(F.col("b") / size))
    chunks = rows.groupBy(*keys, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("b", F.col("x").cast("double").alias("x"), "_fill"))).alias("rows"),  # at most `size`
        F.first("_var").alias("_var"), F.first("_first").alias("_first"))
    chunks = cut_lineage(chunks)
    place = [*keys, "_chunk"]

    def values(row) -> np.ndarray:
        return np.array([np.nan if v["x"] is None else v["x"] for v in row["rows"]], float)

    def noise_of(row) -> tuple[float, float, float]:
        return noises(row["_var"], q_level, q_trend, r)

    def per_chunk(df: DataFrame, make, fields: str) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                found = [(*(row[k] for k in place), *make(row)) for row in part.to_dict("records")]
                yield pd.DataFrame(found, columns=[*place, *(f.split()[0] for f in fields.split(", "))])

        return df.mapInPandas(run, f"{at}, {fields}")

    def per_series(df: DataFrame, make, fields: str, descending: bool = False) -> DataFrame:
        """A few numbers a chunk, in order, one series a task."""
        names = [f.split()[0] for f in fields.split(", ")]

        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("_chunk", ascending=not descending)
            return pd.DataFrame([(*(row[k] for k in place), *new) for row, new in zip(part.to_dict("records"), make(part.to_dict("records")))], columns=[*place, *names])

        return df.groupBy(*keys).applyInPandas(run, f"{at}, {fields}")

    moving = chunks.filter("_var > 0")  # neither null nor NaN
    moving = moving.filter(~F.isnan("_var"))

    def starts(parts):
        head = parts[0]
        spread = head["_var"] * 100.0 + 1.0
        state = np.array([head["_first"], 0.0, spread, 0.0, spread])
        for part in parts:
            yield (state.tolist(),)
            known = (np.zeros((2, 2)), state[:2], state[[2, 3, 3, 4]].reshape(2, 2), np.zeros(2), np.zeros((2, 2)))
            _, mean, cov, _, _ = combined(known, unpacked(part["e"]))
            state = np.array([*mean, cov[0, 0], (cov[0, 1] + cov[1, 0]) / 2, cov[1, 1]])

    elements = per_chunk(moving, lambda row: (packed(element(values(row), noise_of(row))), row["_var"], row["_first"]), "e array<double>, _var double, _first double")
    begun = cut_lineage(moving.join(per_series(elements, starts, "start array<double>"), place))

    def map_of(row):
        """The chunk's map from the state behind it to that of its first bin, and that state if nothing is behind."""
        noise = noise_of(row)
        post = filtered(values(row), np.asarray(row["start"], float), noise)[1:]
        gain, shift = backward(post, noise)
        ended = post[-1, :2]
        whole, moved = np.eye(2), np.zeros(2)
        for k in range(len(post) - 1, -1, -1):
            whole, moved = gain[k] @ whole, gain[k] @ moved + shift[k]
            if k < len(post) - 1:
                ended = gain[k] @ ended + shift[k]
        return (packed((whole, moved, ended)),)

    def behinds(parts):
        behind = None
        for part in parts:
            yield (None if behind is None else behind.tolist(),)
            v = np.asarray(part["m"], float)
            behind = v[6:] if behind is None else v[:4].reshape(2, 2) @ behind + v[4:6]

    maps = per_chunk(begun, map_of, "m array<double>")
    ready = begun.join(per_series(maps, behinds, "behind array<double>", descending=True), place)

    def levels(row):
        noise = noise_of(row)
        post = filtered(values(row), np.asarray(row["start"], float), noise)[1:]
        gain, shift = backward(post, noise)
        out = np.empty(len(post))
        later = post[-1, :2] if row["behind"] is None else gain[-1] @ np.asarray(row["behind"], float) + shift[-1]
        out[-1] = later[0]
        for k in range(len(post) - 2, -1, -1):
            later = gain[k] @ later + shift[k]
            out[k] = later[0]
        return (out.tolist(),)

    done = chunks.join(per_chunk(ready, levels, "levels array<double>"), place, "left")
    none = F.transform("rows", lambda row: F.lit(None).cast("double"))
    each = done.withColumn("levels", F.coalesce("levels", none)).select(*keys, "_first", F.explode(F.arrays_zip("rows", "levels")).alias("v"))
    return each.select(*keys, "v.rows.b", "v.rows.x", "v.rows._fill", F.coalesce("v.levels", F.col("_first").cast("double")).alias("level"))
