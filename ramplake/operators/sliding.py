"""Exact quantiles of a sliding window whose cost does not grow with the window.

A window frame of an aggregate like ``percentile`` is evaluated from scratch for every row: rows x window x log. Here a
chunk's values are ranked once and its ranks kept in a wavelet matrix (one bit of the ranks a level, each level with its
bits counted from the left). The k-th smallest of any stretch of rows is then one walk down the levels, for all rows at
once: rows x log, whatever the window. Rows are cut into index chunks with a halo of one window, as in ``chunks``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T


class WaveletMatrix:
    """Answers which of the ranks from `low` to `high` (not included) is the k-th smallest, for arrays of questions."""

    def __init__(self, ranks: np.ndarray):
        self.levels = []
        top = max(1, int(len(ranks) - 1).bit_length()) if len(ranks) else 1
        for bit in range(top - 1, -1, -1):
            ones = (ranks >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((bit, zeros))
            ranks = np.concatenate([ranks[~ones], ranks[ones]])

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        low, high, k, found = low.copy(), high.copy(), k.copy(), np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            ones = k >= b - a
            k -= np.where(ones, b - a, 0)
            low, high = np.where(ones, zeros[-1] + low - a, a), np.where(ones, zeros[-1] + high - b, b)
            found |= ones.astype(np.int64) << bit
        return found


def trailing_quantiles(index: np.ndarray, values: np.ndarray, back: int, probs: list[float]) -> np.ndarray:
    """For each row the quantiles of the values whose index is 1 to `back` below its own; NaN unless all `back` are there.
    `index` ascends strictly, a missing value is NaN."""
    low, high = np.searchsorted(index, index - back), np.arange(len(index))
    holes = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    out = np.full((len(index), len(probs)), np.nan)
    rows = np.flatnonzero((high - low == back) & (holes[high] == holes[low]))
    if not len(rows):
        return out
    order = np.argsort(values, kind="stable")
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.arange(len(values))
    matrix, ordered = WaveletMatrix(ranks), values[order]
    pick = lambda k: ordered[matrix.smallest(low[rows], high[rows], np.full(len(rows), k))]
    for j, p in enumerate(probs):
        at = p * (back - 1)
        below, above = int(np.floor(at)), int(np.ceil(at))
        out[rows, j] = pick(below) if below == above else (above - at) * pick(below) + (at - below) * pick(above)
    return out


def add_trailing_quantiles(chunked: DataFrame, keys: list[str], idx: str, named: dict[str, str], back: int, probs: list[float]) -> DataFrame:
    """Adds for each (new column: value column) of `named` an array of quantiles of the trailing window, null unless the
    window is complete. `chunked` is cut into chunks with a halo of `back` at least (``chunks.with_halo``), one row for
    each index of (keys, _chunk)."""
    added = T.ArrayType(T.DoubleType())
    schema = T.StructType([*chunked.schema.fields, *(T.StructField(name, added) for name in named)])

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by(idx)
        index = table[idx].to_numpy()
        for name, value in named.items():
            values = table[value].cast(pa.float64()).fill_null(np.nan).to_numpy()
            found = trailing_quantiles(index, values, back, probs)
            flat = pa.array(found.reshape(-1))
            whole = np.isfinite(found[:, 0])
            lists = pa.ListArray.from_arrays(pa.array(len(probs) * np.arange(len(found) + 1), pa.int32()), flat, mask=pa.array(~whole))
            table = table.append_column(name, lists)
        return table

    return chunked.groupBy(*keys, "_chunk").applyInArrow(fill, schema)
