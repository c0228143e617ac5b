"""Paired calendar-block bootstrap.

Losses are first summed per block (map-side partial aggregation does the heavy work); only the small table of
block sums meets the draws. The weights are multinomial: each draw has as many slots as there are blocks and a
digest picks the block of a slot, so all arms, leads and comparators share them and any engine can repeat them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ramplake.config import DAY_US
from ramplake.operators.chunks import equal_chunks


def block_id(us: Column, days: int) -> Column:
    return F.floor(us / F.lit(days * DAY_US)).cast("long")


def dense_blocks(rows: DataFrame, block: str = "block") -> DataFrame:
    """Occupied blocks with dense positions; one row per calendar block, so the single window is bounded by time."""
    return rows.select(block).distinct().withColumn("pos", F.row_number().over(W.orderBy(block)) - 1)


def block_weights(blocks: DataFrame, draws: int, seed: int = 41) -> DataFrame:
    """draw, pos, w: how often each block occurs in each draw."""
    spark = blocks.sparkSession
    n = blocks.agg(F.count("*")).scalar()
    slots = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("slot"))
    text = F.concat_ws("-", F.lit(seed), "draw", "slot")
    pick = F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)
    return slots.groupBy("draw", pick.alias("pos")).agg(F.count("*").alias("w"))


def block_sums(losses: DataFrame, keys: list[str], columns: list[str], block: str = "block") -> DataFrame:
    """Sum and count of each column per key and block."""
    aggs = []
    for c in columns:
        aggs += [F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}")]
    return losses.groupBy(*keys, block).agg(*aggs)


def weighted_draws(sums: DataFrame, keys: list[str], weights: DataFrame, positions: DataFrame, block: str = "block") -> DataFrame:
    """Weighted totals of every summed column per key and draw."""
    totals = [c for c in sums.columns if c not in (*keys, block)]
    located = sums.join(positions, block)
    return located.join(weights, "pos").groupBy(*keys, "draw").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in totals])


def with_interval(draws: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Percentile interval over the draws (a fixed number per key) and the number of usable draws."""
    return draws.groupBy(*keys).agg(
        F.percentile(value, alpha / 2).alias("low"), F.percentile(value, 1 - alpha / 2).alias("high"), F.count(value).alias("valid_draws"))


def pair_arms(losses: DataFrame, candidate: str, reference: str, keys: list[str]) -> DataFrame:
    """Losses of two arms on the windows both scored, as columns ``a`` (candidate) and ``r`` (reference)."""
    side = lambda arm, name: losses.filter(F.col("arm") == arm).select(*keys, "b", "block", F.col("loss").alias(name))
    return side(candidate, "a").join(side(reference, "r"), [*keys, "b", "block"])


def paired_reduction(pairs: DataFrame, keys: list[str], weights: DataFrame, positions: DataFrame, *, zero: str = "null", root: bool = False, floor: float = 1e-12) -> DataFrame:
    """Percent reduction 100·(1 − Σwa/Σwr) with interval; ``root`` takes the root of the ratio.

    A draw whose reference total is zero is null, takes the point value, or divides by the floor.
    """
    def gain(a: Column, r: Column, point: Column | None = None) -> Column:
        ratio = a / F.greatest(r, F.lit(floor)) if zero == "floor" else F.try_divide(a, r)
        value = 100 * (1 - (F.sqrt(ratio) if root else ratio))
        return F.coalesce(value, point) if zero == "point" and point is not None else value
    sums = block_sums(pairs, keys, ["a", "r"])
    point = sums.groupBy(*keys).agg(F.sum("s_a").alias("_a"), F.sum("s_r").alias("_r"), F.sum("n_a").alias("windows"), F.count("*").alias("occupied_blocks"))
    point = point.select(*keys, gain(F.col("_a"), F.col("_r")).alias("reduction_pct"), "windows", "occupied_blocks")
    draws = weighted_draws(sums, keys, weights, positions).join(point.select(*keys, "reduction_pct"), keys)
    draws = draws.withColumn("value", gain(F.col("s_a"), F.col("s_r"), F.col("reduction_pct")))
    return point.join(with_interval(draws, keys, "value"), keys)


def paired_difference(pairs: DataFrame, keys: list[str], weights: DataFrame, positions: DataFrame) -> DataFrame:
    """Mean candidate minus mean reference with interval."""
    sums = block_sums(pairs, keys, ["a", "r"])
    point = sums.groupBy(*keys).agg(((F.sum("s_a") - F.sum("s_r")) / F.sum("n_a")).alias("difference"), (F.sum("s_a") / F.sum("n_a")).alias("mean"))
    draws = weighted_draws(sums, keys, weights, positions).withColumn("value", F.try_divide(F.col("s_a") - F.col("s_r"), F.col("n_a")))
    return point.join(with_interval(draws, keys, "value"), keys)


def contrast_draws(rows: DataFrame, keys: list[str], side: str, value: str, weights: DataFrame, positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point and draws of mean(high) − mean(low), both sides under the same weights."""
    pick = lambda s: F.when(F.col(side) == s, F.col(value))
    data = rows.withColumns({"hi": pick("high"), "lo": pick("low")})
    sums = block_sums(data, keys, ["hi", "lo"])
    gap = lambda f: F.try_divide(f("s_hi"), f("n_hi")) - F.try_divide(f("s_lo"), f("n_lo"))
    point = sums.groupBy(*keys).agg(gap(F.sum).alias("contrast"), F.sum("n_hi").alias("n_high"), F.sum("n_lo").alias("n_low"))
    return point, weighted_draws(sums, keys, weights, positions).withColumn("value", gap(F.col))


def matched_contrast(rows: DataFrame, keys: list[str], side: str, value: str, weights: DataFrame, positions: DataFrame) -> DataFrame:
    point, draws = contrast_draws(rows, keys, side, value, weights, positions)
    return point.join(with_interval(draws, keys, "value"), keys)


def simultaneous_band(point: DataFrame, draws: DataFrame, family: list[str], estimate: str, value: str = "value") -> DataFrame:
    """Band that covers the whole family: 95 % quantile of the largest standardized deviation per draw."""
    sd = draws.groupBy(*family).agg(F.stddev_samp(value).alias("sd"))
    joined = draws.join(point.select(*family, estimate), family).join(sd, family)
    size = point.agg(F.count("*")).scalar()
    peak = joined.groupBy("draw").agg(F.max(F.abs((F.col(value) - F.col(estimate)) / F.col("sd"))).alias("_t"), F.count(value).alias("_k"))
    critical = peak.filter(F.col("_k") == size).agg(F.percentile("_t", 0.95)).scalar()
    out = point.join(sd, family).withColumn("critical", critical)
    return out.withColumns({"low": F.col(estimate) - F.col("critical") * F.col("sd"), "high": F.col(estimate) + F.col("critical") * F.col("sd")})


#: Draws that one task weighs at once.
DRAWS_AT_ONCE = 64


def concordance(score: np.ndarray, weight: np.ndarray, positives: np.ndarray, negatives: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per draw (columns of `weight`, a row for each row): weighted positives, weighted negatives and the weighted number of
    pairs of a positive above a negative, ties by half. Rows ascend by score."""
    starts = np.flatnonzero(np.diff(score, prepend=np.nan) != 0)
    found = []
    for k in range(0, weight.shape[1], DRAWS_AT_ONCE):
        w = weight[:, k : k + DRAWS_AT_ONCE]
        p, n = (np.add.reduceat(w * c[:, None], starts, axis=0) for c in (positives, negatives))
        found.append((p.sum(0), n.sum(0), (p * (np.cumsum(n, axis=0) - 0.5 * n)).sum(0)))
    return tuple(np.concatenate(part) for part in zip(*found))


def auc_draws(rows: DataFrame, keys: list[str], y: str, score: str, weights: DataFrame, positions: DataFrame) -> DataFrame:
    """Weighted AUROC per draw, null where a side has no weight. Rows without a score count for nothing.

    Counts per distinct score and block are cut into score ranges of equal counts. A range takes the weights of its blocks,
    an array a block, and gives three numbers a draw; ranges are added in order, each against the negatives below it. The
    work is rows x draws, whatever the number of blocks or distinct scores.
    """
    kinds = dict(rows.dtypes)
    draws = int(weights.agg(F.coalesce(F.max("draw"), F.lit(-1))).first()[0]) + 1
    located = rows.join(positions, "block")
    counts = located.groupBy(*keys, F.col(score).cast("double").alias("_s"), "pos").agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    ranges = equal_chunks(counts.filter(~F.isnan("_s")), keys, "_s")
    arrays = weights.groupBy("pos").agg(F.collect_list(F.struct("draw", "w")).alias("_w"))
    # under names of its own: both sides of the cogroup come from one table
    group, names = [*keys, "_chunk"], [f"_g{k}" for k in range(len(keys) + 1)]
    used = ranges.select(*(F.col(c).alias(name) for c, name in zip(group, names)), F.col("pos").alias("_pos")).distinct()
    used = used.join(arrays.withColumnRenamed("pos", "_pos"), "_pos")
    at = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    at = f"{at}, " if keys else ""

    def weigh(part: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=[*keys, "_chunk", "p", "n", "u"])
        part = part.sort_values("_s")
        table = np.zeros((len(blocks) + 1, draws))  # the last row is that of blocks never drawn
        place = {pos: k for k, pos in enumerate(blocks["_pos"])}
        for k, drawn in enumerate(blocks["_w"]):
            for d in drawn:
                table[k, d["draw"]] = d["w"]
        of = np.array([place.get(pos, len(blocks)) for pos in part["pos"]])
        found = [np.zeros(draws) for _ in range(3)]
        for k in range(0, draws, DRAWS_AT_ONCE):
            span = slice(k, k + DRAWS_AT_ONCE)
            for whole, piece in zip(found, concordance(part["_s"].to_numpy(), table[of, span], part["_p"].to_numpy(), part["_n"].to_numpy())):
                whole[span] = piece
        return pd.DataFrame([[*(part[c].iloc[0] for c in (*keys, "_chunk")), *(v.tolist() for v in found)]], columns=[*keys, "_chunk", "p", "n", "u"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        """One row a range: positives above all negatives of lower ranges."""
        part = part.sort_values("_chunk")
        p, n, u = (np.array(part[c].tolist()) for c in "pnu")
        total, pairs = (u + p * (np.cumsum(n, axis=0) - n)).sum(0), p.sum(0) * n.sum(0)
        value = np.divide(total, pairs, out=np.full(draws, np.nan), where=pairs > 0)
        out = pd.DataFrame({"draw": np.arange(draws), "value": value})
        for k in keys:
            out[k] = part[k].iloc[0]
        return out[[*keys, "draw", "value"]]

    sums = ranges.groupBy(*group).cogroup(used.groupBy(*names)).applyInPandas(weigh, f"{at}_chunk long, p array<double>, n array<double>, u array<double>")
    return sums.groupBy(*keys).applyInPandas(add, f"{at}draw long, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def global_equal_weight(draws: DataFrame, keys: list[str], lead: str, value: str, leads: int) -> DataFrame:
    """Mean over leads inside each draw, then the interval; a draw with a missing lead is an error."""
    per = draws.groupBy(*keys, "draw").agg(F.avg(value).alias("_v"), F.countDistinct(F.when(F.col(value).isNotNull(), F.col(lead))).alias("_k"))
    per = per.withColumn("_v", F.when(F.col("_k") == leads, F.col("_v")).otherwise(F.raise_error(F.lit("a draw lacks a lead")).cast("double")))
    return with_interval(per, keys, "_v")


def origin_bootstrap(diffs: DataFrame, keys: list[str], origin: str, value: str, draws: int, alpha: float, seed: int = 41) -> DataFrame:
    """Mean difference with percentile interval, resampling forecast origins; ``alpha`` may be Bonferroni-divided.

    An origin is one issue time, so their number is bounded by the calendar; the draws stay in long form.
    """
    origins = diffs.select(F.col(origin).alias("block")).distinct()
    positions = dense_blocks(origins)
    weights = block_weights(positions, draws, seed)
    data = diffs.withColumnRenamed(origin, "block")
    sums = block_sums(data, keys, [value])
    point = sums.groupBy(*keys).agg((F.sum(f"s_{value}") / F.sum(f"n_{value}")).alias("estimate"))
    out = weighted_draws(sums, keys, weights, positions).withColumn("value", F.try_divide(F.col(f"s_{value}"), F.col(f"n_{value}")))
    return point.join(with_interval(out, keys, "value", alpha), keys)
