"""Regular grids, gap-aware lags, fills, splits, histories and targets.

A *series* has key columns, a bigint bin index ``b`` (left-closed, epoch-anchored), a nullable measure ``x``
and a boolean ``ok``. Missing bins are explicit rows with a null measure.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ramplake.config import DAY_US, MINUTE_US, PATH_NODES
from ramplake.operators.chunks import CHUNK, equal_chunks, exact_quantiles, running, windowed


def bin_of(us: str | Column, minutes: int, closed: str = "left") -> Column:
    """Bin index of a microsecond clock. Right-closed bins keep the edge in the earlier bin."""
    us = F.col(us) if isinstance(us, str) else us
    shifted = us if closed == "left" else us - 1
    return F.floor(shifted / F.lit(minutes * MINUTE_US)).cast("long")


def bin_label(b: str | Column, minutes: int, label: str = "left") -> Column:
    """Microsecond clock of a bin edge."""
    b = F.col(b) if isinstance(b, str) else b
    return ((b if label == "left" else b + 1) * F.lit(minutes * MINUTE_US)).cast("long")


def regularize(
    df: DataFrame, keys: list[str], us: str, value: str, valid: str | None, minutes: int, *,
    native_minutes: int | None = None, min_count: int | None = None, position: str = "start", order: str | None = None, repeats: str = "invalid",
) -> DataFrame:
    """Bin raw samples; a bin is usable only with enough good samples and none bad.

    With ``native_minutes`` every expected native sample must be present and valid; ``min_count`` is the rule
    for irregular arrivals. All copies of a repeated timestamp are invalid; with ``repeats='samples'`` each row is a
    sample of its own, as events that only happen to share an instant. End-labelled sources are moved back
    by one native period. One shuffle on (keys, bin) serves both aggregations.
    """
    if position not in ("start", "end", "unverified"):
        raise ValueError("unknown timestamp position")
    if repeats not in ("invalid", "samples"):
        raise ValueError("unknown rule for repeated timestamps")
    if native_minutes is not None and (minutes < native_minutes or minutes % native_minutes):
        raise ValueError("only whole-factor downsampling is supported")
    clock = F.col(us) - (native_minutes * MINUTE_US if position == "end" and native_minutes else 0)
    flag = F.lit(True) if valid is None else F.coalesce(F.col(valid), F.lit(False))
    first = F.col(order) if order else F.col(value)
    raw = df.select(*keys, clock.alias("_us"), F.col(value).cast("double").alias("_x"), flag.alias("_ok"), first.alias("_o"))
    raw = raw.withColumn("b", bin_of("_us", minutes)).withColumn("_x", F.nanvl("_x", F.lit(None).cast("double")))
    if repeats == "invalid":
        stamps = raw.repartition(*keys, "b").groupBy(*keys, "b", "_us").agg(
            F.count("*").alias("_copies"), F.min_by("_x", "_o").alias("_x"), F.bool_and("_ok").alias("_ok"), F.min("_o").alias("_o")
        )
    else:
        stamps = raw.withColumn("_copies", F.lit(1))
    good = (F.col("_copies") == 1) & F.col("_ok") & F.col("_x").isNotNull()
    # the running sum adds in the given order, so that the mean's last bit doesn't hang on the order of arrival
    placed = W.partitionBy(*keys, "b").orderBy("_o", "_us", "_x").rowsBetween(W.unboundedPreceding, W.currentRow)
    stamps = stamps.withColumns({"_sum": F.sum(F.when(good, F.col("_x"))).over(placed), "_n": F.count("*").over(placed)})
    bins = stamps.groupBy(*keys, "b").agg(
        F.try_divide(F.max_by("_sum", "_n"), F.count_if(good)).alias("x"),
        F.count_if(good).alias("n_valid"),
        F.count("*").alias("n_total"),
        F.sum(F.when(F.col("_copies") > 1, F.col("_copies")).otherwise(0)).alias("duplicate_rows"),
    )
    if native_minutes is not None:
        expected = minutes // native_minutes
        ok = (F.col("n_valid") == expected) & (F.col("n_total") == expected)
    else:
        ok = F.col("n_valid") >= (min_count or 1)
    return bins.withColumn("ok", ok).withColumn("x", F.when(F.col("ok"), F.col("x")))


def calendar_grid(df: DataFrame, keys: list[str], idx: str = "b", per_key: bool = False, bounds: tuple[Column, Column] | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Every key at every index between the first and last one (of the table, or of each key).

    Pass ``bounds`` and ``entities`` (the distinct keys) when they are known more cheaply than from ``df`` itself.
    """
    if per_key:
        ends = df.groupBy(*keys).agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi"))
    else:
        lo, hi = bounds or span(df, idx)
        ends = (df.select(*keys).distinct() if entities is None else entities).withColumns({"_lo": lo, "_hi": hi})
    pieces = ends.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("_lo") / CHUNK), F.floor(F.col("_hi") / CHUNK))))
    start, stop = F.greatest("_lo", F.col("_piece") * CHUNK), F.least("_hi", (F.col("_piece") + 1) * CHUNK - 1)
    return pieces.repartition(*keys, "_piece").select(*keys, F.explode(F.sequence(start.cast("long"), stop.cast("long"))).alias(idx))


def on_grid(bins: DataFrame, keys: list[str], idx: str = "b", per_key: bool = False, bounds: tuple[Column, Column] | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Left join onto the calendar grid, so that gaps are rows."""
    out = calendar_grid(bins, keys, idx, per_key, bounds, entities).join(bins, [*keys, idx], "left")
    return out.withColumn("ok", F.coalesce(F.col("ok"), F.lit(False))) if "ok" in bins.columns else out


def resample(df: DataFrame, keys: list[str], us: str, value: str, minutes: int, how: str = "mean", closed: str = "left", label: str = "left") -> DataFrame:
    """Mean, last, first or max per bin; ``last`` and ``first`` skip nulls."""
    v, at = F.col(value), F.when(F.col(value).isNotNull(), F.col(us))
    agg = {"mean": F.avg(v), "max": F.max(v), "last": F.max_by(v, at), "first": F.min_by(v, at), "sum": F.sum(v)}[how]
    b = bin_of(us, minutes, closed)
    return df.groupBy(*keys, b.alias("b")).agg(agg.alias("x")).withColumn("label_us", bin_label("b", minutes, label))


def resample_interpolate(bins: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Upsample to a ``factor`` times finer grid with time-linear interpolation between known bins."""
    fine = bins.withColumn("b", F.col("b") * factor).select(*keys, "b", "x")
    grid = on_grid(fine, keys, "b", per_key=True)
    return interpolate(grid, keys)


def neighbours(series: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Index and value of the nearest known rows at or before (``p_``) and at or after (``n_``) each row."""
    known = F.when(F.col(x).isNotNull(), F.struct(F.col("b").alias("b"), F.col(x).alias("x")))
    out = running(series, keys, "b", {"_p": ("last", known)})
    out = running(out, keys, "b", {"_n": ("last", known)}, reverse=True)
    return out.withColumns({"p_b": F.col("_p.b"), "p_x": F.col("_p.x"), "n_b": F.col("_n.b"), "n_x": F.col("_n.x")}).drop("_p", "_n")


def line_between(p_b, p_x, n_b, n_x, b) -> Column:
    return F.when(F.col(n_b) == F.col(p_b), F.col(p_x)).otherwise(
        F.col(p_x) + (F.col(n_x) - F.col(p_x)) * (F.col(b) - F.col(p_b)) / (F.col(n_b) - F.col(p_b))
    )


def interpolate(series: DataFrame, keys: list[str]) -> DataFrame:
    out = neighbours(series, keys)
    return out.withColumn("x", F.coalesce("x", line_between("p_b", "p_x", "n_b", "n_x", "b"))).drop("p_b", "p_x", "n_b", "n_x")


def gap_guarded_diff(df: DataFrame, keys: list[str], steps: tuple[int, ...] = (1, 3), x: str = "x", idx: str = "b") -> DataFrame:
    """``diff_n``: difference to the n-th earlier row, only if exactly n bins passed."""
    def cols(w):
        out = {}
        for n in steps:
            same = F.col(idx) - F.lag(idx, n).over(w) == n
            out[f"lag_{n}"] = F.when(same, F.lag(x, n).over(w))
            out[f"diff_{n}"] = F.when(same, F.col(x) - F.lag(x, n).over(w))
        return out
    return windowed(df, keys, idx, max(steps), 0, cols)


def rolling(df: DataFrame, keys: list[str], width: int = 3, min_mean: int = 1, min_std: int = 2, x: str = "x") -> DataFrame:
    """Trailing mean and sample deviation; a missing deviation counts as zero."""
    def cols(w):
        f = w.rangeBetween(-(width - 1), 0)
        n = F.count(x).over(f)
        return {
            f"roll_mean_{width}": F.when(n >= min_mean, F.avg(x).over(f)),
            f"roll_std_{width}": F.when(n >= min_std, F.coalesce(F.stddev_samp(x).over(f), F.lit(0.0))).otherwise(0.0),
        }
    return windowed(df, keys, "b", width - 1, 0, cols)


def ramp_abs(df: DataFrame, keys: list[str], width: int = 6, x: str = "x") -> DataFrame:
    """Absolute one-step change with trailing mean and max inside each entity (never across entities)."""
    step = lambda w: {"ramp_abs": F.coalesce(F.abs(F.col(x) - F.lag(x, 1).over(w)), F.lit(0.0))}
    def cols(w):
        f = w.rangeBetween(-(width - 1), 0)
        return {f"ramp_mean_{width}": F.avg("ramp_abs").over(f), f"ramp_max_{width}": F.max("ramp_abs").over(f)}
    return windowed(df, keys, "b", width, 0, step, cols)


def valid_runs(series: DataFrame, keys: list[str], ok: str = "ok", same: str | None = None) -> DataFrame:
    """First and last index of the maximal run of good bins that holds each row; null outside runs.

    A change of the column ``same`` (the split) also ends a run.
    """
    def edges(w):
        def joined(step):
            other = step(ok, 1).over(w)
            if same:
                other = other & step(same, 1).over(w).eqNullSafe(F.col(same))
            return F.coalesce(other, F.lit(False))
        return {
            "_start": F.when(F.col(ok) & ~joined(F.lag), F.col("b")),
            "_end": F.when(F.col(ok) & ~joined(F.lead), F.col("b")),
        }
    out = windowed(series, keys, "b", 1, 1, edges)
    out = running(out, keys, "b", {"run_start": ("last", F.col("_start"))})
    out = running(out, keys, "b", {"run_end": ("last", F.col("_end"))}, reverse=True)
    return out.withColumns({c: F.when(F.col(ok), F.col(c)) for c in ("run_start", "run_end")}).drop("_start", "_end")


def run_length_flags(series: DataFrame, keys: list[str], condition: Column, min_steps: int, name: str = "long_run") -> DataFrame:
    """Flag rows inside runs of ``condition`` that last at least ``min_steps`` bins."""
    out = valid_runs(series.withColumn("_hit", F.coalesce(condition, F.lit(False))), keys, "_hit")
    length = F.col("run_end") - F.col("run_start") + 1
    return out.withColumn(name, F.coalesce(length >= min_steps, F.lit(False))).drop("_hit", "run_start", "run_end")


def span(df: DataFrame, idx: str = "b") -> tuple[Column, Column]:
    """First and last index as fields of one scalar subquery, so that the input is read once for both."""
    both = df.agg(F.struct(F.min(idx).alias("lo"), F.max(idx).alias("hi"))).scalar()
    return both["lo"], both["hi"]


def split_cuts(df: DataFrame, idx: str = "b", first: float = 0.6, second: float = 0.8) -> tuple[Column, Column]:
    """The two split boundaries as scalar subqueries over the whole span."""
    lo, hi = span(df, idx)
    return lo + first * (hi - lo), lo + second * (hi - lo)


def chronological_split(
    df: DataFrame, idx: str = "b", by: str = "span", first: float = 0.6, second: float = 0.8, cuts: tuple[Column, Column] | None = None
) -> DataFrame:
    """``split`` by a fraction of the time span, by row position on the full grid, or at given ``cuts``."""
    if cuts is not None:
        cut1, cut2 = cuts
    elif by == "span":
        cut1, cut2 = split_cuts(df, idx, first, second)
    else:
        lo, hi = span(df, idx)
        n = hi - lo + 1
        cut1, cut2 = lo + F.floor(n * first), lo + F.floor(n * second)
    b = F.col(idx)
    return df.withColumn("split", F.when(b < cut1, "train").when(b < cut2, "validation").otherwise("test"))


def purged(df: DataFrame, cut1: Column, cut2: Column, rule: str, ahead: int, history: int, max_lead: int = 0, idx: str = "b") -> DataFrame:
    """Splits with purge zones.

    ``history``: targets end before a cut and histories start after it; ``lead`` also leaves room for the
    longest lead; ``margin``: drop everything within the target length of a cut.
    """
    b = F.col(idx)
    end, start = b + ahead, b - history - (max_lead if rule == "lead" else 0)
    if rule == "margin":
        train, validation, test = b < cut1 - ahead, (b >= cut1 + ahead) & (b < cut2 - ahead), b >= cut2 + ahead
    elif rule in ("history", "lead"):
        train, validation, test = end < cut1, (start >= cut1) & (end < cut2), start >= cut2
    else:
        raise ValueError("unknown purge rule")
    split = F.when(train, "train").when(validation, "validation").when(test, "test")
    return df.withColumn("split", split)


def history_vector(series: DataFrame, keys: list[str], length: int = 16, x: str = "x", pad: bool = False) -> DataFrame:
    """The last ``length`` values, oldest first. Incomplete histories are null, or padded with the earliest."""
    def cols(w):
        values = F.collect_list(x).over(w.rangeBetween(-(length - 1), 0))
        n = F.size(values)
        if pad:
            return {"history": F.when(n > 0, F.concat(F.array_repeat(values[0], F.lit(length) - n), values))}
        return {"history": F.when(n == length, values)}
    return windowed(series, keys, "b", length - 1, 0, cols)


def target_path(series: DataFrame, keys: list[str], nodes: int = PATH_NODES, x: str = "x") -> DataFrame:
    """The next ``nodes`` values from each bin on; only complete windows stay."""
    def cols(w):
        frame = w.rangeBetween(0, nodes - 1)
        return {"_n": F.count(x).over(frame), "path": F.collect_list(x).over(frame)}
    return windowed(series, keys, "b", 0, nodes - 1, cols).filter(F.col("_n") == nodes).drop("_n")


def lead_shift(targets: DataFrame, inputs: DataFrame, keys: list[str], leads: tuple[int, ...], columns: list[str]) -> DataFrame:
    """Fixed targets, older inputs: for each lead join the input columns at ``b - lead``."""
    wanted = targets.withColumn("lead", F.explode(F.array(*[F.lit(n) for n in leads]))).withColumn("_at", F.col("b") - F.col("lead"))
    source = inputs.select(*keys, F.col("b").alias("_at"), *columns)
    return wanted.join(source, [*keys, "_at"]).drop("_at")


def horizon_targets(series: DataFrame, keys: list[str], horizon: int, step: int, width: int, columns: tuple[str, ...] = ("x",)) -> DataFrame:
    """Mean over the trailing window that ends at each lead; null unless every bin is there for all columns."""
    def cols(w):
        out = {}
        for k in range(1, horizon + 1):
            f = w.rangeBetween(k * step - width + 1, k * step)
            whole = F.lit(True)
            for c in columns:
                whole = whole & (F.count(c).over(f) == width)
            reach = F.count("b").over(w.rangeBetween(1, k * step)) == k * step
            for c in columns:
                out[f"target_{c}_{k:02d}"] = F.when(whole & reach, F.avg(c).over(f))
        return out
    return windowed(series, keys, "b", max(0, width - 1 - step), horizon * step, cols)


def point_target(series: DataFrame, keys: list[str], horizon: int, x: str = "x") -> DataFrame:
    """Value exactly ``horizon`` bins later, taken from the n-th next row only if the clock agrees."""
    def cols(w):
        same = F.lead("b", horizon).over(w) - F.col("b") == horizon
        return {"target": F.when(same, F.lead(x, horizon).over(w))}
    return windowed(series, keys, "b", 0, horizon, cols)


def sample_index(farm: DataFrame, keys: list[str], t_in: int, ahead: int, inputs_ok: str, target_ok: str, flags: tuple[str, ...]) -> DataFrame:
    """One row per origin with contiguity, completeness, window flags and default eligibility."""
    def cols(w):
        back, whole = w.rangeBetween(-(t_in - 1), 0), w.rangeBetween(-(t_in - 1), ahead)
        out = {
            "is_contiguous": F.count("b").over(whole) == t_in + ahead,
            "is_input_complete": F.count_if(F.col(inputs_ok)).over(back) == t_in,
            "is_target_complete": F.coalesce(F.col(target_ok), F.lit(False)),
        }
        return out | {f"window_{f}": F.coalesce(F.bool_or(f).over(whole), F.lit(False)) for f in flags}
    out = windowed(farm, keys, "b", t_in - 1, ahead, cols)
    lo, hi = span(farm)
    out = out.filter((F.col("b") >= lo + t_in - 1) & (F.col("b") <= hi - ahead))
    eligible = F.col("is_contiguous") & F.col("is_input_complete") & F.col("is_target_complete") & ~F.col(f"window_{flags[0]}")
    return out.withColumn("eligible", eligible)


def window_filter(samples: DataFrame, mode: str = "point") -> DataFrame:
    """Kept and dropped windows per reason; ``avg`` and ``delta`` also need a complete target."""
    reason = F.when(~F.col("is_contiguous"), "gap").when(~F.col("is_input_complete"), "input")
    if mode in ("avg", "delta"):
        reason = reason.when(~F.col("is_target_complete"), "target")
    return samples.withColumn("reason", reason.otherwise("kept")).groupBy("reason").agg(F.count("*").alias("windows"))


def gap_fill(series: DataFrame, keys: list[str], method: str = "linear", limit: int = 2) -> DataFrame:
    """Fill short gaps and keep the observed value beside the filled one.

    ``linear`` fills at most ``limit`` bins from each side of a bracketed gap; ``ffill`` carries the last value
    at most ``limit`` bins. Leading and trailing gaps are never filled by ``linear``.
    """
    out = neighbours(series, keys)
    back, ahead = F.col("b") - F.col("p_b"), F.col("n_b") - F.col("b")
    if method == "linear":
        fill = F.when((F.least(back, ahead) <= limit) & back.isNotNull() & ahead.isNotNull(), line_between("p_b", "p_x", "n_b", "n_x", "b"))
    elif method == "ffill":
        fill = F.when(back <= limit, F.col("p_x"))
    else:
        raise ValueError("unknown fill method")
    out = out.withColumnRenamed("x", "x_raw").withColumn("x", F.coalesce("x_raw", fill))
    return out.withColumn("gap_filled", F.col("x_raw").isNull() & F.col("x").isNotNull()).drop("p_b", "p_x", "n_b", "n_x")


def kalman_fill(series: DataFrame, keys: list[str], limit: int = 2, q_level: float = 0.05, q_trend: float = 0.005, r: float = 0.1, size: int = 8192) -> DataFrame:
    """Fill bracketed gaps of at most ``limit`` bins with the smoothed level of a local-linear-trend model.

    The level is that of the whole series, whatever the chunk size (see ``smoother``). A series without spread is
    filled with its first value. Noise follows the variance of the whole series.
    """
    from ramplake.operators.smoother import smoothed

    gaps = neighbours(series.select(*keys, "b", "x"), keys)
    fixed = series.groupBy(*keys).agg(F.var_pop("x").alias("_var"), F.min_by("x", F.when(F.col("x").isNotNull(), F.col("b"))).alias("_first"))
    data = gaps.join(fixed, keys).withColumn("_fill", F.coalesce(F.col("x").isNull() & (F.col("n_b") - F.col("p_b") - 1 <= limit), F.lit(False)))
    out = smoothed(data, keys, q_level, q_trend, r, size)
    return out.select(*keys, "b", F.col("x").alias("x_raw"), F.when(F.col("_fill"), F.col("level")).otherwise(F.col("x")).alias("x"), (F.col("_fill") & F.col("level").isNotNull()).alias("gap_filled"))


def stage_stats(df: DataFrame, us: str, unit: str) -> DataFrame:
    """Rows, timestamps, units, span, cadence (median step in minutes), largest gap and its warning."""
    times = equal_chunks(df.select(us).distinct(), [], us)
    steps = running(times, [], us, {"_prev": ("last", F.col(us))}, chunk="_chunk", strict=True)
    steps = steps.withColumn("step", (F.col(us) - F.col("_prev")) / MINUTE_US)
    cadence = exact_quantiles(steps, [], "step", {"cadence_minutes": 0.5}).select("cadence_minutes").scalar()
    gap = steps.agg(F.max("step")).scalar()
    out = df.agg(
        F.count("*").alias("n_rows"), F.countDistinct(us).alias("n_times"), F.countDistinct(unit).alias("n_units"),
        F.min(us).alias("first_us"), F.max(us).alias("last_us"),
    )
    out = out.withColumns({"cadence_minutes": cadence, "max_gap_minutes": gap})
    return out.withColumn("gap_warning", F.col("max_gap_minutes") > 3 * F.col("cadence_minutes"))


def lag_alignment(series: DataFrame, keys: list[str], a: str, b: str, reach: int = 2) -> DataFrame:
    """Correlation of ``a`` with ``b`` moved by each lag in ±reach; the best lag is flagged."""
    lags = list(range(-reach, reach + 1))
    cols = lambda w: {f"_b{n + reach}": F.lag(b, n).over(w) if n >= 0 else F.lead(b, -n).over(w) for n in lags}
    moved = windowed(series, keys, "b", reach, reach, cols)
    wide = moved.groupBy(*keys).agg(*[F.corr(a, f"_b{n + reach}").alias(f"c{n + reach}") for n in lags])
    pairs = F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"c{n + reach}").alias("corr")) for n in lags])
    out = wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.lag", "p.corr")
    best = out.groupBy(*keys).agg(F.max_by("lag", F.struct("corr", -F.col("lag"))).alias("best_lag"))
    return out.join(best, keys).withColumn("is_best", F.col("lag") == F.col("best_lag")).drop("best_lag")


def maturity_us(target_us: Column, rule: str = "fixed") -> Column:
    """When a label is known: 241 minutes after the target start, or the next full hour after its end plus one minute."""
    if rule == "fixed":
        return target_us + 241 * MINUTE_US
    hour = 60 * MINUTE_US
    return F.ceil((target_us + 4 * hour) / hour).cast("long") * hour + MINUTE_US


def monday_floor_us(us: Column) -> Column:
    """Start of the Monday week: the epoch day was a Thursday, so shift by three days."""
    week = 7 * DAY_US
    return (F.floor((us + 3 * DAY_US) / week) * week - 3 * DAY_US).cast("long")


def daily_persistence(series: DataFrame, keys: list[str], per_day: int, horizons: tuple[int, ...], x: str = "x") -> DataFrame:
    """Forecast for b + k: the value one day before that bin."""
    cols = lambda w: {f"daily_{k}": F.max(x).over(w.rangeBetween(k - per_day, k - per_day)) for k in horizons}
    return windowed(series, keys, "b", per_day, 0, cols)
