"""Thresholds, constant policies, blends, constrained selection and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def decision_cost(p: Column, event: Column, threshold: Column, ratio: Column) -> Column:
    """A false alarm costs one, a miss costs ``ratio``; what is not known has no cost."""
    alarm = p >= threshold
    return F.when(alarm.isNull() | event.isNull(), F.lit(None).cast("double")).when(alarm & ~event, 1.0).when(~alarm & event, ratio).otherwise(0.0)


def threshold_counts(rows: DataFrame, keys: list[str], p: str, event: str, grid: list[float]) -> DataFrame:
    """False alarms, misses and alarms of every threshold, from one histogram of the forecasts.

    Rows are first counted per grid cell and outcome, so the sweep over the thresholds works on a few hundred
    counts per key and never multiplies the rows. Rows without forecast or outcome count for nothing. Costs follow from integer counts, so ties are exact.
    """
    knots = F.array(*[F.lit(float(t)) for t in grid])
    cell = F.size(F.filter(knots, lambda t: F.col(p) >= t))
    hist = rows.filter(F.col(p).isNotNull() & F.col(event).isNotNull()).groupBy(*keys, cell.alias("cell")).agg(F.count_if(F.col(event)).alias("_e"), F.count_if(~F.col(event)).alias("_q"))
    spread = hist.select(*keys, "cell", "_e", "_q", F.posexplode(knots).alias("at", "threshold"))
    alarm = F.col("cell") > F.col("at")
    return spread.groupBy(*keys, "threshold").agg(
        F.sum(F.when(alarm, F.col("_q")).otherwise(0)).alias("false_alarms"), F.sum(F.when(~alarm, F.col("_e")).otherwise(0)).alias("misses"),
        F.sum(F.when(alarm, F.col("_e") + F.col("_q")).otherwise(0)).alias("alarms"), F.sum(F.col("_e") + F.col("_q")).alias("n"))


def select_threshold(rows: DataFrame, keys: list[str], p: str, event: str, grid: list[float], ratios: list[float]) -> DataFrame:
    """Cheapest threshold per key and cost ratio on the given (validation) rows; the lowest one on ties."""
    counts = threshold_counts(rows, keys, p, event, grid)
    priced = counts.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    cost = F.col("false_alarms") + F.col("ratio") * F.col("misses")
    return priced.groupBy(*keys, "ratio").agg(F.min_by(F.struct("threshold", (cost / F.col("n")).alias("cost")), F.struct(cost, "threshold")).alias("s")).select(*keys, "ratio", "s.*")


def constant_policies(train: DataFrame, rows: DataFrame, keys: list[str], event: str, ratios: list[float], validation: DataFrame | None = None) -> DataFrame:
    """Mean cost of never, always and frequency-driven alerting on the given rows, and the best of them.

    With validation rows also of the policy that is cheaper there (never, if both cost the same): validation_choice.
    """
    rate = train.groupBy(*keys).agg(F.avg(F.col(event).cast("double")).alias("_f"))
    base = rows.groupBy(*keys).agg(F.avg(F.col(event).cast("double")).alias("event_rate"), F.count("*").alias("n")).join(rate, keys)
    base = base.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    never, always = F.col("ratio") * F.col("event_rate"), 1 - F.col("event_rate")
    by_rate = F.when(F.col("_f") * F.col("ratio") >= 1 - F.col("_f"), always).otherwise(never)
    out = base.withColumns({"never": never, "always": always, "train_frequency": by_rate})
    out = out.withColumn("best_constant", F.least("never", "always")).drop("_f")
    if validation is None:
        return out
    seen = validation.groupBy(*keys).agg(F.avg(F.col(event).cast("double")).alias("_v"))
    choice = F.when(F.col("ratio") * F.col("_v") <= 1 - F.col("_v"), F.col("never")).otherwise(F.col("always"))
    return out.join(seen, keys).withColumn("validation_choice", choice).drop("_v")


def decision_table(rows: DataFrame, keys: list[str], p: str, event: str, chosen: DataFrame, constants: DataFrame) -> DataFrame:
    """Cost, alert rate and reductions of the frozen thresholds."""
    data = rows.join(chosen.select(*keys, "ratio", "threshold"), keys)
    cost = decision_cost(F.col(p), F.col(event), F.col("threshold"), F.col("ratio"))
    out = data.groupBy(*keys, "ratio", "threshold").agg(F.avg(cost).alias("forecast_cost"), F.avg((F.col(p) >= F.col("threshold")).cast("double")).alias("alert_rate"))
    out = out.join(constants, [*keys, "ratio"])
    gain = lambda c: 100 * (1 - F.try_divide("forecast_cost", c))
    return out.withColumns({"reduction_vs_constant_pct": gain("best_constant"), "reduction_vs_never_pct": gain("never")})


def blend(p: Column, q: Column, w: Column | float) -> Column:
    w = F.lit(w) if isinstance(w, float) else w
    return F.zip_with(p, q, lambda a, b: (1 - w) * a + w * b)


def blend_grid(rows: DataFrame, p: str, q: str, steps: int = 10) -> DataFrame:
    """The blend at every weight 0 … 1."""
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    return rows.withColumn("weight", F.explode(grid)).withColumn("blend", blend(F.col(p), F.col(q), F.col("weight")))


def select_constrained(scores: DataFrame, groups: list[str], primary: str, guard: str, baseline: Column, ties: list[str], tol: float = 1e-12) -> DataFrame:
    """Smallest primary score among candidates whose guard is no worse than the baseline; full tie key."""
    order = W.partitionBy(*groups).orderBy(primary, *ties)
    kept = scores.filter(F.col(guard) <= baseline + tol)
    return kept.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def select_lambda(scores: DataFrame, value: str, strength: str) -> DataFrame:
    """Smallest mean score; the larger strength on ties. A strength without a score comes after all that have one."""
    return scores.orderBy(F.asc_nulls_last(value), F.desc(strength)).limit(1)


def target_route(forecasts: DataFrame, state_arm: str, timing_arm: str, keys: list[str]) -> DataFrame:
    """State head from one arm and timing head from another, with the identity error of the state head."""
    state = forecasts.filter(F.col("arm") == state_arm).select(*keys, "y", "arr", "p")
    timing = forecasts.filter(F.col("arm") == timing_arm).select(*keys, "q", F.col("arr").alias("_arr"))
    out = state.join(timing, keys)
    source = forecasts.filter(F.col("arm") == state_arm).select(*keys, F.col("p").alias("_p"))
    gap = F.array_max(F.zip_with("p", "_p", lambda a, b: F.abs(a - b)))
    return out.join(source, keys).withColumn("state_gap", gap).withColumn("arm", F.lit(f"route_{state_arm}_{timing_arm}")).drop("_p", "_arr")
