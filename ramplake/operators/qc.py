"""Quality control of unit series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ramplake.operators.chunks import cut_lineage, exact_quantiles, windowed
from ramplake.operators.joins import nearest_units


def power_curve_outliers(
    df: DataFrame, unit: str, wind: str, power: str, *, wind_min: float = 0.0, width: float = 0.5, min_n: int = 40, k_low: float = 3.0, k_high: float = 3.0,
) -> DataFrame:
    """Flag rows outside median ± k·sigma of their (unit, wind bin).

    sigma is 1.4826·MAD, or IQR / 1.349 where the MAD is zero. Medians are exact and no group is ever held in one
    buffer, whatever its size.
    """
    valid = F.col(wind).isNotNull() & F.col(power).isNotNull() & (F.col(wind) >= wind_min)
    data = df.withColumn("_bin", F.when(valid, F.floor(F.col(wind) / width)))
    inside = data.filter("_bin IS NOT NULL").select(unit, "_bin", F.col(power).alias("_p"))
    # one row per (unit, bin), read twice below
    centre = cut_lineage(exact_quantiles(inside, [unit, "_bin"], "_p", {"_q25": 0.25, "_median": 0.5, "_q75": 0.75}))
    away = inside.join(centre, [unit, "_bin"]).withColumn("_dev", F.abs(F.col("_p") - F.col("_median")))
    mad = exact_quantiles(away, [unit, "_bin"], "_dev", {"_mad": 0.5})
    counts = inside.groupBy(unit, "_bin").agg(F.count("*").alias("_n"))
    limits = centre.join(mad, [unit, "_bin"]).join(counts, [unit, "_bin"])
    sigma = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise((F.col("_q75") - F.col("_q25")) / 1.349)
    limits = limits.withColumn("_sigma", F.when(sigma > 0, sigma))
    out = data.join(limits, [unit, "_bin"], "left")
    low, high = F.col("_median") - k_low * F.col("_sigma"), F.col("_median") + k_high * F.col("_sigma")
    flag = F.coalesce((F.col("_n") >= min_n) & ((F.col(power) < low) | (F.col(power) > high)), F.lit(False))
    return out.withColumn("outlier", flag).select(*df.columns, "outlier")


def mask_outliers(df: DataFrame, measures: list[str]) -> DataFrame:
    """Keep the rows and null the measures of flagged ones."""
    return df.withColumns({c: F.when(~F.col("outlier"), F.col(c)) for c in measures})


def outage_times(df: DataFrame, time: str, unit: str, flag: Column, expected: Column | None = None) -> DataFrame:
    """Times at which every unit present (or every expected unit) shows low power in usable wind."""
    counts = df.groupBy(time).agg(F.count_if(flag).alias("n_flagged"), F.countDistinct(unit).alias("n_units"))
    need = F.col("n_units") if expected is None else expected
    return counts.withColumn("farm_outage", F.col("n_flagged") >= need)


def drop_farm_outage(df: DataFrame, time: str, unit: str, flag: Column) -> DataFrame:
    bad = outage_times(df, time, unit, flag).filter("farm_outage").select(time)
    return df.join(bad, time, "left_anti")


def tag_farm_outage(df: DataFrame, time: str, unit: str, flag: Column, expected: Column) -> DataFrame:
    tags = outage_times(df, time, unit, flag, expected).select(time, "farm_outage")
    return df.withColumn("unit_outage", F.coalesce(flag, F.lit(False))).join(tags, time)


def min_units(df: DataFrame, time: str, unit: str, n: int) -> DataFrame:
    good = df.groupBy(time).agg(F.countDistinct(unit).alias("_n")).filter(F.col("_n") >= n).select(time)
    return df.join(good, time, "left_semi")


def missing_units(df: DataFrame, time: str, unit: str, units: DataFrame, only_at: DataFrame) -> DataFrame:
    """(time, unit) combinations absent from the table, at the given times."""
    listed = units.agg(F.sort_array(F.collect_set(unit))).scalar()
    grid = only_at.select(time, F.explode(listed).alias(unit))
    return grid.join(df.select(time, unit).distinct(), [time, unit], "left_anti")


def impute_missing_unit(df: DataFrame, time: str, unit: str, units: DataFrame, columns: list[str], *, present: int, k: int = 2, max_missing: int = 1) -> DataFrame:
    """At times with exactly ``present`` units, add the missing ones as the mean of their present neighbours."""
    total = units.agg(F.countDistinct("id")).scalar()
    times = df.groupBy(time).agg(F.countDistinct(unit).alias("_n")).filter((F.col("_n") == present) & (total - F.col("_n") <= max_missing))
    absent = missing_units(df, time, unit, units.select(F.col("id").alias(unit)), times)
    near = nearest_units(units, k, "planar").select(F.col("src").alias(unit), F.col("dst").alias("_near"))
    source = df.select(time, F.col(unit).alias("_near"), *columns)
    added = absent.join(near, unit).join(source, [time, "_near"]).groupBy(time, unit).agg(*[F.avg(c).alias(c) for c in columns])
    return df.withColumn("imputed", F.lit(False)).unionByName(added.withColumn("imputed", F.lit(True)), allowMissingColumns=True)


def drop_high_ramp(df: DataFrame, time: str, power: str, threshold: float) -> DataFrame:
    """Drop times at which the farm total moves more than ``threshold`` in exactly one step."""
    farm = df.groupBy(time).agg(F.sum(power).alias("_p")).withColumn("_k", F.lit(0))
    step = lambda w: {"_bad": (F.abs(F.col("_p") - F.lag("_p", 1).over(w)) > threshold) & (F.col(time) - F.lag(time, 1).over(w) == 1)}
    bad = windowed(farm, ["_k"], time, 1, 0, step).filter("_bad").select(time)
    return df.join(bad, time, "left_anti")


def tag_high_ramp(farm: DataFrame, keys: list[str], x: str = "x", fraction: float | None = None, capacity: float = 1.0) -> DataFrame:
    """Flag steps of at least a fraction of capacity, or of at least the 95 % quantile of all steps."""
    step = lambda w: {"_step": F.abs(F.col(x) - F.lag(x, 1).over(w))}
    data = windowed(farm, keys, "b", 1, 0, step)
    limit = F.lit(fraction * capacity) if fraction else exact_quantiles(data, [], "_step", {"q": 0.95}).select("q").scalar()
    return data.withColumn("high_ramp", F.coalesce(F.col("_step") >= limit, F.lit(False))).drop("_step")


def farm_features(units: DataFrame, time: str, power: str, wind: str) -> DataFrame:
    """Sums, means, complete-unit counts, ratio, step and rolling features of the farm."""
    # added in ascending order: a bin has a value a unit, and the sum's last bit must not hang on the order of arrival
    total = F.aggregate(F.array_sort(F.collect_list(F.col(power).cast("double"))), F.lit(0.0), lambda a, v: a + v)
    farm = units.groupBy(time).agg(
        total.alias("power"), F.avg(wind).alias("wind"), F.count(power).alias("complete_units"), F.count("*").alias("rows"))
    farm = farm.withColumn("_k", F.lit(0))
    def cols(w):
        f3 = w.rangeBetween(-2, 0)
        return {
            "power_diff_1": F.col("power") - F.lag("power", 1).over(w), "power_diff_3": F.col("power") - F.lag("power", 3).over(w),
            "power_mean_3": F.avg("power").over(f3), "power_ratio": F.col("power") / (F.col("wind") + 1.0),
        }
    return windowed(farm, ["_k"], time, 3, 0, cols).drop("_k")


def gap_free_train_stats(df: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """Mean and floored population deviation of each feature plus the power scale, over the training rows."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"std_{c}")]
    stats = df.agg(*aggs)
    scale = exact_quantiles(df, [], columns[0], {"power_scale": 0.995}).select("power_scale").scalar()
    return stats.withColumn("power_scale", scale)
