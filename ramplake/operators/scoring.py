"""Losses, scores, references and summaries of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ramplake.config import CLASSES, PATH_NODES, TIMING_BINS
from ramplake.functions import paths
from ramplake.functions.clip import at_least, at_most


def path_summary(members: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Level, range, net change and end nodes averaged over the member paths of each key."""
    x = paths.nodes(path)
    flat = members.select(*keys, paths.mean(x).alias("_m"), paths.spread(x).alias("_r"), (x[-1] - x[0]).alias("_n"), x[0].alias("_f"), x[-1].alias("_l"))
    return flat.groupBy(*keys).agg(
        (F.avg("_m") / 20).alias("level"), (F.avg("_r") / 10).alias("range_mean"), (F.avg("_n") / 5).alias("net_mean"),
        (F.percentile("_r", 0.1) / 10).alias("range_q10"), (F.percentile("_r", 0.9) / 10).alias("range_q90"),
        (F.avg("_f") / 20).alias("first_node"), (F.avg("_l") / 20).alias("last_node"))


def node_summary(df: DataFrame, keys: list[str], path: str, name: str) -> DataFrame:
    """Mean, population deviation, first and last node of one variable's path."""
    x = paths.nodes(path)
    m = paths.mean(x)
    var = paths.mean([(v - m) * (v - m) for v in x])
    return df.select(*keys, m.alias(f"mean_{name}"), F.sqrt(var).alias(f"std_{name}"), x[0].alias(f"first_{name}"), x[-1].alias(f"last_{name}"))


def fit_standardizer(train: DataFrame, column: str, width: int) -> DataFrame:
    """One row: means and population deviations of each position (1 where constant)."""
    x = F.col(column)
    sds = [F.stddev_pop(x[i]) for i in range(width)]
    return train.agg(F.array(*[F.avg(x[i]) for i in range(width)]).alias("m"), F.array(*[F.when(s > 0, s).otherwise(1.0) for s in sds]).alias("s"))


def standardize(df: DataFrame, fitted: DataFrame, column: str, width: int, name: str) -> DataFrame:
    both = df.withColumn("_fit", fitted.select(F.struct("m", "s")).scalar())
    z = F.array(*[(F.col(column)[i] - F.col("_fit.m")[i]) / F.col("_fit.s")[i] for i in range(width)])
    return both.withColumn(name, z).drop("_fit")


def train_state(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """missing / falling / middle / rising by the quartiles of the training part of each key."""
    from ramplake.functions.scalar import three_state
    from ramplake.operators.chunks import exact_quantiles

    cuts = exact_quantiles(df.filter("split = 'train'"), keys, value, {"_q25": 0.25, "_q75": 0.75})
    return df.join(cuts, keys).withColumn("state", three_state(F.col(value), F.col("_q25"), F.col("_q75"))).drop("_q25", "_q75")


def long_losses(df: DataFrame, keys: list[str], losses: dict[str, Column]) -> DataFrame:
    """One row per (keys, metric, loss); rows without a loss are dropped."""
    wide = df.select(*keys, *[c.cast("double").alias(n) for n, c in losses.items()])
    return wide.unpivot(keys, list(losses), "metric", "loss").filter("loss IS NOT NULL")


def point_metrics(df: DataFrame, model: list[str], lead: str, actual: str, predicted: str, capacity: float) -> DataFrame:
    """MAE, RMSE and their shares of capacity, per model overall (lead null) and per lead."""
    err = F.col(predicted) - F.col(actual)
    data = df.select(*model, lead, F.abs(err).alias("_a"), (err * err).alias("_s"))
    sets = [[F.col(c) for c in model], [F.col(c) for c in (*model, lead)]]
    out = data.groupingSets(sets, *model, lead).agg(F.count("*").alias("n"), F.avg("_a").alias("mae"), F.sqrt(F.avg("_s")).alias("rmse"))
    return out.withColumns({"nmae_pct": 100 * F.col("mae") / capacity, "nrmse_pct": 100 * F.col("rmse") / capacity})


def quantile_metrics(df: DataFrame, keys: list[str], actual: str, columns: dict[float, str], coverage: float = 0.8) -> DataFrame:
    """Weighted interval score, coverage error and width at the wanted coverage, error of the median."""
    y = F.col(actual)
    probs = sorted(columns)
    valid = y.isNotNull()
    for c in columns.values():
        valid = valid & F.col(c).isNotNull()
    middle = F.col(columns[min(probs, key=lambda p: abs(p - 0.5))])
    terms, pairs = [F.abs(middle - y)], []
    for low in (p for p in probs if p < 0.5):
        high = next((p for p in probs if abs(p - (1 - low)) < 1e-9), None)
        if high is None:
            continue
        alpha = 1 - (high - low)
        lo, hi = F.col(columns[low]), F.col(columns[high])
        miss = at_least(lo - y, 0.0) + at_least(y - hi, 0.0)
        terms.append((alpha / 2) * (hi - lo) + miss)
        pairs.append((alpha, lo, hi))
    alpha, lo, hi = min(pairs, key=lambda t: abs(t[0] - (1 - coverage)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    aggs = [F.count("*").alias("n"), F.avg(total / len(terms)).alias("wis"),
            F.abs(F.avg(((y >= lo) & (y <= hi)).cast("double")) - (1 - alpha)).alias("coverage_error"),
            F.avg(hi - lo).alias("interval_width"), F.avg(F.abs(middle - y)).alias("median_mae")]
    return df.filter(valid).groupBy(*keys).agg(*aggs)


def reliability(df: DataFrame, keys: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Count, mean forecast, observed rate and gap per probability bin; the last bin includes one."""
    b = at_most(F.floor(F.col(p) * bins), bins - 1).alias("bin")
    out = df.groupBy(*keys, b).agg(F.count("*").alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("obs_rate"))
    return out.withColumn("abs_gap", F.abs(F.col("mean_pred") - F.col("obs_rate")))


def reliability_between(df: DataFrame, keys: list[str], p: str, y: str, edges: list[float]) -> DataFrame:
    """Reliability in bins between given edges: each has its lower edge, the last one also an upper edge of one.

    Forecasts that are in no bin, null ones too, are left out; a bin without forecasts has no row.
    """
    below = sum((F.when(F.col(p) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    last = len(edges) - 2
    bin = F.when((F.lit(edges[-1]) >= 1) & (F.col(p) == edges[-1]), last).otherwise(below - 1)
    inside = df.withColumn("bin", bin).filter(F.col("bin").between(0, last) & F.col(p).isNotNull() & ~F.isnan(p))
    out = inside.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("obs_rate"))
    low, high = (F.get(F.array(*map(F.lit, ends)), "bin") for ends in (edges[:-1], edges[1:]))
    return out.withColumns({"bin_low": low, "bin_high": high, "abs_gap": F.abs(F.col("mean_pred") - F.col("obs_rate"))}).drop("bin")


def auroc(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Area under the ROC curve with half weight for ties, from counts per distinct score."""
    from ramplake.operators.chunks import equal_chunks, running

    counts = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    counts = equal_chunks(counts, keys, "_s")
    ranked = running(counts, keys, "_s", {"_below": ("sum", F.col("_n"))}, chunk="_chunk", strict=True)
    out = ranked.groupBy(*keys).agg(
        F.sum(F.col("_p") * (F.col("_below") + 0.5 * F.col("_n"))).alias("_u"), F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))
    return out.withColumn("auroc", F.try_divide(F.col("_u"), F.col("positives") * F.col("negatives"))).drop("_u")


def skill_table(losses: DataFrame, candidate: str, reference: str, keys: list[str], groups: list[str], minimum: int = 1) -> DataFrame:
    """Percent loss reduction against the reference arm, overall (group null) and by each group column."""
    pick = lambda arm: F.when(F.col("arm") == arm, F.col("loss"))
    data = losses.filter(F.col("arm").isin(candidate, reference))
    sets = [[F.col(c) for c in keys]] + [[F.col(c) for c in (*keys, g)] for g in groups]
    out = data.groupingSets(sets, *keys, *groups).agg(
        F.count_if(F.col("arm") == candidate).alias("windows"), F.avg(pick(candidate)).alias("loss"), F.avg(pick(reference)).alias("reference_loss"))
    return out.filter(F.col("windows") >= minimum).withColumn("skill_pct", 100 * (1 - F.try_divide(F.col("loss"), F.col("reference_loss"))))


def increments(losses: DataFrame, pairs: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Loss of one arm minus another on the same windows, averaged per key."""
    arms = sorted({a for p in pairs for a in p})
    wide = losses.groupBy(*keys, "b").pivot("arm", arms).agg(F.first("loss"))
    aggs = [F.avg(F.col(a) - F.col(b)).alias(f"{a}_minus_{b}") for a, b in pairs]
    return wide.groupBy(*keys).agg(F.count("*").alias("windows"), *aggs)


def seed_sensitivity(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.count("*").alias("seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lowest"), F.max(value).alias("highest"))


def correspondence(df: DataFrame, keys: list[str], predicted: str, observed: str) -> DataFrame:
    """Mean changes, error, correlation and agreement in sign on the pairs without a zero."""
    p, o = F.col(predicted), F.col(observed)
    moving = (p != 0) & (o != 0)
    return df.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.avg(p).alias("forecast_change"), F.avg(o).alias("observed_change"), F.avg(F.abs(p - o)).alias("change_mae"),
        F.sqrt(F.avg((p - o) * (p - o))).alias("change_rmse"), F.corr(p, o).alias("correlation"),
        F.avg(F.when(moving, (F.signum(p) == F.signum(o)).cast("double"))).alias("sign_agreement"), F.count_if(moving).alias("nonzero_pairs"))


def support_table(windows: DataFrame, keys: list[str], state: str, us: Column, block_days: int = 7) -> DataFrame:
    """Windows, class counts, down events and occupied blocks per key, over all states (null) and per state."""
    data = windows.withColumn("_block", F.floor(us / (block_days * 86_400_000_000)))
    sets = [[F.col(c) for c in keys], [F.col(c) for c in (*keys, state)]]
    return data.groupingSets(sets, *keys, state).agg(
        F.count("*").alias("windows"), *[F.count_if(F.col("y") == k).alias(f"class_{k}") for k in range(CLASSES)],
        F.count_if(F.col("arr") < TIMING_BINS).alias("down_events"), F.countDistinct("_block").alias("occupied_blocks"))


def train_frequency(train: DataFrame, keys: list[str], smooth: int = 1) -> DataFrame:
    """Smoothed class frequency ``p`` and arrival frequency ``q`` of the training windows per key."""
    n, events = F.count("*"), F.count_if(F.col("arr") < TIMING_BINS)
    p = F.array(*[(F.count_if(F.col("y") == k) + smooth) / (n + smooth * CLASSES) for k in range(CLASSES)])
    q = F.array(*[(F.count_if(F.col("arr") == k) + smooth) / (events + smooth * TIMING_BINS) for k in range(TIMING_BINS)])
    return train.groupBy(*keys).agg(p.alias("p"), q.alias("q"))


def frequency_forecast(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the training frequency of each row's key; unseen keys get the uniform forecast."""
    fitted = train_frequency(cases.filter("split = 'train'"), keys)
    flat = lambda k: F.array(*[F.lit(1.0 / k)] * k)
    out = cases.join(fitted, keys, "left")
    return out.withColumns({"p": F.coalesce("p", flat(CLASSES)), "q": F.coalesce("q", flat(TIMING_BINS))})


def scalar_scores(members: Column, truth: Column, m: int, name: str) -> list[Column]:
    """CRPS, error of the mean, 80 % coverage and width of a scalar that m members forecast."""
    from ramplake.functions import losses as ls

    low, high = ls.member_quantile(members, 0.1, m), ls.member_quantile(members, 0.9, m)
    mean = F.aggregate(members, F.lit(0.0), lambda a, v: a + v) / m
    return [ls.crps(members, truth, m).alias(f"{name}_crps"), F.abs(mean - truth).alias(f"{name}_mae"),
            truth.between(low, high).cast("int").alias(f"{name}_coverage80"), (high - low).alias(f"{name}_width80")]


def scalar_ensemble_metrics(df: DataFrame, keys: list[str], members: str, truth: str, m: int, name: str) -> DataFrame:
    """Scores of one scalar of a fixed-size ensemble."""
    return df.select(*keys, *scalar_scores(F.col(members), F.col(truth), m, name))


def path_ensemble_metrics(df: DataFrame, keys: list[str], members: str, truth: str, m: int, nodes: int = PATH_NODES) -> DataFrame:
    """Profile CRPS and squared error of member paths, and the scalar scores of their mean, range and net change.

    Row by row: nothing is joined or shuffled.
    """
    from ramplake.functions import losses as ls

    y = F.col(truth)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    shape = {"mean": lambda p: total(p) / nodes, "range": lambda p: F.array_max(p) - F.array_min(p), "net": lambda p: p[nodes - 1] - p[0]}
    # members of each node and shape are columns of their own first, so that no score repeats how they are made
    across = {f"_n{k}": F.transform(members, lambda p: p[k]) for k in range(nodes)}
    across |= {f"_m_{n}": F.transform(members, fn) for n, fn in shape.items()} | {f"_y_{n}": fn(y) for n, fn in shape.items()}
    at = [F.col(f"_n{k}") for k in range(nodes)]
    crps = paths.mean([ls.crps(c, y[k], m) for k, c in enumerate(at)])
    mse = paths.mean([F.pow(total(c) / m - y[k], 2) for k, c in enumerate(at)])
    scalars = [c for n in shape for c in scalar_scores(F.col(f"_m_{n}"), F.col(f"_y_{n}"), m, n)]
    return df.withColumns(across).select(*keys, crps.alias("profile_crps"), mse.alias("profile_mse"), *scalars)
