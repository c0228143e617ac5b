"""Loss expressions for class, timing, ensemble, interval and path forecasts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ramplake.config import CLASSES, PATH_NODES, TIMING_BINS
from ramplake.functions import paths
from ramplake.functions.clip import at_least, at_most


def _one(cond: Column) -> Column:
    return cond.cast("double")


def _total(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def class_losses(y: Column, p: Column) -> dict[str, Column]:
    """Return, multiclass, up and down Brier scores and the log loss of four-class probabilities."""
    sq = lambda v: v * v
    return {
        "return_brier": sq(p[3] - _one(y == 3)),
        "multiclass_brier": _total([sq(p[k] - _one(y == k)) for k in range(CLASSES)]),
        "log_loss": -F.log(at_most(at_least(F.get(p, y), 1e-12), 1.0)),
        "up_brier": sq(p[1] + p[3] - _one(y.isin(1, 3))),
        "down_brier": sq(p[2] + p[3] - _one(y.isin(2, 3))),
    }


def three_class_losses(y: Column, p: Column) -> dict[str, Column]:
    """Log loss and Brier score of fall / calm / rise, and the direction score on transitions (null on calm)."""
    sq = lambda v: v * v
    return {
        "log_loss": -F.log(at_most(at_least(F.get(p, y), 1e-12), 1.0)),
        "brier": _total([sq(p[k] - _one(y == k)) for k in range(3)]),
        "direction_score": F.when(y != 1, p[2] / at_least(p[0] + p[2], 1e-12)),
    }


def cumulative(q: Column, n: int, force_one: bool) -> list[Column]:
    out, total = [], None
    for k in range(n):
        total = q[k] if total is None else total + q[k]
        out.append(F.lit(1.0) if force_one and k == n - 1 else total)
    return out


def timing_losses(arrival: Column, q: Column, occurrence: Column, minutes_per_bin: int = 15, normalize: bool = False) -> dict[str, Column]:
    """Joint and conditional timing scores; the conditional ones are null without an event.

    The last node of the conditional distribution is one by contract.
    """
    k = TIMING_BINS
    if normalize:
        mass = F.aggregate(q, F.lit(0.0), lambda a, v: a + v)
        q = F.transform(q, lambda v: v / F.when(mass > 0, mass).otherwise(1.0))
    cdf = cumulative(q, k, True)
    truth = [_one(arrival <= j) for j in range(k)]
    joint = [(c * occurrence - t) * (c * occurrence - t) for c, t in zip(cdf, truth)]
    event = arrival < k
    median = F.lit(k - 1)
    for j in range(k - 2, -1, -1):
        median = F.when(cdf[j] >= 0.5, F.lit(j)).otherwise(median)
    at = F.get(q, at_most(arrival, k - 1))
    mass = F.when(event, occurrence * at).otherwise(1 - occurrence)
    return {
        "joint_rps": _total(joint) / k,
        "early_cdf_loss": _total(joint[:-1]) / (k - 1),
        "occurrence_brier": joint[-1],
        "joint_log_loss": -F.log(at_least(mass, 1e-12)),
        "conditional_rps": F.when(event, _total([(c - t) * (c - t) for c, t in zip(cdf[:-1], truth[:-1])]) / (k - 1)),
        "conditional_median_mae": F.when(event, minutes_per_bin * F.abs(median - arrival).cast("double")),
    }


def rps17(p17: Column, arrival: Column) -> Column:
    """Sum form of the ranked probability score over 17 bins, no event being the last bin."""
    cdf = cumulative(p17, TIMING_BINS + 1, False)
    return _total([(c - _one(arrival <= j)) * (c - _one(arrival <= j)) for j, c in enumerate(cdf)])


def joint_product(p_down: Column, q: Column) -> Column:
    """Seventeen-bin distribution from occurrence and conditional timing."""
    return F.concat(F.transform(q, lambda v: v * p_down), F.array(1 - p_down))


def condition(p17: Column) -> Column:
    """Conditional timing from the 17-bin distribution; null without mass."""
    head = F.slice(p17, 1, TIMING_BINS)
    mass = F.aggregate(head, F.lit(0.0), lambda a, v: a + v)
    return F.when(mass > 0, F.transform(head, lambda v: v / mass))


def crps(members: Column, actual: Column, m: int) -> Column:
    """Mean absolute error of the members minus half their mean pair distance (sorted form)."""
    ordered = F.array_sort(members)
    near = F.aggregate(members, F.lit(0.0), lambda a, v: a + F.abs(v - actual)) / m
    pairs = _total([ordered[i] * float(2 * (i + 1) - m - 1) for i in range(m)]) / (m * m)
    return near - pairs


def interval_score(actual: Column, low: Column, high: Column, alpha: float) -> Column:
    miss = at_least(low - actual, 0.0) + at_least(actual - high, 0.0)
    return high - low + (2 / alpha) * miss


def member_quantile(members: Column, prob: float, m: int) -> Column:
    """Linear-interpolated quantile of a fixed-size member array."""
    ordered = F.array_sort(members)
    h = prob * (m - 1)
    low = int(h)
    high = min(low + 1, m - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (h - low)


def structure_losses(actual: Column, predicted: Column, anchor: Column, n: int = PATH_NODES) -> dict[str, Column]:
    """Trajectory, endpoint and internal-geometry errors; the chord starts one minute before the issue."""
    a, p = paths.nodes(actual, n), paths.nodes(predicted, n)
    share = [(15 * (i + 1) + 1) / (15 * n + 1) for i in range(n)]
    bend = lambda x: [v - anchor - (x[-1] - anchor) * s for v, s in zip(x, share)]
    mean_sq = lambda u, v: _total([(f - g) * (f - g) for f, g in zip(u, v)]) / n
    return {
        "trajectory": mean_sq(p, a), "endpoint": (p[-1] - a[-1]) * (p[-1] - a[-1]), "internal_geometry": mean_sq(bend(p), bend(a)),
    }


def weather_error(forecast: Column, reference: Column, n: int = PATH_NODES) -> dict[str, Column]:
    """Level, net change, geometry and path error of a forecast path."""
    e = [f - r for f, r in zip(paths.nodes(forecast, n), paths.nodes(reference, n))]
    inner = [e[i] - (e[0] + (e[-1] - e[0]) * (i / (n - 1))) for i in range(1, n - 1)]
    rms = lambda v: F.sqrt(_total([x * x for x in v]) / len(v))
    return {"level": F.abs(_total(e) / n), "net": F.abs(e[-1] - e[0]), "geometry": rms(inner), "path": rms(e)}
