"""Expressions on fixed-width path arrays.

The width is known when the plan is built, so the ordered folds are unrolled into plain ``least``,
``greatest`` and ``when`` expressions that stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ramplake.config import PATH_NODES, THRESHOLD_TOL, TIMING_BINS
from ramplake.functions.clip import at_least, at_most


def nodes(path: str | Column, n: int = PATH_NODES) -> list[Column]:
    path = F.col(path) if isinstance(path, str) else path
    return [path[i] for i in range(n)]


def excursions(path: str | Column, n: int = PATH_NODES, anchor: Column | None = None) -> tuple[list[Column], list[Column]]:
    """Rise above the lowest earlier node and fall below the highest earlier node, per node."""
    x = ([anchor] if anchor is not None else []) + nodes(path, n)
    ups, downs = [], []
    for j in range(1, len(x)):
        ups.append(x[j] - F.least(*x[: j + 1]))
        downs.append(F.greatest(*x[: j + 1]) - x[j])
    return ups, downs


def reaches(values: list[Column], cut) -> Column:
    """Whether any value reaches the cut, as a chain of short branches (one large expression would not be compiled)."""
    out = F.when(values[0] >= cut, True)
    for v in values[1:]:
        out = out.when(v >= cut, True)
    return out.otherwise(False)


def process_class(path: str | Column, thr: float | Column, n: int = PATH_NODES, anchor: Column | None = None, tol: float = THRESHOLD_TOL) -> Column:
    """0 calm, 1 rise, 2 fall, 3 both, from ordered excursions of at least ``thr``."""
    ups, downs = excursions(path, n, anchor)
    cut = thr - tol if isinstance(thr, float) else thr - F.lit(tol)
    return reaches(ups, cut).cast("int") + 2 * reaches(downs, cut).cast("int")


def with_excursions(df: DataFrame, path: str, n: int = PATH_NODES) -> DataFrame:
    """Add ``ups`` and ``downs``, the excursions of every node, for labelling many rows at many thresholds.

    The running extremes are built one projection per node, so each is computed once from the one before and the
    work is linear in the path length; as single expressions it would be quadratic.
    """
    x = nodes(path, n)
    out = df.withColumns({"_lo0": x[0], "_hi0": x[0]})
    for j in range(1, n):
        out = out.withColumns({f"_lo{j}": F.least(f"_lo{j - 1}", x[j]), f"_hi{j}": F.greatest(f"_hi{j - 1}", x[j])})
    out = out.withColumns({"ups": F.array(*[x[j] - F.col(f"_lo{j}") for j in range(1, n)]), "downs": F.array(*[F.col(f"_hi{j}") - x[j] for j in range(1, n)])})
    return out.drop(*[f"_{s}{j}" for s in ("lo", "hi") for j in range(n)])


def first_passage(path: str | Column, thr: float | Column, direction: str = "down", n: int = PATH_NODES, tol: float = THRESHOLD_TOL) -> Column:
    """Index of the first node after the start where the excursion reaches ``thr``; n - 1 if none does."""
    ups, downs = excursions(path, n)
    cut = thr - tol if isinstance(thr, float) else thr - F.lit(tol)
    hits = ups if direction == "up" else downs
    out = F.when(hits[0] >= cut, F.lit(0))
    for j, value in enumerate(hits[1:], 1):
        out = out.when(value >= cut, F.lit(j))
    return out.otherwise(F.lit(n - 1))


def class_at(thr: Column, tol: float = THRESHOLD_TOL) -> Column:
    cut = thr - tol
    return (F.array_max("ups") >= cut).cast("int") + 2 * (F.array_max("downs") >= cut).cast("int")


def passage_at(thr: Column, direction: str = "down", n: int = PATH_NODES, tol: float = THRESHOLD_TOL) -> Column:
    hits = F.transform("ups" if direction == "up" else "downs", lambda v: v >= thr - tol)
    first = F.array_position(hits, F.lit(True)).cast("int")
    return F.when(first > 0, first - 1).otherwise(n - 1)


def mean(values: list[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / len(values)


def spread(values: list[Column]) -> Column:
    return F.greatest(*values) - F.least(*values)


def coarse_excess_variation(path: str | Column, quarter: Column | None = None, stride: int = 4, n: int = PATH_NODES, unit: float = 10.0) -> Column:
    """Total variation of the coarse path beyond its net change.

    The coarse path has both ends and the nodes on full hours; ``quarter`` says how many quarters of an hour after a
    full hour the path starts (0 to 3, nothing: 0).
    """
    x = nodes(path, n)

    def excess(start: int) -> Column:
        picks = sorted({0, n - 1, *(k for k in range(n) if (k + start) % stride == 0)})
        steps = [F.abs(x[j] - x[i]) for i, j in zip(picks, picks[1:])]
        return at_least(sum(steps[1:], steps[0]) - F.abs(x[-1] - x[0]), 0.0) / unit

    if quarter is None:
        return excess(0)
    out = F.when(quarter == 0, excess(0))
    for start in range(1, stride):
        out = out.when(quarter == start, excess(start))
    return out


def sorted_interior(path: str | Column, n: int = PATH_NODES) -> Column:
    """Sort the interior nodes and keep both ends: same values, no temporal order."""
    path = F.col(path) if isinstance(path, str) else path
    return F.concat(F.array(path[0]), F.array_sort(F.slice(path, 2, n - 2)), F.array(path[n - 1]))


def residual_summary(error: str | Column, n: int = PATH_NODES) -> Column:
    """mean, first, last, min, max, net and range of an error path, in fifths."""
    e = nodes(error, n)
    parts = [mean(e), e[0], e[-1], F.least(*e), F.greatest(*e), e[-1] - e[0], spread(e)]
    return F.array(*[p / 5 for p in parts])


def response_features(known: Column, wind: str | Column, n: int = PATH_NODES) -> Column:
    """Known inputs followed by the scaled wind path and its level, net change and range."""
    w = nodes(wind, n)
    tail = [v / 20 for v in w] + [mean(w) / 20, (w[-1] - w[0]) / 5, spread(w) / 10]
    return F.concat(known, F.array(*tail))


def issue_context(anchor: Column, first: str | Column, second: str | Column, n: int = PATH_NODES) -> Column:
    """Seven features known at issue: level terms, both forecasts' net change, level and range, interaction."""
    f, s = nodes(first, n), nodes(second, n)
    change = (f[-1] - f[0]) / 5
    return F.array(anchor, anchor * anchor, change, (s[-1] - s[0]) / 5, mean(f) / 20, spread(f) / 10, anchor * change)


def chord_residual(path: str | Column, n: int = PATH_NODES) -> list[Column]:
    """Deviation of each node from the straight line between the ends."""
    x = nodes(path, n)
    return [x[i] - (x[0] + (x[-1] - x[0]) * (i / (n - 1))) for i in range(n)]


def log_prob(p: str | Column, floor: float = 1e-6) -> Column:
    return F.transform(p, lambda v: F.log(at_most(at_least(v, floor), 1.0)))


def timing_width() -> int:
    return TIMING_BINS
