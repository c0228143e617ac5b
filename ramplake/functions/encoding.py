"""Angular fields of unit-domain shapes, their inversion and cosine coefficients."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F
from ramplake.functions.clip import at_least, at_most


def _unit(x: Column) -> Column:
    return F.transform(x, lambda v: at_least(at_most(v.cast("double"), 1.0), -1.0))


def _co(v: Column) -> Column:
    return F.sqrt(at_least(1 - v * v, 0.0))


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it by name inside ``use``."""
    return F.transform(F.array(value), use)[0]


def _field(x: Column, cell) -> Column:
    """Flattened square of ``cell(u_i, c_i, u_j, c_j)``; values and complements are computed once per row."""
    pairs = F.transform(_unit(x), lambda u: F.struct(u.alias("u"), _co(u).alias("c")))
    return _bind(pairs, lambda z: F.flatten(F.transform(z, lambda a: F.transform(z, lambda b: cell(a["u"], a["c"], b["u"], b["c"])))))


def gasf(x: Column) -> Column:
    """Flattened summation field."""
    return _field(x, lambda u, c, v, d: u * v - c * d)


def gadf(x: Column) -> Column:
    """Flattened difference field."""
    return _field(x, lambda u, c, v, d: c * v - u * d)


def polarity(x: Column) -> Column:
    """Sign at the node of largest magnitude, the first one on ties."""
    size = F.transform(x, lambda v: F.abs(v))
    return F.signum(F.element_at(x, F.array_position(size, F.array_max(size)).cast("int")).cast("double"))


def invert_gasf(field: Column, sign: Column, n: int) -> Column:
    """The path behind a summation field, given the sign at its largest node."""
    sizes = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sqrt(at_least((F.get(field, i * (n + 1)) + 1) / 2, 0.0))
    )
    def unfold(m: Column) -> Column:
        anchor = F.array_position(m, F.array_max(m)).cast("int") - 1
        return _bind(F.struct(anchor.alias("at"), F.get(m, anchor).alias("top")), lambda t: F.transform(
            m, lambda v, i: (F.get(field, i * n + t["at"]) + _co(v) * _co(t["top"])) / (t["top"] * sign)))
    return _bind(sizes, unfold)


def dct2_ortho(x: Column, n: int, first: int, coefficients: int) -> Column:
    """The first orthonormal DCT-II coefficients of ``n`` nodes starting at ``first``."""
    def coefficient(k: int) -> Column:
        scale = math.sqrt((1 if k == 0 else 2) / n)
        total = F.lit(0.0)
        for i in range(n):
            total = total + x[first + i].cast("double") * (scale * math.cos(math.pi * k * (2 * i + 1) / (2 * n)))
        return total
    return F.array(*[coefficient(k) for k in range(coefficients)])
