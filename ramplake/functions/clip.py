"""Bounds that keep missing values missing: greatest and least skip nulls, so a bare clip would turn them into values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def at_least(value: Column, bound: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(bound)))


def at_most(value: Column, bound: float) -> Column:
    """A NaN, which sorts above all numbers, stays what it is."""
    return F.when(value.isNotNull(), F.when(F.isnan(value.cast("double")), value).otherwise(F.least(value, F.lit(bound))))


def clip(value: Column, low: float, high: float) -> Column:
    return at_most(at_least(value, low), high)
