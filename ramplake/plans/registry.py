"""The table of registered queries and, for each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; zone-free timestamps become UTC timestamps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(ntz) if ntz else df


def half_away(x: Column, scale: float) -> Column:
    """Nearest multiple of 1/scale; values too large to scale stay."""
    whole = F.round(x * scale, 0) / scale
    return F.when(F.isnan(whole) | (F.abs(whole) == float("inf")), x).otherwise(whole)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns as the SQL's ``round`` does: the scaled double to a whole number, halves away from zero.

    ``F.round`` rounds the shortest decimal form instead, and differs where a value stands half-way between two results.
    """
    scale = 10.0 ** digits
    cols = {c: half_away(F.col(c).cast("double"), scale) for c, t in df.dtypes if t in ("double", "float")}
    ints = {c: F.col(c).cast("long") for c, t in df.dtypes if t in ("int", "smallint", "tinyint")}
    return df.withColumns({**cols, **ints}) if cols or ints else df
