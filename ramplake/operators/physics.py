"""Weather over forecast windows: hourly fields brought to quarter-hour nodes and integrated.

A window of four hours that starts at any quarter hour lies in at most six hourly rows. They are gathered once per hour in
a bounded frame over hour chunks, each start joins its hour by equality, and nodes and integrals are expressions of
that array, so no node is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ramplake.config import PATH_NODES
from ramplake.operators.chunks import windowed

QUARTERS = 4
FIELDS = ("u10", "v10", "u100", "v100", "t2m", "sp", "sshf")
PASCAL, SECONDS = 100.0, 3600.0  # of a hectopascal, of an hour


def hours_ahead(hourly: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS, hour: str = "b") -> DataFrame:
    """For each hourly row the rows of its hour and the hours after it that a window can touch, as arrays by field: element
    k of a field is hour + k, null where that hour is missing."""
    reach = (PATH_NODES - 1) // QUARTERS + 1

    def frames(w):
        return {f"{name}_h": F.array(*(F.max(name).over(w.rangeBetween(k, k)) for k in range(reach + 1))) for name in fields}

    return windowed(hourly.select(*keys, hour, *fields), keys, hour, 0, reach, frames).select(*keys, hour, *(F.col(f"{name}_h").alias(name) for name in fields))


def at_nodes(hours: str, offset: str = "_r") -> Column:
    """Values at the quarter-hour nodes, on straight lines between the hours; a node on the hour needs that hour alone."""

    def node(k: Column) -> Column:
        at = F.col(offset) + k
        i, part = F.floor(at / QUARTERS).cast("int"), (at % QUARTERS) / F.lit(float(QUARTERS))
        left = F.get(hours, i)
        return F.when(part == 0, left).otherwise(left + (F.get(hours, i + 1) - left) * part)

    return F.transform(F.sequence(F.lit(0), F.lit(PATH_NODES - 1)), node)


def trapezoid_mean(values: Column) -> Column:
    """Mean of the line through the nodes; null with any node missing."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return (total - (F.get(values, 0) + F.get(values, PATH_NODES - 1)) / 2) / (PATH_NODES - 1)


def interval_mean(hours: str, offset: str = "_r") -> Column:
    """Mean of an hourly accumulation over the window's quarters. The value of an hour covers the hour before it, and each
    quarter lies in one of them, so hour k has the weight of its quarters inside the window."""
    n = PATH_NODES - 1
    total = F.lit(0.0)
    for k in range(1, n // QUARTERS + 2):
        inside = F.least(F.lit(QUARTERS), F.lit(n) + F.col(offset) - QUARTERS * (k - 1)) - (F.col(offset) if k == 1 else 0)
        total = total + F.when(inside == 0, 0.0).otherwise(F.get(hours, k) * inside)
    return total / n


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def window_physics(hourly: DataFrame, starts: DataFrame, keys: list[str], *, hour: str = "b", start: str = "q") -> DataFrame:
    """Physics of the windows `starts` (keys, quarter-hour index `start`), one row each: interval mean of the heat flux in
    watts, trapezoid means of shear and speed, changes of speed, wind vector, temperature and pressure from end to end.

    `hourly` has the fields FIELDS by hour index; heat is an accumulation of the hour that ends there, the others are
    instantaneous. A result is null where one of its own hours or fields is missing.
    """
    wide = hours_ahead(hourly, keys, hour=hour)
    wanted = starts.withColumn(hour, F.floor(F.col(start) / QUARTERS).cast("long")).withColumn("_r", F.pmod(F.col(start), F.lit(QUARTERS)).cast("int"))
    data = wanted.join(wide, [*keys, hour], "left")
    # one projection a step, so that no expression is copied into another
    data = data.withColumn("heat", interval_mean("sshf") / SECONDS)
    data = data.withColumns({f"_{name}": at_nodes(name) for name in ("u10", "v10", "u100", "v100", "t2m", "sp")})
    pairs = F.arrays_zip("_u10", "_v10", "_u100", "_v100")
    data = data.withColumns({
        "_speed": F.zip_with("_u100", "_v100", hypot),
        "_shear": F.transform(pairs, lambda p: hypot(p["_u100"] - p["_u10"], p["_v100"] - p["_v10"]))})
    ends = lambda name: F.get(name, PATH_NODES - 1) - F.get(name, 0)
    return data.select(
        *starts.columns, trapezoid_mean(F.col("_shear")).alias("shear"), "heat", trapezoid_mean(F.col("_speed")).alias("speed100"),
        ends("_speed").alias("wind_delta"), hypot(ends("_u100"), ends("_v100")).alias("vector_delta"),
        ends("_t2m").alias("temperature_delta"), (ends("_sp") / PASCAL).alias("pressure_delta_hpa"))
