"""Readers of minute CSVs, tables by suffix, event series and station or weather files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ramplake.functions.clip import at_least
from ramplake.sources.files import headers, listed

# Header words that name the identifier, time, wind and power columns of raw files.
ID_WORDS = ("名称", "机组", "turbine", "id", "machine_num", "machine", "pow_fan_id", "fan_id")
TIME_WORDS = ("时间", "timestamp", "datetime", "time")
WIND_WORDS = ("风速", "windspeed", "wind_speed", "speed")
POWER_WORDS = ("有功", "功率", "power", "active")
# Spellings accepted by the strict boolean column.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")


class MissingOverride(ValueError):
    """A column that was named for a role is not in the table."""


def resolve_columns(columns: list[str], wanted: dict[str, tuple[str, ...]], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Column per role: the one named for it, otherwise the first header that contains one of the words. A role without a
    column is a ValueError, then a named column that is not there a MissingOverride."""
    overrides = overrides or {}
    word = lambda role: next((c for c in columns if any(w in c.strip().lower() for w in wanted[role])), None)
    found = {role: overrides.get(role) or word(role) for role in wanted}
    without = [role for role, name in found.items() if name is None]
    if without:
        raise ValueError(f"no column for {', '.join(without)}")
    absent = [name for name in found.values() if name not in columns]
    if absent:
        raise MissingOverride(f"column {', '.join(absent)} not found")
    return found


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given order, by aggregation rather than by a window over the key."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def typed_scada(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Minute rows with types, negative readings as zero. A reading that is no number is null."""
    number = lambda role: at_least(F.col(names[role]).try_cast("double"), 0.0)
    out = raw.select(
        F.col(names["id"]).cast("string").alias("turbine_id"), F.col(names["time"]).try_cast("timestamp").alias("datetime"),
        number("wind").alias("wind_speed_1min"), number("power").alias("power_1min_inst"), *[c for c in ("_file", "_at") if c in raw.columns])
    return out.filter(F.col("turbine_id").isNotNull() & F.col("datetime").isNotNull())


def in_range(out: DataFrame, *, wind: tuple[float, float], power_min: float, power_max: float = 0.0, start: str = "", end: str = "") -> DataFrame:
    """Rows with both readings in range; ``end`` given as a date includes that whole day."""
    out = out.filter(F.col("wind_speed_1min").between(*wind) & (F.col("power_1min_inst") >= power_min))
    if power_max > 0:
        out = out.filter(F.col("power_1min_inst") <= power_max)
    if start:
        out = out.filter(F.col("datetime") >= F.lit(start).cast("timestamp"))
    if end:
        limit = F.lit(end).cast("timestamp")
        out = out.filter(F.col("datetime") < limit + F.make_dt_interval(days=F.lit(1)) if len(end) == 10 else F.col("datetime") <= limit)
    return out


def files_by_header(spark: SparkSession, paths: str | list[str], pattern: str, encoding: str, recursive: bool, exclude: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Files under each header line, without those of an empty one and those of an excluded name. Only file names and headers come to
    the driver; of a file only its first block is read."""
    files = listed(spark, paths, pattern, recursive)
    if exclude:
        files = files.filter(~F.element_at(F.split("path", "/"), -1).isin(*exclude))
    out: dict[str, list[str]] = {}
    for r in headers(files, encoding).filter("header IS NOT NULL").orderBy("path").select("path", "header").collect():
        out.setdefault(r["header"], []).append(r["path"])
    return out


def read_scada_csv(
    spark: SparkSession, paths: str | list[str], *, pattern: str = "*.csv", encoding: str = "UTF-8", recursive: bool = False, overrides: dict[str, str] | None = None,
    wind: tuple[float, float] = (0.0, 50.0), power_min: float = 0.0, power_max: float = 0.0, start: str = "", end: str = "", id_prefix: str = "", exclude: tuple[str, ...] = (),
) -> DataFrame:
    """Minute CSVs with keyword-resolved columns, de-duplicated on (unit, time) keeping the first by file and position.

    Columns are resolved for each header that occurs; files without the needed columns and files of the names in `exclude`
    are left out. It is an error if no file has the columns, or if one lacks a column that `overrides` names. Encoded ids are mapped per file, before rows out of range go.
    """
    parts, missing = [], None
    for _, files in sorted(files_by_header(spark, paths, pattern, encoding, recursive, exclude).items()):
        raw = spark.read.option("header", True).option("encoding", encoding).csv(files)
        try:
            names = resolve_columns(raw.columns, {"id": ID_WORDS, "time": TIME_WORDS, "wind": WIND_WORDS, "power": POWER_WORDS}, overrides)
        except MissingOverride:
            raise
        except ValueError as error:
            missing = error
            continue
        raw = raw.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())})
        parts.append(typed_scada(raw, names))
    if not parts:
        raise missing or ValueError("no file to read")
    out = reduce(DataFrame.unionByName, parts)
    if id_prefix:
        out = remap_encoded_ids(out, "turbine_id", "datetime", id_prefix, within=["_file"])
    out = in_range(out, wind=wind, power_min=power_min, power_max=power_max, start=start, end=end)
    return keep_first(out, ["turbine_id", "datetime"], ["_file", "_at"]).drop("_file", "_at")


def remap_encoded_ids(df: DataFrame, unit: str, time: str, prefix: str, max_id: int = 117, within: list[str] | None = None) -> DataFrame:
    """Strip the prefix from identifiers at times where some identifier exceeds ``max_id``."""
    number = F.col(unit).cast("string").try_cast("long")
    encoded = df.groupBy(*(within or []), time).agg((F.max(number) > max_id).alias("_encoded"))
    suffix = F.regexp_replace(F.col(unit).cast("string"), f"^{prefix}", "")
    strip = F.col("_encoded") & F.col(unit).cast("string").startswith(prefix) & suffix.try_cast("long").between(1, max_id)
    out = df.join(encoded, [*(within or []), time])
    return out.withColumn(unit, F.when(F.coalesce(strip, F.lit(False)), suffix.try_cast("long").cast("string")).otherwise(F.col(unit).cast("string"))).drop("_encoded")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """csv, txt or parquet by suffix (also gzipped), or every parquet file of a folder."""
    name = path.lower().removesuffix(".gz")
    reader = spark.read.schema(schema) if schema else spark.read
    if name.endswith((".csv", ".txt")):
        return reader.option("header", True).option("inferSchema", schema is None).option("sep", "," if name.endswith(".csv") else "\t").csv(path)
    return reader.option("mergeSchema", schema is None).parquet(path)


def strict_boolean(value: Column) -> Column:
    """Boolean from the accepted spellings; anything else is an error."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(word, F.lit("null")))).cast("boolean"))


def read_event_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("power").cast("double").alias("power"), strict_boolean(F.col("valid")).alias("valid"))


def weather_hourly_union(parts: list[DataFrame], time: str = "time") -> DataFrame:
    """Monthly tables stacked by name; the earliest part wins for a repeated hour."""
    stacked = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("_part", F.lit(i))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    return keep_first(stacked, [time], ["_part"]).drop("_part")


def static_priors(df: DataFrame, unit: str, columns: list[str]) -> DataFrame:
    """Exact median of each static column per unit."""
    from ramplake.operators.chunks import exact_quantiles

    out = None
    for c in columns:
        one = exact_quantiles(df, [unit], c, {c: 0.5})
        out = one if out is None else out.join(one, unit, "full")
    return out
