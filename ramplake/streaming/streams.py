"""Structured Streaming forms of the causal rules: closing bins, causal fill, online doors, maturity, alerts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ramplake.config import MATURITY_MINUTES
from ramplake.operators.decide import decision_cost
from ramplake.operators.folds import fold
from ramplake.sources.writers import scratch


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file of a folder as a stream; zone-free timestamps become UTC timestamps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(folder)
    ntz = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(ntz) if ntz else df


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available into a parquet sink and return what was written."""
    spark = df.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    query = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def streaming_regularize(stream: DataFrame, keys: list[str], ts: str, value: str, minutes: int, late: str, min_count: int = 1) -> DataFrame:
    """Bins that close when the watermark passes; later rows are dropped by the engine and show in its metrics."""
    binned = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, f"{minutes} minutes"))
    out = binned.agg(F.avg(value).alias("x"), F.count(value).alias("n"))
    return out.select(*keys, F.floor(F.unix_micros("window.start") / (minutes * 60_000_000)).alias("b"), "x", "n", (F.col("n") >= min_count).alias("ok"))


def causal_fill(stream: DataFrame, key: str, limit: int) -> DataFrame:
    """Carry the last value forward for at most ``limit`` bins; state per unit is one value, its bin and the last bin seen.

    Input: key, b, x (null where missing). Rows of a micro-batch are put in order first. A row at or before a bin that an
    earlier micro-batch has passed comes too late to be filled causally, and is dropped: its bin has been decided.
    """
    types = dict(stream.dtypes)
    schema = f"{key} {types[key]}, b bigint, x double, gap_filled boolean"

    def step(k, batches, state):
        seen, last_b, last_x = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values("b")
        if seen is not None:
            rows = rows[rows["b"] > seen]
        out = []
        for b, x in zip(rows["b"], rows["x"]):
            missing = x is None or x != x
            if not missing:
                last_b, last_x = int(b), float(x)
                out.append((k[0], int(b), float(x), False))
            elif last_b is not None and b - last_b <= limit:
                out.append((k[0], int(b), last_x, True))
            else:
                out.append((k[0], int(b), None, False))
        if len(rows):
            state.update((int(rows["b"].iloc[-1]), last_b, last_x))
        yield pd.DataFrame(out, columns=[key, "b", "x", "gap_filled"])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "seen bigint, b bigint, x double", "append", "NoTimeout")


def online_doors(stream: DataFrame, key: str, epsilon: float, kind: str = "swing") -> DataFrame:
    """Swinging door over a stream of bins: emits a segment when it closes, or when the run breaks.

    Input: key, b, x with missing bins left out. The state is the open segment, so it never grows. Rows at or before the
    last bin of an earlier micro-batch are dropped; they are no break of the run.
    """
    import numpy as np

    types = dict(stream.dtypes)
    schema = f"{key} {types[key]}, start bigint, end bigint, x_start double, x_end double"

    def step(k, batches, state):
        rows = pd.concat(list(batches)).dropna(subset=["x"]).sort_values("b")
        b, x = rows["b"].to_numpy(dtype="int64"), rows["x"].to_numpy(dtype=float)
        out = []
        if state.exists:
            s, xs, low, high, pb, px = state.get
            held = (s, xs, low, high, epsilon, 0, "")
        else:
            held, pb, px = None, None, None
        if pb is not None:
            b, x = b[b > pb], x[b > pb]
        cuts = [0, *(np.flatnonzero(np.diff(b) != 1) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held is not None and b[lo] != pb + 1:
                if held[0] < pb:
                    out.append((k[0], held[0], pb, held[1], px))
                held = None
            part_b, part_x, first = b[lo:hi], x[lo:hi], 0
            closed, held = fold(kind, part_b, part_x, first, held, epsilon, 0)
            out += [(k[0], c[1], c[2], c[3], c[4]) for c in closed]
            pb, px = int(part_b[-1]), float(part_x[-1])
        if held is not None:
            state.update((int(held[0]), float(held[1]), float(held[2]), float(held[3]), pb, px))
        yield pd.DataFrame(out, columns=[key, "start", "end", "x_start", "x_end"])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "s bigint, xs double, low double, high double, pb bigint, px double", "append", "NoTimeout")


def maturity_join(forecasts: DataFrame, outcomes: DataFrame, key: str, issue: str, known: str, late: str = "1 hour", minutes: int = MATURITY_MINUTES, span: int = 60) -> DataFrame:
    """A forecast meets its outcome only once the label is mature; both watermarks bound the state."""
    f = forecasts.withWatermark(issue, late).alias("f")
    o = outcomes.withWatermark(known, late).alias("o")
    ripe = (F.col(f"f.{key}") == F.col(f"o.{key}")) & F.expr(f"o.{known} >= f.{issue} + INTERVAL {minutes} MINUTES AND o.{known} <= f.{issue} + INTERVAL {minutes + span} MINUTES")
    return f.join(o, ripe)


def streaming_supports(stream: DataFrame, keys: list[str], ts: str, late: str, gap: str = "4 hours") -> DataFrame:
    """Event supports as session windows."""
    s = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("anchor_count"), F.max(ts).alias("last"))
    return s.select(*keys, F.unix_micros("session_window.start").alias("start"), F.unix_micros("last").alias("end"), "anchor_count")


def rolling_scores(stream: DataFrame, keys: list[str], ts: str, loss: str, late: str, width: str = "56 days", slide: str = "7 days") -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width, slide)).agg(F.avg(loss).alias("score"), F.count(loss).alias("n"))
    return w.select(*keys, F.unix_micros("window.start").alias("start"), "score", "n")


def alerts(stream: DataFrame, thresholds: DataFrame, keys: list[str], p: str, event: str) -> DataFrame:
    """Stream–static join with the frozen thresholds."""
    joined = stream.join(thresholds, keys)
    return joined.withColumns({"alert": F.col(p) >= F.col("threshold"), "cost": decision_cost(F.col(p), F.col(event), F.col("threshold"), F.col("ratio"))})
