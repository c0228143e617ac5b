"""Window work on hot series.

A window partitioned by the entity alone puts a whole series into one task. Every operator here cuts a
series into index chunks instead, so that a series holding a large share of all rows still spreads over
the cluster:

* ``windowed`` evaluates *bounded* frames. Rows within reach of a neighbouring chunk are copied into it
  (the halo), the frame runs inside ``(keys, chunk)``, and only the owning chunk keeps its rows.
* ``running`` evaluates *unbounded* running sums, extremes and last values. It scans inside each chunk and
  adds a carry taken from a table with one row per (keys, chunk).
* ``equal_chunks`` cuts at equal counts instead of equal index widths, for series whose rows crowd: a busy day is then
  many chunks, and a quiet year one.
* ``exact_quantiles`` finds exact linear-interpolated quantiles. For large groups a sketch brackets the wanted
  ranks, one aggregate counts what lies below the bracket, and only the bracketed values are ranked.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, WindowSpec, functions as F

CHUNK = 4096


def _slot(column: Column, size: int) -> Column:
    return F.floor(column / F.lit(size)).cast("long")


def with_halo(df: DataFrame, idx: str, before: int, after: int, size: int) -> DataFrame:
    """Copy each row into every chunk whose own rows can see it; ``_own`` marks the home copy."""
    first, last = _slot(F.col(idx) - after, size), _slot(F.col(idx) + before, size)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_chunk") == _slot(F.col(idx), size)
    )


def windowed(
    df: DataFrame,
    keys: list[str],
    idx: str,
    before: int,
    after: int,
    *stages: Callable[[WindowSpec], dict[str, Column]],
    size: int | None = None,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Add columns from frames that look back ``before`` and ahead ``after`` index units in total.

    Each stage receives the window (ordered by ``idx``) and may use the columns of earlier stages.
    """
    size = size or max(CHUNK, 8 * (before + after))
    out = with_halo(df, idx, before, after, size)
    window = W.partitionBy(*keys, "_chunk").orderBy(idx, *ties)
    for stage in stages:
        out = out.withColumns(stage(window))
    return out.filter("_own").drop("_chunk", "_own")


def equal_chunks(df: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Adds ``_chunk``, the same for stretches of about equal numbers of rows in the order of (keys, idx).

    The borders come from Spark's sample of that order, so a key or a day with most of the rows spreads over as many chunks
    as its rows need; rows that share key and index stay together. The rows are written with their chunk, because another
    run would draw other borders. Rows without an index are in no stretch and go.
    """
    placed = df.filter(F.col(idx).isNotNull()).repartitionByRange(*keys, idx)
    return cut_lineage(placed.withColumn("_chunk", F.spark_partition_id().cast("long")))


def running(
    df: DataFrame,
    keys: list[str],
    idx: str,
    specs: dict[str, tuple[str, Column]],
    *,
    ties: tuple[str, ...] = (),
    size: int | None = None,
    reverse: bool = False,
    strict: bool = False,
    chunk: str | None = None,
) -> DataFrame:
    """Running ``sum``, ``max``, ``min`` or ``last`` (last non-null) along ``idx``.

    The current row is included unless ``strict``; ``reverse`` runs from the end. ``ties`` completes the
    order of rows that share an index value; such rows stay in one chunk. Chunks are ``size`` index units wide, or given
    by the column ``chunk`` (from ``equal_chunks``), which stays.
    """
    size = size or CHUNK
    values = {f"_v_{name}": column for name, (_, column) in specs.items()}
    data = df.withColumns({"_chunk": F.col(chunk) if chunk else _slot(F.col(idx), size), **values})
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in (idx, *ties)]
    chunk_order = F.col("_chunk").desc() if reverse else F.col("_chunk").asc()
    local = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    carried = W.partitionBy(*keys).orderBy(chunk_order).rowsBetween(W.unboundedPreceding, -1)
    position = F.struct(idx, *ties)
    totals, carries, locals_, merged = [], {}, {}, {}
    for name, (kind, _) in specs.items():
        value, total = F.col(f"_v_{name}"), F.col(f"_t_{name}")
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            totals.append(pick(value, F.when(value.isNotNull(), position)).alias(f"_t_{name}"))
            locals_[f"_l_{name}"] = F.last(value, ignorenulls=True).over(local)
            carries[f"_c_{name}"] = F.last(total, ignorenulls=True).over(carried)
            merged[name] = F.coalesce(f"_l_{name}", f"_c_{name}")
            continue
        fold = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
        totals.append(fold(value).alias(f"_t_{name}"))
        locals_[f"_l_{name}"] = fold(value).over(local)
        carries[f"_c_{name}"] = fold(total).over(carried)
        if kind == "sum":
            zero = F.lit(0)
            merged[name] = F.coalesce(F.col(f"_l_{name}"), zero) + F.coalesce(F.col(f"_c_{name}"), zero)
        else:
            merged[name] = (F.greatest if kind == "max" else F.least)(f"_l_{name}", f"_c_{name}")
    summary = data.groupBy(*keys, "_chunk").agg(*totals).withColumns(carries)
    summary = summary.select(*keys, "_chunk", *carries)
    out = data.withColumns(locals_).join(summary, [*keys, "_chunk"]).withColumns(merged)
    return out.select(*[c for c in df.columns if c not in specs], *specs)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 20000
) -> DataFrame:
    """One row per key with exact linear-interpolated quantiles of the non-null ``value``; without keys one row.

    The sketch of a key has a fixed size and a proven rank error of n / accuracy, so the wanted ranks lie inside a bracket
    of values for certain; one aggregate counts what is below, and only bracketed values are ranked. Groups of any size
    take this path; in one smaller than the sketch every value is in its bracket.
    """
    data = df.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    names = sorted(probs, key=probs.get)
    slack = 2.0 / accuracy
    levels = [p for n in names for p in (max(0.0, probs[n] - slack), min(1.0, probs[n] + slack))]
    marks = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_x").alias("_lowest"), F.max("_x").alias("_highest"), F.percentile_approx("_x", levels, accuracy).alias("_marks"))
    few = F.col("_n") <= 4 * accuracy  # a rank is more than the slack there
    lo = [F.col("_lowest") if probs[n] <= slack else F.when(few, F.col("_lowest")).otherwise(F.col("_marks")[2 * i]) for i, n in enumerate(names)]
    hi = [F.col("_highest") if probs[n] >= 1 - slack else F.when(few, F.col("_highest")).otherwise(F.col("_marks")[2 * i + 1]) for i, n in enumerate(names)]
    # brackets belong to the key, not to the row; without keys they are one value, not a table to join
    marks = marks.select(*keys, F.struct("_n", F.array(*lo).alias("los"), F.array(*hi).alias("his")).alias("_m"))
    marked = data.join(marks, keys) if keys else data.withColumn("_m", marks.scalar())
    # the first bracket that ends at or above the value holds it, or lies above it
    at = F.size(F.filter("_m.his", lambda h: h < F.col("_x")))
    start = F.get("_m.los", at)
    cell = F.when(F.col("_x") >= start, F.struct(F.col("_x").alias("v"), F.lit(1).alias("inside"))).when(
        start.isNotNull(), F.struct(start.alias("v"), F.lit(0).alias("inside")))
    counts = marked.withColumn("_cell", cell).filter("_cell IS NOT NULL").groupBy(*keys, "_cell").agg(F.count("*").alias("_c"), F.first("_m._n").alias("_n"))
    upto = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("_hi", F.sum("_c").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    aggs = []
    for n in names:
        h = F.lit(probs[n]) * (F.col("_n") - 1)
        value_at = lambda rank: F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_cell.v")))
        low, high, frac = value_at(F.floor(h)), value_at(F.ceil(h)), F.max(h - F.floor(h))
        aggs.append((low + (high - low) * frac).alias(n))
    return ranked.groupBy(*keys).agg(*aggs)


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a fresh local one only where none is set and Spark runs in one process."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-ckpt-")
    return _LOCAL_FOLDERS[sc.applicationId]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that an iteration survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
