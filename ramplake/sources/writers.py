"""Sinks: month partitions, multi-table bundles, catalogues."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ramplake.operators.chunks import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder the cluster names."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_monthly(df: DataFrame, path: str, time: str) -> None:
    """One folder per month, so that time filters prune files; rows of a month are spread before the write."""
    month = F.date_format(time, "yyyyMM")
    df.withColumn("month", month).repartition("month", F.pmod(F.xxhash64(time), F.lit(16))).write.partitionBy("month").mode("overwrite").parquet(path)


def write_bundle(tables: dict[str, DataFrame], path: str, contract: dict) -> None:
    """Several tables and a one-row contract; the contract comes last and marks the bundle complete."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps({**contract, "tables": {n: d.dtypes for n, d in tables.items()}}, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("contract")).write.mode("overwrite").parquet(f"{path}/contract")


def read_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    contract = json.loads(spark.read.parquet(f"{path}/contract").first()["contract"])
    return {n: spark.read.parquet(f"{path}/{n}") for n in contract["tables"]}, contract


def write_catalog(events: DataFrame, path: str, pairs: DataFrame | None = None, coverage: DataFrame | None = None) -> None:
    """Gzipped CSV; arrays become pipe-joined text."""
    for name, df in {"events": events, "pairs": pairs, "coverage": coverage}.items():
        if df is None:
            continue
        flat = {c: F.array_join(F.col(c).cast("array<string>"), "|") for c, t in df.dtypes if t.startswith("array")}
        df.withColumns(flat).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/{name}")
