"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ramplake.operators.chunks import cut_lineage, ensure_checkpoint_dir, shared_folder

__all__ = ["by_batch", "connected", "cut_lineage", "ensure_checkpoint_dir", "fresh_folder", "identity", "load", "shared_folder", "slices", "unpacked", "whole_row", "word_count"]

#: Words of a text are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = " \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 21


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def identity(text: str = "text", doc: str = "doc_id") -> Column:
    """A document is its id with its text: repeated rows are one document, rows without id differ by text."""
    return F.struct(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns))


def unpacked(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """The columns of a struct made by whole_row."""
    return df.select(*(F.col(f"{row}.`{c}`").alias(c) for c in columns))


def word_count(text: str = "text") -> Column:
    """Words of a text; a null text has none."""
    flat = F.col(text)
    for space in SPACES[1:]:
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    flat = F.trim(flat)
    gaps = F.length(flat) - F.length(F.regexp_replace(flat, "(?<! ) ", ""))
    return F.when(F.col(text).isNull() | (flat == ""), F.lit(0)).otherwise(gaps + 1).cast("long")


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for functions that need one batch only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about `limit` characters of text (one row at least), null texts as empty ones."""
    at = batch.schema.get_field_index(text)
    start = 0
    while start < batch.num_rows:
        texts, size = [], 0
        while start + len(texts) < batch.num_rows and (not texts or size < limit):
            texts.append(batch.column(at)[start + len(texts)].as_py() or "")
            size += len(texts[-1])
        yield batch.slice(start, len(texts)), texts
        start += len(texts)
    pa.default_memory_pool().release_unused()  # the worker lives on, beside others


def connected(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of `edges` (a, b): columns node, root.

    Every round points each node at the smallest node next to its root and then at that node's own root, so the
    distance a label travels doubles; a checkpoint ends each round.
    """
    links = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    roots = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = (
            links.join(roots.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        )
        step = roots.join(near, "node").select("node", "root", F.least("root", "low").alias("low"))
        # the root of the old root may also take the smaller label
        hooks = step.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        step = step.join(hooks, "node", "left").select("node", "root", F.least("low", F.coalesce("hook", "low")).alias("low"))
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("far"))
        step = cut_lineage(step.join(jump, "low", "left").select("node", "root", F.least("low", F.coalesce("far", "low")).alias("next")))
        done = step.filter("next < root").isEmpty()
        roots = step.select("node", F.col("next").alias("root"))
        if done:
            return roots
