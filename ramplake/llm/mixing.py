"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target of words by water-filling: the share of the whole is dealt by weight, a source stops at
`limit` times its size, and what it leaves is dealt to the others. A source's weight over training time is a
piecewise linear schedule; its integral, scaled to the target, is the source's cumulative token demand. Documents
of a source stand in digest order, pass after pass, until the target is met; a document whose first word is the
C-th of its source is trained at the time at which the cumulative demand reaches C, so inverting that function gives
its position. Sorting by range of position gives the order of training.

No source is ever in one task: running sums are made of digest buckets (4,096 a source) and of documents in a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ramplake.llm.common import whole_row, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0
#: Knots (time, weight) of the schedules that sources take in turn: fading, steady, growing.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
BUCKET_DIGITS = 3


def demand_time(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of a schedule reaches `share` (0 to 1) of the whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    if min(areas, default=0.0) <= 0 or knots[0][0] != 0 or knots[-1][0] != 1 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule needs knots from time 0 to 1 with weights above 0 between them")
    total, done, out = sum(areas), 0.0, None
    steps = []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        rest = share * F.lit(total) - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * F.lit(2 * (w1 - w0) / (t1 - t0)), F.lit(0.0)))
        steps.append((done + area, F.when(rest <= 0, F.lit(t0)).otherwise(F.lit(t0) + rest * 2 / (F.lit(w0) + root))))
        done += area
    out = steps[-1][1]
    for end, value in reversed(steps[:-1]):
        out = F.when(share * F.lit(total) < end, value).otherwise(out)
    return F.least(out, F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple, share: float, limit: float) -> DataFrame:
    """Target and place of every source of `sizes` (source, source_size): one row a source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    named = named.select("*", weight.alias("weight"), (F.col("source_size") * limit).alias("cap"))
    # sources meet their caps in the order of cap to weight; the level is that of the first that doesn't
    order = W.orderBy(F.col("cap") / F.col("weight"), "place")
    left = F.lit(share) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = named.withColumn("level", left / F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    open_level = F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(-(F.col("cap") / F.col("weight")), -F.col("place"), F.col("level").alias("level")))).over(W.partitionBy())
    level = level.withColumn("open", open_level["level"])
    return level.select("source", "source_size", "place", F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("open") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, *, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, schedules: tuple = SCHEDULES, text: str = "text", size: Column | None = None) -> DataFrame:
    """Columns doc (a struct of all columns of `docs`), size, source_size, target, taken and positions.

    size: words of the text (null or empty: 0), or the column given. taken: words that the mix takes of the document,
    a multiple of its size; a source's sum is within half a document of its target. positions: training times of its
    copies, in [0, 1), empty if none is taken. A null source is a source of its own and the last one; documents without
    words are never taken; repeated rows are documents of their own. An empty table gives an empty one. The same rows
    give the same mix, however they are partitioned.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    tie = F.xxhash64(text) if text in docs.columns else F.lit(0)
    rows = docs.select(
        whole_row(docs).alias("doc"), F.col("source").alias("source"), (word_count(text) if size is None else size).cast("long").alias("size"),
        digest.alias("digest"), F.substring(digest, 1, BUCKET_DIGITS).alias("bucket"),
        tie.alias("tie"))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, limit)
    before = F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), before.alias("before"))
    buckets = buckets.join(targets, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    joined = rows.join(buckets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    inside = W.partitionBy("source", "bucket").orderBy("digest", "doc.doc_id", "size", "tie")
    start = F.col("before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    placed = joined.withColumn("start", start)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.withColumn("whole", whole)
    more = (F.col("start") * 2 + F.col("size")) <= 2 * (F.col("target") - F.col("whole") * F.col("source_size"))
    copies = F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(F.lit(0))
    placed = placed.withColumn("copies", copies)

    def at(copy: Column) -> Column:
        reached = (copy * F.col("source_size") + F.col("start")) / F.col("target")
        out = demand_time(reached, schedules[-1])
        for k, knots in enumerate(schedules[:-1]):
            out = F.when(F.col("place") % len(schedules) == k, demand_time(reached, knots)).otherwise(out)
        return out

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))
    return placed.select("doc", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy, range-sorted by position: columns position and doc."""
    copies = mixed.select(F.explode("positions").alias("position"), "doc")
    return copies.repartitionByRange("position", "doc.doc_id").sortWithinPartitions("position", "doc.doc_id")


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM docs GROUP BY source),
capped AS (
  SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
targets AS (
  SELECT source, source_size, place, least(cap, weight * coalesce((SELECT arg_min(level, [cap / weight, place]) FROM levels WHERE level * weight < cap), 1e300)) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, place, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    (sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN size > 0 THEN size * (whole + (2 * start + size <= 2 * (target - whole * source_size))::BIGINT) ELSE 0 END AS taken, start / target AS u FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken = 0 THEN NULL
    WHEN place % 3 = 0 THEN CASE WHEN u <= 0 THEN 0 ELSE u * 2 / (1.5 + sqrt(2.25 - 2 * u)) END
    WHEN place % 3 = 1 THEN u
    WHEN u < 0.3125 THEN CASE WHEN u <= 0 THEN 0 ELSE u * 2 / (0.5 + sqrt(0.25 + u)) END
    ELSE 0.5 + (u - 0.3125) * 2 / (0.75 + sqrt(0.5625 + (u - 0.3125) * 5)) END AS position
FROM taken
"""
