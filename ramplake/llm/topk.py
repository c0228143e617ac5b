"""Exact top-k inner products over norm-sorted blocks.

Candidates are sorted by descending length and cut into blocks. A first pass takes each query through the block of the
longest vectors; its k-th best score there divided by its length is the least length that any other candidate must have
(Cauchy-Schwarz), so queries sorted by that length meet a prefix of the blocks only. Inside a pair of blocks vectors are
in the basis of the singular vectors, which puts most of the length into the first coordinates: the partial sum over
those plus the product of the residual lengths bounds the score, and only what the bound leaves is multiplied out, in
integers. Ties and rounding are on the safe side of the bound, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ramplake.llm.common import cut_lineage

SCALE = 256
K, EVERY = 5, 50
BLOCK, QUERY_BLOCK = 2048, 512
LEADING = 16
EXACT = 2.0**52


def quantized(vectors: DataFrame, *, vec: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """Columns vec_id and v (floor(scale * component) as array<double>, whole numbers) of the vectors that take part."""
    x = F.transform(F.col(vec), lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vec).isNotNull() & F.col(key).isNotNull())
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.when(usable, F.transform(x, lambda c: F.floor(c * scale).cast("double"))).alias("v")).filter("v IS NOT NULL")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    out = np.zeros((len(column), width))
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    if len(lengths) and (lengths == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width).astype(float)
    for row, (a, b) in enumerate(zip(ends, ends[1:])):
        out[row, : b - a] = flat[a:b]
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, by the sum of outer products (width x width) of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column(0), width)
            top = np.abs(m).max(initial=1.0)
            total += (m / top).T @ (m / top)
        for k in range(width):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([total[k].tolist()])], ["row", "sums"])

    parts = vectors.select("v").mapInArrow(run, "row int, sums array<double>").select("row", F.posexplode("sums").alias("col", "x"))
    gram = np.zeros((width, width))
    for r in parts.groupBy("row", "col").agg(F.sum("x").alias("x")).collect():
        gram[r["row"], r["col"]] = r["x"]
    return np.linalg.eigh(gram)[1][:, ::-1]


def packed(vectors: DataFrame, width: int, order: list, block: int) -> DataFrame:
    """One row for each block of up to `block` vectors in the given order: columns block (in that order), ids, v, floors,
    top (largest norm), need (smallest of column need)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, rows, floors, need = np.empty(0, np.int64), np.empty((0, width)), np.empty(0), np.empty(0)

        def out(n: int) -> pa.RecordBatch:
            v = np.ascontiguousarray(rows[:n])
            return pa.record_batch(
                [pa.array([part << 32 | made]), pa.array([ids[:n].tobytes()]), pa.array([v.tobytes()]), pa.array([floors[:n].tobytes()]), pa.array([float(norms(v).max())]), pa.array([float(need[:n].min())])],
                ["block", "ids", "v", "floors", "top", "need"])

        for batch in batches:
            ids, rows = np.append(ids, batch.column(0).to_numpy()), np.vstack([rows, matrix(batch.column(1), width)])
            floors, need = np.append(floors, batch.column(2).to_numpy()), np.append(need, batch.column(3).to_numpy())
            while len(ids) >= block:
                yield out(block)
                ids, rows, floors, need, made = ids[block:], rows[block:], floors[block:], need[block:], made + 1
        if len(ids):
            yield out(len(ids))

    ranged = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("vec_id", "v", "floor", "need").mapInArrow(run, "block long, ids binary, v binary, floors binary, top double, need double")


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, basis: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k best candidates of one block for each query (rows of q, places in c, scores); none below the query's floor."""
    lead = min(LEADING, q.shape[1])
    qr, cr = q @ basis, c @ basis
    rest_q, rest_c = np.sqrt((qr[:, lead:] ** 2).sum(1)), np.sqrt((cr[:, lead:] ** 2).sum(1))
    length_q = norms(q)
    slack = 1e-9 * (1 + length_q) * (1 + norms(c).max())
    bound = qr[:, :lead] @ cr[:, :lead].T + np.outer(rest_q, rest_c) + slack[:, None]
    whole = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < EXACT
    own = q_ids[:, None] == c_ids[None, :]
    bound[own] = -np.inf
    # the k best bounds, multiplied out, raise the floor; then all that may still reach it
    n = min(k, len(c))
    rows, places, scores = [], [], []
    first = np.argpartition(-bound, n - 1, axis=1)[:, :n]
    for i in range(len(q)):
        score = exact(q[i], c[first[i]], whole)
        score = score[~own[i, first[i]]]
        low = floor[i] if len(score) < k else max(floor[i], float(min(score)))
        at = np.flatnonzero((bound[i] >= low) & ~own[i])
        if not len(at):
            continue
        score = exact(q[i], c[at], whole)
        order = sorted(range(len(at)), key=lambda j: (-score[j], c_ids[at[j]])) if not whole else np.lexsort((c_ids[at], -score))
        for j in order[:k]:
            if score[j] >= floor[i]:
                rows.append(i)
                places.append(at[j])
                scores.append(int(score[j]))
    return np.array(rows, np.int64), np.array(places, np.int64), np.array(scores, object)


def exact(x: np.ndarray, rows: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products of whole numbers: doubles hold them while they are below 2^52, else Python's integers do."""
    if whole:
        return (rows @ x).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, row)) for row in rows], object)


def kth_scores(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[float]:
    """Each query's k-th best score in one block, -inf if the block has fewer others."""
    whole = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < EXACT
    out = []
    for i in range(len(q)):
        score = exact(q[i], c[c_ids != q_ids[i]], whole)
        out.append(float(np.sort(score)[-k]) if len(score) >= k else -np.inf)
    return out


def search(vectors: DataFrame, *, vec: str = "embedding", key: str = "vec_id", k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """Columns query_id, rank, vec_id and score: each query's k candidates of highest inner product, ties to the smaller id.

    Queries are the ids divisible by `every`; candidates all rows with another id. Vectors that are null or hold a null,
    NaN or infinite component take no part, nor do rows without id. Shorter vectors count as filled with zeros. Repeated
    rows are candidates of their own; a repeated query asks once, with the vector that sorts first. An empty table gives
    no rows; a score beyond 64 bits is an error. Queries against candidates are a stated set against all rows, in blocks
    of fixed size.
    """
    table = cut_lineage(quantized(vectors, vec=vec, key=key, scale=scale))
    width = max(1, table.agg(F.max(F.size("v"))).first()[0] or 0)
    basis = rotation(table, width)
    nowhere = F.lit(float("-inf"))
    measured = table.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))
    ranked = measured.select("vec_id", "v", nowhere.alias("floor"), F.col("norm").alias("need"))
    candidates = cut_lineage(packed(ranked, width, [F.desc("need"), F.col("vec_id")], block))
    longest = candidates.orderBy(F.desc("top"), "block").select("ids", "v").limit(1).collect()
    seed = vectors.sparkSession.sparkContext.broadcast([(bytes(r["ids"]), bytes(r["v"])) for r in longest])  # one block at most

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c_ids, c = (np.frombuffer(x, t) for x, t in zip(seed.value[0], (np.int64, float)))
                q = matrix(batch.column(1), width)
                low = np.array(kth_scores(batch.column(0).to_numpy(), q, c_ids, c.reshape(-1, width), k))
                length = norms(q)
                # a candidate shorter than this cannot reach the floor; the margin is for rounding
                need = np.where((low > 0) & (length > 0), low / np.maximum(length, 1e-300) * (1 - 1e-9), -np.inf)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(low), pa.array(need)], ["vec_id", "v", "floor", "need"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q, low, ids, v = (np.frombuffer(batch.column(n)[row].as_buffer(), t) for n, t in enumerate((np.int64, float, float, np.int64, float)))
                rows, places, scores = best(q_ids, q.reshape(-1, width), ids, v.reshape(-1, width), basis, k, low)
                yield pa.record_batch([pa.array(q_ids[rows]), pa.array(ids[places]), pa.array(scores.tolist(), pa.int64())], ["query_id", "vec_id", "score"])

    asks = table.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asks = asks.mapInArrow(floors, "vec_id long, v array<double>, floor double, need double")
    queries = cut_lineage(packed(asks, width, [F.col("need"), F.col("vec_id")], QUERY_BLOCK))
    # blocks of candidates are numbered by their largest length; a query block meets those before its least need
    marks = candidates.select(F.lit(0).alias("kind"), "block", F.col("top").alias("length")).union(queries.select(F.lit(1), "block", "need"))
    counted = marks.withColumn("before", F.sum(1 - F.col("kind")).over(W.orderBy(F.desc("length"), "kind", "block").rowsBetween(W.unboundedPreceding, 0)))
    numbered = candidates.join(counted.filter("kind = 0").select("block", F.col("before").alias("number")), "block")
    meets = queries.join(counted.filter("kind = 1 AND before > 0").select("block", "before"), "block")
    meets = meets.select(F.col("ids").alias("q_ids"), F.col("v").alias("q"), "floors", F.explode(F.sequence(F.lit(1).cast("long"), "before")).alias("number"))
    pairs = meets.join(numbered.select("number", "ids", "v"), "number")
    found = pairs.select("q_ids", "q", "floors", "ids", "v").mapInArrow(searched, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
