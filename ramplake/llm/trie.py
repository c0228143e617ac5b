"""A trie of conversations, built from whole sequences.

Identical conversations are collapsed first: one sequence with a weight and the list of its ends. Sequences that are
proper prefixes of others are dropped by an anti-join, what stays are the leaves. Every prefix of every distinct sequence
is then a row (its digest, the sequence's weight, the text before it and after it), and one aggregation by digest makes the
nodes.

Everything is rows and sums, no conversation and no group is an array. A prefix is known by the exclusive or of digests of
its (place, role, text), 128 bits; such digests of parts of a conversation combine, so a conversation that holds a third
of all turns is cut into ranges that are scanned apart and carried over. What a subtree saves is a difference of two sums
along sequences: over a node's members, of all text below it (each copy counted), less the same with each node below
counted once, at the least leaf through it. So no node is copied to its ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ramplake.llm.common import cut_lineage
from ramplake.llm.sqltext import BYTES, crc32_sql

#: A rebuilt conversation begins with the turns of the first of its hundred.
GROUP, MOST = 100, 5
#: Conversation ids a list of ends is joined by, a row each.
BUCKET = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def scanned(rows: DataFrame, order: list[str], *, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """Replaces columns by their running sums or exclusive ors within conv. Rows are scanned within (conv, chunk), where
    chunks are ranges of the order, and each chunk's total is carried to those behind it."""
    folds = {**{c: F.sum for c in sums}, **{c: F.bit_xor for c in xors}}
    local = W.partitionBy("conv", "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "chunk").agg(*(fold(c).alias(c) for c, fold in folds.items()))
    carried = totals.select("conv", "chunk", *(F.coalesce(fold(c).over(before), F.lit(0)).alias(f"{c}_before") for c, fold in folds.items()))
    joined = rows.withColumns({c: fold(c).over(local) for c, fold in folds.items()}).join(carried, ["conv", "chunk"])
    whole = {c: F.col(c) + F.col(f"{c}_before") if c in sums else F.col(c).bitwiseXOR(F.col(f"{c}_before")) for c in folds}
    return joined.withColumns(whole).drop(*(f"{c}_before" for c in folds))


def numbered(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns conv, chunk, number (of the turn, from 1), a and b (digests of role and text) and size (code points).

    Turns are in ascending order, null first, equal ones by digest. Null roles and texts are empty. Rows without a
    conversation are no turns of any. Repeated rows are turns of their own.
    """
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = turns.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.xxhash64(*said).alias("a"),
        F.xxhash64(F.lit(1), *said).alias("b"), F.length(said[1]).cast("long").alias("size"), F.lit(1).cast("long").alias("number"))
    order = ["turn", "a", "b"]
    rows = cut_lineage(rows.filter("conv IS NOT NULL").repartitionByRange("conv", *order).withColumn("chunk", F.spark_partition_id()))
    return scanned(rows, order, sums=("number",)).select("conv", "chunk", "number", "a", "b", "size")


def own_start(conv: str = "conv") -> Column:
    """How many of its first turns a conversation leaves out."""
    return (F.crc32(F.col(conv).cast("string")) % (MOST + 1)).cast("long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Numbered turns of every conversation with its first h turns replaced by those of the first conversation of its
    hundred: all there are if fewer, none if it is absent. Columns as numbered(), number being the new place."""
    convs = turns.select("conv").distinct().select("conv", own_start().alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    first = turns.filter((F.col("conv") % GROUP == 0) & (F.col("number") <= MOST)).select(F.col("conv").alias("base"), "number", "a", "b", "size")
    heads = cut_lineage(convs.join(first, "base").filter("number <= h").select("conv", F.lit(-1).alias("chunk"), "number", "a", "b", "size"))
    taken = heads.groupBy("conv").agg(F.count("*").alias("taken"))
    own = turns.filter(F.col("number") > own_start()).join(taken, "conv", "left")
    own = own.select("conv", "chunk", (F.col("number") - own_start() + F.coalesce("taken", F.lit(0))).alias("number"), "a", "b", "size")
    return heads.unionByName(own)


def ends(whole: DataFrame) -> DataFrame:
    """Columns p, q and ends_sha256 of the ascending conversation ids of each sequence (p, q), joined by commas. Ids are
    joined within ranges of ids first; the digest takes one such range after the other."""
    by_range = F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",")  # BUCKET ids at most
    listed = whole.groupBy("p", "q", F.floor(F.col("conv") / BUCKET).alias("bucket")).agg(by_range.alias("ids"))
    listed = listed.repartition("p", "q").sortWithinPartitions("p", "q", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = None
        for batch in batches:
            done = []
            for p, q, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if (p, q) != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (p, q), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield record(done)
        if key is not None:
            yield record([(*key, digest.hexdigest())])

    def record(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)], ["p", "q", "ends_sha256"])

    return listed.mapInArrow(run, "p long, q long, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations `convs` (column conv) with the turns `rows` (as numbered()).

    Columns conv_id (the smallest member), depth (the node's text is this turn of that conversation; 0 is the root),
    parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes of the subtree), saved_tokens (code points
    of last texts, times members less one, summed over the subtree) and ends_sha256 (of the ids of the conversations that end here).
    A conversation without turns is a member of the root alone. Without conversations there are no nodes.
    """
    keyed = rows.select(
        "conv", "chunk", F.col("number").alias("depth"), "size", F.xxhash64("number", "a", "b").alias("own_p"), F.xxhash64("b", "a", "number").alias("own_q"))
    every = keyed.select("*", F.col("size").alias("upto"), F.col("own_p").alias("p"), F.col("own_q").alias("q"))
    every = scanned(every, ["depth"], sums=("upto",), xors=("p", "q"))
    prefixes = cut_lineage(every.select(
        "conv", "depth", "size", "p", "q", F.col("p").bitwiseXOR(F.col("own_p")).alias("parent_p"), F.col("q").bitwiseXOR(F.col("own_q")).alias("parent_q"),
        (F.col("upto") - F.col("size")).alias("before"), "own_p", "own_q"))

    none = [F.lit(0).cast("long").alias(c) for c in ("own_p", "own_q", "size", "turns")]
    parts = prefixes.select("conv", "own_p", "own_q", "size", F.lit(1).cast("long").alias("turns")).union(convs.select("conv", *none))
    whole = cut_lineage(parts.groupBy("conv").agg(F.bit_xor("own_p").alias("p"), F.bit_xor("own_q").alias("q"), F.sum("size").alias("total"), F.sum("turns").alias("turns")))

    # whole sequences collapse: one member, the smallest, stands for all
    sequences = cut_lineage(whole.groupBy("p", "q").agg(F.count("*").alias("weight"), F.min("conv").alias("conv"), F.first("total").alias("total"), F.first("turns").alias("turns")))
    path = ["conv", "depth", "size", "p", "q", "parent_p", "parent_q", "before"]
    zero, missing = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = [F.col("conv"), *(zero.alias(c) for c in path[1:5]), *(missing.alias(c) for c in path[5:7]), zero.alias("before")]
    weights = ["weight", "total", "turns"]
    paths = prefixes.select(*path).join(sequences.select("conv", *weights), "conv").select(*path, *weights).union(sequences.select(*root, *weights))
    proper = paths.filter("depth < turns").select("p", "q").distinct()
    leaves = sequences.join(proper, ["p", "q"], "left_anti").select("conv", F.lit(True).alias("leaf"))
    paths = cut_lineage(paths.join(leaves, "conv", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False))))

    below = F.col("total") - F.col("before")
    nodes = cut_lineage(paths.groupBy("p", "q").agg(
        F.min("conv").alias("conv_id"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.first("parent_p").alias("parent_p"), F.first("parent_q").alias("parent_q"),
        F.sum("weight").alias("n_convs"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.min(F.when(F.col("leaf"), F.col("conv"))).alias("owner"),
        F.sum(F.col("weight") * below).alias("copied")))
    # the nodes whose least leaf is a sequence's end are the last of its path
    owned = nodes.groupBy(F.col("owner").alias("conv")).agg(F.min("depth").alias("since"), F.sum("size").alias("owned"))
    once = paths.filter("leaf").join(owned, "conv").groupBy("p", "q").agg(F.sum(F.when(F.col("depth") >= F.col("since"), below).otherwise(F.col("owned"))).alias("once"))
    children = nodes.filter("depth > 0").groupBy(F.col("parent_p").alias("p"), F.col("parent_q").alias("q")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("p").alias("parent_p"), F.col("q").alias("parent_q"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(once, ["p", "q"]).join(children, ["p", "q"], "left").join(ends(whole), ["p", "q"], "left").join(parents, ["parent_p", "parent_q"], "left")
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("copied") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (rebuilt()) of a table with columns conv_id, turn, role and text; see
    numbered() for null and repeated rows, prefix_trie() for the columns. An empty table gives no nodes."""
    turns = cut_lineage(numbered(conversations))
    return prefix_trie(rebuilt(turns), turns.select("conv").distinct())


ORACLE = f"""
WITH {BYTES},
told AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
shared AS (SELECT c, turns, {crc32_sql('c::VARCHAR')} % {MOST + 1} AS h FROM told, bytes),
rebuilt AS (
  SELECT o.c, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(o.turns, h + 1, len(o.turns))) AS s
  FROM shared o LEFT JOIN told b ON b.c = o.c - o.c % {GROUP}),
prefixes AS (SELECT c, len(s) AS n, unnest(list_transform(range(len(s) + 1), lambda d: {{'d': d, 's': list_slice(s, 1, d)}}), recursive := false) AS x FROM rebuilt),
flat AS (SELECT c, n, x.d AS d, x.s AS s FROM prefixes),
nodes AS (
  SELECT s, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ended,
    (count(*) - 1) * CASE WHEN d > 0 THEN length(s[d].t) ELSE 0 END AS saved FROM flat GROUP BY s, d),
related AS (SELECT u.s, u.d, u.saved, unnest(list_transform(range(u.d + 1), lambda k: {{'s': list_slice(u.s, 1, k)}}), recursive := false) AS up FROM nodes u),
parents AS (SELECT DISTINCT list_slice(s, 1, d - 1) AS s FROM nodes WHERE d > 0),
subtrees AS (
  SELECT r.up.s AS s, sum(r.saved) AS saved, count(*) FILTER (WHERE p.s IS NULL) AS n_leaves, count(*) FILTER (WHERE r.d = len(r.up.s) + 1) AS n_children
  FROM related r LEFT JOIN parents p ON p.s = r.s GROUP BY r.up.s)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, t.n_children, t.n_leaves, t.saved::BIGINT AS saved_tokens, sha256(n.ended) AS ends_sha256
FROM nodes n JOIN subtrees t ON t.s = n.s LEFT JOIN nodes p ON n.d > 0 AND p.s = list_slice(n.s, 1, n.d - 1)
"""
