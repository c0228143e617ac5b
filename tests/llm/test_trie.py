"""The conversation trie against a walk over all prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ramplake.llm import trie


def nodes_by_walk(sequences):
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = Counter(node[:-1] for node in members if node)
    out = Counter()
    for node, convs in members.items():
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in below[node] if u)
        ended = ",".join(map(str, sorted(c for c in convs if len(sequences[c]) == len(node))))
        out[
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node],
            sum(u not in children for u in below[node]), saved, hashlib.sha256(ended.encode()).hexdigest()] += 1
    return out


def rebuilt_by_hand(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in told.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    return {c: turns.get(c - c % 100, [])[: heads[c]] + s[heads[c] :] for c, s in turns.items()}


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, conv string, chunk int, a long").repartition(4)


def some_rows():
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 240), 7_000_000_100, 7_000_000_101]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice("ab") * rng.randrange(1, 3)))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 380) for t in range(7)]  # many equal conversations
    rows += [(None, 1, "user", "of no conversation"), (41, None, None, None), (41, 0, None, "first"), (42, 0, "user", ""), (43, 1, "", None)]
    return rows


def test_trie_equals_walk(spark, monkeypatch):
    monkeypatch.setattr(trie, "BUCKET", 7)  # lists of ends in many parts
    rows = some_rows()
    got = Counter(map(tuple, trie.rebuilt_trie(table(spark, rows)).collect()))
    assert got == nodes_by_walk(rebuilt_by_hand(rows))


def test_trie_without_rebuilding(spark):
    rows = [r for r in some_rows() if r[0] is not None]
    turns = trie.numbered(table(spark, rows))
    told = defaultdict(list)
    for c, turn, role, text in rows:
        told[c].append((turn is not None, turn or 0, role or "", text or ""))
    got = Counter(map(tuple, trie.prefix_trie(turns, turns.select("conv").distinct()).collect()))
    assert got == nodes_by_walk({c: [(r, t) for _, _, r, t in sorted(v)] for c, v in told.items()})


def test_hot_conversation_is_cut(spark):
    """A conversation of most of all turns spreads over range partitions; its numbers run through."""
    rows = spark.range(20_000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        found = trie.cut_lineage(trie.numbered(rows.union(rows.limit(10).withColumn("conv_id", F.lit(8)))))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.filter("conv = 7").select("chunk").distinct().count() > 1
    assert [r.number for r in found.filter("conv = 7").orderBy("number").collect()] == list(range(1, 20_001))


def test_repeated_turns_and_no_turns(spark):
    """Repeated rows are turns of their own; a conversation whose turns all fall away, and one without a first of its hundred, end at the root."""
    rows = [(c, 0, "user", "only") for c in (401, 402, 403, 404, 405, 406)] + [(500, 0, "user", "twice")] * 2
    got = Counter(map(tuple, trie.rebuilt_trie(table(spark, rows)).collect()))
    assert got == nodes_by_walk(rebuilt_by_hand(rows))


def test_empty(spark):
    assert trie.rebuilt_trie(table(spark, some_rows()[:1]).filter("false")).collect() == []
