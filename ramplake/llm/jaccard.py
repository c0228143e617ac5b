"""Near-duplicates by a SimHash index and exact Jaccard similarity of word shingles: no pair at the threshold is missed.

A text is the set of hashes of its five-word shingles, and has the fingerprint that simhash gives it. The index of simhash
finds the texts whose fingerprints are equal or within two bits; their sets are compared exactly, and what passes is linked.

Most pairs at the threshold differ by three to eleven bits. Segments of 64 bits that hold so many make buckets that grow
with the table, so the links beyond two bits are found by the sets themselves. Under any one order of all shingles, two
sets of similarity 0.8 or more share one of the first n // 5 + 1 shingles of each (the prefix filter), so sets filed under
those meet in a bucket, without exception. The order puts shingles that a sample of texts finds often last: common
passages make no buckets but for texts that consist of them.

With the matches of the index, each set is first compared with one other: the one that stands first in most of its
buckets. What that links is one component. Then all pairs of a bucket that are still in different components, of sizes,
parities and common prefixes that can reach the threshold, are compared. A large group of near copies is few components by then, so few of its pairs are
formed. The parities of a set are PARITIES bits, each flipped by every hash that falls on it: where two sets' bits differ,
some hash is in one set only, so the bits that differ are a lower bound of the hashes that do, and a pair beyond the
threshold is dropped inside the join, before it is a row. Every comparison is exact, and no bucket is capped; the square
that is left is that of comparing the parities of many unlike sets in one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ramplake.llm import simhash
from ramplake.llm.common import connected, cut_lineage, slices, unpacked, whole_row

#: Similarity of 0.8: 9 x common >= 4 x (size + size), and a prefix of n // 5 + 1.
SHINGLE, SEED = 5, 42
#: One text of so many is in the sample that orders the shingles; at most so many shingles are ordered by it.
SAMPLED, COMMON = 16, 200_000
#: Partners of a text that one task compares with it, and slots of the filter of texts.
PARTNERS, SLOTS = 256, 1 << 20
#: Bits of a set's parities, in words of 64.
PARITIES, WORD_BITS = 256, 64


def shingles(text: str, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes: none without words; a text of fewer words than a shingle is one shingle."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.empty(0, np.int64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(length)))) if len(words) >= length else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64).view(np.int64))


def parities(found: np.ndarray) -> np.ndarray:
    """Whether the number of hashes is odd, for each remainder of PARITIES, as words of 64 bits."""
    odd = np.bincount(found.view(np.uint64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and how many sampled texts have them: those of three at least, the most frequent if too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                yield pa.record_batch([pa.array(np.concatenate([np.empty(0, np.int64), *map(shingles, texts)]))], ["g"])

    sample = rows.filter(F.pmod("h", F.lit(SAMPLED)) == 0).select("text")
    found = sample.mapInArrow(run, "g long").groupBy("g").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "g").limit(COMMON).toPandas().sort_values("g")
    return found["g"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def prefixes(rows: DataFrame) -> DataFrame:
    """Columns doc_id, h, key (a hash of the whole set), n (its size), fp (the text's fingerprint), prefix and parity (words of bits)
    for every row of columns doc_id, h, text."""
    common, often = common_shingles(rows)

    def prefix(found: np.ndarray) -> np.ndarray:
        at = np.searchsorted(common, found)
        at[at == len(common)] = 0
        rank = np.where(common[at] == found, often[at], 0) if len(common) else np.zeros(len(found), np.int64)
        return found[np.argsort(rank, kind="stable")[: len(found) // 5 + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = [shingles(t) for t in texts]
                keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64).view(np.int64)
                sizes = pa.array([len(x) for x in found], pa.int32())
                prints = pa.array(np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64))
                columns = [part.column(0), part.column(1), pa.array(keys), sizes, prints, lists([prefix(x) for x in found]), lists([parities(x) for x in found])]
                yield pa.record_batch(columns, ["doc_id", "h", "key", "n", "fp", "prefix", "parity"])

    return rows.mapInArrow(run, "doc_id long, h long, key long, n int, fp long, prefix array<long>, parity array<long>")


def prefix_length(n: Column) -> Column:
    return F.least(n, F.floor(n / 5) + 1)


def possible(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def near_parities() -> Column:
    """Whether sets with columns n, n_2, p0, p0_2, … can reach the threshold: at it, a ninth of both sizes is in one set only."""
    differ = [F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"p{k}_2"))) for k in range(PARITIES // WORD_BITS)]
    return 9 * sum(differ[1:], differ[0]) <= F.col("n") + F.col("n_2")


def verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets have similarity 0.8 or more. sets: a row (doc_id, h) that has the key.

    Texts come sorted: that of a, then those of its partners, PARTNERS or so at a time. One set is held, none is shuffled.
    """
    pairs = cut_lineage(pairs.distinct())
    parts = F.ceil(F.count("*").over(W.partitionBy("a")) / PARTNERS)
    asked = pairs.select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    asked = asked.select("a", "part", F.col("b").alias("key")).union(asked.select("a", "part", F.col("a").alias("key"))).distinct()
    asked = cut_lineage(asked.join(sets.select("key", "place"), "key").select("a", "part", "key", "place"))
    # most texts are asked for by nobody; this filter has a row for each slot at most
    slots = F.broadcast(asked.select(F.pmod("place.h", F.lit(SLOTS)).alias("slot")).distinct())
    texts = rows.withColumn("slot", F.pmod("h", F.lit(SLOTS))).join(slots, "slot", "left_semi").select(F.struct("doc_id", "h").alias("own"), "text")
    met = texts.join(asked, texts["own"].eqNullSafe(asked["place"])).select("a", "part", "key", "text")
    met = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("key") != F.col("a"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, np.empty(0, np.int64)
        for batch in batches:
            for rest, texts in slices(batch, "text"):
                found = []
                for a, key, text in zip(rest.column(0).to_pylist(), rest.column(2).to_pylist(), texts):
                    if a == key:
                        if hub != a:
                            hub, held = a, shingles(text)
                    else:
                        items = shingles(text)
                        if 9 * len(np.intersect1d(held, items, assume_unique=True)) >= 4 * (len(held) + len(items)):
                            found.append((a, key))
                yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

    return cut_lineage(met.mapInArrow(run, "a long, b long").distinct())


def rooted(links: DataFrame) -> DataFrame:
    """Columns key and root for every b of `links` (a, b): what following b to a, from link to link, ends at. Each b has
    one a, and no way leads back to where it began. Ways double in length from round to round."""
    roots = cut_lineage(links.select(F.col("b").alias("key"), F.col("a").alias("root")))
    while True:
        far = roots.select(F.col("key").alias("root"), F.col("root").alias("far"))
        step = cut_lineage(roots.join(far, "root", "left").select("key", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return roots
        roots = step.select("key", "root")


def indexed_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints the SimHash index matches: of two bits at most between the least keys of two
    fingerprints, and of each other key with the least one of its own fingerprint."""
    least = cut_lineage(sets.groupBy("fp").agg(F.min("key").alias("low")))
    links = simhash.near_links(least.select("fp"))
    ends = [least.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab"]
    near = links.join(ends[0], "a").join(ends[1], "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    return near.union(sets.select("fp", "key").join(least, "fp").filter("key <> low").select("low", "key"))


def near_groups(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Columns key and root: keys with equal roots are those that pairs of similarity 0.8 or more connect; a key without
    a row is its own root."""
    sizes = sets.select("key", "n")
    filed = sets.select("key", F.explode("prefix").alias("g"))
    shared = cut_lineage(filed.withColumn("m", F.count("*").over(W.partitionBy("g"))).filter("m > 1"))
    # the set that meets most others stands first in its buckets; each set is compared with the one it meets so most often.
    # A hub stands before its set in one order of all sets, so links never form a ring
    scores = cut_lineage(shared.groupBy("key").agg(F.sum("m").alias("score")))
    scored = shared.join(scores, "key")
    first = F.first("key").over(W.partitionBy("g").orderBy(F.desc("score"), "key"))
    often = scored.select("key", first.alias("hub")).filter("key <> hub").groupBy("key", "hub").agg(F.count("*").alias("c"))
    best = often.groupBy("key").agg(F.max(F.struct("c", "hub")).alias("best")).select("key", "best.hub", "best.c").join(sizes, "key")
    likely = best.filter(5 * F.col("c") >= 2 * prefix_length(F.col("n"))).select(F.col("hub").alias("a"), F.col("key").alias("b"))
    # matches of the index in the same order; sets that meet nobody in a bucket are below the threshold with all others
    order = [scores.select(F.col("key").alias(c), F.struct((-F.col("score")).alias("score"), "key").alias(f"at_{c}")) for c in "ab"]
    matched = indexed_pairs(sets).join(order[0], "a").join(order[1], "b")
    ends = F.least("at_a", "at_b"), F.greatest("at_a", "at_b")
    links = verified(likely.union(matched.select(ends[0]["key"].alias("a"), ends[1]["key"].alias("b"))), rows, sets)
    roots = rooted(links.groupBy("b").agg(F.min("a").alias("a")))
    # a set may have several matches; those that its one way to a root leaves out count below
    tops = [roots.select(F.col("key").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    others = links.join(tops[0], "a", "left").join(tops[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))

    named = shared.select("g", "key").join(sizes, "key").join(roots, "key", "left").select("g", "key", "n", F.coalesce("root", "key").alias("root"))
    named = cut_lineage(named)
    mixed = named.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("g")
    bits = [F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(PARITIES // WORD_BITS)]
    left = named.join(mixed, "g", "left_semi").join(sets.select("key", *bits), "key")
    other = left.select("g", *(F.col(c).alias(f"{c}_2") for c in left.columns if c != "g"))
    cross = left.join(other, "g").filter((F.col("key") < F.col("key_2")) & (F.col("root") != F.col("root_2")) & possible(F.col("n"), F.col("n_2")) & near_parities())
    met = cross.groupBy("key", "key_2", "n", "n_2", "root", "root_2").agg(F.count("*").alias("c"))
    # of the set whose prefix ends first, only what comes after its prefix can be common besides what the prefixes share
    after = F.greatest(*(F.col(n) - prefix_length(F.col(n)) for n in ("n", "n_2")))
    enough = 9 * (F.col("c") + after) >= 4 * (F.col("n") + F.col("n_2"))
    asked = cut_lineage(met.filter(enough).select(F.col("key").alias("a"), F.col("key_2").alias("b"), "root", "root_2"))
    # what the first links connect is one node by now
    between = asked.join(verified(asked.select("a", "b"), rows, sets), ["a", "b"]).select(F.col("root").alias("a"), F.col("root_2").alias("b"))
    tops = connected(between.union(others.filter("a <> b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = sets.select("key").join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    return every.join(tops, "root", "left").select("key", F.coalesce("top", "root").alias("root"))


def keep_first(docs: DataFrame, *, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row of `docs` of each group that near-duplicate pairs connect, with its columns as they are: that of the smallest
    id, of equal ids that of the smallest text hash. A row without id stays only where its group has no other; of repeated
    rows one stays. Texts without words, null ones too, are one another's copies. An empty table gives an empty one."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    found = prefixes(rows)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    sets = found.groupBy("key").agg(F.min(place).alias("least"), F.first("n").alias("n"), F.min_by("fp", place).alias("fp"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"))
    sets = cut_lineage(sets.select("key", "n", "fp", "prefix", "parity", "least", F.struct("least.doc_id", "least.h").alias("place")))
    first = sets.select("key", "least").join(near_groups(rows, sets), "key").groupBy("root").agg(F.min("least").alias("least"))
    # by one struct of the same type, in which null ids are equal (no hash is null): a sorted join and the choice among
    # repeated rows share one shuffle of the rows
    own = docs.select(whole_row(docs).alias("row"), F.struct(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(text).alias("h")).alias("own"))
    kept = first.select(F.struct("least.doc_id", F.coalesce("least.h", F.lit(0)).alias("h")).alias("kept"))
    left = own.join(kept, F.col("own") == F.col("kept"), "left_semi").dropDuplicates(["own"])
    return unpacked(left, "row", docs.columns)
