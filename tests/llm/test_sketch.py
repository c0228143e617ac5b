"""Scaled sketches against sets of shingles, one shingle at a time."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import prose
from ramplake.llm import plans, sketch

MASK = (1 << 64) - 1


def hash_of(shingle):
    def scrambled(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
        return x ^ x >> 31

    shingle = shingle.ljust(sketch.SHINGLE, b"\0")
    return scrambled(scrambled(int.from_bytes(shingle[:8], "little")) + int.from_bytes(shingle[8:], "little") & MASK)


def shingles(text):
    raw = text.encode()
    return {raw[i : i + sketch.SHINGLE] for i in range(max(1, len(raw) - sketch.SHINGLE + 1))}


def sketch_by_shingle(text):
    kept = {h for h in map(hash_of, shingles(text)) if h * sketch.SCALE < 1 << 64}
    return sorted(kept or {xxhash.xxh64_intdigest(text.encode()) | sketch.WHOLE})


def test_sketches_equal_brute_force(messy_rows):
    texts = [t or "" for _, t, *_ in messy_rows]
    assert [s.tolist() for s in sketch.sketches_of(texts)] == [sketch_by_shingle(t) for t in texts]
    assert sketch.sketches_of([]) == [] and sketch.sketches_of(["a"])[0].tolist() == sketch_by_shingle("a")


def test_query_equals_brute_force(spark, messy, messy_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(sketch, "CHUNK_BYTES", 1 << 14)  # many chunks, so many neighbours lie in different ones
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["op12_scaled_sketch"](spark, str(tmp_path)).collect()
    hashes = {r["t"]: r["h"] for r in messy.select(F.col("text").alias("t"), F.xxhash64("text").alias("h")).collect()}
    rows = sorted(((d is not None, d or 0, hashes[t]), d, t or "") for d, t, *_ in messy_rows)

    def hexed(values):
        return "".join("%016x" % h for h in values)

    def near(a, b):
        return len(set(a) & set(b)) / min(len(a), len(b))

    want = Counter()
    for (_, doc, text), (_, _, following) in zip(rows, rows[1:] + rows[:1]):
        m = len(text) // 4
        edited = text[: len(text) - m] + following[:m]
        own, other, after = map(sketch_by_shingle, (text, edited, following))
        want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(other), near(own, other), near(own, after)] += 1
    assert Counter(map(tuple, got)) == want


def test_one_document_follows_itself(spark, empty):
    one = spark.createDataFrame([(5, "abcdefgh" * 10)], "doc_id long, text string")
    row = sketch.compare_with_next(one).first()
    assert row.near_next == 1.0 and row.edited == sketch.spliced("abcdefgh" * 10, "abcdefgh" * 10)
    assert sketch.compare_with_next(empty).collect() == [] and sketch.sketch_documents(empty).collect() == []


def test_estimates_of_unequal_documents(spark):
    """A document of 200 words in a source of a hundred times its length: the share held is met within a tenth."""
    rng = random.Random(5)
    long = [prose(rng, 200) for _ in range(100)]
    halves = [" ".join([*t.split()[:100], *prose(rng, 100).split()]) for t in long[:20]]
    docs = sketch.sketch_documents(spark.createDataFrame([(i, t, "big") for i, t in enumerate(long)] + [(1000 + i, t, "small") for i, t in enumerate(halves)], "doc_id long, text string, s string"))
    named = docs.withColumn("s", F.when(F.col("doc_id") < 1000, "big").otherwise("small"))
    found = sketch.containment(named.filter("s = 'small'"), sketch.merged(named.filter("s = 'big'"), "s"), "s").collect()
    held = set().union(*map(shingles, long))
    assert len(found) == 20
    exact = {1000 + i: len(shingles(t) & held) / len(shingles(t)) for i, t in enumerate(halves)}
    errors = [r.contained - exact[r.doc_id] for r in found]
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.2


def test_merging_is_the_sketch_of_all(spark, messy, messy_rows):
    named = sketch.sketch_documents(messy).withColumn("s", F.lit("all"))
    got = {r["hash"] & MASK for r in sketch.merged(named, "s").collect()}
    assert got == set().union(*(sketch_by_shingle(t or "") for _, t, *_ in messy_rows))


def test_likeness_of_columns(spark):
    frame = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5])], "a array<long>, b array<long>")
    assert frame.select(sketch.likeness("a", "b")).first()[0] == pytest.approx(2 / 3)
