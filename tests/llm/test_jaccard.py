"""The near-dedup of the pipeline against all pairs by brute force."""

import random

import corpus_pipeline
import numpy as np
from conftest import prose
from pyspark.sql import functions as F
from ramplake.llm import jaccard, simhash


def items(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def kept_by_brute_force(rows):
    sets, root = [items(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, (doc, _) in enumerate(rows):
        key = (doc is None, doc or 0)  # a row without id stays only where its group has no other
        first[find(i)] = min(first.get(find(i), key), key)
    return sorted(first.values())


def edited_rows():
    rng, rows = random.Random(4), []
    for group in range(14):
        base = prose(rng, rng.choice([30, 100, 300, 1000])).split()
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 40)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            rows.append(" ".join(words))
    rows += [prose(rng, 5) + " " + "the common line that is in all of these texts here " * 2 + prose(rng, 30) for _ in range(20)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate([*rows, "", None, "one two", "one two three"])]


def test_every_pair_at_the_threshold_is_found(spark):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((False, r["doc_id"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == kept_by_brute_force(rows)
    assert len(got) < len(rows) - 40


def test_common_shingles_come_last(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((False, r["doc_id"]) for r in jaccard.keep_first(docs).collect()) == kept_by_brute_force(rows)


def test_parities_are_a_lower_bound():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.choice([0, 3, 60, 2000])
        a, b = ({rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)} for _ in range(2))
        b = set(list(a)[: n * rng.randrange(5) // 4]) | set(list(b)[: rng.randrange(n + 1)])
        x, y = (jaccard.parities(np.array(sorted(s), np.int64)) for s in (a, b))
        differ = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
        assert differ <= len(a ^ b) and (differ - len(a ^ b)) % 2 == 0 and len(x) * 64 == jaccard.PARITIES


def test_chains_of_links_end_at_their_roots(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(40, 200)]
    got = {r["key"]: r["root"] for r in jaccard.rooted(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {b: 100 if 100 < b < 130 else 0 for _, b in links}


def copied_rows():
    """Long texts with copies of a word or two changed, so that fingerprints are equal or near, and unlike texts."""
    rng, rows = random.Random(9), []
    for _ in range(6):
        base = prose(rng, 1500).split()
        for k in range(12):
            words = list(base)
            for _ in range(k % 3):
                words[rng.randrange(len(words))] = "changed"
            rows.append(" ".join(words))
    rows += [prose(rng, 40) for _ in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def grouped(nodes, pairs):
    root = {x: x for x in nodes}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = {x: low if r == high else r for x, r in root.items()}
    return root


def test_pairs_of_the_index_connect_what_two_bits_do(spark):
    docs = spark.createDataFrame(copied_rows(), "doc_id long, text string").repartition(3)
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    sets = jaccard.prefixes(rows).dropDuplicates(["key"]).cache()
    prints = {r["key"]: r["fp"] for r in sets.collect()}
    found = [tuple(r) for r in jaccard.indexed_pairs(sets).collect()]
    near = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2]
    assert any(prints[a] == prints[b] for a, b in near) and any(prints[a] != prints[b] for a, b in near)
    assert grouped(prints, found) == grouped(prints, near)


def test_near_dedup_goes_through_the_index(spark, monkeypatch):
    rows, asked, compared = copied_rows(), [], []
    links, verified = simhash.near_links, jaccard.verified

    def spied(pairs, *rest):
        compared.append({tuple(r) for r in pairs.collect()})
        return verified(pairs, *rest)

    def found(distinct, *rest):
        asked.append(distinct.count())
        return links(distinct, *rest)

    monkeypatch.setattr(simhash, "near_links", found)
    monkeypatch.setattr(jaccard, "verified", spied)
    # without hubs only matches of the index are compared first
    monkeypatch.setattr(jaccard, "prefix_length", lambda n: F.lit(1 << 20) if not compared else F.least(n, F.floor(n / 5) + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((False, r["doc_id"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == kept_by_brute_force(rows)
    assert asked == [len({simhash.fingerprint(t) for _, t in rows})]
    assert len(compared) == 2 and len(compared[0]) > 6
