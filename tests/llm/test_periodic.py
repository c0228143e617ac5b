"""Periodic runs against a direct search by period."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from ramplake.llm import periodic, plans


def runs_by_period(words, min_words=periodic.MIN_WORDS, min_times=periodic.MIN_TIMES):
    """For each period, the maximal stretches that keep it; a stretch belongs to its smallest period."""
    found = {}
    for q in range(1, len(words) // min_times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(min_words, min_times * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("bounds", [(6, 4), (2, 2), (4, 2), (3, 3)])
def test_runs_equal_brute_force(bounds):
    rng = random.Random(sum(bounds))
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(60))]
            if words and rng.random() < 0.5:
                at = rng.randrange(len(words))
                words = words[:at] + words[at : at + rng.randrange(1, 9)] * rng.randrange(1, 9)
            texts.append(words)
        assert periodic.runs_of(texts, *bounds) == [runs_by_period(w, *bounds) for w in texts]


def test_suffix_ranks_order_all_suffixes():
    rng = random.Random(4)
    for _ in range(50):
        symbols = [rng.randrange(3) for _ in range(rng.randrange(40))] + [3]
        ranks = periodic.suffix_ranks(np.array(symbols))[-1]
        assert np.argsort(ranks).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_one_word_over_and_over():
    assert periodic.runs_of([[b"a"] * 50_000, [], [b"x"] * 5, [b"%d" % (i % 999) for i in range(20_000)]]) == [[(0, 50_000, 1)], [], [], [(0, 20_000, 999)]]


def test_query_columns_equal_brute_force(spark, messy, messy_rows, tmp_path):
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()

    def expected(doc, text):
        words = (text or "").encode().split()
        h = zlib.crc32(("" if doc is None else str(doc)).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = runs_by_period(words) if n < 5_000 else periodic.runs_of([words])[0]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        listing = "".join("%d,%d,%d\n" % r for r in runs)
        return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())

    assert Counter(map(tuple, got)) == Counter(expected(d, t) for d, t, *_ in messy_rows)
    assert any(r["n_runs"] for r in got)


def test_empty_table(empty):
    assert periodic.periodic_runs(empty).collect() == []
