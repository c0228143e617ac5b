"""The other corpus operators against brute force, on a table with nulls, copies, long texts and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import prose
from ramplake.llm import licenses, linededup, mixing, quality, rules, runindex, simhash, topk
from ramplake.llm.common import connected, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# --- helpers


def test_word_count(spark, messy, messy_rows):
    got = messy.select("doc_id", word_count().alias("n")).collect()
    assert Counter((r["doc_id"], r["n"]) for r in got) == Counter((d, len(words(t))) for d, t, *_ in messy_rows)


def test_connected_matches_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(70)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# --- SimHash


def print_of(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams)) if grams else 0


def components(prints, distance=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark, messy, messy_rows, empty):
    got = simhash.near_duplicates(messy).select("doc_id", simhash.hexadecimal().alias("fp"), "component_id").collect()
    prints = [print_of(r[1]) for r in messy_rows]
    lowest = {}
    names = components(prints)
    for name, (doc, *_) in zip(names, messy_rows):
        lowest[name] = min((x for x in (lowest.get(name), doc) if x is not None), default=None)
    want = Counter((r[0], f"{p:016x}", lowest[n]) for r, p, n in zip(messy_rows, prints, names))
    assert Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_near_links_reach_every_pair_in_two_bits(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints = set(base) | {(1 << 64) - 1, 0, 1 << 63}
    for x in list(prints):
        for _ in range(12):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            prints.add(x ^ sum(1 << int(b) for b in bits))
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    roots = connected(simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")))
    got = defaultdict(set)
    for r in roots.collect():
        got[r["root"]].add(r["node"])
    want = defaultdict(set)
    for x, n in zip(signed, components(prints)):
        want[n].add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(w) for w in want.values() if len(w) > 1)


def test_keep_first(spark, messy, messy_rows, empty):
    prints = [print_of(r[1]) for r in messy_rows]
    first = {}
    for n, r in zip(components(prints), messy_rows):
        first[n] = min(first.get(n, (True, 1 << 62)), (r[0] is None, r[0] or 0))
    got = simhash.keep_first(messy)
    assert got.columns == messy.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == sorted(first.values())
    assert simhash.keep_first(empty).count() == 0


# --- lines


def lines_by_brute_force(rows, span=3):
    distinct = {(d, t) for d, t, *_ in rows if t is not None}
    order = sorted(distinct, key=lambda k: (k[0] is not None, k[0] or 0))
    seen, cut = set(), defaultdict(set)
    places = []
    for doc in order:
        numbered = [(i, x) for i, x in enumerate(doc[1].split("\n")) if x.strip(" ")]
        for n in range(1, span + 1):
            for s in range(len(numbered) - n + 1):
                run = tuple(x for _, x in numbered[s : s + n])
                if n == span or len(re.findall(r"[^ \t-\r]+", "\n".join(run))) > 50:
                    places.append((doc, [i for i, _ in numbered[s : s + n]], run))
    for doc, numbers, run in places:
        if run in seen:
            cut[doc].update(numbers)
        seen.add(run)
    return {doc: "\n".join(x for i, x in enumerate(doc[1].split("\n")) if i not in cut[doc]) for doc in distinct}, cut


def test_line_dedup(spark, messy, messy_rows, empty):
    want, cut = lines_by_brute_force(messy_rows)
    assert sum(map(len, cut.values())) > 50
    got = linededup.dedup_lines(messy).select("row.doc_id", "row.text", "row.position", "n_lines", "n_removed", "cleaned").collect()
    assert len(got) == len(messy_rows)
    for r in got:
        key = (r["doc_id"], r["text"])
        assert r["position"] == 3
        assert r["cleaned"] == (None if r["text"] is None else want[key])
        assert r["n_removed"] == len(cut[key]) and r["n_lines"] == (0 if r["text"] is None else r["text"].count("\n") + 1)
    assert linededup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("gram, window", [(1, 1), (2, 4), (3, 2)])
def test_line_dedup_other_lengths(spark, messy, messy_rows, gram, window):
    want, _ = lines_by_brute_force(messy_rows, gram + window - 1)
    for r in linededup.dedup_lines(messy, gram=gram, window=window).select("row.doc_id", "row.text", "cleaned").filter("text IS NOT NULL").collect():
        assert r["cleaned"] == want[(r["doc_id"], r["text"])]


def test_long_passages_of_one_or_two_lines_go(spark):
    rng = random.Random(8)
    one, first, second, short = prose(rng, 51), prose(rng, 30), prose(rng, 21), prose(rng, 50)
    texts = [f"start\n{one}\nend", f"{first}\n\n{second}", one, f"{short}\nother {short}", f"{first}\t\n{second}", f"new\n{first}\n{second}\nnext", f"{short}\nagain {first}", f"{one}\n{one}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: r[1] for r in linededup.dedup_lines(docs).select("row.doc_id", "cleaned").collect()}
    # the fifth has another first line, and a common line of fifty words isn't long enough
    assert [got[k] for k in range(8)] == [*texts[:2], "", *texts[3:5], "new\nnext", texts[6], ""]
    assert {d: x for (d, _), x in lines_by_brute_force(list(enumerate(texts)))[0].items()} == got


def test_line_dedup_stays_in_the_engine(spark, messy):
    plan = linededup.dedup_lines(messy)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# --- rules


def stats_by_brute_force(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")) if w else 0, twice, len(inside)


def test_text_stats(messy_rows):
    for _, text, *_ in [*messy_rows, (0, "a b c a b c d"), (0, "a a a a"), (0, "# # #\n\n x\n x"), (0, "\x1c a\x85b")]:
        assert rules.text_stats(text or "")[:5] == stats_by_brute_force(text)


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, Fraction(1, 10)), (50, 3, Fraction(1, 7)), (200, 9, Fraction(1, 25)), (30, 30, Fraction(1, 2))):
        term, total = (1 - p) ** n, Fraction(0)
        for i in range(k + 1):
            total += term
            term = term * (n - i) / (i + 1) * p / (1 - p)
        assert rules.few_rejections(k, n, float(p)) == pytest.approx(float(total), rel=1e-9)


def test_strictest_stops_at_the_first_failure():
    cuts = (3.0, 2.0, 1.0)
    assert rules.strictest([1000, 0, 0, 0], cuts, 0.01, 0.05) == 1.0
    assert rules.strictest([1000, 50, 0, 0], cuts, 0.01, 0.05) == 2.0
    assert rules.strictest([1000, 0, 0, 50], cuts, 0.01, 0.05) is None
    assert rules.strictest([20, 0, 0, 0], cuts, 0.01, 0.05) is None  # too few labels to be sure


def test_rules_keep_their_promise(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(4000):
        good = i % 4 > 0
        w = [f"w{int(x)}" for x in rng.integers(0, 5000, 80)]
        if not good or rng.random() < 0.002:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "en" if i % 2 else None, int(good)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    labels = table.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (1, None), (10**9, 1)], "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in rules.filter_quality(table.select("doc_id", "text", "lang"), labels, alpha=0.05).collect()}
    good = [got[i] for i, *_, q in rows if q]
    assert sum(not r["kept"] for r in good) <= 0.05 * len(good)
    assert sum(got[i]["kept"] for i, *_, q in rows if not q) == 0


def test_rules_on_messy_rows(spark, messy, messy_rows, empty):
    labels = spark.createDataFrame([(10, 1), (11, 0), (None, 1)], "doc_id long, quality int")
    got = rules.filter_quality(messy, labels).collect()
    want = Counter()
    for doc, text, *_ in messy_rows:
        s = stats_by_brute_force(text)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want[(doc, *s, failed, not failed)] += 1  # so few labels switch no rule on
    assert Counter((r["doc_id"], *(r[c] for c in rules.STATS[:5]), r["base_failed"], r["kept"]) for r in got) == want
    assert rules.filter_quality(empty, labels).count() == 0 and rules.filter_quality(messy, labels.filter("false")).count() == len(messy_rows)


# --- mixing


def test_mix(spark, messy, messy_rows, empty):
    got = mixing.mix(messy).select("doc.doc_id", "doc.source", "doc.text", "size", "source_size", "target", "taken", "positions").collect()
    again = mixing.mix(messy.repartition(11)).select("doc.doc_id", "doc.text", "taken", "positions").collect()
    assert Counter(str((r["doc_id"], r["text"], r["taken"], r["positions"])) for r in got) == Counter(str(tuple(r)) for r in again)
    sizes = Counter()
    for _, text, _, source in messy_rows:
        sizes[source] += len(words(text))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, live = {}, 1.5 * sum(sizes.values()), set(names)
    while live:  # deal by weight, close what is above its cap, deal again
        level = left / sum(weights[s] for s in live)
        full = {s for s in live if weights[s] * level >= 2 * sizes[s]}
        if not full:
            target |= {s: weights[s] * level for s in live}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        live -= full
    largest = Counter()
    taken = Counter()
    for r in got:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == len(r["positions"]) * r["size"]
        assert all(0 <= p < 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert mixing.mix(empty).count() == 0


def test_positions_follow_the_schedule(spark):
    for knots in mixing.SCHEDULES:
        shares = np.linspace(0, 1, 101)[:-1]
        got = spark.createDataFrame([(float(x),) for x in shares], "u double").select("u", mixing.demand_time(F.col("u"), knots).alias("t")).collect()
        grid = np.linspace(0, 1, 200_001)
        weight = np.interp(grid, *zip(*knots))
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        for r in got:
            assert np.interp(r["t"], grid, demand / demand[-1]) == pytest.approx(r["u"], abs=1e-5)
    with pytest.raises(ValueError):
        mixing.demand_time(F.lit(0.5), ((0.0, 0.0), (1.0, 0.0)))


def test_mix_query_reads_the_training_order(spark, monkeypatch):
    """what the query says of a document comes from the rows in training order."""
    from ramplake.llm import plans

    kept = mixing.in_training_order
    monkeypatch.setattr(mixing, "in_training_order", lambda mixed: kept(mixed).filter("position < 0.5"))
    rows = plans.QUERIES["op5_curriculum_mix"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.taken for r in rows) and all(r.position < 0.5 for r in rows if r.taken)
    assert any(r.size and not r.taken and r.position is None for r in rows)


def test_training_order(spark, messy):
    rows = mixing.in_training_order(mixing.mix(messy)).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)


# --- top-k


def top_by_brute_force(rows, k=5, every=50):
    usable = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, x in sorted({i: v for i, v in reversed(usable) if i % every == 0}.items()):
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 2e5])
def test_top_k(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) * scale * rng.exponential()]) for i in range(700)]
    rows += [(1000 + i, [scale, 0.0] * 4) for i in range(60)]  # ties
    rows += [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [9.0 * scale] * 8), (2200, [0.0] * 8), (2250, [scale, -scale]), (2300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("v", F.lit(1))
    got = topk.search(df, block=64)
    assert sorted(map(tuple, got.collect())) == top_by_brute_force(rows)
    assert topk.search(df.filter("false")).count() == 0
    few = df.filter("vec_id IN (50, 51, 52)")
    assert sorted(map(tuple, topk.search(few).collect())) == top_by_brute_force([r for r in rows if r[0] in (50, 51, 52)])


# --- licences


def test_licenses(spark, messy, messy_rows, empty):
    texts = [(1, "The MIT"), (2, licenses.MIT.upper().replace(",", " ;")), (3, "Copyright (c) 2021 A. Person\n\n" + licenses.ISC.replace("\n\n", "\n")), (4, None), (5, ""), (5, ""), (6, licenses.MIT + " x")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[i]["text_license"] for i in range(1, 7)] == [None, "MIT", "ISC", None, None, None]
    found = licenses.scan_licenses(messy).collect()
    assert len(found) == len(messy_rows)
    (row,) = [r for r in found if r["doc_id"] == 94]
    assert (row["line_licenses"], row["n_license_lines"], row["text_license"]) == (["LicenseRef-all-rights-reserved", "MIT"], 2, None)
    assert licenses.scan_licenses(empty).count() == 0


# --- repeated byte strings


def removed_by_brute_force(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [8192, 3])
def test_remove_repeats(spark, messy, messy_rows, empty, hot):
    got = runindex.remove_repeats(messy, hot_pieces=hot).select("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = removed_by_brute_force([(r[1] or "").encode() for r in messy_rows], 200)
    assert Counter(map(tuple, got)) == want
    assert runindex.remove_repeats(empty).count() == 0


def test_pieces_cover_every_start_once():
    rng = np.random.default_rng(8)
    raw = bytes(rng.integers(97, 100, 9000).astype(np.uint8)) + b"ab" * 2000
    whole = runindex.pieces(raw, 200, 32)
    for segment in (300, 1000, 1 << 20):
        v, c, first, sizes, again = runindex.pieces(raw, 200, 32, segment)
        assert np.array_equal(np.concatenate([np.arange(a, a + n) for a, n in zip(first, sizes)]), np.arange(len(raw) - 199))
        assert np.array_equal(np.repeat(v, sizes), np.repeat(whole[0], whole[3]))
        content = {}
        for name, a, n in zip(zip(v, c), first, sizes):
            assert content.setdefault(name, raw[a : a + n + 199]) == raw[a : a + n + 199]


def test_matching_statistics():
    rng = np.random.default_rng(4)
    for _ in range(40):
        base = [bytes(rng.choice([97, 98], rng.integers(3, 60)).astype(np.uint8)) for _ in range(3)]
        texts = [b"".join(base[k] for k in rng.integers(0, 3, rng.integers(0, 5))) for _ in range(rng.integers(1, 7))]
        index = runindex.RunIndex(texts)
        assert int(index.runs.sum()) == index.n
        places = [(t, i) for t in texts for i in range(len(t))]
        numbered = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]

        def match(a, b):
            n = 0
            while a[1] + n < len(a[0]) and b[1] + n < len(b[0]) and a[0][a[1] + n] == b[0][b[1] + n]:
                n += 1
            return n

        want = [max((match(p, q) for q, other in zip(places, numbered) if other != own), default=0) for p, own in zip(places, numbered)]
        assert index.matching_statistics().tolist() == want


def test_copies_make_few_runs():
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 101, 500).astype(np.uint8))
    assert len(runindex.RunIndex([text] * 20).runs) < 2 * len(runindex.RunIndex([text]).runs) + 20


# --- quality


def test_quality_learns_without_bad_labels(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1500):
        w = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(60)]
        good = i % 5 > 0
        rows.append((i, " ".join(w) if good else " ".join(x + "###" for x in w), good))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _, good in rows if good and i % 2] + [(None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert 0.5 < model.prior < 0.95
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [(got[i]["score"], good) for i, _, good in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert min(s for s, good in held if good) > max(s for s, good in held if not good)
    assert all((s >= quality.THRESHOLD) == good for s, good in held)
    repeat = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(7), quality.train(docs.repartition(3), labels)).collect()}
    assert repeat == pytest.approx({i: r["score"] for i, r in got.items()})


def test_quality_on_messy_rows(spark, messy, messy_rows, empty):
    labels = spark.createDataFrame([(i, 1) for i in range(10, 40)], "doc_id long, quality int")
    for model in (quality.train(messy, labels), quality.train(messy, labels.filter("false"))):
        got = quality.score(messy, model).collect()
        assert len(got) == len(messy_rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
        kept = quality.keep_good(messy, model)
        assert kept.columns == messy.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality.train(empty, labels) is quality.BLANK and quality.score(empty, quality.BLANK).count() == 0 and quality.keep_good(empty, quality.BLANK).count() == 0


def test_sample_takes_each_document_once(spark):
    """A much repeated id brings one row; labelled documents are part of the unlabelled text too."""
    rows = [(i, f"words of document {i} " * (1 + i % 5), 1) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    hot = docs.union(spark.range(3000).selectExpr("7L", "'words of document 7 ' || repeat('words of document 7 ', 2)"))
    once, often = quality.train(docs, labels), quality.train(hot, labels)
    assert once is not quality.BLANK and np.allclose(once.mean, often.mean) and np.allclose(once.weights, often.weights)
