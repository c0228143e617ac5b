"""Periodic runs of words: stretches that repeat a shorter word sequence several times over.

The suffixes of a text's words are sorted and the common prefixes of neighbours measured. Neighbours are then united as
Kruskal's algorithm does, longest common prefix first, so that at length l the classes are the suffixes that share their
first l words. A class keeps its positions in order. When two classes meet, positions of different classes that become
neighbours share exactly l words; where they are d <= l apart, period d holds from the first of them for d + l words and
no further. A run's start and the start of its second period become neighbours at the run's own length less a period: a
position of that class between them would give the stretch a smaller period. So no run is missed, and of all stretches
with the same ends the least distance is the smallest period.

Texts are independent rows: nothing is shuffled. Many texts are sorted at once (prefix doubling in numpy), and only those
that hold some sequence of words, as long as a shortest run less a period, twice.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ramplake.llm.common import slices
from ramplake.llm.sqltext import BYTES, crc32_sql

#: A run has MIN_WORDS words at least and MIN_TIMES times its period at least.
MIN_WORDS, MIN_TIMES = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"

Run = tuple[int, int, int]
Words = list[bytes]


def split_words(text: str) -> Words:
    return text.encode().split()  # bytes: the six ASCII spaces only


def groups(a: np.ndarray) -> np.ndarray:
    """Index of the first of the equal neighbours that each element of a sorted array stands with."""
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: rank of the 2^k symbols from each position on (equal sequences have equal ranks), until all
    ranks differ. The last is the order of the suffixes. Some symbol that occurs once must end every sequence."""
    order = np.argsort(symbols, kind="stable")
    first = groups(symbols[order])
    rank = np.empty(len(symbols), np.int64)
    rank[order] = first
    levels, width = [rank], 1
    tied = order[np.bincount(first, minlength=len(order))[first] > 1]
    while len(tied):
        upper, lower = rank[tied], rank[tied + width]
        key = upper * len(symbols) + lower
        by_key = np.argsort(key, kind="stable")
        first, block = groups(key[by_key]), groups(upper[by_key])
        rank, tied = rank.copy(), tied[by_key]
        rank[tied] = upper[by_key] + first - block
        tied = tied[np.bincount(first, minlength=len(tied))[first] > 1]
        levels.append(rank)
        width *= 2
    return levels


def neighbours(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring suffixes with their common prefixes, of `least` symbols or more, the longest first."""
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    k = min(least.bit_length() - 1, len(levels) - 1)
    close = levels[k][a] == levels[k][b]
    a, b = a[close], b[close]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a + common] == levels[k][b + common]
        common[same] += 1 << k
    by_length = np.argsort(-common, kind="stable")
    by_length = by_length[: np.count_nonzero(common >= least)]
    return a[by_length], b[by_length], common[by_length]


def stretches(symbols: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[Run]:
    """All runs (start, length, smallest period) of a sequence whose parts each end with a symbol of their own."""
    found: dict[tuple[int, int], int] = {}
    classes: dict[int, list[int]] = {}
    before = np.concatenate([[-1], symbols[:-1]]).tolist()  # no word stands before the first

    def met(i: int, j: int, common: int) -> None:
        d = j - i
        if d + common >= max(min_words, min_times * d) and before[i] != before[j]:
            if d < found.get((i, d + common), d + 1):
                found[i, d + common] = d

    for a, b, common in zip(*(x.tolist() for x in neighbours(suffix_ranks(symbols), shortest_repeat(min_words, min_times)))):
        large, small = classes.setdefault(a, [a]), classes.setdefault(b, [b])
        if len(large) < len(small):
            large, small = small, large
        if 8 * len(small) < len(large):
            for x in small:
                insort(large, x)
        else:
            large.extend(small)
            large.sort()
        own = set(small)
        for x in small:
            at = bisect_left(large, x)
            if at and large[at - 1] not in own:
                met(large[at - 1], x, common)
            if at + 1 < len(large) and large[at + 1] not in own:
                met(x, large[at + 1], common)
            classes[x] = large
    return sorted((start, length, period) for (start, length), period in found.items())


def shortest_repeat(min_words: int, min_times: int) -> int:
    """Words that every run has in common with itself moved by a period, at least."""
    return min(max(min_words, min_times * q) - q for q in range(1, min_words + 1))


def runs_of(texts: list[Words], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[list[Run]]:
    """Runs of each text by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    span = shortest_repeat(min_words, min_times)
    some = [t for t, words in enumerate(texts) if len(words) >= min_words]
    if not some:
        return out
    sizes = np.array([len(texts[t]) + 1 for t in some])
    # a number for each word, and one for the end of a text
    coded = pa.array([w for t in some for w in (*texts[t], None)], pa.binary()).dictionary_encode()
    kinds = len(coded.dictionary) + 1
    owner = np.repeat(np.arange(len(some)), sizes)
    symbols = owner * kinds + coded.indices.fill_null(kinds - 1).to_numpy(zero_copy_only=False)
    # texts in which no sequence of `span` words has a hash that another has are done with
    mixed = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(len(mixed) - span + 1, np.uint64)
    for k in range(span):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : len(total) + k]
    ordered = np.sort(total)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    left = np.zeros(len(some), bool)
    left[owner[: len(total)][np.isin(total, twice)]] = True
    kept = np.flatnonzero(left)
    starts = np.cumsum(sizes[kept]) - sizes[kept]
    for start, length, period in stretches(symbols[left[owner]], min_words, min_times):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[some[kept[k]]].append((start - int(starts[k]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: Words, runs: list[Run]) -> Words:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic_runs(
    docs: DataFrame, *, text: str = "text", doc: str = "doc_id", min_words: int = MIN_WORDS, min_times: int = MIN_TIMES,
    words: Callable[[int | None, str], Words] = lambda doc, text: split_words(text),
) -> DataFrame:
    """Columns doc_id, runs (array of start, length, period, by start, then period; numbers of words from 0) and collapsed
    (the words that no run holds after its first period, joined by spaces), a row for each row of `docs`.

    `words` takes the words of a row from its id and text. Null and empty texts have no words, no runs and an empty
    collapsed text. Repeated rows get the same result; a null id stays null; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                taken = [words(d, t) for d, t in zip(part.column(0).to_pylist(), texts)]
                found = runs_of(taken, min_words, min_times)
                ends = np.cumsum([0, *map(len, found)])
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                collapsed = [b" ".join(collapse(w, r)).decode() for w, r in zip(taken, found)]
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, runs array<{RUN}>, collapsed string")


def strongest(runs: str | Column = "runs") -> Column:
    """The run with the greatest length to period, of equals the first, then that of the smallest period; null without runs."""

    def order(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        place = F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.signum(F.when(left != right, right - left).otherwise(place)).cast("int")

    return F.get(F.array_sort(runs, order), 0)


def planted(doc: int | None, text: str) -> Words:
    """For one id in ten the words from some place on repeat the first of them; a null id counts as an empty text."""
    words = split_words(text)
    g, rest = divmod(zlib.crc32(str("" if doc is None else doc).encode()), 10)
    n = len(words)
    if rest or not n:
        return words
    at = g % n
    return words[:at] + [words[at + k % (1 + (n - at) // (3 + g % 8))] for k in range(n - at)]


ORACLE = rf"""
WITH {BYTES},
base AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql('doc_id::VARCHAR')} AS h FROM documents, bytes),
sized AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS parts FROM base),
placed AS (SELECT doc_id, w, changed, a, 1 + (n - a) // parts AS p, unnest(range(n)) AS i FROM sized),
words AS (SELECT doc_id, i, w[1 + CASE WHEN changed AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM placed),
grams AS (
  SELECT doc_id, i, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS g
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
steps AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
spans AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS l FROM steps GROUP BY doc_id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM spans GROUP BY doc_id, s, l),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listing FROM runs GROUP BY doc_id),
best AS (
  SELECT doc_id, s, l, q FROM runs r
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DECIMAL(38, 18) / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
  sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
