"""Repeated byte strings by run-length compressed Burrows-Wheeler indexes.

Routing. Every 200-byte string has a least hash among its 32-byte windows; equal strings have the same one. Successive
starts with the same least hash form a piece: the bytes that their strings cover. So all strings that can be equal
meet under one hash, and a hash that occurs once is done with. Of pieces with equal bytes one is kept, with
their number.

Index. The pieces of some hashes, about a megabyte, are one block. Its suffixes are sorted, and all that is kept of the
order is the run-length compressed transform: the run heads and tails with their sampled text positions. Matching
statistics are streamed over the text: at a sampled position the longest match with the neighbour suffix is compared
directly, and at any other it is one less than at the position before it, because there the neighbours' previous letters
agree. A start whose longest match elsewhere, or whose piece's number, reaches the length is marked. Blocks of copies
have few runs, so few comparisons.

Hot hashes. A hash with more distinct pieces than HOT_PIECES (a passage with thousands of different surroundings) is not
put into one block: its pieces are cut into their single 200-byte strings, which are counted by 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ramplake.llm.common import cut_lineage

LENGTH, WINDOW = 200, 32
#: Starts of one piece at most; long stretches of one hash, as in periodic texts, are several pieces.
PIECE_STARTS = 512
#: Starts of a long text that are hashed at once.
SEGMENT = 1 << 20
BLOCK_BYTES, HOT_PIECES = 1 << 20, 8192
SEEDS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
KEYS = ["doc", "sum", "n"]


def window_hashes(data: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each window, by doubling: a hash of 2n bytes is made of two of n."""
    a, b, c = (np.uint64(s) for s in SEEDS)
    known = {1: (data.astype(np.uint64) + np.uint64(1)) * a}
    size = 1
    while size * 2 <= window:
        h = known[size]
        known[size * 2] = pair(h[: len(h) - size], h[size:], b)
        size *= 2
    out, done = known[size], size
    while done < window:
        step = max(k for k in known if k <= window - done)
        part = known[step][done:]
        out = pair(out[: len(part)], part, c)
        done += step
    out = (out ^ out >> np.uint64(31)) * c
    return out ^ out >> np.uint64(29)


def pair(left: np.ndarray, right: np.ndarray, odd: np.uint64) -> np.ndarray:
    return (left ^ left >> np.uint64(29)) * odd + (right ^ right >> np.uint64(32))


def sliding_least(values: np.ndarray, count: int) -> np.ndarray:
    out, size = values, 1
    while size * 2 <= count:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = count - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pieces(raw: bytes, length: int, window: int, segment: int = SEGMENT) -> tuple[np.ndarray, ...]:
    """Pieces of a text, of long texts segment by segment, so that the arrays stay small."""
    if len(raw) < segment + length:
        return segment_pieces(raw, length, window)
    parts = []
    for begin in range(0, len(raw) - length + 1, segment):
        v, c, first, sizes, again = segment_pieces(raw[begin : begin + segment + length - 1], length, window)
        parts.append((v, c, first + begin, sizes, again))
    return tuple(np.concatenate(p) for p in zip(*parts))


def segment_pieces(raw: bytes, length: int, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of a text: least hash, a hash of all its bytes, first start, number of starts, whether the least hash comes
    twice in it (without that, or another piece of the hash, no string of the piece can be anywhere else)."""
    if len(raw) < length:
        return (*(np.empty(0, np.int64) for _ in range(4)), np.empty(0, bool))
    data = np.frombuffer(raw, np.uint8)
    hashes = window_hashes(data, window)
    least = sliding_least(hashes, length - window + 1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    sizes = np.diff(np.append(first, len(least)))
    if sizes.max() > PIECE_STARTS:
        parts = -(-sizes // PIECE_STARTS)
        offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        sizes = np.minimum(np.repeat(sizes, parts) - offset * PIECE_STARTS, PIECE_STARTS)
        first = np.repeat(first, parts) + offset * PIECE_STARTS
    # a polynomial over the window hashes, from running sums; differences of sums are the content's alone
    weights = powers(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * weights)])
    last = first + sizes + length - window
    content = (sums[last] - sums[first]) * inverse_powers(len(hashes))[first] ^ (sizes.astype(np.uint64) * np.uint64(SEEDS[1]))
    # windows that are the least of some start; of equal ones in one piece two follow each other among them
    padding = np.zeros(length - window, np.uint64)
    highest = ~sliding_least(~np.concatenate([padding, least, padding]), length - window + 1)
    chosen = np.flatnonzero(hashes == highest)
    equal = np.concatenate([[0], np.cumsum(hashes[chosen[1:]] == hashes[chosen[:-1]])])
    low, high = np.searchsorted(chosen, first), np.searchsorted(chosen, last) - 1
    return least[first].view(np.int64), content.view(np.int64), first, sizes, equal[high] > equal[low]


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64."""
    return _grown("up", n, SEEDS[0])


def inverse_powers(n: int) -> np.ndarray:
    return _grown("down", n, pow(SEEDS[0], -1, 1 << 64))


def _grown(name: str, n: int, base: int) -> np.ndarray:
    if len(_POWERS.get(name, ())) < n:
        _POWERS[name] = np.cumprod(np.append(np.uint64(1), np.full(max(n, 1 << 16), np.uint64(base))))
    return _POWERS[name][:n]


class RunIndex:
    """The run-length compressed transform of a set of texts; only run heads and tails keep their positions."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.raw = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        n = self.n = int(sizes.sum())
        ends = np.cumsum(sizes)
        self.rest = np.repeat(ends, sizes) - np.arange(n)  # bytes from a position to its text's end
        starts = ends - sizes
        order = self._suffixes()
        before = np.zeros(n, np.int64)  # 0: the text begins here, unlike any other letter
        before[1:] = self.raw[: max(n - 1, 0)].astype(np.int64) + 1
        before[starts[sizes > 0]] = 0
        letters = before[order]
        head = np.ones(n, bool)
        head[1:] = (letters[1:] != letters[:-1]) | (letters[1:] == 0)
        tail = np.append(head[1:], True)[:n]
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail)
        self.letters, self.runs = letters[heads], np.diff(np.append(heads, n))
        self.heads, self.tails = order[heads], order[tails]

    def _suffixes(self) -> np.ndarray:
        """Positions in the order of the suffixes of their texts; equal ones end with their texts and stand in text order."""
        n, rest = self.n, self.rest
        key = np.zeros(n, np.int64)
        for k in range(7):
            letter = np.zeros(n, np.int64)
            letter[: n - k] = np.where(rest[: n - k] > k, self.raw[k:n].astype(np.int64) + 1, 0)
            key = key * 257 + letter
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.append(True, ordered[1:] != ordered[:-1])[:n]
        slot = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
        size = 7
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        while len(slots):
            at = order[slots]
            over = rest[at] <= size
            # a text that has ended comes first, in text order
            second = np.where(over, at, n + 1 + rank[np.where(over, 0, at + size)])
            both = rank[at] * (2 * n + 2) + second
            by = np.argsort(both, kind="stable")
            order[slots] = at = at[by]
            both = both[by]
            new = np.append(True, both[1:] != both[:-1])
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
            slots = slots[~(new & np.append(new[1:], True))]
            size *= 2
        return order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the texts at each pair of positions."""
        most = np.minimum(self.rest[a], self.rest[b])
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        step = np.arange(8)
        while len(live):
            at, other = a[live] + out[live], b[live] + out[live]
            same = self.raw[np.minimum(at[:, None] + step, len(self.raw) - 1)] == self.raw[np.minimum(other[:, None] + step, len(self.raw) - 1)]
            equal = np.where(same.all(1), 8, same.argmin(1))
            out[live] += equal
            live = live[(equal == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match at any other position."""
        if not self.n:
            return np.zeros(0, np.int64)
        # the neighbour before a head is the tail of the run before, the one after a tail is the head of the next run
        side = self.common(self.heads[1:], self.tails[:-1])
        return np.maximum(self._streamed(self.heads, np.append(0, side)), self._streamed(self.tails, np.append(side, 0)))

    def _streamed(self, samples: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """From the sampled positions on one less with every letter; each text's first position is a sample."""
        place, value = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        place[samples], value[samples] = samples, lengths
        place = np.maximum.accumulate(place)
        return np.maximum(value[place] - (np.arange(self.n) - place), 0)


def marked(texts: list[bytes], numbers: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts whose string of `length` bytes occurs elsewhere: text, first start, end. numbers: copies of each text."""
    index = RunIndex(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    mark = (index.matching_statistics() >= length) | (np.repeat(np.asarray(numbers), sizes) > 1)
    mark &= index.rest >= length
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(np.cumsum(sizes), low, "right")
    begin = (np.cumsum(sizes) - sizes)[text]
    return text, low - begin, high - begin


def named(docs: DataFrame, text: str, doc: str) -> DataFrame:
    """Rows with an identity: id, CRC-32 and bytes of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc).cast("long").alias("doc"), F.crc32(body.cast("binary")).alias("sum"), F.octet_length(body).alias("n"), body.alias("body"))


def all_pieces(rows: DataFrame, length: int, window: int) -> DataFrame:
    """Columns v (least hash), c (content), KEYS, first, starts, again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, row = batch.column(3), 0
            while row < batch.num_rows:
                at, found, size = row, [], 0
                while row < batch.num_rows and size < 1 << 21:
                    raw = bodies[row].as_py().encode()
                    found.append(pieces(raw, length, window))
                    size += len(raw)
                    row += 1
                times = [len(f[0]) for f in found]
                v, c, first, starts, again = (np.concatenate(x) for x in zip(*found))
                keys = pa.array(np.repeat(np.arange(at, row), times))
                own = [batch.column(k).take(keys) for k in range(3)]
                yield pa.record_batch([pa.array(v), pa.array(c), *own, pa.array(first.astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(again)], ["v", "c", *KEYS, "first", "starts", "again"])

    return rows.filter(F.col("n") >= length).mapInArrow(run, "v long, c long, doc long, sum long, n int, first int, starts int, again boolean")


def with_texts(rows: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """rows with the columns of `wanted`, which is by KEYS."""
    w = wanted.select(F.struct(*KEYS).alias("of"), *[c for c in wanted.columns if c not in KEYS])
    same = rows["doc"].eqNullSafe(w["of.doc"]) & (rows["sum"] == w["of.sum"]) & (rows["n"] == w["of.n"])
    return rows.join(w, same, how).drop("of")


def cut_out(rows: DataFrame, distinct: DataFrame, length: int, single: bool) -> DataFrame:
    """The bytes of distinct pieces, each from its first occurrence: columns v, c, number, piece. Single: a row for each
    start with the digest of its string: v, c, number, start, digest."""
    at = distinct.select("rep.*", F.struct("v", "c", "number", F.col("rep.first").alias("first"), F.col("rep.starts").alias("starts")).alias("piece"))
    wanted = at.groupBy(*KEYS).agg(F.collect_list("piece").alias("pieces"))  # no more than the document has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column(0)[row].as_py().encode()
                found = pa.RecordBatch.from_struct_array(batch.column(1)[row].values)
                v, c, number = (found.column(k) for k in range(3))
                first, starts = (found.column(k).to_numpy() for k in (3, 4))
                if not single:
                    cut = [raw[a : a + k + length - 1] for a, k in zip(first.tolist(), starts.tolist())]
                    yield pa.record_batch([v, c, number, pa.array(cut, pa.binary())], ["v", "c", "number", "piece"])
                    continue
                times = pa.array(np.repeat(np.arange(len(starts)), starts))
                offset = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
                digests = [hashlib.blake2b(raw[a : a + length], digest_size=16).digest() for a in (np.repeat(first, starts) + offset).tolist()]
                yield pa.record_batch([v.take(times), c.take(times), number.take(times), pa.array(offset.astype(np.int32)), pa.array(digests, pa.binary())], ["v", "c", "number", "start", "digest"])

    schema = "v long, c long, number long, start int, digest binary" if single else "v long, c long, number long, piece binary"
    return with_texts(rows, wanted, "inner").select("body", "pieces").mapInArrow(run, schema)


def indexed(found: DataFrame, length: int) -> DataFrame:
    """Columns v, c, low, high: ranges of repeated starts in each piece. All pieces of a hash are in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[int, int]] = []
        numbers, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            text, low, high = marked(texts, numbers, length)
            v, c = (np.array(x, np.int64)[text] for x in zip(*names))
            return pa.record_batch([pa.array(v), pa.array(c), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["v", "c", "low", "high"])

        for batch in batches:
            for v, c, number, piece in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if names and names[-1] == (v, c):  # from a repeated row
                    continue
                if size >= BLOCK_BYTES and names[-1][0] != v:
                    yield flush()
                    names, numbers, texts, size = [], [], [], 0
                names.append((v, c))
                numbers.append(number)
                texts.append(piece)
                size += len(piece)
        if names:
            yield flush()

    return found.repartition("v").sortWithinPartitions("v", "c").mapInArrow(run, "v long, c long, low int, high int")


def repeated_ranges(rows: DataFrame, length: int = LENGTH, window: int = WINDOW, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """Columns KEYS and ranges: array of (low, high), starts whose string also starts elsewhere."""
    every = all_pieces(rows, length, window)
    often = every.groupBy("v").agg(F.count("*").alias("times"), F.max("again").alias("again")).filter("times > 1 OR again").select("v")
    members = cut_lineage(every.drop("again").join(often, "v", "left_semi"))
    distinct = cut_lineage(members.groupBy("v", "c").agg(F.count("*").alias("number"), F.min(F.struct(*KEYS, "first", "starts")).alias("rep")))
    hot = cut_lineage(distinct.groupBy("v").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > hot_pieces).select("v"))
    ranges = indexed(cut_out(rows, distinct.join(hot, "v", "left_anti"), length, False), length)
    if not hot.isEmpty():
        strings = cut_lineage(cut_out(rows, distinct.join(hot, "v", "left_semi"), length, True))
        twice = strings.groupBy("digest").agg(F.sum("number").alias("times")).filter("times > 1").select("digest")
        ranges = ranges.union(strings.join(twice, "digest", "left_semi").select("v", "c", F.col("start").alias("low"), (F.col("start") + 1).alias("high")))
    placed = members.join(ranges, ["v", "c"]).select(*KEYS, F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high")).alias("range"))
    return placed.groupBy(*KEYS).agg(F.collect_set("range").alias("ranges"))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, window: int = WINDOW, hot_pieces: int = HOT_PIECES, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Columns doc_id, n_bytes, n_removed, n_spans and kept (binary: the bytes that stay), a row for each row of `docs`.

    A byte goes if a string of `length` bytes that covers it starts at any other place too, in its own document or another,
    as the texts were given. Null texts are empty ones. Repeated rows repeat one another; rows without id take part. Texts
    shorter than `length` stay whole; an empty table gives an empty one; other columns aren't read.
    """
    rows = named(docs, text, doc)
    joined = with_texts(rows, repeated_ranges(rows, length, window, hot_pieces), "left").select("doc", "body", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[row].as_py().encode(), np.uint8)
                ranges = batch.column(2)[row]
                gone = np.zeros(len(data), bool)
                if ranges.is_valid:
                    found = pa.RecordBatch.from_struct_array(ranges.values)
                    low, high = (found.column(k).to_numpy() for k in (0, 1))
                    edge = np.bincount(low, minlength=len(data) + 1) - np.bincount(high + length - 1, minlength=len(data) + 1)
                    gone = np.cumsum(edge)[: len(data)] > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                yield pa.record_batch(
                    [batch.column(0).slice(row, 1), *(pa.array([x], pa.int64()) for x in (len(data), int(gone.sum()), spans)), pa.array([data[~gone].tobytes()], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
