"""Byte-pair encoding and decoding with a lexicon of the corpus's frequent words.

The vocabulary is a word-end BPE model file (normalizer NFC, white space runs to one space, lower case; pieces by
a pattern; letters are bytes; the last letter of a piece carries the word-end mark). Pieces are independent of one
another, so an encoder only has to know pieces: frequent ones come from the transducer of `lexicon`, all others
are merged exactly, many at a time, always the pair of lowest rank and among equal ones the leftmost.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from ramplake.llm.common import cut_lineage, slices
from ramplake.llm.lexicon import Lexicon, compile_lexicon

LEXICON_WORDS = 65_536
LEXICON_WORD_BYTES = 48
#: Chunks remembered by one task; the memory is emptied when full.
MEMO_CHUNKS = 200_000
MATRIX_LETTERS = 64
NONE = np.iinfo(np.int32).max
WHITE = regex.compile(r"\s+")
CHUNK_END = np.int32(-1).tobytes()
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Ids that decoding puts together at once.
DECODE_IDS = 250_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is visible, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in visible else next(free)) for b in range(256)]


def newer_letters(path: str) -> tuple[list[int], dict[int, str]]:
    """Code points on which the tables here and the tokenizers library's differ, as Unicode versions do: those that are
    letters or digits only here, and the lower case of those that have one only there. The library is asked."""
    from tokenizers import Tokenizer  # here only: tasks don't need it

    reference = Tokenizer.from_file(path)
    newer = [m[0] for m in regex.finditer(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)) if unicodedata.category(m[0]) == "Cn"]
    lower = {ord(c): low for c in newer if (low := reference.normalizer.normalize_str(c)) != c}
    marks = [ord(c) for c in newer if ord(c) not in lower and len(reference.pre_tokenizer.pre_tokenize_str(f"a{c}b")) > 1]
    return marks, lower


def char_class(points: list[int]) -> str:
    """The inside of a bracket expression, with runs as ranges."""
    ends = [k for k in range(len(points)) if k + 1 == len(points) or points[k + 1] != points[k] + 1]
    starts = [0, *(k + 1 for k in ends[:-1])]
    return "".join(f"\\U{points[a]:08x}-\\U{points[b]:08x}" for a, b in zip(starts, ends))


class Vocabulary:
    """The parts of a tokenizer file that encoding and decoding need. Only the described kind of file is taken."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path} is not a word-end BPE file of the supported kind")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.pattern = split["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {**ids, **self.special}
        self.tokens = [""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + end] for c in letters], np.int32)
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]]
        keys = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([m for *_, m in pairs], np.int32)
        self.marks, self.newer_lower = newer_letters(path)

    def chunks(self, text: str) -> list[str | int]:
        """The text between white space, with the ids of special tokens where they stand. No piece spans white space."""
        if not any(t in text for t in self.special):
            return self._words(text)
        out: list[str | int] = []
        at = 0
        for m in self._special.finditer(text):
            out += self._words(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._words(text[at:])

    @staticmethod
    def _words(text: str) -> list[str]:
        """As str.split, but for the four separators that are no white space in the tokenizer's pattern."""
        return [w for w in WHITE.split(text) if w] if SEPARATORS.search(text) else text.split()

    def ready(self) -> Vocabulary:
        """Compiles what isn't sent to the tasks."""
        self._find = regex.compile(self.pattern + "|\n").findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        marks, self._newer, self._find_newer = char_class(self.marks), None, None
        if marks:
            # the same pattern with letters and digits less the marks
            careful = self.pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{marks}])").replace(r"[\p{L}]", rf"[\p{{L}}--[{marks}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{marks}]]")
            self._newer = regex.compile(f"[{marks}{char_class(sorted(self.newer_lower))}]")
            self._find_newer = regex.compile(careful + "|\n", regex.V1).findall
        return self

    def pieces(self, chunks: list[str]) -> list[str]:
        """The pieces of all chunks, each chunk ended by a line feed, which no chunk holds: NFC, lower case letter by
        letter (without the rule for a sigma at a word's end), pattern."""
        text = "\n".join([*chunks, ""])
        if text.isascii():
            return self._find(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self._newer and len(text.encode("latin-1", "ignore")) < len(text) and self._newer.search(text):
            return self._find_newer(text.translate(self.newer_lower))
        return self._find(text)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as bytes of 32-bit integers, by merging its letters."""
        out, short = [b""] * len(words), {}
        for i, w in enumerate(words):
            if len(w) > MATRIX_LETTERS:
                out[i] = self._merge_long(w).tobytes()
            elif w:
                short.setdefault((len(w) + 3) // 4, []).append(i)
        for rows in short.values():
            for k in range(0, len(rows), 16_384):
                part = rows[k : k + 16_384]
                flat, ends = self._merge_matrix([words[i] for i in part])
                for i, a, b in zip(part, [0, *ends], ends):
                    out[i] = flat[a:b]
        return out

    def _merge_matrix(self, words: list[bytes]) -> tuple[bytes, list[int]]:
        """One row a word; every round merges the best pair of each row that still has one. Ids one word after the other, and ends."""
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max()) + 1
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        ids = self.inner[raw]
        ids[np.arange(n), lengths - 1] = self.last[raw[np.arange(n), lengths - 1]]
        places = np.arange(width)
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        rank[places[:-1] >= lengths[:, None] - 1] = NONE
        final, ended, rows = np.empty((n, width), np.int32), np.empty(n, np.int64), np.arange(n)
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                final[rows[over]], ended[rows[over]] = ids[over], lengths[over]
                go = ~over
                rows, ids, rank, lengths, at, best = rows[go], ids[go], rank[go], lengths[go], at[go], best[go]
            here = np.arange(len(rows))
            ids[here, at] = self.merged[best]
            lengths = lengths - 1
            move = places[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(move, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(move[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            rank[here, at] = np.where(at < lengths - 1, self.ranks(ids[here, at], ids[here, at + 1]), NONE)
            some = np.flatnonzero(at > 0)
            rank[some, at[some] - 1] = self.ranks(ids[some, at[some] - 1], ids[some, at[some]])
        return final[places < ended[:, None]].tobytes(), (4 * np.cumsum(ended)).tolist()

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for a long word. All places of the best pair, without overlaps, are taken from the left in one
        round: a merge cannot make a pair of lower rank than one still to come but where their tokens are made of it,
        and those are looked at again in the next round."""
        raw = np.frombuffer(word, np.uint8)
        ids = np.append(self.inner[raw[:-1]], self.last[raw[-1]])
        while len(ids) > 1:
            rank = self.ranks(ids[:-1], ids[1:])
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            # in a run of overlapping places every second one counts
            run = np.cumsum(np.append(True, np.diff(at) != 1))
            first = at[np.append(True, np.diff(run) != 0)]
            at = at[(at - first[run - 1]) % 2 == 0]
            lowest = NONE
            made = ids.copy()
            made[at] = self.merged[best]
            made = np.delete(made, at + 1)
            new = self.ranks(made[:-1], made[1:])
            lowest = new.min() if len(new) else NONE
            if lowest < best and len(at) > 1:  # a new pair goes first: one merge at a time
                ids[at[0]] = self.merged[best]
                ids = np.delete(ids, at[0] + 1)
            else:
                ids = made
        return ids.astype(np.int32)


class Encoder:
    """Encodes texts in a task: memo, then lexicon, then merges."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, room: int = MEMO_CHUNKS):
        self.vocabulary, self.lexicon, self.room, self.memo = vocabulary.ready(), lexicon, room, {}
        self.specials = set(vocabulary.special.values())

    def learn(self, chunks: list[str]) -> None:
        """Remembers chunks: known pieces from the lexicon, all others merged."""
        pieces = self.vocabulary.pieces(chunks)
        distinct = list(set(pieces) - {"\n"})
        words = [p.encode() for p in distinct]
        ids, rest = {"\n": CHUNK_END}, range(len(words))
        if self.lexicon:
            places = self.lexicon.places(words)
            known = np.flatnonzero(places >= 0)
            ids.update(zip([distinct[k] for k in known], self.lexicon.ids(places[known])))
            rest = np.flatnonzero(places < 0).tolist()
        ids.update(zip([distinct[k] for k in rest], self.vocabulary.merge([words[k] for k in rest])))
        flat = b"".join(map(ids.__getitem__, pieces))
        ends = (4 * np.flatnonzero(np.frombuffer(flat, np.int32) == -1)).tolist()
        self.memo.update(zip(chunks, [flat[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        memo = self.memo
        parts = [self.vocabulary.chunks(t) for t in texts]
        distinct = set().union(*parts)
        new = distinct - memo.keys()
        if len(memo) + len(new) > self.room:
            memo.clear()
            new = distinct
        for c in new & self.specials:
            memo[c] = np.int32(c).tobytes()
        self.learn(list(new - self.specials))
        return [np.frombuffer(b"".join(map(memo.__getitem__, part)), np.int32) for part in parts]


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Occurrences of every piece in all documents: columns piece, n. Tasks count first, so a common word is sent once a task."""
    vocabulary = Vocabulary(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary.ready()
        seen: Counter[str | int] = Counter()

        def sent() -> pa.RecordBatch:
            words = [c for c in seen if not isinstance(c, int)]
            pieces = vocabulary.pieces(words)
            number = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
            at = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
            ended = at == number["\n"]
            of = np.cumsum(ended) - ended  # the chunk that a piece is of
            times = np.fromiter((seen[c] for c in words), np.int64, len(words))
            seen.clear()
            total = np.bincount(at[~ended], weights=times[of[~ended]], minlength=len(number)).astype(np.int64)
            del number["\n"]
            return pa.record_batch([pa.array(list(number), pa.string()), pa.array(np.delete(total, at[ended][0]))], ["piece", "n"])

        for batch in batches:
            for _, texts in slices(batch, text):
                for t in texts:
                    seen.update(vocabulary.chunks(t))
                if len(seen) > MEMO_CHUNKS:
                    yield sent()
        if any(not isinstance(c, int) for c in seen):
            yield sent()

    counted = docs.select(text).mapInArrow(count, "piece string, n long")
    return counted.groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_lexicon(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The compiled transducer of the most frequent pieces of up to LEXICON_WORD_BYTES bytes, `words` at most.

    Counts cover all documents; a piece is in if its count is in a class (an eighth of a power of two wide) that still
    fits as a whole, so no order of all pieces is needed. The lexicon is a shortcut only: it is bounded (65,536 short
    pieces, about 2 MB), and pieces outside it are merged.
    """
    kind = F.floor(8 * F.log2("n"))
    counts = cut_lineage(word_counts(docs, path, text).filter((F.col("n") > 1) & F.octet_length("piece").between(1, LEXICON_WORD_BYTES)))
    room, least = words, None
    for r in sorted(counts.groupBy(kind.alias("kind")).count().collect(), key=lambda r: -r["kind"]):  # a few hundred classes at most
        if r["count"] > room:
            break
        room, least = room - r["count"], r["kind"]
    frequent = counts.filter(kind >= least).select("piece").collect() if least is not None else []
    pieces = [r["piece"].encode() for r in frequent]
    return compile_lexicon({p: np.frombuffer(ids, np.int32) for p, ids in zip(pieces, Vocabulary(path).merge(pieces))})


def decoded(tokens: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of id sequences, given one after the other with their ends: tokens joined by spaces, unknown ids left out."""
    parts, row = [], 0
    while row < len(ends) - 1:
        n = max(1, int(np.searchsorted(ends, ends[row] + DECODE_IDS, "right")) - 1 - row)
        part, upto = ids[ends[row] : ends[row + n]], ends[row : row + n + 1] - ends[row]
        known = (part >= 0) & (part < len(tokens))
        upto = np.concatenate([[0], np.cumsum(known)])[upto].astype(np.int32)
        parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(upto), tokens.take(pa.array(part[known]))), " "))
        row += n
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def encode(docs: DataFrame, path: str, *, text: str = "text", doc: str = "doc_id", lexicon: bytes | None = None, decode_too: bool = False) -> DataFrame:
    """Ids of every whole text: columns `doc` and ids array<int>, a row for each row of `docs`.

    Null and empty texts give no ids. Repeated rows stay; other columns aren't read. Without a lexicon all pieces are merged.
    decode_too adds column decoded, what `decode` makes of the ids, in the same task.
    """
    vocabulary, sc = Vocabulary(path), docs.sparkSession.sparkContext
    shared = sc.broadcast(lexicon) if lexicon else None
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, Lexicon.at(shared.value) if shared else None)
        tokens = pa.array(vocabulary.tokens)
        for batch in batches:
            for part, texts in slices(batch, text):
                ids = encoder.encode(texts)
                ends, flat = np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate(ids)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                columns += [decoded(tokens, flat, ends)] if decode_too else []
                yield pa.record_batch(columns, [doc, "ids", "decoded"][: len(columns)])

    return docs.select(doc, text).mapInArrow(run, f"`{doc}` {kind}, ids array<int>" + ", decoded string" * decode_too)


def decode(encoded: DataFrame, path: str, *, doc: str = "doc_id") -> DataFrame:
    """Texts of id sequences, tokens joined by spaces: columns `doc`, ids, decoded. Null ids give an empty text, unknown ids nothing."""
    vocabulary = Vocabulary(path)
    kind = encoded.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(vocabulary.tokens)
        for batch in batches:
            lists = batch.column(1)
            lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            yield pa.record_batch([batch.column(0), lists, decoded(tokens, lists.flatten().to_numpy(zero_copy_only=False), ends)], [doc, "ids", "decoded"])

    return encoded.select(doc, "ids").mapInArrow(run, f"`{doc}` {kind}, ids array<int>, decoded string")
