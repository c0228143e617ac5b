"""A minimal acyclic transducer from words to id sequences, kept in one flat file that readers memory-map.

States with the same future are one state, so suffixes are shared. Every arc carries the number of words that
come before its branch; the sum along a path is the word's place in sorted order, and that place names its slice
in the pool of ids. Looking up is one binary search for each letter over the sorted (state, letter) arcs, for all
words of a batch at once.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np

MAGIC = b"LEXI\x01\x00\x00\x00"


def compile_lexicon(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The file for `entries`, whose keys are non-empty byte strings."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, *arcs)
        if key not in register:
            register[key] = len(states)
            states.append((final, arcs))
        return register[key]

    # the open path: for each letter of the last word its state's finality and finished arcs
    path: list[list] = [[False, []]]
    letters: list[int] = []

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            path[-1][1].append((letters.pop(), settle(final, arcs)))

    for word in words:
        shared = 0
        while shared < len(letters) and shared < len(word) and letters[shared] == word[shared]:
            shared += 1
        close(shared)
        for letter in word[shared:]:
            letters.append(letter)
            path.append([False, []])
        path[-1][0] = True
    close(0)
    root = settle(*path[0])
    # children are registered before their parents, so one pass counts the words below every state
    below = np.zeros(len(states), np.int64)
    keys, targets, before = [], [], []
    for state, (final, arcs) in enumerate(states):
        count = int(final)
        for letter, target in arcs:
            keys.append(state << 8 | letter)
            targets.append(target)
            before.append(count)
            count += below[target]
        below[state] = count
    pool = [np.asarray(entries[w], np.int32) for w in words]
    starts = np.cumsum([0, *map(len, pool)], dtype=np.int64)
    arrays = [
        np.asarray(keys, np.int64), np.asarray(targets, np.int32), np.asarray(before, np.int32),
        np.asarray([final for final, _ in states], np.uint8), starts, np.concatenate(pool) if pool else np.empty(0, np.int32),
    ]
    head = np.asarray([root, *map(len, arrays)], np.int64).tobytes()
    body = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)
    return MAGIC + head + body


KINDS = (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32)


class Lexicon:
    """Reader of a compiled file. `at` maps the bytes from a file of the task's own, which goes when the mapping does."""

    def __init__(self, data: np.ndarray):
        if data[:8].tobytes() != MAGIC:
            raise ValueError("not a lexicon file")
        self.root, *sizes = data[8:64].view(np.int64).tolist()
        place, arrays = 64, []
        for kind, size in zip(KINDS, sizes):
            n = size * np.dtype(kind).itemsize
            arrays.append(np.asarray(data[place : place + n]).view(kind))
            place += n + -n % 8
        self.keys, self.targets, self.before, self.final, self.starts, self.pool = arrays

    @classmethod
    def at(cls, blob: bytes) -> Lexicon:
        with tempfile.NamedTemporaryFile(prefix="lexicon-") as f:  # the name goes at once, the pages with the mapping
            f.write(blob)
            f.flush()
            return cls(np.memmap(f.name, np.uint8, "r"))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in sorted order, -1 for unknown ones."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths > 0)
        state = np.full(n, self.root, np.int64)
        place = np.zeros(n, np.int64)
        depth = 0
        while len(live):
            key = state[live] << 8 | flat[starts[live] + depth]
            arc = np.searchsorted(self.keys, key)
            known = self.keys[np.minimum(arc, len(self.keys) - 1)] == key
            live, arc = live[known], arc[known]
            state[live] = self.targets[arc]
            place[live] += self.before[arc]
            depth += 1
            ended = lengths[live] == depth
            done = live[ended]
            done = done[self.final[state[done]] == 1]
            out[done] = place[done]
            live = live[~ended]
        return out

    def ids(self, places: np.ndarray) -> list[bytes]:
        """Ids of known places, as bytes of 32-bit integers."""
        pool = memoryview(self.pool).cast("B")
        return [bytes(pool[a:b]) for a, b in zip((4 * self.starts[places]).tolist(), (4 * self.starts[places + 1]).tolist())]
