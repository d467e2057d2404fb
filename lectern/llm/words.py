"""Words of many texts at once, in numpy on the buffers of an Arrow batch.

A batch is cut into blocks of a megabyte (a longer text is a block of its own), so working memory does not depend on
the number of rows in a batch. Words never cross texts. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and digits and every byte of a longer code point are word bytes here, the rest separates.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
NEWLINE = np.arange(256) == 10

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def powers(n: int, forward: bool) -> np.ndarray:
    """The first ``n`` powers of the hash base, or of its inverse, modulo 2**64."""
    have = _powers[forward]
    if len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, _BASE if forward else _BACK)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * BLOCK_BYTES:
            _powers[forward] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits after which all bits look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Spans:
    """Byte spans ``start``..``end`` with the hash of their bytes; text ``d`` owns spans ``first[d]``..``first[d+1]``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


@dataclass
class Block:
    """Consecutive texts: their bytes, and where each begins and ends."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spans(self, separator: np.ndarray, lower: bool = False) -> Spans:
        """Maximal runs of bytes that are no separators."""
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        if n == 0:
            none = np.zeros(0, np.int64)
            return Spans(none, none, np.zeros(0, np.uint64), np.zeros(len(self.offsets), np.int64))
        inside = ~separator[data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        after = np.empty(n, bool)
        after[0] = False
        after[1:] = inside[:-1]
        start = np.flatnonzero(inside & ~(after & ~edge[:-1]))
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        return Spans(start, end, hashed(data, start, end), np.searchsorted(start, self.offsets))

    def words(self, lower: bool = False) -> Spans:
        return self.spans(BLANK, lower)

    def units(self, words: Spans) -> Spans:
        """The words with the blanks before them, and the blanks that end a text: together they are the texts."""
        edge = np.zeros(len(self.data) + 1, bool)
        edge[words.end] = True
        edge[self.offsets] = True
        cut = np.flatnonzero(edge)
        return Spans(cut[:-1], cut[1:], hashed(self.data, cut[:-1], cut[1:]), np.searchsorted(cut, self.offsets))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``start`` to ``end``."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n, True), out=total[1:])
    value = (total[end] - total[start]) * powers(n + 1, False)[start]
    return mix(value + (end - start).astype(np.uint64))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    for batch in batches:
        texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        n = len(texts)
        if n == 0:
            continue
        _, place, raw = texts.buffers()
        offsets = np.frombuffer(place, np.int64)[texts.offset:texts.offset + n + 1]
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, n)
            yield Block(batch.slice(at, to - at), whole[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
            at = to
    pa.default_memory_pool().release_unused()  # a worker stays for other tasks, beside other processes


def windows(words: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of every run of ``n`` words within a text."""
    total = len(words.hash)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(words.first[1:], np.diff(words.first))
    at = np.flatnonzero(np.arange(total) + n <= last)
    value = np.zeros(len(at), np.uint64)
    for j in range(n):
        value = (value + words.hash[at + j]) * _BASE
        value ^= value >> np.uint64(32)
    return at, mix(value)


def rolling(words: Spans) -> np.ndarray:
    """Prefix sums from which the hash of any run of words follows by one subtraction and one multiplication; see ``rolled``."""
    total = np.zeros(len(words.hash) + 1, np.uint64)
    np.cumsum(words.hash * powers(len(words.hash), True), out=total[1:])
    return total


def rolled(words: Spans, total: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``windows``, from the prefix sums of all words: the cost does not depend on ``n``."""
    last = np.repeat(words.first[1:], np.diff(words.first))
    at = np.flatnonzero(np.arange(len(words.hash)) + n <= last)
    return at, mix((total[at + n] - total[at]) * powers(len(words.hash), False)[at] + np.uint64(n))


def keyed(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that only agree within one owner."""
    return mix(value + (owner.astype(np.uint64) + np.uint64(1)) * _BASE)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether its key occurs elsewhere, and whether it occurred earlier."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice, later = np.empty(len(key), bool), np.empty(len(key), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later
