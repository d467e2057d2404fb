"""Quality rules: characters inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as w

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])

COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "line_coverage double, ngram_coverage array<double>, kept boolean")


@dataclass(frozen=True)
class Limits:
    """``coverage``: (words in an n-gram, largest share of word characters inside later occurrences of such n-grams).

    n-grams have at least three words. ``lines``: largest share of word characters on lines that repeat an earlier line.
    """

    coverage: tuple[tuple[int, float], ...] = ((5, 0.15), (7, 0.13), (10, 0.10))
    lines: float = 0.30
    min_words: int = 50
    repeat_words: float = 0.50


def repetition(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, counts, shares and the verdict ``kept``. Other input columns are left out.

    Row-local: no shuffle. A null or empty text has zero counts and fails (fewer than ``min_words`` words); a null id is passed
    through; repeated rows give repeated results. A share of a text without word characters is 0. A share equal to its limit
    passes. Lines are compared byte by byte, words too (case matters).
    """
    if any(n < 3 for n, _ in limits.coverage):
        raise ValueError("n-grams need three words or more")
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda batches: _measure(batches, limits), f"doc_id {kind}, {COLUMNS}")


def _measure(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    for block in w.blocks(batches):
        words = block.words()
        owner = words.owner()
        whole = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum((block.data & 0xC0) != 0x80, out=whole[1:])
        chars = whole[words.end] - whole[words.start]
        n_words, word_chars = np.diff(words.first), w.sums(chars, words.first)

        dup_lines, line_chars = _lines(block, words, chars)
        total = w.rolling(words)
        base, twice, _ = _covered(words, total, owner, 3, None)
        shares = []
        for n, _ in limits.coverage:
            # an n-gram can only repeat where all the trigrams in it do
            _, _, later = _covered(words, total, owner, n, twice)
            shares.append(w.sums(chars * later, words.first) / np.maximum(word_chars, 1))
        repeat = w.sums(base, words.first)
        failed = (n_words < limits.min_words) | (repeat > limits.repeat_words * n_words)
        line_share = line_chars / np.maximum(word_chars, 1)
        good = line_share <= limits.lines
        for (_, most), share in zip(limits.coverage, shares, strict=True):
            good &= share <= most
        flat = np.stack(shares, 1).ravel() if shares else np.zeros(0)
        symbols = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum(SYMBOLS[block.data], out=symbols[1:])
        yield pa.RecordBatch.from_arrays(
            [block.rows.column("doc_id"), *map(pa.array, (n_words, word_chars, np.diff(symbols[block.offsets]), dup_lines, repeat, failed, line_share)),
             pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * len(shares), pa.int32()), pa.array(flat)), pa.array(good & ~failed)],
            ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_coverage", "ngram_coverage", "kept"])


def _covered(words: w.Spans, prefix: np.ndarray, owner: np.ndarray, n: int, within: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: inside any repeated n-gram; is the first word of one; inside a later occurrence of one."""
    total = len(words.hash)
    at, value = w.rolled(words, prefix, n)
    if within is not None:
        run = np.zeros(total + 1, np.int64)
        np.cumsum(within, out=run[1:])
        able = run[at + n - 2] - run[at] == n - 2
        at, value = at[able], value[able]
    twice, later = w.repeated(w.keyed(value, owner[at]))
    starts = np.zeros(total, bool)
    starts[at[twice]] = True
    return _spread(at[twice], n, total), starts, _spread(at[later], n, total)


def _spread(at: np.ndarray, n: int, total: int) -> np.ndarray:
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def _lines(block: w.Block, words: w.Spans, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and the word characters on them."""
    lines = block.spans(w.NEWLINE)
    low, high = np.searchsorted(words.start, lines.start), np.searchsorted(words.start, lines.end)
    _, later = w.repeated(w.keyed(lines.hash, lines.owner()))
    later &= high > low
    total = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=total[1:])
    return w.sums(later, lines.first), w.sums(later * (total[high] - total[low]), lines.first)
