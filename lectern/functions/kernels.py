"""The few Arrow kernels for semantics the JVM functions lack. Each handles one value at a time and keeps no state."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


@F.pandas_udf(T.StringType())
def unescape_compose(values: pd.Series) -> pd.Series:
    """Character references decoded, then NFC."""
    return values.map(lambda v: unicodedata.normalize("NFC", html.unescape(v)), na_action="ignore")


@F.pandas_udf(T.StringType())
def fold_compatible(values: pd.Series) -> pd.Series:
    """NFKC, letters and digits only, lower-cased; a capital sigma is the same letter wherever it stands."""
    def fold(value: str) -> str:
        return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", value)).replace("\u03a3", "\u03c3").lower()
    return values.map(fold, na_action="ignore")


DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])


@F.pandas_udf(DECODED)
def decode_legacy(contents: pd.Series) -> pd.DataFrame:
    """Bytes that are neither UTF-8 nor marked UTF-16: GB18030, then a statistical guess, else null."""
    def guess(data):
        if data is None:
            return None, None
        data = bytes(data)
        try:
            return data.decode("gb18030"), "gb18030"
        except UnicodeDecodeError:
            pass
        try:
            from charset_normalizer import from_bytes
        except ImportError:
            return None, None
        best = from_bytes(data).best()
        return (str(best), best.encoding) if best is not None else (None, None)
    return pd.DataFrame([guess(data) for data in contents], columns=["text", "encoding"])


def decode_as(encoding: str):
    """Strict decoding under a named encoding; undecodable bytes give null."""
    @F.pandas_udf(T.StringType())
    def decode(contents: pd.Series) -> pd.Series:
        def one(data):
            try:
                return bytes(data).decode(encoding)
            except UnicodeDecodeError:
                return None
        return contents.map(one, na_action="ignore")
    return decode


class _Extractor(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in fixed.DROPPED_ELEMENTS:
            self.hidden.append(tag)
        elif not self.hidden and (tag == "br" or tag in fixed.BLOCK_ELEMENTS):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden and self.hidden.pop() != tag:
                pass
        elif not self.hidden and tag in fixed.BLOCK_ELEMENTS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


@F.pandas_udf(T.StringType())
def html_text_strict(values: pd.Series) -> pd.Series:
    """Text extraction with an HTML tokenizer instead of patterns."""
    def extract(value: str) -> str:
        parser = _Extractor()
        parser.feed(re.sub(r"<\?xml[^>]*\?>", "", value))
        parser.close()
        return "".join(parser.out)
    return values.map(extract, na_action="ignore")


EDITS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("insertions", "deletions", "substitutions")])


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance with a column of the table held in the bits of two integers: a handful of operations on whole columns for each
    character of ``b``."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for i, char in enumerate(b):
        places[char] = places.get(char, 0) | 1 << i
    all_bits, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    more, less, distance = all_bits, 0, len(b)  # bits whose cell is one more, one less, than the cell above
    for char in a:
        equal = places.get(char, 0)
        vertical = equal | less
        flat = (((equal & more) + more) ^ more) | equal
        up, down = less | ~(flat | more) & all_bits, more & flat
        distance += bool(up & top) - bool(down & top)
        up = up << 1 | 1
        more = (down << 1 | ~(vertical | up)) & all_bits
        less = up & vertical & all_bits
    return distance


@F.pandas_udf(T.IntegerType())
def distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


GUESS = 32  # edits beyond the difference of lengths that a first band has room for
BLOCK = 1 << 15  # cells of the rows that are filled together


def edit_counts(reference: str, hypothesis: str) -> tuple[int, int, int]:
    """Insertions, deletions, substitutions of one optimal alignment, preferring substitutions on ties."""
    return edit_counts_of([(reference, hypothesis)])[0]


def edit_counts_of(pairs: list[tuple[str, str]]) -> list[tuple[int, int, int]]:
    """``edit_counts`` of many pairs. What both texts of a pair begin and end with takes no edits and is left out.

    Only cells that an alignment of few edits can pass are filled: a band around the diagonal. A result that needs more edits than the band has room
    for is not certain; the band is then as wide as the known distance takes.
    """
    out: list = [None] * len(pairs)
    todo: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    for at, (a, b) in enumerate(pairs):
        short = min(len(a), len(b))
        start = 0
        while start < short and a[start] == b[start]:
            start += 1
        end = 0
        while end < short - start and a[-1 - end] == b[-1 - end]:
            end += 1
        a, b = a[start:len(a) - end], b[start:len(b) - end]
        if not a or not b:
            out[at] = len(b), len(a), 0
        else:
            todo[at] = _points(a), _points(b), abs(len(a) - len(b)) + min(GUESS, 2 * min(len(a), len(b)))
    for last in (False, True):
        wider = {}
        for members in _alike(todo):
            counts = _in_band([todo[at][:2] for at in members], [todo[at][2] for at in members])
            for at, own in zip(members, counts):
                if sum(own) <= todo[at][2] or last:
                    out[at] = own
                else:
                    a, b = todo[at][:2]
                    wider[at] = a, b, edit_distance(*(x.tobytes().decode("utf-32-le", "surrogatepass") for x in (a, b)))
        todo = wider
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _alike(todo: dict[int, tuple[np.ndarray, np.ndarray, int]]) -> list[list[int]]:
    """Pairs whose bands have about the same width and length, in blocks of bounded size; a larger pair is a block of its own."""
    blocks: list[list[int]] = []
    kind, width, longest = None, 0, 0
    for at in sorted(todo, key=lambda i: (todo[i][2].bit_length(), len(todo[i][0]))):
        a, _, most = todo[at]
        if kind != most.bit_length() or len(a) > longest or (len(blocks[-1]) + 1) * max(width, most + 1) > BLOCK:
            blocks.append([])
            kind, width, longest = most.bit_length(), 0, len(a) + len(a) // 4 + 16
        width = max(width, most + 1)
        blocks[-1].append(at)
    return blocks


def _in_band(pairs: list[tuple[np.ndarray, np.ndarray]], most: list[int]) -> list[tuple[int, int, int]]:
    """The table of each pair, a row at a time for all of them, in a band that has room for ``most`` edits of each.

    A cell packs (distance, insertions), so the split follows from the distance and the length difference. Cells right of a text's end or below
    it are filled as well; no way from them leads back.
    """
    # column minus row stays within these, or the steps aside and back would exceed the distance
    left = max((k - (len(b) - len(a))) // 2 for (a, b), k in zip(pairs, most))
    right = max((k + (len(b) - len(a))) // 2 for (a, b), k in zip(pairs, most))
    width, rows, size = left + right + 1, max(len(a) for a, _ in pairs), len(pairs)
    scale = np.int64(max(len(a) + len(b) for a, b in pairs) + width + 1)
    far = scale * scale * 4
    source = np.full((rows, size), 0xFFFFFFFE, np.uint32)
    target = np.full((left + rows + right + 1, size), 0xFFFFFFFF, np.uint32)  # of column j at left + j
    for p, (a, b) in enumerate(pairs):
        source[:len(a), p] = a
        kept = b[:rows + right]
        target[left + 1:left + 1 + len(kept), p] = kept
    ends: dict[int, list[int]] = {}
    for p, (a, _) in enumerate(pairs):
        ends.setdefault(len(a), []).append(p)
    out: list = [None] * size
    # cell k of row i is column i + k - left, less k insertions, so a row's insertions are a running minimum; below the last is one never reached
    row = np.full((width + 1, size), far, np.int64)
    row[left:width] = -left * (scale + 1)
    cost, below = np.empty((width, size), np.int64), np.empty((width, size), np.int64)
    for i in range(1, rows + 1):
        np.multiply(target[i:i + width] != source[i - 1], scale, out=cost)
        cost += row[:-1]
        np.add(row[1:], 2 * scale + 1, out=below)
        np.minimum(cost, below, out=cost)
        if i <= left:
            cost[:left - i] = far
            cost[left - i] = i * scale - (left - i) * (scale + 1)
        if size > 1:
            np.minimum.accumulate(cost, axis=0, out=row[:-1])
        else:
            np.minimum.accumulate(cost[:, 0], out=row[:-1, 0])
        for p in ends.get(i, ()):
            a, b = pairs[p]
            cell = len(b) - len(a) + left
            distance, insertions = divmod(int(row[cell, p]) + cell * int(scale + 1), int(scale))
            deletions = insertions - (len(b) - len(a))
            out[p] = insertions, deletions, distance - insertions - deletions
    return out


@F.pandas_udf(EDITS)
def edit_operations(references: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
    given = [r is not None and h is not None for r, h in zip(references, hypotheses)]
    counts = iter(edit_counts_of([pair for pair, known in zip(zip(references, hypotheses), given) if known]))
    return pd.DataFrame([next(counts) if known else (None, None, None) for known in given], columns=["insertions", "deletions", "substitutions"])
