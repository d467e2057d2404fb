"""Language identification with hyperdimensional profiles.

Every symbol has a random vector of -1 and 1. A trigram is its three vectors, rotated by two, one and no places, multiplied
element by element; a text is the sum over its trigrams, a language the sum over its texts. A text gets the language whose
sum has the largest cosine with its own. The prototypes are fitted on the labelled rows that are passed for it; a prediction
looks at the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .tables import fresh

UNDETERMINED = "und"
ROWS, CHUNK = 128, 2048
HELD = 1 << 19  # trigrams with counts that a task holds before it gives them out
POINT = 21  # bits of a code point; three make the key of a trigram


@dataclass(frozen=True)
class Profiles:
    """Prototypes as rows of a matrix, in the order of ``languages``: at most ``Size.languages`` by ``Size.dimensions`` numbers."""

    languages: tuple[str, ...]
    matrix: np.ndarray


@dataclass(frozen=True)
class Size:
    """``languages`` bounds what reaches the driver: more of them is an error, as a larger table of prototypes would be. ``dimensions`` are a
    multiple of 64."""

    dimensions: int = 1024
    languages: int = 2000


def fit(labelled: DataFrame, size: Size = Size(), text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Prototypes from all rows with a language. Rows without text add nothing; a language that has no letter is not learned.

    Trigram counts are added up on the executors; the driver gets one vector for each language.
    """
    source = labelled.filter(labelled[lang_col].isNotNull()).select(labelled[lang_col].cast("string").alias("lang"), labelled[text_col].alias("text"))
    counts = source.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # one row of partial sums for each language and task
    partial = counts.mapInArrow(lambda b: _bundle(b, size.dimensions), "lang string, at int, value long")
    sums = partial.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v")).limit(size.languages + 1).collect()
    if len(rows) > size.languages:
        raise ValueError(f"more than {size.languages} languages")
    rows = sorted(rows, key=lambda r: r["lang"])
    matrix = np.array([[x["value"] for x in r["v"]] for r in rows], np.float64).reshape(len(rows), size.dimensions)
    norm = np.linalg.norm(matrix, axis=1)
    good = norm > 0
    return Profiles(tuple(r["lang"] for r, g in zip(rows, good, strict=True) if g), (matrix[good] / norm[good, None]).astype(np.float32))


def identify(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = (), text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep``, then the language and the score (the cosine, negative ones as 0) under ``names``, one row per input row.

    ``und`` with score 0 where the text is null, empty or has no letter, or no language was learned. A tie goes to the first
    language in sorted order. Row-local.
    """
    hidden = fresh("_text", keep)
    source = docs.select(*[docs[c].alias(c) for c in keep], docs[text_col].alias(hidden))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(lambda b: _predict(b, profiles, list(keep), names, hidden), f"{schema}{', ' if keep else ''}`{names[0]}` string, `{names[1]}` double")


def symbols(block: w.Block) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the lower-cased texts and where each text's begin.

    0 stands for a run of non-letters (there is one at both ends), every letter for itself.
    """
    parts, first = [], np.zeros(len(block) + 1, np.int64)
    raw = block.data.tobytes()
    for d in range(len(block)):
        text = raw[block.offsets[d]:block.offsets[d + 1]].decode("utf-8", "replace").lower()
        points = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
        parts.append(points)
        first[d + 1] = first[d] + len(points)
    points = np.concatenate(parts)
    code = CODES[np.minimum(points, len(CODES) - 1)]
    rare = np.flatnonzero(points >= len(CODES) - 1)
    if len(rare):
        code[rare] = [_code(int(p)) for p in points[rare]]
    keep = (code != 0) | np.concatenate([[True], code[:-1] != 0])
    keep[first[:-1]] = True
    return code[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def _code(point: int) -> int:
    return point if chr(point).isalpha() else 0


CODES = np.array([_code(p) for p in range(0x3000)] + [0], np.int64)


def letters(points: np.ndarray, dimensions: int) -> np.ndarray:
    """The vector of each code point: bits of hashes of the point and the place, as -1 and 1."""
    place = np.arange(dimensions // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        words = w.mix(w.mix(points.astype(np.uint64) + np.uint64(0x51ED270B))[:, None] + place * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(words.view(np.uint8).reshape(len(points), dimensions // 8), axis=1).astype(np.int8) * 2 - 1


def _vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    points, spot = np.unique(np.stack([grams >> 2 * POINT, grams >> POINT, grams]) & (1 << POINT) - 1, return_inverse=True)
    own = letters(points, dimensions)
    a, b, c = spot.reshape(3, -1)
    return np.roll(own, 2, 1)[a] * np.roll(own, 1, 1)[b] * own[c]


def _grams(block: w.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of all texts, where each text's begin, and whether the text has a letter. The last two of a text reach into the next."""
    code, first = symbols(block)
    gram = np.zeros(len(code), np.int64)
    if len(code) > 2:
        gram[:-2] = (code[:-2] << POINT | code[1:-1]) << POINT | code[2:]
    return gram, first, w.sums(code != 0, first) > 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language, given out whenever many have gathered and at the end of a task."""
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for lang, (gram, n) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(gram), np.int32))), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])
        totals.clear()

    for block in w.blocks(batches):
        gram, first, _ = _grams(block)
        own: dict[str, list[np.ndarray]] = {}
        for d, lang in enumerate(block.rows.column("lang").to_pylist()):
            own.setdefault(lang, []).append(gram[first[d]:max(first[d], first[d + 1] - 2)])
        for lang, parts in own.items():
            new, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in totals:
                old, before = totals[lang]
                new, back = np.unique(np.concatenate([old, new]), return_inverse=True)
                n = np.rint(np.bincount(back, np.concatenate([before, n]))).astype(np.int64)
            totals[lang] = new, n
        size = sum(len(g) for g, _ in totals.values())
        if size > HELD:
            yield from given()
    yield from given()


def _bundle(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        gram, n = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
        langs = np.array(batch.column("lang").to_pylist(), object)
        for at in range(0, len(gram), 4096):
            own = _vectors(gram[at:at + 4096], dimensions).astype(np.float64)
            for lang in set(langs[at:at + 4096]):
                here = langs[at:at + 4096] == lang
                total = n[at:at + 4096][here] @ own[here]
                totals[lang] = totals.get(lang, 0) + np.rint(total).astype(np.int64)
    for lang, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions), pa.int32()), pa.array(total)], ["lang", "at", "value"])


def _predict(batches: Iterator[pa.RecordBatch], profiles: Profiles, keep: list[str], out: tuple[str, str], text_col: str) -> Iterator[pa.RecordBatch]:
    names = np.array([*profiles.languages, UNDETERMINED], object)
    dimensions = profiles.matrix.shape[1]
    for block in w.blocks(batches, text_col):
        gram, first, letters = _grams(block)
        n = len(block)
        best, score = np.full(n, len(names) - 1), np.zeros(n)
        if len(profiles.languages):
            inside = np.ones(len(gram), bool)
            inside[first[1:] - 1] = inside[first[1:] - 2] = False  # a text has two symbols at least, its ends
            owner = np.repeat(np.arange(n), np.diff(first))[inside]
            place = gram[inside]
            for at in range(0, n, ROWS):
                to = min(n, at + ROWS)
                low, high = np.searchsorted(owner, (at, to))
                known, column = np.unique(place[low:high], return_inverse=True)
                order = np.argsort(column, kind="stable")
                row, column = owner[low:high][order] - at, column[order]
                bundle = np.zeros((to - at, dimensions), np.float32)
                for part in range(0, len(known), CHUNK):
                    size = min(CHUNK, len(known) - part)
                    own = slice(*np.searchsorted(column, (part, part + size)))
                    counts = np.bincount(row[own] * size + column[own] - part, minlength=(to - at) * size).reshape(to - at, size).astype(np.float32)
                    bundle += counts @ _vectors(known[part:part + size], dimensions).astype(np.float32)
                cosine = bundle @ profiles.matrix.T / np.maximum(np.linalg.norm(bundle, axis=1), 1e-30)[:, None]
                best[at:to] = cosine.argmax(1)
                score[at:to] = np.clip(cosine.max(1), 0, 1)
            best[~letters], score[~letters] = len(names) - 1, 0
        yield pa.RecordBatch.from_arrays([*(block.rows.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(score)], [*keep, *out])
