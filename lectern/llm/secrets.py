"""Secret scan: fixed patterns, and strings that look random by a battery of tests.

A candidate is a maximal run of key characters outside base spans, or a part of it between separators, that mixes kinds of
characters. Its encoding is the smallest alphabet that holds it. Of candidates that overlap, the one least likely to be ordinary
counts, and its p-value is multiplied by the number tested in the run. Three statistics look for order that random strings in that encoding do not have: a chi-squared statistic of the symbol
counts, the number of runs above and below the middle of the alphabet, and the serial correlation of neighbours. A candidate
that fails them is ordinary. For the others the hypothesis to reject is "an ordinary string of this length happens to look as
even as this": its p-value falls with length, so short strings cannot be discovered by luck. Discoveries are then held to
a false-discovery rate (Benjamini and Hochberg) within each encoding and class of length, over the whole table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable
from . import words as w

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Parts of a candidate: without the signs of the one or the other base64 alphabet, segments of a path, letters and digits alone.
PARTS = [re.compile(r"[A-Za-z0-9" + signs + r"]{20,}={0,2}") for signs in ("+/", "_-", "+_-", "")]
#: Encodings from the smallest alphabet to the largest; the order of symbols is that of their values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
BIN = 0.05  # width of the classes of -log10 p
FAILED = -1


@dataclass(frozen=True)
class Battery:
    """``order``: smallest p-value of a random string in the combined tests; ``rate``: false discoveries among discoveries;
    ``effective``: symbols an ordinary string seems to be drawn from, as a share of its alphabet."""

    order: float = 0.01
    rate: float = 0.01
    effective: float = 0.30


def scan(docs: DataFrame, battery: Battery = Battery(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base, spans``, one row per input row.

    ``base`` and ``spans`` are arrays of ``kind, start, end`` (code points, end exclusive) ordered by start, then kind; ``spans``
    adds random-looking strings that overlap no base span. A null or empty text has none. A null id is passed through; rows that
    repeat are judged one by one. A pattern's match whose value is too short is dropped and still uses up its characters.
    Tied p-values are discovered together.
    """
    found = stable(_found(docs, battery, id_col, text_col))
    cuts = _cuts(found, battery)
    cut = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]) if cuts else F.lit(None).cast("map<string,int>")
    added = F.transform(F.filter("maybe", lambda m: F.coalesce(m["level"] >= F.try_element_at(cut, m["stratum"]), F.lit(False))),
                        lambda m: F.struct(F.lit("random").alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    return found.withColumn("added", added).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.size("added").cast("long").alias("n_random"), "base",
        F.array_sort(F.concat("base", "added"), order).alias("spans"))


def joined(spans: Column | str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]", battery: Battery = Battery(), text_col: str = "text") -> DataFrame:
    """``docs`` with every span that ``scan`` finds replaced by ``mark``; overlapping spans are replaced together. Other columns stay.

    The first pass over the texts settles the false-discovery cuts, a few hundred numbers; the second rewrites each row where it lies.
    """
    cuts = _cuts(stable(_found(docs.select(F.lit(0).alias("_id"), docs[text_col].alias("_text")), battery, "_id", "_text").filter("size(maybe) > 0")), battery)
    return docs.mapInArrow(lambda b: _redact(b, cuts, mark, battery, text_col), docs.schema)


def _found(docs: DataFrame, battery: Battery, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda b: _scan(b, battery), f"doc_id {kind}, n_assign long, n_access long, n_hex long, "
                             "base array<struct<kind:string,start:int,end:int>>, maybe array<struct<start:int,end:int,stratum:string,level:int>>")


def _cuts(found: DataFrame, battery: Battery) -> dict[str, int]:
    """The smallest class of p-values that is discovered in each stratum, among all strings that were tested there. Ranks need counts alone: there are a few hundred strata,
    and a few thousand classes of p-values in each, whatever the input."""
    level = found.select(F.explode("maybe").alias("m")).groupBy("m.stratum", "m.level").agg(F.count("*").alias("n"))
    above = Window.partitionBy("stratum").orderBy(F.desc("level"))
    ranked = level.withColumn("rank", F.sum("n").over(above)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    held = ranked.filter(F.col("level") > FAILED).filter(F.pow(F.lit(10.0), -F.col("level") * BIN) * F.col("all") <= battery.rate * F.col("rank"))
    return {r["stratum"]: r["cut"] for r in held.groupBy("stratum").agg(F.min("level").alias("cut")).collect()}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds a token which mixes letters and digits, or cases beyond a capital at the front."""
    digit, small, large = (any(map(f, token)) for f in (str.isdigit, str.islower, lambda c: c.isupper()))
    if not ((digit and (small or large)) or (small and any(map(str.isupper, token[1:])))):
        return None
    body = token.rstrip("=")
    return next((name for name, symbols in ALPHABETS.items() if set(body) <= set(symbols)), None)


def _upper(z: float) -> float:
    """Upper tail of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _cube_root(x: float, mean: float, variance: float) -> float:
    """Normal score of a sum of squares with this mean and variance (Wilson and Hilferty on the fitted gamma distribution)."""
    shape = mean * mean / variance
    return ((max(x, 0) / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * 3 * math.sqrt(shape)


def battery_values(token: str, name: str, battery: Battery) -> tuple[float, float]:
    """p-value of the hypothesis "random", combined over the tests, and of "ordinary at this length"."""
    symbols = ALPHABETS[name]
    rank = np.array([symbols.index(c) for c in token.rstrip("=")])
    n, k = len(rank), len(symbols)
    counts = np.bincount(rank, minlength=k)
    chi = float((counts.astype(float) ** 2).sum() * k / n - n)
    uneven = _upper(_cube_root(chi, k - 1, 2 * (k - 1) * (n - 1) / n))
    high = rank >= k / 2
    a, b = int(high.sum()), int((~high).sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * a * b / n
    spread = 2 * a * b * max(2 * a * b - n, 0) / (n * n * (n - 1))
    ordered = math.erfc(abs(runs - mean) / math.sqrt(2 * spread)) if spread > 0 else 0.0
    centred = rank - rank.mean()
    power = float((centred ** 2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    linked = math.erfc(abs(serial + 1 / n) * math.sqrt(n) / math.sqrt(2))
    random = min(1.0, 3 * min(uneven, ordered, linked))
    # ordinary strings use their alphabet unevenly: every pair of symbols agrees 1/effective times as often as in a random one
    m = max(2.0, k * battery.effective)
    excess = (n - 1) * (k / m - 1)
    ordinary = 1 - _upper(_cube_root(chi, k - 1 + excess, 2 * (k - 1) + 4 * excess + 2 * (k / m) ** 2))
    return random, max(ordinary, 1e-300)


def candidates(text: str, base: list[tuple[str, int, int]], battery: Battery) -> Iterator[tuple[int, int, str, int]]:
    """``start, end, stratum, level`` of the strings apart from base spans that were tested; levels are classes of p-values, ``FAILED`` of those that
    do not pass for random."""
    at = 0
    for low, high in [*sorted((s, e) for _, s, e in base), (len(text), len(text))]:
        for m in CANDIDATE.finditer(text, at, max(at, low)):
            yield from sorted(_parts(text, *m.span(), battery))
        at = max(at, high)


def _parts(text: str, low: int, high: int, battery: Battery) -> Iterator[tuple[int, int, str, int]]:
    spans = {(low, high), *(m.span() for part in PARTS for m in part.finditer(text, low, high))}
    named = [(start, end, name) for start, end in spans if (name := encoding(text[start:end]))]
    tested = [(*battery_values(text[start:end], name, battery), start, end, name) for start, end, name in named]
    taken: list[tuple[int, int]] = []
    for random, ordinary, start, end, name in sorted(tested, key=lambda x: (x[1], x[2] - x[3], x[2])):
        if random >= battery.order and not any(start < e and s < end for s, e in taken):
            taken.append((start, end))
            yield start, end, f"{name}/{(end - start).bit_length()}", int(-math.log10(min(1.0, ordinary * len(tested))) / BIN)
    # what was tested and does not pass for random counts among the tests of its stratum
    for _, _, start, end, name in sorted(tested, key=lambda x: (x[2] - x[3], x[2])):
        if not any(start < e and s < end for s, e in taken):
            taken.append((start, end))
            yield start, end, f"{name}/{(end - start).bit_length()}", FAILED


def _redact(batches: Iterator[pa.RecordBatch], cuts: dict[str, int], mark: str, battery: Battery, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        out = []
        for text in batch.column(at).to_pylist():
            base = base_spans(text or "")
            spans = [(s, e) for _, s, e in base]
            spans += [(s, e) for s, e, stratum, level in candidates(text or "", base, battery) if level >= cuts.get(stratum, level + 1)]
            if spans:
                parts, done = [], 0
                for start, end in sorted(spans):
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                text = "".join(parts) + text[done:]
            out.append(text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def _scan(batches: Iterator[pa.RecordBatch], battery: Battery) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    maybe = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("level", pa.int32())])
    for block in w.blocks(batches):
        counts, base, more = [], [], []
        raw = block.data.tobytes()
        for at, to in zip(block.offsets[:-1], block.offsets[1:], strict=True):
            text = raw[at:to].decode("utf-8", "replace")
            own = base_spans(text)
            counts.append([sum(s[0] == kind for s in own) for kind in KINDS[:3]])
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own])
            more.append([dict(zip(("start", "end", "stratum", "level"), c, strict=True)) for c in candidates(text, own, battery)])
        columns = np.array(counts, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays(
            [block.rows.column("doc_id"), *(pa.array(columns[:, k].copy()) for k in range(3)), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(maybe))],
            ["doc_id", "n_assign", "n_access", "n_hex", "base", "maybe"])


