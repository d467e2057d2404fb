"""Benchmark decontamination with spaced seeds.

A seed mask selects some of the tokens of a short stretch and ignores the others, so a seed still matches when an ignored
token was replaced. The two masks below are lossless for the rule that is applied: any stretch of 13 tokens with at most
two replaced ones contains an untouched seed of one of them. A hit fixes an alignment; tokens around it are then compared
position by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stable
from . import words as w
from .tables import FILTER_BITS, bit_filter, passes

STRETCH, REPLACED = 13, 2
SHORTEST = 4  # tokens of an item that is looked for inside other text
MASKS = ("11101011", "11001111")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that share a stretch.

    Tokens are runs of ASCII letters, digits and other code points above 127, A-Z lower-cased; punctuation and blanks separate.
    A stretch is ``STRETCH`` consecutive tokens on each side of which at most ``REPLACED`` differ. ``matched`` counts the item's
    tokens that agree within such stretches on the best alignment, ``overlap`` is their share of ``item_tokens``; ``doc_start``
    and ``item_start`` are the first token of the first stretch there. Ties take the earliest alignment.

    An item shorter than a stretch is matched as a whole and without replacements; with fewer than ``SHORTEST`` tokens, only by a
    text that has no others. Null and empty texts share nothing. Rows without id are left out on both sides. Items with
    equal tokens are compared once, and each is reported. Rows that share a document id are compared one by one; the best
    counts. An empty table on either side gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.filter(benchmark[item_col].isNotNull()).select(benchmark[item_col].alias("item_id"), benchmark[item_text_col].alias("text"))
    item_kind = items.schema["item_id"].dataType.simpleString()
    coded = stable(items.mapInArrow(_items, f"item_id {item_kind}, digest long, tokens binary, seeds array<long>"))
    unique = stable(coded.groupBy("digest").agg(F.first("tokens").alias("item"), F.first("seeds").alias("seeds")))
    seeds = stable(unique.select("digest", F.posexplode("seeds").alias("at", "seed"))
                   .select("digest", "seed", F.expr(f"at div {len(MASKS)}").cast("int").alias("item_at")))
    sizes = [r["size"] for r in unique.select((F.length("item") / 8).cast("int").alias("size")).filter(F.col("size").between(1, STRETCH - 1)).distinct().collect()]  # at most 12
    reach = unique.agg(F.max(F.length("item"))).first()[0]
    wanted = bit_filter(seeds.select(F.expr(f"cast(seed & {(1 << FILTER_BITS) - 1} as int)").alias("bit")))
    source = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    regions = stable(source.mapInArrow(lambda b: _regions(b, wanted, (reach or 0) // 8, sizes),
                                       f"doc_id {kind}, region long, first_token long, tokens binary, hits array<struct<at:int,seed:long>>"))
    hits = regions.select("doc_id", "region", F.explode("hits").alias("hit")).select("doc_id", "region", "hit.*")
    lines = hits.join(seeds, "seed").select("doc_id", "region", "digest", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = (lines.join(regions.select("doc_id", "region", "first_token", "tokens"), ["doc_id", "region"])
             .join(unique.select("digest", "item"), "digest"))
    checked = pairs.select("doc_id", "digest", "first_token", "shift", "tokens", "item").mapInArrow(
        _compare, f"doc_id {kind}, digest long, doc_start long, item_start long, matched long, item_tokens long")
    best = checked.groupBy("doc_id", "digest").agg(
        F.max(F.struct("matched", (-F.col("doc_start")).alias("early"), (-F.col("item_start")).alias("low"), "item_tokens")).alias("m"))
    return best.join(coded.select("item_id", "digest").distinct(), "digest").select(
        "doc_id", "item_id", F.col("m.matched").alias("matched"), F.col("m.item_tokens").alias("item_tokens"),
        (F.col("m.matched") / F.col("m.item_tokens")).alias("overlap"),
        (-F.col("m.early")).alias("doc_start"), (-F.col("m.low")).alias("item_start"))


def _seeds(words: w.Spans) -> tuple[np.ndarray, np.ndarray]:
    """First word of each mask position inside a text, and the seeds there, one column per mask."""
    span = max(map(len, MASKS))
    at, _ = w.windows(words, span)
    columns = []
    for k, mask in enumerate(MASKS):
        value = np.full(len(at), k + 1, np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                value = w.mix(value + words.hash[at + j])
        columns.append(value)
    return at, np.stack(columns, 1)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in w.blocks(batches):
        words = block.spans(w.PUNCTUATION, lower=True)
        at, seed = _seeds(words)
        first = np.searchsorted(at, words.first)
        total = w.rolling(words)
        digest, tokens, seeds = [], [], []
        for d in range(len(block)):
            own = words.hash[words.first[d]:words.first[d + 1]]
            value = np.uint64(len(own))
            with np.errstate(over="ignore"):
                summed = np.add.reduce(w.mix(own + np.arange(len(own), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))) if len(own) else np.uint64(0)
                digest.append(w.mix(np.array([value + summed], np.uint64)).view(np.int64)[0])
            tokens.append(own.tobytes())
            seeds.append(seed[first[d]:first[d + 1]].ravel().view(np.int64) if len(own) >= STRETCH else whole(words, total, d))
        yield pa.RecordBatch.from_arrays([block.rows.column("item_id"), pa.array(digest, pa.int64()), pa.array(tokens, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))],
                                         ["item_id", "digest", "tokens", "seeds"])


def whole(words: w.Spans, total: np.ndarray, d: int) -> np.ndarray:
    """The one seed of a short item: the hash of all its tokens."""
    low, high = int(words.first[d]), int(words.first[d + 1])
    if low == high:
        return np.zeros(0, np.int64)
    return w.mix((total[high:high + 1] - total[low:low + 1]) * w.powers(len(words.hash), False)[low:low + 1] + np.uint64(high - low)).view(np.int64)


def _short(words: w.Spans, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of runs as long as the short items."""
    total = w.rolling(words)
    out = []
    for size in sizes:
        at, value = w.rolled(words, total, size)
        if size < SHORTEST:
            alone = np.repeat(np.diff(words.first) == size, np.diff(words.first))[at]
            at, value = at[alone], value[alone]
        out.append((at, value))
    return out


def _regions(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, reach: int, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Stretches of a document around seeds that may be the benchmark's: all tokens within the longest item's length."""
    for block in w.blocks(batches):
        words = block.spans(w.PUNCTUATION, lower=True)
        at, seed = _seeds(words)
        places = [(np.repeat(at, len(MASKS)), seed.ravel()), *_short(words, sizes)]
        at, seed = np.concatenate([a for a, _ in places]), np.concatenate([s for _, s in places])
        maybe = passes(wanted, (seed & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64))
        at, seed = at[maybe], seed[maybe].view(np.int64)
        order = np.argsort(at, kind="stable")
        at, seed = at[order], seed[order]
        owner = words.owner()[at] if len(at) else at
        ids, region, first, tokens, hits = [], [], [], [], []
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > 2 * reach)) + 1 if len(at) else []
        for own_at, own_seed in zip(np.split(at, cut), np.split(seed, cut), strict=True):
            if not len(own_at):
                continue
            d = int(np.searchsorted(words.first, own_at[0], "right")) - 1
            low, high = max(words.first[d], own_at[0] - reach), min(words.first[d + 1], own_at[-1] + reach)
            ids.append(d)
            region.append(int(words.hash[low:high].sum(dtype=np.uint64).view(np.int64)))
            first.append(int(low - words.first[d]))
            tokens.append(words.hash[low:high].tobytes())
            hits.append([{"at": int(a), "seed": int(s)} for a, s in zip(own_at - low, own_seed, strict=True)])
        # a region is known by its place and its tokens, also where rows repeat
        key = [(f * 0x9E3779B1 + r) % (1 << 62) for f, r in zip(first, region, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [block.rows.column("doc_id").take(pa.array(ids, pa.int32())), pa.array(key, pa.int64()), pa.array(first, pa.int64()), pa.array(tokens, pa.binary()),
             pa.array(hits, pa.list_(pa.struct([("at", pa.int32()), ("seed", pa.int64())])))], ["doc_id", "region", "first_token", "tokens", "hits"])


def aligned(tokens: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """Item position of the first good stretch when item token 0 lies at ``shift``, and agreeing tokens inside good stretches."""
    low, high = max(0, -shift), min(len(item), len(tokens) - shift)
    if len(item) < STRETCH:
        return 0, len(item) if high - low == len(item) and (tokens[shift:shift + len(item)] == item).all() else 0
    if high - low < STRETCH:
        return 0, 0
    same = tokens[low + shift:high + shift] == item[low:high]
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[STRETCH:] - total[:-STRETCH] >= STRETCH - REPLACED)
    if not len(good):
        return 0, 0
    step = np.zeros(len(same) + 1, np.int64)
    np.add.at(step, good, 1)
    np.add.at(step, good + STRETCH, -1)
    return low + int(good[0]), int((same & (np.cumsum(step[:-1]) > 0)).sum())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, out = [], []
        for i, (base, shift, tokens, item) in enumerate(zip(*(batch.column(c) for c in ("first_token", "shift", "tokens", "item")), strict=True)):
            own = np.frombuffer(item.as_buffer(), np.uint64)
            start, matched = aligned(np.frombuffer(tokens.as_buffer(), np.uint64), own, shift.as_py())
            if matched:
                rows.append(i)
                out.append((base.as_py() + shift.as_py() + start, start, matched, len(own)))
        columns = np.array(out, np.int64).reshape(-1, 4)
        kept = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(kept), batch.column("digest").take(kept), *(pa.array(columns[:, k].copy()) for k in range(4))],
                                         ["doc_id", "digest", "doc_start", "item_start", "matched", "item_tokens"])
