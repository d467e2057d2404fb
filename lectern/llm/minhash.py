"""Near-duplicates by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its smallest and its largest image, so half as many
hashes are evaluated. Both agree with probability equal to the Jaccard similarity. Bands of signature values are join
keys; what shares a band is confirmed on the full shingle sets.

Copies never meet pairwise. Equal sets fall together first. Of each bucket, one member (the one that shares most bands with
others) can stand for it; each text meets the best such member of its buckets. Texts that met the same one are a family; those
that are not linked with it are compared with the family in blocks. What still shares a bucket across families and
components meets in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stable
from . import words as w
from .tables import bit_filter, components, follow, passes, slot

PIECE = 1 << 16
BLOCK, CHUNK = 1 << 17, 1 << 20
ODD = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Near:
    """``words`` a shingle; ``percent`` of the union two sets must share. The band numbers lose fewer than one link in
    100,000 at a similarity of 0.8."""

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4


def near_duplicates(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    Words are separated by ASCII blanks, A-Z lower-cased. A text of fewer words than a shingle is one shingle; a text without
    words (or null) has an empty set and is linked with nothing. ``component_id`` is the smallest id reachable over links,
    ``kept`` says that the row has it. Rows that share an id count as one document. A row without id keeps its own row, with a
    null component, and is kept.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    cards = stable(source.mapInArrow(lambda b: _cards(b, near), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    full = cards.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stable(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    labels = _labels(source, full, classes, near)
    # the smallest id of a component is that of one of its classes
    lows = labels.groupBy("label").agg(F.min("node").alias("low"))
    named = labels.join(lows, "label").select("node", "low")
    home = (classes.join(named, F.col("rep") == F.col("node"), "left")
            .select("d1", "d2", F.coalesce("low", "rep").alias("component_id")))
    slim = cards.select("doc_id", "n_shingles", "d1", "d2")
    linked = slim.filter("n_shingles > 0").join(home, ["d1", "d2"], "left").select("doc_id", "n_shingles", "component_id")
    alone = slim.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _labels(source: DataFrame, full: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """``node, label`` for the class representatives that share a band with another."""
    firsts = full.join(classes, ["d1", "d2"]).filter("doc_id = rep").select("rep", "bands").dropDuplicates(["rep", "bands"])
    keys = stable(firsts.select("rep", F.explode("bands").alias("key")).distinct())
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    member = stable(keys.join(shared, "key"))
    weight = member.groupBy("rep").agg(F.sum("size").alias("score"))
    member = stable(member.join(weight, "rep").select("key", "rep", "score"))

    wanted = bit_filter(weight.select(slot(F.col("rep")).alias("bit")))
    sets = stable(source.filter("doc_id IS NOT NULL").select("doc_id", "text", slot(F.col("doc_id")).alias("bit"))
                  .mapInArrow(lambda b: _sets(b, near, wanted), "doc_id long, n long, code binary, shingles binary"))

    hub = member.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("minus"))).alias("hub"))
    best = (member.join(hub, "key").filter("rep != -hub.minus")
            .groupBy("rep").agg(F.max("hub").alias("hub")).select(F.col("rep").alias("a"), (-F.col("hub.minus")).alias("b")))
    best = stable(best)
    found = _confirm(best, sets, near)
    up = weight.join(found, F.col("rep") == F.col("a"), "left").select(F.col("rep").alias("node"), F.coalesce("b", "rep").alias("up"))
    labels = _merge(follow(up), _families(best, found, sets, near))

    home = best.select(F.col("a").alias("_a"), F.col("b").alias("family"))
    placed = (member.join(labels, member["rep"] == labels["node"]).join(home, F.col("rep") == F.col("_a"), "left")
              .select("key", "rep", "label", F.coalesce("family", "rep").alias("family")))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    active = stable(placed.join(mixed, "key", "left_semi"))
    main = active.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = active.join(main, "key").filter("label != main").select("key", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("family").alias("fa"))
    others = active.select("key", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("family").alias("fb"))
    pairs = (rest.join(others, "key").filter("la != lb AND fa != fb AND a != fb AND b != fa")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return _merge(labels, _confirm(pairs, sets, near))


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after the labels at both ends of each link became one."""
    at = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    edges = stable(links.join(at, F.col("a") == F.col("_n")).select("b", F.col("_l").alias("x"))
                   .join(at, F.col("b") == F.col("_n")).select(F.col("x").alias("a"), F.col("_l").alias("b")).filter("a != b").distinct())
    if edges.isEmpty():
        return labels
    merged = components(edges).select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return stable(labels.join(merged, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label")))


def _families(best: DataFrame, found: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links between texts that met the same member of their buckets, where one of the two is not linked with that member.

    Those texts are compared with the whole family in blocks: a block of them and a chunk of the family, both bounded by their
    number of shingles, make one group. A group gives a spanning forest of its links, not all of them.
    """
    family = (best.join(found.select(F.col("a").alias("_a"), F.lit(True).alias("linked")), F.col("a") == F.col("_a"), "left")
              .join(sets.select("doc_id", "n"), F.col("a") == F.col("doc_id"))
              .select(F.col("b").alias("hub"), F.col("a").alias("rep"), "linked", "n"))
    family = stable(family)
    size = (family.groupBy("hub").agg(F.sum(F.when(F.col("linked").isNull(), F.col("n"))).alias("open"), F.sum("n").alias("all"), F.count("*").alias("texts"))
            .filter("open IS NOT NULL AND texts > 1")
            .select("hub", F.ceil(F.col("open") / BLOCK).alias("blocks"), F.ceil(F.col("all") / CHUNK).alias("chunks")))
    family = family.join(size, "hub")
    asks = family.filter("linked IS NULL").select(
        "hub", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "rep", F.lit(True).alias("asks"))
    answers = family.select(
        "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("rep", F.lit(1)), "chunks").alias("chunk"), "rep", F.lit(False).alias("asks"))
    rows = asks.unionByName(answers).join(sets.select("doc_id", "shingles"), F.col("rep") == F.col("doc_id")).drop("doc_id")
    return stable(rows.groupBy("hub", "block", "chunk").applyInArrow(lambda t: _forest(t, near), "a long, b long"))


def _forest(group: pa.Table, near: Near) -> pa.Table:
    asks = group.column("asks").to_numpy()
    reps = group.column("rep").to_numpy()
    texts = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in group.column("shingles").chunks for x in chunk]
    order = np.flatnonzero(asks)
    up = {int(r): int(r) for r in reps}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for at in range(0, len(order), 256):
        block = order[at:at + 256]
        size = np.array([len(texts[i]) for i in block])
        known, place = np.unique(np.concatenate([texts[i] for i in block]), return_inverse=True)
        holds = np.zeros((len(known), len(block)), np.uint8)
        holds[place, np.repeat(np.arange(len(block)), size)] = 1
        for i in np.flatnonzero(~asks):
            spot = np.searchsorted(known, texts[i])
            spot[spot == len(known)] = 0
            common = holds[spot[known[spot] == texts[i]]].sum(0, dtype=np.int64)
            for k in np.flatnonzero(100 * common >= near.percent * (size + len(texts[i]) - common)):
                a, b = root(int(reps[i])), root(int(reps[block[k]]))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((int(reps[i]), int(reps[block[k]])))
    ends = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": ends[:, 0].copy(), "b": ends[:, 1].copy()})


def _confirm(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs ``a, b`` that are linked. Sizes and signatures rule most others out before sets are moved."""
    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(f"_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    pairs = stable(pairs)
    likely = pairs.join(side("a", "n", "code"), F.col("a") == F.col("_a")).join(side("b", "n", "code"), F.col("b") == F.col("_b"))
    likely = stable(likely.filter(100 * F.least("n_a", "n_b") >= near.percent * F.greatest("n_a", "n_b")).select("a", "b", "code_a", "code_b")
                    .mapInArrow(lambda b: _likely(b, near), "a long, b long"))
    joined = likely.join(side("a", "shingles"), F.col("a") == F.col("_a")).join(side("b", "shingles"), F.col("b") == F.col("_b"))
    return stable(joined.select("a", "b", "shingles_a", "shingles_b").mapInArrow(lambda b: _linked(b, near), "a long, b long").distinct())


def shingle_sets(block: w.Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and where each text's begin."""
    words = block.words(lower=True)
    at, value = w.windows(words, n)
    first = np.searchsorted(at, words.first)
    size = np.diff(words.first)
    out = []
    for d in range(len(block)):
        own = value[first[d]:first[d + 1]]
        if not len(own) and size[d]:
            whole = words.hash[words.first[d]:words.first[d + 1]]
            own = w.mix(np.array([np.bitwise_xor.reduce(w.mix(whole + np.arange(1, len(whole) + 1, dtype=np.uint64) * ODD))], np.uint64))
        out.append(np.unique(own))
    return (np.concatenate(out) if out else value), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def signatures(flat: np.ndarray, first: np.ndarray, permutations: int) -> np.ndarray:
    """A row per text with a non-empty set: the minima under all permutations, then the maxima."""
    rows = np.flatnonzero(np.diff(first))
    out = np.empty((len(rows), 2 * permutations), np.uint64)
    seeds = w.mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * ODD).reshape(2, -1)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(first[rows], first[rows[at]] + PIECE)))
        low, high = first[rows[at]], first[rows[min(to, len(rows)) - 1] + 1]
        piece, starts = flat[low:high], first[rows[at:to]] - low
        for j in range(permutations):
            image = piece * (seeds[0, j] | np.uint64(1)) + seeds[1, j]
            out[at:to, j] = np.minimum.reduceat(image, starts)
            out[at:to, permutations + j] = np.maximum.reduceat(image, starts)
        at = to
    return out


def _band_keys(signature: np.ndarray, near: Near) -> np.ndarray:
    values = signature[:, :near.bands * near.rows].reshape(len(signature), near.bands, near.rows)
    key = np.broadcast_to(w.mix(np.arange(1, near.bands + 1, dtype=np.uint64)), values.shape[:2]).copy()
    for r in range(near.rows):
        key = w.mix(key * ODD + values[:, :, r])
    return key


def _permutations(near: Near) -> int:
    return -(-near.bands * near.rows // 2)


def _cards(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    for block in w.blocks(batches):
        flat, first = shingle_sets(block, near.words)
        size = np.diff(first)
        full = size > 0
        keys = _band_keys(signatures(flat, first, _permutations(near)), near)
        total = np.zeros((2, len(flat) + 1), np.uint64)
        np.cumsum(w.mix(flat), out=total[0, 1:])
        np.cumsum(w.mix(flat ^ ODD), out=total[1, 1:])
        digest = (total[:, first[1:]] - total[:, first[:-1]]).view(np.int64)
        ends = np.concatenate([[0], np.cumsum(full * near.bands)])
        yield pa.RecordBatch.from_arrays(
            [block.rows.column("doc_id"), pa.array(size), pa.array(digest[0]), pa.array(digest[1]),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))],
            ["doc_id", "n_shingles", "d1", "d2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], near: Near, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    def chosen() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(wanted, batch.column("bit").to_numpy())))

    for block in w.blocks(chosen()):
        flat, first = shingle_sets(block, near.words)
        full = np.diff(first) > 0
        code = signatures(flat, first, _permutations(near)).astype(np.uint8)
        raw = flat.tobytes()
        at = first * 8
        rows = np.flatnonzero(full)
        yield pa.RecordBatch.from_arrays(
            [block.rows.column("doc_id").filter(pa.array(full)), pa.array(np.diff(first)[full]), pa.array([x.tobytes() for x in code], pa.binary()),
             pa.array([raw[at[d]:at[d + 1]] for d in rows], pa.binary())], ["doc_id", "n", "code", "shingles"])


def _likely(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    """Drops pairs whose signatures agree so rarely that a link is out of the question (six standard deviations)."""
    width = 2 * _permutations(near)
    share = near.percent / 100
    least = width * share - 6 * (width * share * (1 - share)) ** 0.5
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in ("code_a", "code_b"))
        yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(1) >= least))


def _linked(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("shingles_a"), batch.column("shingles_b")
        good = []
        for x, y in zip(left, right, strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * common >= near.percent * (len(a) + len(b) - common))
        yield pc.filter(batch.select(["a", "b"]), pa.array(good, pa.bool_()))
