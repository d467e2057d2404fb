"""Language-model scores of whole texts: word unigrams, and a self-attention model over subword ids.

Unigrams: all words of the training texts are counted. The commonest words, at most ``Scoring.common`` of them, are sent to every
task; the rest of a text's words are rare by construction and meet their counts in a join.

Attention: every text is encoded once and its ids are written. Ids are counted over all training texts, and consecutive windows cover
each of them, so that every id of every training text, and its end, is a target once a round. Each shard of texts trains a copy of the
weights; the copies are averaged, in each of ``Scoring.rounds`` rounds. Scoring moves overlapping windows over a text's ids and scores each id
once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stable
from . import attention as at
from . import words as w
from .tokenizing import PLAIN, Ids

LN10 = float(np.log(10))
ODD = ~w.BLANK & ((np.arange(256) < 32) | (np.arange(256) > 126))  # bytes that a text which is not plain has
TOGETHER = 1 << 20
IDS = 1 << 18  # ids that are worked on together; a longer text is a piece of its own


@dataclass(frozen=True)
class Scoring:
    shape: at.Shape = at.Shape()
    common: int = 1 << 20
    rounds: int = 1
    batch: int = 64
    end_id: int = 50256


@dataclass(frozen=True)
class Unigrams:
    """``tokens`` and ``distinct`` of the training texts, counts by word hash as a table, and the commonest as sorted arrays."""

    tokens: int
    distinct: int
    texts: int
    counts: DataFrame
    hashes: np.ndarray
    found: np.ndarray


def score(docs: DataFrame, training: Column, vocabulary: str, scoring: Scoring = Scoring(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, training, n_tokens, n_known, train_tokens, base_score, score``, one row per input row.

    ``training`` says which rows to learn from; null counts as no. Words are separated by ASCII blanks, A-Z lower-cased; every text ends
    with one end token. ``base_score`` is the sum of log10((c + 1) / (N + V + 1)), ``score`` the model's log10-probability of the text's ids
    and its end. A null or empty text is the end alone. A null id is passed through; rows that repeat are scored, and learned
    from, as often. Without training rows both models are uniform.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    learn = source.filter("training").select("text")
    unigrams = count_words(learn, scoring)
    kind = source.schema["doc_id"].dataType.simpleString()
    row = f"row long, doc_id {kind}, training boolean, n_tokens long, known long, sum double"
    first = stable(source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        lambda b, u=(unigrams.hashes, unigrams.found, unigrams.texts): _encode(b, u, vocabulary, scoring), f"{row}, ids binary, rare array<struct<word:long,n:int>>"))
    model = train(first.filter("training").select("ids"), scoring)
    scored = stable(first.drop("rare").mapInArrow(lambda b: _score(b, model), f"{row}, score double"))
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    hit = rare.join(unigrams.counts.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"))
    more = hit.groupBy("row").agg(F.sum("n").alias("_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_sum"))
    total = float(np.log10(unigrams.tokens + unigrams.distinct + 1))
    return scored.join(more, "row", "left").select(
        "doc_id", "training", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(unigrams.tokens).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("_sum", F.lit(0.0)) - F.col("n_tokens") * total).alias("base_score"), "score")


def count_words(learn: DataFrame, scoring: Scoring) -> Unigrams:
    counts = stable(learn.mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")))
    # how many words are how common, in some hundreds of classes
    level = F.floor(F.log2("c") * 16).cast("int")
    classes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()
    texts = int(learn.count())
    sent, cut = 0, None
    for row in classes:
        if sent + row["n"] > scoring.common:
            break
        sent, cut = sent + row["n"], row["level"]
    top = counts.filter(level >= cut).toArrow() if cut is not None else counts.limit(0).toArrow()
    word = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return Unigrams(sum(r["c"] for r in classes) + texts, sum(r["n"] for r in classes) + (texts > 0), texts, counts, word[order], top.column("c").to_numpy()[order])


def train(texts: DataFrame, scoring: Scoring = Scoring()) -> at.Model:
    """``texts`` has the ``ids`` of whole texts, from end to end."""
    counts = texts.mapInArrow(_count_ids, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per subword
    model = at.initial({r["id"]: r["n"] for r in counts}, scoring.shape)
    if counts:
        pairs = texts.mapInArrow(lambda b, rank=model.rank: _count_pairs(b, rank), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        model = at.after(model, pairs.column("pair").to_numpy(), pairs.column("n").to_numpy())  # some 4 million pairs at most
    for turn in range(scoring.rounds if counts else 0):
        copies = texts.mapInArrow(lambda b, m=model, t=turn: _train(b, m, scoring, t), "at int, value double, weight long")
        mean = copies.groupBy("at").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value")).toArrow()  # one row per weight
        values = np.empty(mean.num_rows)
        values[mean.column("at").to_numpy()] = mean.column("value").to_numpy()
        model = model.with_flat(values)
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of some ``TOGETHER`` words in one, so that a word common in them is a row once."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        word, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")  # sorted parts are merged
        word, n = word[order], n[order]
        first = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1) if len(word) else np.zeros(0, np.int64)
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(np.add.reduceat(n, first) if len(word) else n)], ["word", "c"])

    for block in w.blocks(batches):
        parts.append(np.unique(block.words(lower=True).hash, return_counts=True))
        if sum(len(word) for word, _ in parts) > TOGETHER:
            yield merged()
    if parts:
        yield merged()


def _ids(block: w.Block, words: w.Spans, encoder: Ids, end_id: int) -> list[bytes]:
    """Ids of each text, 16 bits each, with the end before and after. Each unit of plain texts is encoded once a block at most."""
    raw, bounds = block.data.tobytes(), block.offsets.tolist()
    plain, odd = np.ones(len(block), bool), w.sums(ODD[block.data], block.offsets)
    for i in np.flatnonzero(odd).tolist():
        plain[i] = PLAIN.fullmatch(raw[bounds[i]:bounds[i + 1]].decode("utf-8", "replace")) is not None
    units = block.units(words)
    here = np.repeat(plain, np.diff(units.first))
    value, back = np.unique(units.hash[here], return_inverse=True)
    one = np.empty(len(value), np.int64)
    one[back] = np.flatnonzero(here)
    known, begin, size = encoder.units.find(value, lambda i: [raw[a:b].decode() for a, b in zip(units.start[one[i]].tolist(), units.end[one[i]].tolist(), strict=True)])
    n = np.zeros(len(here), np.int64)
    n[here] = size[back]
    per = w.sums(n, units.first)  # ids of each text
    own = size[back]
    spot = np.arange(own.sum()) + np.repeat(begin[back] - (np.cumsum(own) - own), own)
    out = np.full(len(spot) + 2 * len(block), end_id, "<u2")
    out[np.arange(len(spot)) + np.repeat(2 * np.arange(len(block)) + 1, per)] = known[spot]
    flat, ends = out.tobytes(), (2 * np.cumsum(per + 2)).tolist()
    ids = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    end = np.array([end_id], "<u2").tobytes()
    for i in np.flatnonzero(~plain).tolist():
        whole = encoder.whole(raw[bounds[i]:bounds[i + 1]].decode("utf-8", "replace"))
        ids[i] = end + np.frombuffer(whole, "<u4").astype("<u2").tobytes() + end
    return ids


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of about ``IDS`` in a piece, and where each text begins and ends among them."""
    for batch in batches:
        column = batch.column("ids").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data, low = column.buffers()[2], 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + 2 * IDS, "right")) - 1)
            yield np.frombuffer(data, "<u2", (offsets[high] - offsets[low]) // 2, offsets[low]), (offsets[low:high + 1] - offsets[low]) // 2
            low = high


def windows(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of targets of consecutive windows over texts of two ids or more. A window begins with the last target of the one
    before, so each id of a text but its first is a target once."""
    targets = np.diff(offsets) - 1
    per = -(-targets // size)
    within = size * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    return np.repeat(offsets[:-1], per) + within, np.minimum(size, np.repeat(targets, per) - within)


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for ids, _ in _flat(batches):
        total += np.bincount(ids, minlength=len(total))
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["id", "n"])


def _count_pairs(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(at.KNOWN * (at.COMMON + 1), np.int64)
    for ids, offsets in _flat(batches):
        keys = np.delete(at.pairs(rank[ids]), offsets[1:-1] - 1)  # the end of a text and the begin of the next are no pair
        np.add.at(total, keys, 1)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["pair", "n"])


def _train(batches: Iterator[pa.RecordBatch], model: at.Model, scoring: Scoring, turn: int) -> Iterator[pa.RecordBatch]:
    """One pass over a shard; gives the trained weights and how many targets they saw."""
    size, seen = scoring.shape.window, 0
    adam = at.Adam(model.with_flat(model.flat()), 0.01 / (1 + turn))
    column = np.arange(size + 1)
    for ids, offsets in _flat(batches):
        numbers = np.append(model.rank[ids], np.zeros(size, np.int32))
        start, targets = windows(offsets, size)
        order = np.random.default_rng([turn, seen]).permutation(len(start))
        for low in range(0, len(order), scoring.batch):
            own = order[low:low + scoring.batch]
            real = column[:size] < targets[own, None]
            run = numbers[start[own, None] + column]
            run[:, 1:][~real] = 0
            adam.step(run, real.astype(np.float32), False)
        seen += int(targets.sum())
    if seen:
        flat = adam.model.flat()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat.astype(np.float64)), pa.array(np.full(len(flat), seen))], ["at", "value", "weight"])


def text_scores(model: at.Model, texts: list[np.ndarray], batch: int = 192) -> np.ndarray:
    """Natural log-probability of each sequence of ids, whose first id is given."""
    window, step = model.shape.window, model.shape.step
    lengths = np.array([len(x) - 1 for x in texts])
    per = -(-lengths // step)
    # each text gets whole steps of a buffer; the window of step j begins at step j, its new ids end ``window`` later
    room = (per + -(-window // step)) * step
    base = np.concatenate([[0], np.cumsum(room)])
    inputs, targets = np.full(base[-1], -1, np.int32), np.full(base[-1], -1, np.int32)
    for text, place in zip(texts, base[:-1] + window - step, strict=True):
        numbers = model.rank[text]
        inputs[place:place + len(text) - 1] = numbers[:-1]
        targets[place:place + len(text) - 1] = numbers[1:]
    steps = len(inputs) // step - -(-window // step) + 1
    seen = np.lib.stride_tricks.as_strided(inputs, (max(steps, 0), window), (4 * step, 4), writeable=False)
    owner = np.repeat(np.arange(len(texts)), per)
    first = np.repeat(base[:-1] // step, per) + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    out = np.zeros(len(texts))
    for low in range(0, len(owner), batch):
        rows = first[low:low + batch]
        new = targets[(rows * step + window - step)[:, None] + np.arange(step)]
        out += np.bincount(owner[low:low + batch], at.log_probabilities(model, seen[rows], new).sum(1, dtype=np.float64), len(texts))
    return out


def _encode(batches: Iterator[pa.RecordBatch], unigrams: tuple[np.ndarray, np.ndarray, int], vocabulary: str, scoring: Scoring) -> Iterator[pa.RecordBatch]:
    hashes, counts, texts = unigrams
    encoder = Ids.of(vocabulary)
    logs = np.log10(counts + 1.0)
    for block in w.blocks(batches):
        words = block.words(lower=True)
        word, back = np.unique(words.hash, return_inverse=True)
        spot = np.minimum(np.searchsorted(hashes, word), max(len(hashes) - 1, 0))
        known = hashes[spot] == word if len(hashes) else np.zeros(len(word), bool)
        value = np.where(known, logs[spot], 0.0) if len(hashes) else np.zeros(len(word))
        here = known[back]
        total = np.concatenate([[0], np.cumsum(value[back])])
        first = words.first
        unknown = np.flatnonzero(~here)
        text_of = np.searchsorted(first, unknown, "right") - 1
        order = np.lexsort((back[unknown], text_of))
        unknown, text_of = unknown[order], text_of[order]
        start = np.flatnonzero(np.append(True, (back[unknown][1:] != back[unknown][:-1]) | (text_of[1:] != text_of[:-1]))[:len(unknown)])
        items = pa.StructArray.from_arrays([pa.array(words.hash[unknown[start]].view(np.int64)), pa.array(np.diff(np.append(start, len(unknown))).astype(np.int32))], ["word", "n"])
        rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(text_of[start], np.arange(len(block) + 1)).astype(np.int32)), items)
        ids = _ids(block, words, encoder, scoring.end_id)
        yield pa.RecordBatch.from_arrays(
            [block.rows.column("row"), block.rows.column("doc_id"), block.rows.column("training"), pa.array(np.diff(first) + 1), pa.array(w.sums(here, first) + (texts > 0)),
             pa.array(total[first[1:]] - total[first[:-1]] + np.log10(texts + 1.0)), pa.array(ids, pa.binary()), rare],
            ["row", "doc_id", "training", "n_tokens", "known", "sum", "ids", "rare"])


def _score(batches: Iterator[pa.RecordBatch], model: at.Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [text_scores(model, np.split(ids, offsets[1:-1])) for ids, offsets in _flat([batch])]
        yield batch.drop_columns(["ids"]).append_column("score", pa.array(np.concatenate([np.zeros(0), *scores]) / LN10))
    pa.default_memory_pool().release_unused()  # a worker stays for other tasks, beside other processes
