"""Ranked lexical search with geometric blocks in every posting list.

Queries come in blocks, and a pass over the documents answers a block. The coordinates of a document are its term weights for the terms of
the block's queries; they are written once. Tasks gather documents into shards. In a shard the posting list of each term is divided
into blocks of similar documents, and a block keeps the largest value of every coordinate over its documents. A query's product with
that summary is a bound on each score in the block, so a block whose bound is under the tenth best score so far holds no answer. Nothing
else is skipped: results are exact. What a task has found so far bounds its later shards.

The score is whole-number arithmetic in 64 bits. N: documents with a term, L: their terms, n: a document's terms, df: documents with the term,
tf: its occurrences. A term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); m = 10 + 90 * n * N div L; the score sums
w * (10**9 * tf div (1000 * tf + 8 * m)) over the query's distinct terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable
from . import words as w

UNIT = 16  # of a summary: values are below 10**6, so rounded up to units they fit 16 bits and still bound
DIRECT = 8  # lists up to this length are scored without a summary
SALTS = 256


@dataclass(frozen=True)
class Search:
    """``best``: answers a query. ``block``: documents in a block, about. ``documents`` and ``cells`` bound a shard: its documents, and
    documents times terms. ``queries`` and ``terms`` bound the queries of a pass, and their terms (a longer query is a pass of its own)."""

    best: int = 10
    block: int = 48
    documents: int = 2048
    cells: int = 1 << 23
    queries: int = 2000
    terms: int = 1 << 15


@dataclass(frozen=True)
class Query:
    item: object
    terms: np.ndarray  # sorted hashes


@dataclass(frozen=True)
class Plan:
    """What a pass sends to every task: the vocabulary of its queries, weights, corpus totals."""

    vocabulary: np.ndarray
    weights: np.ndarray
    documents: int
    total: int
    queries: list[tuple[object, np.ndarray]]  # item id and places in the vocabulary, those of weight 0 left out


def search(docs: DataFrame, items: DataFrame, how: Search = Search(), id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of every row of ``items`` with a score above 0, equal scores by rising id.

    Terms are maximal runs of ASCII letters, digits and code points above 127, A-Z lower-cased. Null and empty texts have none: such documents
    are in no answer, such items have none. Repeated document rows are documents of their own; a null id comes after the others. Every
    row of ``items`` is a query: repeated ones give repeated answers. Empty tables give no rows. Further columns are left out.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    asked = items.select(items[item_col].alias("item_id"), items[item_text_col].alias("text"))
    item_kind = asked.schema["item_id"].dataType.simpleString()
    answers = []
    for queries in query_blocks(asked, item_kind, how):
        vocabulary = np.unique(np.concatenate([q.terms for q in queries]))
        forward = stable(source.mapInArrow(lambda b, v=vocabulary: _forward(b, v), f"doc_id {kind}, n long, terms binary, tf binary"))
        plan = weigh(forward, vocabulary, queries)
        found = forward.filter(F.length("terms") > 0).mapInArrow(lambda b, p=plan: _answer(b, p, how), f"query int, doc_id {kind}, score long")
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).filter(F.col("rank") <= how.best)
        best = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= how.best)
        names = docs.sparkSession.createDataFrame([(i, q.item) for i, q in enumerate(queries)], f"query int, item_id {item_kind}")
        answers.append(stable(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")))  # at most ``queries`` names
    if not answers:
        return docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    return reduce(DataFrame.unionByName, answers)


def query_blocks(asked: DataFrame, item_kind: str, how: Search) -> Iterator[list[Query]]:
    """Queries in bounded blocks; the driver holds one block, and a partition of coded queries, at a time."""
    coded = stable(asked.mapInArrow(_query_terms, f"item_id {item_kind}, terms binary"))
    block, size = [], 0
    for row in coded.filter(F.length("terms") > 0).toLocalIterator():
        terms = np.frombuffer(row["terms"], np.uint64)
        if block and (len(block) >= how.queries or size + len(terms) > how.terms):
            yield block
            block, size = [], 0
        block.append(Query(row["item_id"], terms))
        size += len(terms)
    if block:
        yield block


def weigh(forward: DataFrame, vocabulary: np.ndarray, queries: list[Query]) -> Plan:
    totals = forward.filter("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
    documents, total = totals["documents"], totals["total"] or 0
    size = len(vocabulary)
    counts = (forward.select("terms").mapInArrow(lambda b: _frequencies(b, size), "term int, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).toArrow())  # a row for each term of the queries
    df = np.zeros(size, np.int64)
    df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    places = [np.searchsorted(vocabulary, q.terms) for q in queries]
    return Plan(vocabulary, weights, documents, total, [(q.item, p[weights[p] > 0]) for q, p in zip(queries, places, strict=True)])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in w.blocks(batches):
        words = block.spans(w.PUNCTUATION, lower=True)
        terms = [np.unique(words.hash[a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([block.rows.column("item_id"), pa.array(terms, pa.binary())], ["item_id", "terms"])


def _forward(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Number of terms of each text, and the places in the vocabulary and occurrences of those that are in it."""
    for block in w.blocks(batches):
        words = block.spans(w.PUNCTUATION, lower=True)
        spot = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
        known = vocabulary[spot] == words.hash
        key, tf = np.unique(words.owner()[known] * len(vocabulary) + spot[known], return_counts=True)
        cut = np.searchsorted(key, np.arange(len(block) + 1) * len(vocabulary))
        place, tf = (key % len(vocabulary)).astype(np.int32), tf.astype(np.int32)
        bounds = list(zip(cut[:-1], cut[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [block.rows.column("doc_id"), pa.array(np.diff(words.first)), pa.array([place[a:b].tobytes() for a, b in bounds], pa.binary()),
             pa.array([tf[a:b].tobytes() for a, b in bounds], pa.binary())], ["doc_id", "n", "terms", "tf"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each row's begin."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    return np.frombuffer(data, np.int32, (offsets[-1] - offsets[0]) // 4, offsets[0]) if data is not None else np.zeros(0, np.int32), (offsets - offsets[0]) // 4


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(size, np.int64)
    for batch in batches:
        df += np.bincount(_flat(batch.column("terms"))[0], minlength=size)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Values of coordinates: ``n`` are the terms of the documents that ``tf`` belongs to."""
    if int(n.max(initial=0)) * 90 * documents >= 1 << 62:
        n = n.astype(object)
    m = (10 + n * 90 * documents // total).astype(np.int64)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Shard:
    """Documents with their coordinates, and blocks of similar documents in the list of every term.

    ``terms`` are the vocabulary places that occur, as columns. List ``t`` has ``lists[t]`` as its documents in the order of blocks; blocks with a
    summary are numbered through the shard: ``first[t]``..``first[t + 1]``, documents ``members[b]``, ``summary[:, b]`` in units, rounded up.
    """

    def __init__(self, ids: list, offsets: np.ndarray, place: np.ndarray, value: np.ndarray, weights: np.ndarray, block: int):
        self.ids = ids
        self.terms, column = np.unique(place, return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
        self.values = np.zeros((len(ids), len(self.terms)), np.int32)
        self.values[owner, column] = value
        self.largest = self.values.max(0).astype(np.int64)
        units = -(-self.values // UNIT)
        units = units.astype(np.uint16)
        # similarity is judged on a random projection of the weighted coordinates
        turn = np.random.default_rng(3).choice(np.array([-1, 1], np.float32), (len(self.terms), 64))
        near = (self.values * weights[self.terms].astype(np.float32)) @ turn
        near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
        order = np.argsort(column, kind="stable")
        self.lists = np.split(owner[order], np.cumsum(np.bincount(column, minlength=len(self.terms)))[:-1])
        self.members: list[np.ndarray] = []
        self.first = np.zeros(len(self.terms) + 1, np.int64)
        tops = []
        for t, own in enumerate(self.lists):
            if len(own) > DIRECT:
                centres = own[::block]
                group = (near[own] @ near[centres].T).argmax(1) if len(centres) > 1 else np.zeros(len(own), np.int64)
                ranked = own[np.argsort(group, kind="stable")]
                for part in np.split(ranked, np.cumsum(np.bincount(group))[:-1]):
                    if len(part):
                        self.members.append(part)
                        tops.append(units[part].max(0))
            self.first[t + 1] = len(self.members)
        self.summary = np.ascontiguousarray(np.array(tops, np.uint16).reshape(len(tops), len(self.terms)).T)

    def bounds(self, columns: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """No document of a block scores more than its bound. Whole numbers below 2**53, so doubles are exact."""
        return UNIT * (weights.astype(np.float64) @ self.summary[columns][:, blocks].astype(np.float64))

    def scores(self, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.values[rows[:, None], columns].astype(np.int64) @ weights

    def answer(self, places: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Puts the shard's documents among ``best``; says how many were scored."""
        spot = np.minimum(np.searchsorted(self.terms, places), len(self.terms) - 1)
        here = self.terms[spot] == places
        columns, weights = spot[here], weights[here]
        if not len(columns):
            return 0
        # terms that cannot reach the floor even together need no list of their own
        reach = weights * self.largest[columns]
        rising = np.argsort(reach, kind="stable")
        needed = columns[rising[np.cumsum(reach[rising]) >= best.floor]]
        seen = np.zeros(len(self.ids), bool)

        def look(rows: np.ndarray) -> None:
            rows = rows[~seen[rows]]
            if len(rows):
                rows = np.unique(rows)
                seen[rows] = True
                best.add(self.scores(rows, columns, weights), rows, self.ids)

        short = [self.lists[t] for t in needed if len(self.lists[t]) <= DIRECT]
        if short:
            look(np.concatenate(short))
        ranges = [np.arange(self.first[t], self.first[t + 1]) for t in needed]
        blocks = np.concatenate(ranges) if ranges else np.zeros(0, np.int64)
        bound = self.bounds(columns, weights, blocks)
        able = bound >= best.floor
        blocks, bound = blocks[able], bound[able]
        falling = np.argsort(-bound, kind="stable")
        low, step = 0, 4
        while low < len(falling):
            own = falling[low:low + step]
            own = own[bound[own] >= best.floor]
            if not len(own):
                break
            look(np.concatenate([self.members[b] for b in blocks[own]]))
            low, step = low + step, step * 2
        return int(seen.sum())


class Best:
    """The best documents of a query so far. ``floor`` is the least score that may still be among them."""

    def __init__(self, size: int):
        self.size = size
        self.found: list[tuple] = []
        self.floor = 1

    def add(self, scores: np.ndarray, rows: np.ndarray, ids: list) -> None:
        able = scores >= self.floor
        scores, rows = scores[able], rows[able]
        if len(scores) > self.size:
            able = scores >= np.partition(scores, -self.size)[-self.size]
            scores, rows = scores[able], rows[able]
        if len(scores):
            new = [(-s, ids[r] is None, ids[r]) for s, r in zip(scores.tolist(), rows.tolist(), strict=True)]
            self.found = sorted(self.found + new, key=lambda x: x[:2] if x[1] else x)[:self.size]
            if len(self.found) == self.size:
                self.floor = -self.found[-1][0]


def shards(batches: Iterator[pa.RecordBatch], plan: Plan, how: Search) -> Iterator[Shard]:
    size = max(64, min(how.documents, how.cells // len(plan.vocabulary)))
    held, rows = [], 0

    def made() -> Shard:
        table = pa.Table.from_batches(held).combine_chunks()
        batch = table.to_batches()[0]
        place, offsets = _flat(batch.column("terms"))
        tf, _ = _flat(batch.column("tf"))
        n = np.repeat(batch.column("n").to_numpy(), np.diff(offsets))
        return Shard(batch.column("doc_id").to_pylist(), offsets, place, impacts(tf, n, plan.documents, plan.total), plan.weights, how.block)

    for batch in batches:
        low = 0
        while low < batch.num_rows:
            part = batch.slice(low, size - rows)
            held.append(part)
            low, rows = low + part.num_rows, rows + part.num_rows
            if rows == size:
                yield made()
                held, rows = [], 0
    if rows:
        yield made()


def _answer(batches: Iterator[pa.RecordBatch], plan: Plan, how: Search) -> Iterator[pa.RecordBatch]:
    best = [Best(how.best) for _ in plan.queries]
    kind = None

    def noted() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            if batch.num_rows:
                yield batch

    for shard in shards(noted(), plan, how):
        for own, (_, places) in zip(best, plan.queries, strict=True):
            shard.answer(places, plan.weights[places], own)
    rows = [(q, found) for q, own in enumerate(best) for found in own.found]
    for low in range(0, len(rows), 1 << 16):
        part = rows[low:low + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in part], pa.int32()), pa.array([f[2] for _, f in part], kind), pa.array([-f[0] for _, f in part], pa.int64())],
                                         ["query", "doc_id", "score"])
    pa.default_memory_pool().release_unused()  # a worker stays for other tasks, beside other processes


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
c AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
q AS (
  SELECT r, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT row_number() OVER () AS r, item_id, text FROM benchmark)),
t AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (
  SELECT q.r AS qr, q.item_id, t.r, t.doc_id,
         sum(CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term), c GROUP BY ALL)
SELECT item_id, "rank"::INT AS "rank", doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id NULLS LAST) AS "rank" FROM s WHERE score > 0) WHERE "rank" <= 10
"""
