"""Packing token sequences into windows of equal capacity by multiway differencing (Karmarkar and Karp).

Texts are cut where they fill a window; what is left over of each is collected in pools of a few hundred windows. In a pool, every
piece starts as a partition of its own with all other windows empty. The two partitions with the largest differences are merged,
fullest window with emptiest, until one partition is left; its windows are nearly equal. If the fullest exceeds the capacity,
the number of windows rises by one and the pool is partitioned again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import words as w
from .tokenizing import Ids


@dataclass(frozen=True)
class Packing:
    """``windows`` in a pool; ``slack`` tokens a window that a pool leaves free so that differences of the windows fit; a share
    ``sand`` of a pool is cut into pieces of at most ``grain`` tokens, which even the windows out."""

    capacity: int = 2048
    windows: int = 256
    slack: int = 3
    sand: float = 0.06
    grain: int = 96
    end_id: int = 1


COLUMNS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, packing: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit; every text ends with ``end_id``, so a null or empty text is that one id. ``start`` counts
    the text's ids before the piece, ``offset`` the ids before it in its sequence, where pieces lie without gaps. A
    null id is passed through; rows that repeat are packed as often.

    Nothing is shuffled: each task pools the texts of its partition in their order, in memory bounded by a pool and one text, and
    numbers its sequences from the partition's number on. Only the last pool of a partition can be smaller, and leaves less than one
    window unused.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda b: _pack(b, vocabulary, packing), f"doc_id {kind}, {COLUMNS}")


class Rows:
    """Pieces of finished sequences."""

    def __init__(self, first: int) -> None:
        self.sequence = first
        self.columns: list[list] = [[] for _ in range(7)]
        self.kind: pa.DataType = pa.null()

    def add(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, total, start, ids in pieces:
            length = len(ids) // 4
            for column, value in zip(self.columns, (doc, start, length, ids, total, self.sequence, offset), strict=True):
                column.append(value)
            offset += length
        self.sequence += 1

    def take(self) -> pa.RecordBatch:
        kinds = [self.kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)],
                                         ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        self.columns = [[] for _ in range(7)]
        return out


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str, packing: Packing) -> Iterator[pa.RecordBatch]:
    encode = Ids.of(vocabulary).encode
    end = np.array([packing.end_id], "<u4").tobytes()
    rows = Rows(TaskContext.get().partitionId() << 40)
    full = 4 * packing.capacity
    size = packing.windows * (packing.capacity - packing.slack)
    pool: list[tuple] = []
    held = 0
    for block in w.blocks(batches):
        rows.kind = block.rows.column("doc_id").type
        raw = block.data.tobytes()
        for d, doc in enumerate(block.rows.column("doc_id").to_pylist()):
            ids = encode(raw[block.offsets[d]:block.offsets[d + 1]].decode("utf-8", "replace")) + end
            total = len(ids) // 4
            at = 0
            while len(ids) - at >= full:
                rows.add([(doc, total, at // 4, ids[at:at + full])])
                at += full
            while at < len(ids):
                part = min(len(ids) - at, 4 * (size - held))
                pool.append((doc, total, at // 4, ids[at:at + part]))
                at, held = at + part, held + part // 4
                if held == size:
                    _empty(pool, packing, rows)
                    pool, held = [], 0
        if len(rows.columns[0]) > 512:
            yield rows.take()
    if pool:
        _empty(pool, packing, rows)
    yield rows.take()


def _empty(pool: list[tuple], packing: Packing, rows: Rows) -> None:
    pieces = _ground(pool, packing)
    lengths = [len(p[3]) // 4 for p in pieces]
    windows = -(-sum(lengths) // packing.capacity)
    while True:
        parts = differencing(lengths, windows)
        if max(sum(lengths[i] for i in part) for part in parts) <= packing.capacity:
            break
        windows += 1
    for part in parts:
        if part:
            rows.add(_joined([pieces[i] for i in sorted(part)]))


def _ground(pool: list[tuple], packing: Packing) -> list[tuple]:
    """The pool with some of its longest pieces cut small."""
    left = packing.sand * sum(len(p[3]) // 4 for p in pool)
    cut = set()
    for i in sorted(range(len(pool)), key=lambda i: -len(pool[i][3])):
        if left <= 0:
            break
        cut.add(i)
        left -= len(pool[i][3]) // 4
    out = []
    for i, (doc, total, start, ids) in enumerate(pool):
        step = 4 * packing.grain if i in cut else len(ids)
        out += [(doc, total, start + at // 4, ids[at:at + step]) for at in range(0, len(ids), step)]
    return out


def _joined(pieces: list[tuple]) -> list[tuple]:
    """Neighbouring pieces of one text that met again become one."""
    out = [pieces[0]]
    for piece in pieces[1:]:
        doc, total, start, ids = out[-1]
        if piece[:2] == (doc, total) and doc is not None and piece[2] == start + len(ids) // 4:
            out[-1] = (doc, total, start, ids + piece[3])
        else:
            out.append(piece)
    return out


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """``windows`` lists of indices with nearly equal sums of ``lengths``."""
    count = len(lengths)
    left, right = np.full(2 * count * 2 + windows * 2, -1, np.int64), np.full(2 * count * 2 + windows * 2, -1, np.int64)
    joint = count  # numbers from here on stand for two sets of pieces put together
    heap = []
    for i, length in enumerate(lengths):
        sums, held = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], held[0] = length, i
        heap.append((-length if windows > 1 else 0, i, sums, held))
    heapq.heapify(heap)
    turn = count
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums, in_b = a + b[::-1], in_b[::-1]
        both = np.flatnonzero((in_a >= 0) & (in_b >= 0))
        held = np.maximum(in_a, in_b)
        if joint + len(both) > len(left):
            left, right = (np.concatenate([x, np.full(len(x) + len(both), -1, np.int64)]) for x in (left, right))
        fresh = np.arange(joint, joint + len(both))
        left[fresh], right[fresh], held[both] = in_a[both], in_b[both], fresh
        joint += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums, held))
        turn += 1
    out = []
    for top in heap[0][3]:
        part, todo = [], [int(top)] if top >= 0 else []
        while todo:
            x = todo.pop()
            if x < count:
                part.append(x)
            else:
                todo += [int(left[x]), int(right[x])]
        out.append(part)
    return out
