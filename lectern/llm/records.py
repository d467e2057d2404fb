"""Token sequences as length-delimited binary records with an offset index.

A record is: length of the payload (unsigned 64 bit), masked checksum of those eight bytes (32 bit), payload, masked checksum of the
payload (32 bit); all little-endian. The checksum is CRC-32, rotated by 15 bits and shifted by a constant, so that checksums of
data that hold checksums stay sound. The payload is: bytes per id (2 or 4), 1 if there is a document id, the document id (signed
64 bit), the ids. An index file holds, for each record and once more for the end, its offset and the number of ids before it in
the file (unsigned 64 bit each).

Each task writes one record file and one index under names of its own; the manifest, which Spark commits, lists those that count.
A task that is run again leaves a file nobody reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as w
from .tables import whole_numbers
from .tokenizing import Ids

MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
LEAD = struct.Struct("<BBq")
MANIFEST = "part int, records string, index string, n_records long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all texts, each followed by ``end_id``, and writes them in ascending order of id; returns the manifest, one row per file.

    The texts are sorted over the cluster into ``files`` ranges of ids (``spark.sql.shuffle.partitions`` by default). ``folder`` is a URI that
    every executor can write to. A null or empty text is the end id alone. Rows without id come first; rows that share an id follow
    each other, in any number of files. Ids are whole numbers; a column of another type is an error. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    whole_numbers(docs, id_col)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("hash"), F.monotonically_increasing_id().alias("row"))
    # one id may hold any share of the rows: its texts, and their copies, are spread too
    order = ["doc_id", "hash", "row"]
    ordered = source.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    where = f"{folder}/{uuid.uuid4().hex}"
    ordered.mapInArrow(lambda b: _write(b, where, vocabulary, end_id), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: all records in the order of the files. ``start`` counts the ids of all records before."""
    return _read(spark, manifest, None)


def read_shuffled(spark: SparkSession, manifest: DataFrame, seed: int) -> DataFrame:
    """The rows of ``read_records`` in an order drawn from ``seed``: every file's records are visited in random order over its index."""
    return _read(spark, manifest, seed)


def _read(spark: SparkSession, manifest: DataFrame, seed: int | None) -> DataFrame:
    # one row per file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.repartition(max(1, manifest.count())) if seed is None else placed.repartition(max(1, manifest.count()), F.xxhash64("part", F.lit(seed)))
    return placed.select("part", "records", "index", "base").mapInArrow(lambda b: _records(b, seed), "doc_id long, start long, n_tokens long, ids binary")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = Ids.of(vocabulary).encode
    end = np.array([end_id], "<u4").tobytes()
    part = TaskContext.get().partitionId()
    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
    out = None
    index, at, tokens = [], 0, 0
    for block in w.blocks(batches):
        if out is None:
            system, path = _open(name)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            out = system.open_output_stream(f"{path}.rec", buffer_size=1 << 20)
        raw = block.data.tobytes()
        for d, doc in enumerate(block.rows.column("doc_id").to_pylist()):
            ids = np.frombuffer(encode(raw[block.offsets[d]:block.offsets[d + 1]].decode("utf-8", "replace")) + end, "<u4")
            wide = 4 if int(ids.max()) > 0xFFFF else 2
            payload = LEAD.pack(wide, doc is not None, doc or 0) + ids.astype(f"<u{wide}").tobytes()
            length = struct.pack("<Q", len(payload))
            out.write(b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)))))
            index.append((at, tokens))
            at, tokens = at + HEAD.size + len(payload) + 4, tokens + len(ids)
    if out is not None:
        out.close()
        index.append((at, tokens))
        with system.open_output_stream(f"{path}.idx") as side:
            side.write(np.array(index, "<u8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([f"{name}.rec"]), pa.array([f"{name}.idx"]), pa.array([len(index) - 1]), pa.array([tokens])],
            ["part", "records", "index", "n_records", "n_tokens"])


def parse(frame: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids of one record; raises ``ValueError`` where lengths or checksums do not agree."""
    length, check = HEAD.unpack_from(frame)
    payload = frame[HEAD.size:-4]
    if masked(frame[:8]) != check or len(payload) != length or struct.pack("<I", masked(payload)) != frame[-4:]:
        raise ValueError("damaged record")
    wide, known, doc = LEAD.unpack_from(payload)
    return (doc if known else None), np.frombuffer(payload, f"<u{wide}", offset=LEAD.size).astype("<u4")


def _records(batches: Iterator[pa.RecordBatch], seed: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, records, index, base in zip(*(batch.column(c).to_pylist() for c in ("part", "records", "index", "base")), strict=True):
            system, path = _open(index)
            with system.open_input_stream(path) as side:
                place = np.frombuffer(side.read(), "<u8").astype(np.int64).reshape(-1, 2)
            system, path = _open(records)
            with system.open_input_file(path) as data:
                whole = np.random.default_rng([seed or 0, part]).permutation(len(place) - 1)
                for at, to in _runs(place[:, 0], 1 << 22):
                    # in order, a run of neighbouring records is one read; shuffled reads go record by record
                    order = range(at, to) if seed is None else whole[at:to]
                    raw = data.read_at(int(place[to, 0] - place[at, 0]), int(place[at, 0])) if seed is None else None
                    docs, starts, ids = [], [], []
                    for k in order:
                        low, high = int(place[k, 0]), int(place[k + 1, 0])
                        doc, own = parse(raw[low - place[at, 0]:high - place[at, 0]] if raw is not None else data.read_at(high - low, low))
                        docs.append(doc)
                        starts.append(base + int(place[k, 1]))
                        ids.append(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])


def _runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of records of at most ``limit`` bytes, or one record."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to
