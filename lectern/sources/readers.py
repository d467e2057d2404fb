"""Readers: input discovery, text decoding, EPUB containers, JSON state and clip tables."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions import text as tx
from ..functions.rows import keep_where, unnest
from ..operators.scan import position
from ..session import stable

BOOK_GLOB = "*.{[tT][xX][tT],[eE][pP][uU][bB]}"


def discover(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Input files as ``path, modificationTime, length, content``. Missing or empty input is an error.

    ``content`` is read only if a later step selects it, and is never sorted or shuffled here; see ``listing``.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", BOOK_GLOB).option("recursiveFileLookup", str(recursive).lower())
    try:
        files = reader.load(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"No input book or directory: {path}") from exc
    if files.select("path").isEmpty():
        raise ValueError("No TXT/EPUB books found")
    return files


def listing(files: DataFrame) -> DataFrame:
    """The discovered files without their content, ordered by case-folded path."""
    return files.select("path", "modificationTime", "length").orderBy(F.lower("path"))


def decode_text(files: DataFrame, encoding: str | None = None, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Decoded files with ``text, encoding``, and the undecodable ones with ``error``.

    UTF-8 is decoded in the JVM; only other content reaches the Arrow kernels, where damaged content becomes an error row.
    """
    data = F.col(content)
    if encoding:
        named = encoding.lower().replace("_", "-")
        strict = F.decode(data, "UTF-8") if named in {"utf-8", "utf8"} else None
        text = F.when(F.is_valid_utf8(data.cast("string")), strict) if strict is not None else kernels.decode_as(encoding)(data)
        df = files.withColumn("text", text).withColumn("encoding", F.lit(encoding))
    else:
        start = F.hex(F.substring(data, 1, 2))
        marked = start.isin("FFFE", "FEFF")
        valid = F.is_valid_utf8(data.cast("string"))
        df = files.withColumn("_legacy", kernels.decode_legacy(F.when(~marked & ~valid, data)))
        plain = F.regexp_replace(data.cast("string"), "^\\x{FEFF}", "")
        df = (df.withColumn("text", F.when(marked, kernels.decode_as("utf-16")(F.when(marked, data))).when(valid, plain).otherwise(F.col("_legacy.text")))
              .withColumn("encoding", F.when(marked, "utf-16").when(valid, "utf-8").otherwise(F.col("_legacy.encoding"))).drop("_legacy"))
    return (keep_where(df, F.col("text").isNotNull()),
            keep_where(df, F.col("text").isNull()).drop("text", "encoding").withColumn("error", F.lit("Cannot detect text encoding")))


EPUB_ENTRIES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("pos", T.IntegerType()),
    T.StructField("item", T.StringType()), T.StructField("name", T.StringType()), T.StructField("properties", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("data", T.BinaryType())])

# Entries of small containers leave a task together: a frame for each costs far more than opening it.
ENTRY_ROWS, ENTRY_CHARS = 2000, 4 << 20


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _unpack(path: str, content: bytes) -> Iterator[tuple]:
    """Entries of one container: metadata, spine, table of contents, documents, images."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        container = ElementTree.fromstring(box.read("META-INF/container.xml"))
        package_name = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(box.read(package_name))
        base = posixpath.dirname(package_name)

        def full(href: str) -> str:
            return posixpath.normpath(posixpath.join(base, unquote(href)))

        manifest = {}
        for pos, node in enumerate(package.iter()):
            tag = _local(node.tag)
            if tag in {"title", "creator"} and node.text:
                yield path, "meta", pos, None, tag, None, node.text, None
            elif tag == "meta" and node.get("name") == "cover":
                yield path, "cover", pos, node.get("content"), None, None, None, None
            elif tag == "item":
                manifest[node.get("id")] = (node.get("href"), node.get("media-type", ""), node.get("properties", ""))
            elif tag == "itemref":
                yield path, "spine", pos, node.get("idref"), None, None, node.get("linear"), None
        listed = False
        for pos, (item, (href, media, properties)) in enumerate(manifest.items()):
            name = unquote(href)
            if media == "application/xhtml+xml":
                yield path, "doc", pos, item, name, properties, box.read(full(href)).decode("utf-8", "replace"), None
            elif media.startswith("image/"):
                yield path, "image", pos, item, name, properties, media, box.read(full(href))
            elif media == "application/x-dtbncx+xml":
                listed, entry = True, 0
                for point in ElementTree.fromstring(box.read(full(href))).iter():
                    if _local(point.tag) != "navPoint":
                        continue
                    label = next((e.text for e in point.iter() if _local(e.tag) == "text"), None)
                    target = next((e.get("src") for e in point if _local(e.tag) == "content"), None)
                    if target:
                        yield path, "toc", entry, None, unquote(target), None, label, None
                        entry += 1
        if not listed:
            for href, _, properties in manifest.values():
                if "nav" in properties.split():
                    for entry, (target, label) in enumerate(_navigation(box.read(full(href)))):
                        yield path, "toc", entry, None, posixpath.normpath(posixpath.join(posixpath.dirname(unquote(href)), unquote(target))), None, label, None


def _navigation(content: bytes) -> Iterator[tuple[str, str]]:
    """Targets and labels of a navigation document's table of contents."""
    for part in ElementTree.fromstring(content).iter():
        if _local(part.tag) == "nav" and any(_local(k) == "type" and "toc" in v.split() for k, v in part.attrib.items()):
            for link in part.iter():
                if _local(link.tag) == "a" and link.get("href"):
                    yield link.get("href"), " ".join("".join(link.itertext()).split())


def read_epub(files: DataFrame) -> dict[str, DataFrame]:
    """Typed tables of EPUB containers: ``meta, spine, docs, toc, images, covers, errors``.

    Containers are opened inside tasks, once: the entries are written. A broken one becomes an error row. Everything after this is joins
    (see ``epub``). The table of contents is the NCX, or without one the navigation document.
    """
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    own = list(_unpack(path, bytes(content)))
                except Exception as exc:  # one bad container must not stop the others
                    own = [(path, "error", 0, None, None, None, f"{type(exc).__name__}: {exc}", None)]
                rows += own
                held += sum(len(row[6] or "") + len(row[7] or b"") for row in own)
                if len(rows) >= ENTRY_ROWS or held >= ENTRY_CHARS:
                    yield pd.DataFrame(rows, columns=EPUB_ENTRIES.names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=EPUB_ENTRIES.names)

    books = files.filter(F.lower("path").endswith(".epub")).select("path", "content")
    entries = stable(books.mapInPandas(unpack, EPUB_ENTRIES).withColumnRenamed("path", "book_id"))

    def table(kind: str, *columns) -> DataFrame:
        return entries.filter(F.col("kind") == kind).select("book_id", *columns)

    return {
        "meta": table("meta", "pos", "name", "value"),
        "spine": table("spine", "pos", "item", F.col("value").alias("linear")),
        "docs": table("doc", "item", "name", "properties", F.col("value").alias("html")),
        "toc": table("toc", "pos", F.col("name").alias("href"), F.col("value").alias("title")),
        "images": table("image", "pos", "item", "name", "properties", F.col("value").alias("media_type"), "data"),
        "covers": table("cover", F.col("item").alias("cover_item")),
        "errors": table("error", F.col("value").alias("error")),
    }


def read_json_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One record per JSON document; an unreadable document gives nulls, a missing path an empty table."""
    fields = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    try:
        return (spark.read.schema(fields).option("multiLine", "true").option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    except AnalysisException:
        return spark.createDataFrame([], fields)


def read_segment_state(log: DataFrame, schema: T.StructType, key: str = "id", data: str = "data") -> DataFrame:
    """Key/JSON rows as typed records; unparsable rows keep their key and null fields."""
    return log.withColumn("_r", F.from_json(data, schema, {"mode": "PERMISSIVE"})).select(
        key, *[F.col(f"_r.{n}").alias(n) for n in schema.names if n != key])


CLIPS = "clip_id long, rate int, channels int, samples array<float>"


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """Clips as ``clip_id, rate, channels, samples, error``: an error where the rate or the channels make no signal of the samples."""
    df = spark.read.schema(CLIPS).parquet(path)
    known = (F.coalesce("rate", F.lit(0)) > 0) & (F.coalesce("channels", F.lit(0)) > 0)
    return df.withColumn("error", F.when(~known, "no rate or channels").when(F.col("samples").isNull(), "no samples")
                         .when(F.pmod(F.size("samples"), F.col("channels")) != 0, "incomplete frame"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files as ``file, line_no, line, bytes``. A large log is read in several splits, whose places give the order."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"), (F.octet_length("value") + 1).alias("bytes"))
    return position(rows, ["file"], ["_block", "_at"], "line_no").select("file", "line_no", "line", "bytes")


def lines_of(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    return (unnest(texts, tx.lines(text), *keys, at="_p", value="line")
            .select(*keys, (F.col("_p") + 1).alias("line_no"), "line", (F.octet_length("line") + 1).alias("bytes")))
