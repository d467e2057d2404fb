"""The kernels under SQL names, for use in ``spark.sql``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.segment import cuts
from ..settings import SegmentSizes
from . import kernels


def register(spark: SparkSession, sizes: SegmentSizes = SegmentSizes()) -> None:
    """``segment_text(text)`` is a table function, for ``FROM …, LATERAL segment_text(text)``: a row ``seg_index, text, start, end, boundary`` for each
    piece. Pieces leave as they are cut and are never one array. The others are scalar."""
    spark.udtf.register("segment_text", segments(sizes))
    spark.udf.register("fold_compatible", kernels.fold_compatible)
    spark.udf.register("unescape_compose", kernels.unescape_compose)
    spark.udf.register("edit_operations", kernels.edit_operations)


SEGMENT = "seg_index bigint, text string, start int, end int, boundary string"


def segments(sizes: SegmentSizes):
    class Segments:
        def eval(self, text: str | None) -> Iterator[tuple]:
            if text is not None:
                for number, piece in enumerate(cuts(text, sizes.target, sizes.longest, sizes.shortest), 1):
                    yield number, *piece
    return udtf(Segments, returnType=SEGMENT, useArrow=True)
