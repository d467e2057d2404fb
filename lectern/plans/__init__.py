"""Queries over the standard tables, registered with the SQL they are checked against."""

from . import (chapter_queries, job_queries, lifecycle_queries, quality_queries, segment_queries, state_queries, stream_queries,  # noqa: F401
               text_queries)
from .registry import ORACLES, QUERIES  # noqa: F401
