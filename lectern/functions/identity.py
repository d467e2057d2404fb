"""Content identities: SHA-256 over canonical JSON (sorted keys, compact, raw non-ASCII)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def digest(**fields: Column) -> Column:
    """Digest of an object; keys are sorted, nulls kept. Cast doubles to strings before calling."""
    return digest_value(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))


def digest_value(value: Column) -> Column:
    """Digest of a struct, array or map column as JSON."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def digest_string(value: Column) -> Column:
    """Digest of a bare string: a JSON string literal, taken out of a one-element array."""
    literal = F.to_json(F.array(value))
    return F.sha2(F.substring(literal, F.lit(2), F.length(literal) - 2), 256)


def digest_literal(value) -> str:
    """The same digest for a driver-side value such as a configuration."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def hash_number(digest_column: Column) -> Column:
    """The first 32 bits of a hex digest as a number."""
    return F.conv(F.substring(digest_column, 1, 8), 16, 10).cast("bigint")


def content_hash(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def segment_seed(text: Column, chapter: Column, base: int = fixed.BASE_SEED) -> Column:
    return F.pmod(F.lit(base).cast("bigint") + hash_number(digest(text=text, chapter=chapter)),
                  F.lit(fixed.SEED_MODULUS).cast("bigint"))


def segment_id(text: Column, seed: Column, generation: str) -> Column:
    return digest(generation=F.lit(generation), text=text, seed=seed.cast("bigint"))


def attempt_seed(seed: Column, attempt: Column) -> Column:
    return F.pmod(seed.cast("bigint") + attempt.cast("bigint"), F.lit(fixed.SEED_MODULUS).cast("bigint"))
