"""Measures of sample arrays: flat values and offsets of the Arrow list column, whole clips and frames reduced at once.

Each kernel sees a batch as one array of all its samples and the place where each clip begins, and works on pieces of some million samples (a
longer clip is a piece of its own). Nothing is boxed and nothing loops over samples. Null samples count as NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 1 << 22


@dataclass
class Ragged:
    """Consecutive clips: clip ``i`` owns ``values[offsets[i]:offsets[i + 1]]``. ``valid``: the clip is not null (a null one has no samples)."""

    values: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.valid)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def reduce(self, how: np.ufunc, values: np.ndarray, empty: float) -> np.ndarray:
        """One number for each clip, ``empty`` for one without samples."""
        out = np.full(len(self), empty, values.dtype)
        some = np.flatnonzero(self.sizes)
        if len(some):
            out[some] = how.reduceat(values, self.offsets[:-1][some])
        return out

    def peak(self) -> np.ndarray:
        return self.reduce(np.maximum, np.abs(self.values), np.nan)

    def count(self, test: np.ndarray) -> np.ndarray:
        return self.reduce(np.add, test.astype(np.int64), 0)

    def share(self, test: np.ndarray) -> np.ndarray:
        return self.count(test) / np.where(self.sizes, self.sizes, np.nan)

    def rms(self) -> np.ndarray:
        return np.sqrt(self.reduce(np.add, self.values * self.values, np.nan) / np.where(self.sizes, self.sizes, np.nan))

    def usable(self) -> np.ndarray:
        return (self.sizes > 0) & (self.count(~np.isfinite(self.values)) == 0)

    def frames(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First sample of every full frame of ``size`` samples, and where each clip's frames begin. A size below 1 has no frames."""
        number = np.where(size > 0, self.sizes // np.maximum(size, 1), 0)
        first = np.concatenate([[0], np.cumsum(number)])
        within = np.arange(first[-1]) - np.repeat(first[:-1], number)
        return np.repeat(self.offsets[:-1], number) + within * np.repeat(size, number), first

    def frame_sums(self, values: np.ndarray, size: np.ndarray) -> Ragged:
        """Sums of ``values`` over the full frames of each clip."""
        start, first = self.frames(size)
        if not len(start):
            return Ragged(np.zeros(0), first, self.valid)
        ends = start + np.repeat(size, np.diff(first))
        # the sum from a start to its end, then from there to the next start, which is left out
        bounds = np.stack([start, ends], 1).ravel()
        return Ragged(np.add.reduceat(np.append(values, 0.0), bounds)[::2], first, self.valid)

    def mono(self, channels: np.ndarray) -> Ragged:
        """Channel mean of interleaved samples; an incomplete last frame is dropped."""
        if (channels == 1).all():
            return self
        sums = self.frame_sums(self.values, channels)
        sums.values /= np.repeat(channels, sums.sizes)
        return sums

    def frame_rms(self, size: np.ndarray) -> Ragged:
        sums = self.frame_sums(self.values * self.values, size)
        sums.values = np.sqrt(sums.values / np.repeat(size, sums.sizes))
        return sums

    def longest_run(self, test: np.ndarray) -> np.ndarray:
        """Length of the longest run of consecutive values that pass, within a clip."""
        best = np.zeros(len(self), np.int64)
        if not len(test):
            return best
        edge = np.zeros(len(test) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], test[:-1]])
        after = np.concatenate([test[1:], [False]])
        start = np.flatnonzero(test & (~before | edge[:-1]))
        end = np.flatnonzero(test & (~after | edge[1:])) + 1
        np.maximum.at(best, np.searchsorted(self.offsets, start, "right") - 1, end - start)
        return best

    def audible(self, floor: float, relative: float, pad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last (exclusive) kept sample, padded around what is louder than the threshold, and whether anything is."""
        limit = np.fmax(floor, self.peak() * relative)
        at = np.flatnonzero(np.abs(self.values) > np.repeat(limit, self.sizes))
        low, high = np.searchsorted(at, self.offsets[:-1]), np.searchsorted(at, self.offsets[1:])
        heard = high > low
        if not len(at):
            return np.zeros(len(self), np.int64), np.zeros(len(self), np.int64), heard
        first = at[np.minimum(low, len(at) - 1)] - self.offsets[:-1]
        last = at[np.maximum(high - 1, 0)] - self.offsets[:-1] + 1
        return np.maximum(first - pad, 0), np.minimum(last + pad, self.sizes), heard


def _numbers(column: pa.Array, rows: slice) -> np.ndarray:
    """Whole numbers, 0 for null."""
    return pc.fill_null(pc.cast(column[rows], pa.int64()), 0).to_numpy(zero_copy_only=False)


def pieces(column: pa.Array) -> Iterator[tuple[Ragged, slice]]:
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(lengths)
    low = 0
    while low < len(column):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + PIECE, "right")))
        part = column[low:high]
        values = part.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        offsets = np.concatenate([[0], np.cumsum(lengths[low:high])])
        yield Ragged(values, offsets, pc.is_valid(part).to_numpy(zero_copy_only=False)), slice(low, high)
        low = high


def _nullable(values: np.ndarray, known: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=~known)


def _lists(clips: Ragged) -> pa.Array:
    offsets = pa.array(clips.offsets.astype(np.int32), pa.int32(), mask=np.append(~clips.valid, False))
    return pa.ListArray.from_arrays(offsets, pa.array(clips.values))


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@dataclass(frozen=True)
class Levels:
    """Limits the measures are taken at: ``clipped`` from which a sample counts as clipped, ``silent`` under which one does as silent, ``quiet``
    for the level of a frame of ``frame`` seconds."""

    clipped: float
    silent: float = 0.0
    quiet: float = 0.0
    frame: float = 0.02


MEASURES = T.StructType([T.StructField("usable", T.BooleanType()), *(T.StructField(n, T.DoubleType()) for n in ("seconds", "peak", "clipped", "silent", "rms")),
                         T.StructField("quiet_run", T.LongType())])
DOUBLES = T.ArrayType(T.DoubleType())
BOUNDS = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
_FIELDS = [("usable", pa.bool_()), ("seconds", pa.float64()), ("peak", pa.float64()), ("clipped", pa.float64()), ("silent", pa.float64()), ("rms", pa.float64()), ("quiet_run", pa.int64())]


@lru_cache(maxsize=64)
def _measure(levels: Levels) -> Callable[..., Column]:
    @F.arrow_udf(MEASURES)
    def measured(samples: pa.Array, rate: pa.Array, channels: pa.Array) -> pa.Array:
        out = []
        for clips, rows in pieces(samples):
            rates, split = _numbers(rate, rows), _numbers(channels, rows)
            some = clips.valid & (clips.sizes > 0)
            timed = some & (rates > 0) & (split > 0)
            loud = np.abs(clips.values)
            size = np.where(timed, np.maximum(1, np.rint(rates * levels.frame)), 0).astype(np.int64)
            frames = clips.mono(np.where(split > 0, split, 0)).frame_rms(size)
            seconds = np.where(timed, clips.sizes // np.maximum(split, 1) / np.maximum(rates, 1), 0.0)
            columns = [(clips.usable(), clips.valid), (seconds, timed), (clips.peak(), some), (clips.share(loud >= levels.clipped), some),
                       (clips.share(loud < levels.silent), some), (clips.rms(), some), (frames.longest_run(frames.values < levels.quiet), timed)]
            out.append(pa.StructArray.from_arrays([_nullable(v, k, kind) for (v, k), (_, kind) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS]))
        return _joined(out, pa.struct(_FIELDS))
    return measured


def measures(samples: Column, levels: Levels, rate: Column | None = None, channels: Column | None = None) -> Column:
    """All measures of a clip in one pass, as ``MEASURES``. Fields are null for a null clip and, but for ``usable``, for an empty one; those in seconds
    also without a positive rate and number of channels."""
    one = F.lit(1).cast("bigint")
    return _measure(levels)(samples, one if rate is None else rate.cast("bigint"), one if channels is None else channels.cast("bigint"))


@F.arrow_udf(DOUBLES)
def mono(samples: pa.Array, channels: pa.Array) -> pa.Array:
    return _joined([_lists(clips.mono(_numbers(channels, rows))) for clips, rows in pieces(samples)], pa.list_(pa.float64()))


@F.arrow_udf(DOUBLES)
def frame_rms(samples: pa.Array, size: pa.Array) -> pa.Array:
    return _joined([_lists(clips.frame_rms(_numbers(size, rows))) for clips, rows in pieces(samples)], pa.list_(pa.float64()))


_BOUNDS = pa.struct([("first", pa.int64()), ("last", pa.int64())])


@lru_cache(maxsize=64)
def audible(floor: float, relative: float, pad_seconds: float) -> Callable[..., Column]:
    @F.arrow_udf(BOUNDS)
    def bounds(samples: pa.Array, rate: pa.Array) -> pa.Array:
        out = []
        for clips, rows in pieces(samples):
            first, last, heard = clips.audible(floor, relative, np.floor(_numbers(rate, rows) * pad_seconds).astype(np.int64))
            out.append(pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["first", "last"], mask=pa.array(~heard)))
        return _joined(out, _BOUNDS)
    return bounds


@F.arrow_udf(DOUBLES)
def scaled(samples: pa.Array, gain: pa.Array) -> pa.Array:
    out = []
    for clips, rows in pieces(samples):
        factor = gain[rows].to_numpy(zero_copy_only=False)
        clips.values = clips.values * np.repeat(factor, clips.sizes)
        out.append(_lists(clips))
    return _joined(out, pa.list_(pa.float64()))
