"""Sample measures against plain loops, on odd clips and on long ones."""

from __future__ import annotations

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import samples as sm
from lectern.operators import clips as cp
from lectern.operators import quality as ql

SCHEMA = "id int, s array<double>, rate int, channels int, chars int, peak string"


def odd() -> list[tuple]:
    rnd = random.Random(5)
    nan, inf = math.nan, math.inf
    fixed = [None, [], [0.0], [0.5, -1.0], [nan], [0.1, None, 0.2], [inf, 0.0], [-inf], [1e300, 1e-300], [0.0] * 40, [0.9995] * 3 + [0.1] * 5, [0.0] * 10 + [0.7] + [0.0] * 10]
    fixed += [[rnd.choice([0.0, rnd.uniform(-1, 1), 0.001]) for _ in range(rnd.randint(1, 90))] for _ in range(60)]
    return [(i, s, rnd.choice([20, 50, 400, 1]), rnd.choice([1, 2, 3]), 4, "x") for i, s in enumerate(fixed)] + [(900, [0.1] * 9, None, 1, 4, "x"), (901, [0.1] * 9, 20, 0, 4, "x"), (902, [0.1] * 9, 0, None, 4, "x")]


@pytest.fixture(scope="module")
def clips(spark):
    return spark.createDataFrame(odd(), SCHEMA).repartition(3)


def same(a, b):
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-12, abs=1e-300)


def numbers(s):
    return None if s is None else [math.nan if x is None else x for x in s]


def rms(x):
    return math.sqrt(math.fsum(v * v for v in x) / len(x)) if all(map(math.isfinite, x)) and max(map(abs, x)) < 1e150 else None


def test_measures_agree_with_loops(clips):
    found = {r["id"]: r["m"] for r in clips.select("id", ql.measures(F.col("s"), F.col("rate"), F.col("channels"), clipped=0.9, silent=0.01, quiet=0.3).alias("m")).collect()}
    for i, s, rate, channels, *_ in odd():
        s, m = numbers(s), found[i]
        if s is None:
            assert m["usable"] is None and m["peak"] is None and m["seconds"] is None
            continue
        assert m["usable"] == (len(s) > 0 and all(map(math.isfinite, s)))
        if not s:
            assert m["peak"] is None and m["clipped"] is None and m["rms"] is None and m["seconds"] is None
            continue
        assert same(m["peak"], math.nan if any(map(math.isnan, s)) else max(map(abs, s)))
        assert same(m["clipped"], sum(abs(x) >= 0.9 for x in s) / len(s)) and same(m["silent"], sum(abs(x) < 0.01 for x in s) / len(s))
        assert rms(s) is None or same(m["rms"], rms(s))
        if not rate or not channels:
            assert m["seconds"] is None and m["quiet_run"] is None
            continue
        assert same(m["seconds"], len(s) // channels / rate)
        if m["usable"] and max(map(abs, s)) < 1e150:
            folded = [sum(s[k:k + channels]) / channels for k in range(0, len(s) - channels + 1, channels)]
            size = max(1, round(rate * 0.02))
            quiet = [rms(folded[k:k + size]) < 0.3 for k in range(0, len(folded) - size + 1, size)]
            assert m["quiet_run"] == max([0, *(len(list(g)) for q, g in itertools.groupby(quiet) if q)])


def test_frames_bounds_and_gain_agree_with_loops(clips):
    rows = clips.select("id", "s", "rate", "channels", ql.mono(F.col("s"), F.col("channels")).alias("mono"), ql.frame_rms(F.col("s"), F.lit(4)).alias("frames"),
                        cp.audible_bounds(F.col("s"), F.col("rate"), relative=0.5).alias("b"), cp.apply_gain(F.col("s")).alias("scaled")).collect()
    for r in rows:
        s, channels = numbers(r["s"]), r["channels"] or 0
        if s is None:
            assert r["mono"] is None and r["frames"] is None and r["b"] is None and r["scaled"] is None
            continue
        want = [sum(s[k:k + channels]) / channels for k in range(0, len(s) - channels + 1, channels)] if channels > 0 else []
        assert len(r["mono"]) == len(want) and all(map(same, r["mono"], want))
        assert len(r["frames"]) == len(s) // 4
        assert all(rms(s[4 * k:4 * k + 4]) is None or same(v, rms(s[4 * k:4 * k + 4])) for k, v in enumerate(r["frames"]))
        limit = max(0.002, 0.5 * max(map(abs, s), default=0)) if s and not any(map(math.isnan, s)) else 0.002
        loud = [k for k, x in enumerate(s) if abs(x) > limit]
        pad = math.floor((r["rate"] or 0) * 0.15)
        assert r["b"] == ((max(0, loud[0] - pad), min(len(s), loud[-1] + 1 + pad)) if loud else None)
        if s and all(map(math.isfinite, s)) and max(map(abs, s)) < 1e150:
            gain = min(4.0, 0.8 / max(map(abs, s))) if any(s) else 4.0
            assert r["scaled"] == pytest.approx([x * gain for x in s])


def test_broken_clips_fail_and_null_rates_do_too(clips):
    found = {r["id"]: r for r in ql.check_clips(clips.drop("peak"), "s").collect()}
    assert len(found) == len(odd())
    for i in (0, 1, 4, 5, 6, 7, 900, 901, 902):
        assert found[i]["reasons"] == ["empty_or_nonfinite_audio"] and found[i]["pass"] is False and found[i]["duration"] is None
    warned = {r["id"]: r["w"] for r in clips.select("id", cp.level_warnings(F.col("s")).alias("w")).collect()}
    assert warned[0] == [] and warned[1] == [] and "silence" in warned[9]


def test_pieces_do_not_change_measures(monkeypatch):
    rows = pa.array([s for _, s, *_ in odd()], pa.list_(pa.float32()))
    whole = [(c.peak().tolist(), c.usable().tolist()) for c, _ in sm.pieces(rows)][0]
    monkeypatch.setattr(sm, "PIECE", 7)
    parts = list(sm.pieces(rows.slice(3)))
    assert len(parts) > 20
    peaks = [p for c, _ in parts for p in c.peak().tolist()]
    assert all(map(same, peaks, whole[0][3:])) and [u for c, _ in parts for u in c.usable().tolist()] == whole[1][3:]


def test_a_minute_of_sound_takes_no_boxed_loop(spark):
    """Clips of 60 s at 24 kHz, stereo; no lambda over samples is left in the plan."""
    values = (0.5 * np.sin(np.arange(2 * 60 * 24000) / 50)).astype(np.float32)
    table = pa.table({"samples": pa.array([values] * 4, pa.list_(pa.float32())), "rate": [24000] * 4, "channels": [2] * 4, "chars": [600] * 4})
    long = spark.createDataFrame(table)
    checked = ql.check_clips(long)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan.split("reasons")[0] and plan.count("ArrowEvalPython") == 1
    started = time.time()
    rows = checked.select("duration", "peak", "clipping_ratio", "max_silence_seconds", "pass").collect()
    assert [(r["duration"], r["pass"]) for r in rows] == [(60.0, True)] * 4 and time.time() - started < 60
