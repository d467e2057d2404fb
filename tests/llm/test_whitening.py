"""Whitening against numpy's own decomposition and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int, n long, w string"


def brute(vectors: list[list[float]], k: int = 8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors])
    n, total = len(x), x.sum(0)
    away = x - total / n
    values, basis = np.linalg.eigh(away.T @ away / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    return n, deviation, away @ basis / np.sqrt(values), values / np.trace(away.T @ away / n)


@pytest.mark.parametrize("size, rows", [(12, 400), (3, 50)])
def test_whitening_agrees_with_numpy(spark, size, rows):
    rng = np.random.default_rng(size)
    good = (rng.normal(size=(rows, size)) @ rng.normal(size=(size, size))).tolist()
    data = [(i, v) for i, v in enumerate(good)]
    data += [(rows, None), (rows + 1, [None, *good[0][1:]]), (rows + 2, [math.nan, *good[0][1:]]), (rows + 3, [-math.inf, *good[0][1:]]),
             (rows + 4, [1e30, *good[0][1:]]), (rows + 5, good[0][1:]), (rows + 6, []), (rows + 7, [*good[0], 1.0])]
    data += [(7, good[7]), (None, good[9])]
    frame = spark.createDataFrame([(i, v, 1, 5, "x") for i, v in data], SCHEMA).repartition(5)
    found = w.whiten(frame).collect()
    vectors = [*good, good[7], good[9]]
    n, deviation, white, explained = brute(vectors)
    k = min(8, size)
    assert len(found) == len(vectors) * k
    assert sorted(r["vec_id"] for r in found if r["component"] == 1 and r["vec_id"] is not None) == sorted([*range(rows), 7])
    assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in found)
    rows_of = {r["vec_id"] if r["vec_id"] is not None else rows + 1: {} for r in found}
    for r in found:
        rows_of[r["vec_id"] if r["vec_id"] is not None else rows + 1][r["component"]] = r
    signs = {}
    for i, want in enumerate(white[:rows]):
        for c in range(1, k + 1):
            r = rows_of[i][c]
            assert r["deviation"] == deviation[i]
            signs.setdefault(c, np.sign(r["whitened"] * want[c - 1]))
            assert r["whitened"] * signs[c] == pytest.approx(want[c - 1], abs=1e-8)
            assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)


@pytest.mark.parametrize("vectors", [[], [None, [], [None]], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_tables_without_variance_give_no_rows(spark, vectors):
    frame = spark.createDataFrame([(i, v, 0, 0, "") for i, v in enumerate(vectors)], SCHEMA)
    assert w.whiten(frame).count() == 0


def test_rank_bounds_components_and_limits_are_errors(spark):
    frame = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 0, 0, "") for i in range(9)], SCHEMA)
    found = w.whiten(frame)
    assert {r["component"] for r in found.collect()} == {1}
    assert found.agg(F.stddev_pop("whitened")).first()[0] == pytest.approx(1, abs=1e-9)
    with pytest.raises(ValueError, match="dimensions"):
        w.whiten(frame, w.Whitening(dimensions=2))


def test_deviations_beyond_64_bits():
    away, remainder, n = np.array([[1 << 49, 0], [3, -2]]), np.array([1, 2]), 1 << 20
    assert w.deviations(away, remainder, n) == [None, (3 * n - 1) ** 2 + (2 * n + 2) ** 2]
    edge = np.array([[3037000499, 0]])
    assert w.deviations(edge, np.array([0, 0]), 1) == [3037000499 ** 2]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 90])
def test_leading_eigenvectors(n):
    rng = np.random.default_rng(n)
    spread = rng.normal(size=(n, n))
    turn, _ = np.linalg.qr(spread)
    thrice = (turn * np.repeat([3.0, 2.0, 1.0], -(-n // 3))[:n]) @ turn.T  # clusters of equal eigenvalues
    blocks = np.diag(rng.integers(0, 3, n).astype(float))
    for matrix in (spread @ spread.T, thrice, (thrice + thrice.T) / 2, blocks, np.eye(n) * 1e9, np.zeros((n, n)), spread[:, :2] @ spread[:, :2].T * 1e-12):
        values, vectors = w.leading(matrix, 8)
        want = np.linalg.eigvalsh(matrix)[::-1][:8]
        size = max(np.abs(want).max(), 1e-300)
        assert np.abs(values - want).max() < 1e-13 * size
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_sturm_counts():
    diagonal, beside = np.array([2.0, 0.0, 2.0, 5.0]), np.array([1.0, 0.0, 3.0])
    full = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
    points = np.array([-9.0, 0.1, 2.0, 2.5, 9.0])
    assert w.below(diagonal, beside, points).tolist() == [(np.linalg.eigvalsh(full) < p).sum() for p in points]
