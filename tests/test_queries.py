"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from lectern.plans import ORACLES, QUERIES
from tests.oracle import ROOT, compare, duck

SF = os.environ.get("TEST_SF", "0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    frame = QUERIES[name](spark, f"{ROOT}/sf{SF}")
    error, _ = compare(frame, con, ORACLES[name])
    assert error is None, error


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_registers_them():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0
    assert frame.columns == ["lang", "chapters", "segments", "chars", "spoken_chars", "hard_splits", "longest"]
