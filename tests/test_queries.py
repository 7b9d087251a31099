"""Every registered query with check SQL gives the rows of DuckDB (small data)."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402

from keystead.plans import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_registry():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {n for n in names if n in QUERIES} <= set(entry.oracle_sql())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r.undervalue_score, r.id))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n in QUERIES))
def test_query(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None
