"""Every registered query against its SQL check on the smallest sample."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from caudal.catalog import all_queries
from tests.compare import connect, duck_answer, spark_answer
from tests.conftest import SAMPLE

QUERIES = entry_points.queries()
CHECKS = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = connect(SAMPLE)
    yield con
    con.close()


def test_every_query_has_a_check():
    """Queries of the training-data operators have checks only where SQL can express them."""
    assert set(all_queries()) <= set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(name, spark, duck):
    columns, rows = spark_answer(QUERIES[name](spark, SAMPLE))
    expected_columns, expected = duck_answer(duck, CHECKS[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry_point(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["canal", "total", "monto_total"]
    assert result.count() > 0
