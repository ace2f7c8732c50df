"""Every query with SQL gives DuckDB's rows; the others run."""

import pytest

from treeline.plans import catalog

from .compare import same
from .conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_duckdb(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_rebalance_moves_copies(spark):
    assert catalog.QUERIES["rebalance_plan"](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
