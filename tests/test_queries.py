"""Every registered query of the engine: against its SQL, or at least whole and repeatable."""

import pytest
from compare import assert_same, duck

from tidelens.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    assert_same(catalog.queries()[name](spark, SF), duck(SF), SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs_and_repeats(spark, name):
    first = sorted(map(repr, catalog.queries()[name](spark, SF).collect()))
    assert first
    if name != "scenario_series":
        assert first == sorted(map(repr, catalog.queries()[name](spark, SF).repartition(3).collect()))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
