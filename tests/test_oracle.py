"""Every registered query against its DuckDB statement on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from checks import compare

TABLES = entry_module.SMOKE_TABLES
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return compare.connect(TABLES)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, tables, name):
    query = entry_module.queries()[name]
    if name in ORACLE:
        assert compare.differences(spark, query, ORACLE[name], tables, TABLES) == []
    else:
        assert query(spark, TABLES).count() > 0


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(entry_module.queries())


def test_differences_are_found(spark, tables):
    frame = lambda spark, _: spark.sql("SELECT 1 AS a, 2.0D AS b")
    assert compare.differences(spark, frame, "SELECT 1 AS a, 2.0::DOUBLE AS b", tables, TABLES) == []
    assert compare.differences(spark, frame, "SELECT 1 AS a, 2.1::DOUBLE AS b", tables, TABLES)
    assert compare.differences(spark, frame, "SELECT 1::BIGINT AS a, 2.0::DOUBLE AS b", tables, TABLES)
    assert compare.differences(spark, frame, "SELECT 1 AS a, 2.0::DOUBLE AS b LIMIT 0", tables, TABLES)
    assert compare.differences(spark, frame, "SELECT 1 AS a, 2.0::DOUBLE AS c", tables, TABLES)


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns == ["year", "month", "month_name", "revenue", "orders", "prev_revenue", "mom_growth_pct"]
    assert rows.count() == 80
