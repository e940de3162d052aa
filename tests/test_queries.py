"""Every registered query beside its SQL on the smallest tables, and checks of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry_file
import check

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_entry(spark):
    assert entry_file.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())


#: The training-data operators have tests of their own.
@pytest.mark.parametrize("name", [n for n in entry_file.queries() if not n.startswith("op") and n != "pipeline"])
def test_query_matches_sql(spark, base, name):
    df = entry_file.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    statement = entry_file.oracle_sql().get(name)
    if statement is None:
        assert rows
        return
    found = base.execute(statement)
    theirs = check.ordered([c[0] for c in found.description], found.fetchall())
    assert check.ordered(df.columns, rows) == theirs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_needed(spark):
    text = plan(entry_file.queries()["revenue_by_category"](spark, FOLDER))
    assert "o_custkey" not in text and "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_discount:double>" in text


def test_date_filter_reaches_the_scan(spark):
    text = plan(entry_file.queries()["filter_date_range"](spark, FOLDER))
    assert "GreaterThan(l_quantity,40.0)" in text and "GreaterThanOrEqual(o_orderdate" in text


def test_facts_scan_once_and_top_k_is_limited_before_the_shuffle(spark):
    facts = plan(entry_file.queries()["profile_columns"](spark, FOLDER))
    assert facts.count("FileScan parquet [l_orderkey") == 1
    top = plan(entry_file.queries()["top_values"](spark, FOLDER))
    assert "WindowGroupLimit" in top


@pytest.mark.parametrize("name", ["uncovered_metrics", "grounding_status", "kpi_totals", "encode_labels", "chi_square"])
def test_no_cross_or_nested_loop_joins(spark, name):
    text = plan(entry_file.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
