"""Registered queries of the subpackage beside their SQL, and op12 beside the plain base patterns, on the smallest tables."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry_file
import check
from test_personal_data import brute_base, text_of

FOLDER = "/root/testdata/sf0.001"
WITH_SQL = [n for n in entry_file.oracle_sql() if n.startswith("op")]


def test_which_have_sql():
    assert set(WITH_SQL) == {"op7_exact_dedup", "op11_lexical_search", "op13_fill_in_middle"}


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = entry_file.queries()[name](spark, FOLDER)
    found = base.execute(entry_file.oracle_sql()[name])
    theirs = check.ordered([c[0] for c in found.description], found.fetchall())
    assert check.ordered(df.columns, [tuple(r) for r in df.collect()]) == theirs


def test_op12_counts_and_digests(spark):
    rows = {r.doc_id: r for r in entry_file.queries()["op12_personal_data"](spark, FOLDER).collect()}
    for doc_id, text in duckdb.execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall():
        spans, row = brute_base(text), rows.pop(doc_id)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for _, _, k in spans) for kind in range(4)]
        assert row.base_sha256 == hashlib.sha256(text_of(spans).encode()).hexdigest()
        assert set(text_of(spans).split(",")) <= set(row.spans.split(","))
    assert not rows
