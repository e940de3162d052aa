import json

import pytest
from pyspark.errors import AnalysisException, ParseException

from tallyloom.functions.columns import settle_format
from tallyloom.functions.ranking import dense_index
from tallyloom.functions.scratch import scratch_folder
from tallyloom.operators.metrics import monthly_revenue
from tallyloom.sources import readers, sql, tables


def test_read_by_extension(spark, five, tmp_path):
    five.coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    assert readers.load_dataset(spark, str(tmp_path / "t.csv")).count() == 5
    document = tmp_path / "one.json"
    document.write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert readers.load_dataset(spark, str(document), json_document=True).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.load_dataset(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        readers.load_dataset(spark, str(tmp_path / "t.xlsx"))


def test_save_replace_and_append(spark, five):
    path = scratch_folder(spark)
    assert tables.save_table(five, "stored_five", path).head()["rows_loaded"] == 5
    tables.save_table(five, "stored_five", path, mode="append")
    assert spark.table("stored_five").count() == 10
    tables.save_table(five, "stored_five", path)
    assert spark.table("stored_five").count() == 5
    assert "stored_five" in tables.table_names(spark)
    rows = tables.table_catalog(spark, ["stored_five"]).collect()
    assert [r["column"] for r in sorted(rows, key=lambda r: r["ordinal"])] == five.columns and rows[0]["row_count"] == 5
    with pytest.raises(PermissionError):
        tables.sample_rows(spark, "stored_five")


def test_read_only_sql(spark, five):
    five.createOrReplaceTempView("transactions")
    assert sql.sql_query(spark, "SELECT COUNT(*) AS n FROM transactions;").head()["n"] == 5
    for text in ("DROP TABLE transactions", "delete from transactions", "SELECT replace('a', 'b', 'c')", "select 1; Insert into x values (1)"):
        with pytest.raises(PermissionError):
            sql.sql_query(spark, text)
    assert sql.sql_query(spark, "SELECT COUNT(*) AS dropped_rows FROM transactions").head()[0] == 5
    with pytest.raises(AnalysisException):
        sql.sql_query(spark, "SELECT nothing FROM nowhere")


def test_schema_fingerprint(spark, five):
    import hashlib

    five.createOrReplaceTempView("fingerprinted")
    expected = hashlib.md5("_".join(sorted(five.columns)).encode()).hexdigest()[:12]
    assert tables.schema_fingerprint(spark, ["fingerprinted"]).head()["fingerprint"] == expected


def test_csv_cells_with_quotes_line_feeds_and_missing_values(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('name,said,n,share\n"a","He said ""hi, you"" twice",1,0.5\nb,"two\nlines",NA,n/a\nc,,3,2\nd,NaN,x,1\n')
    rows = {r["name"]: r for r in readers.load_dataset(spark, str(path), schema="name string, said string, n int, share double").collect()}
    assert rows["a"]["said"] == 'He said "hi, you" twice' and rows["b"]["said"] == "two\nlines"
    assert rows["b"]["n"] is None and rows["b"]["share"] is None and rows["c"]["said"] is None and rows["d"]["said"] is None
    assert rows["d"]["n"] is None and rows["c"]["n"] == 3
    found = readers.load_dataset(spark, str(path))
    assert dict(found.dtypes) == {"name": "string", "said": "string", "n": "string", "share": "double"}


def test_dates_in_one_other_format(spark):
    df = spark.createDataFrame([("12/31/2024", 1.0), ("01/15/2025", 2.0), ("soon", 3.0), (None, 4.0)], "order_date string, revenue double")
    assert settle_format(df, "order_date") == ("MM/dd/yyyy", 1)
    rows = monthly_revenue(df, date_format="MM/dd/yyyy").collect()
    assert [(r["month"], r["revenue"]) for r in rows] == [("2024-12", 1.0), ("2025-01", 2.0)]
    assert settle_format(df.select("revenue"), "revenue") == ("", 0)


@pytest.mark.parametrize("text", [
    "SET spark.sql.ansi.enabled=false", "RESET", "USE default", "CACHE TABLE transactions", "UNCACHE TABLE transactions",
    "LOAD DATA INPATH '/x' INTO TABLE t", "ADD JAR '/x.jar'", "MSCK REPAIR TABLE t", "REFRESH TABLE t", "ANALYZE TABLE t COMPUTE STATISTICS",
    "MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN UPDATE SET a = 1", "EXPLAIN SELECT 1", "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'SELECT 1'",
    "DECLARE x = 1", "-- SELECT\nSET a = 1", "/* SELECT */ USE x", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT JAVA_METHOD ('java.util.UUID', 'randomUUID')", "SELECT * FROM parquet.`/x`", "SELECT * FROM `csv` . `/x`", "SELECT * FROM json /* */ . `/x`",
    "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM transactions", "FROM transactions MAP a USING 'cat' AS b", "SELECT * FROM IDENTIFIER('parquet.`/x`')",
    "SELECT IDENTIFIER('reflect')('a', 'b')", "CALL x()", "SELECT * FROM STREAM transactions", "SELECT * FROM transactions TIMESTAMP AS OF '2020-01-01'",
    "SELECT * FROM transactions WITH (path = '/x')", "SELECT unknown_function(1)", "SELECT * FROM python_worker_logs()", "SELECT from_protobuf(a, 'b', '/c') FROM transactions",
    "SELECT * FROM `org.apache.spark.sql.execution.datasources.parquet.ParquetFileFormat`.`/x`",
    "SELECT * FROM `org.apache.spark.sql.execution.datasources.v2.parquet.ParquetDataSourceV2`.`/x`", "SELECT * FROM a.b.c",
    # the same from every place where a query holds another, or an expression
    "SELECT 1 WHERE EXISTS (SELECT 1 FROM parquet.`/x`)", "SELECT (SELECT max(a) FROM orc.`/x`)", "SELECT 1 IN (SELECT a FROM text.`/x`)",
    "WITH a AS (SELECT * FROM csv.`/x`) SELECT 1", "SELECT * FROM transactions JOIN LATERAL (SELECT * FROM json.`/x`)", "FROM transactions |> JOIN parquet.`/x`",
    "SELECT sum(revenue) OVER w FROM transactions WINDOW w AS (ORDER BY java_method('a', 'b'))", "SELECT transform(array(1), x -> reflect('a', 'b'))",
    "SELECT sum(revenue) FILTER (WHERE reflect('a', 'b') = '1') FROM transactions", "VALUES (reflect('a', 'b'))", "SELECT * FROM range(reflect('a', 'b'))",
    "SELECT 1 LIMIT int(reflect('a', 'b'))", "SELECT * FROM transactions LATERAL VIEW reflect('a', 'b') x AS y", "SELECT try_reflect('a', 'b')", "SELECT system.builtin.reflect('a', 'b')",
])
def test_commands_are_refused(spark, five, text):
    five.createOrReplaceTempView("transactions")
    with pytest.raises((PermissionError, ParseException) if not text else PermissionError):
        sql.sql_query(spark, text)


def test_quotes_that_hide_a_call_do_not_run_it(spark):
    text = "SELECT 1 AS `'`, reflect('java.lang.System', 'setProperty', 'tallyloom.probe', 'b') AS `c'`"
    with pytest.raises(PermissionError):
        sql.sql_query(spark, text)
    assert spark._jvm.java.lang.System.getProperty("tallyloom.probe") is None


def test_queries_with_odd_literals_are_run(spark):
    assert sql.sql_query(spark, "(SELECT '-- set' AS a) UNION ALL VALUES ('/* x')").count() == 2
    assert sql.sql_query(spark, "-- a note\nWITH t AS (SELECT 'it\\'s' AS a) SELECT a FROM t;").head()[0] == "it's"
    assert sql.sql_query(spark, "SELECT 'reflect(1), parquet.`/x` USING' AS `reflect('a')`").head()[0] == "reflect(1), parquet.`/x` USING"


@pytest.mark.parametrize("text", [
    "SELECT order_id, sum(revenue) OVER w FROM transactions WINDOW w AS (PARTITION BY order_id ORDER BY revenue ROWS 1 PRECEDING)",
    "SELECT product_category, count(DISTINCT order_id) FILTER (WHERE revenue > 1) FROM transactions GROUP BY ROLLUP (product_category) HAVING count(*) > 0 ORDER BY 1 LIMIT 3 OFFSET 1",
    "SELECT /*+ BROADCAST(b) */ * FROM transactions a LEFT ANTI JOIN transactions b USING (order_id)", "FROM transactions |> WHERE revenue > 1 |> SELECT order_id",
    "SELECT * FROM transactions PIVOT (sum(revenue) FOR product_category IN ('Books', 'Clothing'))", "SELECT * FROM range(3), LATERAL (SELECT id + 1)",
    "SELECT * FROM transactions LATERAL VIEW explode(array(1, 2)) t AS n", "SELECT * EXCEPT (revenue) FROM transactions TABLESAMPLE (50 PERCENT)",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r", "SELECT transform(array(1), x -> x + 1), CAST('1' AS INT), extract(YEAR FROM DATE '2020-01-01')",
    "SELECT * FROM (VALUES (1, 2)) AS t(a, b) UNPIVOT (v FOR n IN (a, b))", "TABLE transactions", "SELECT order_id FROM transactions EXCEPT (SELECT 'O1' INTERSECT SELECT 'O2')",
])
def test_queries_of_every_kind_are_run(spark, five, text):
    five.createOrReplaceTempView("transactions")
    sql.sql_query(spark, text).collect()


def test_tables_of_the_catalog_by_their_whole_name(spark, five):
    five.createOrReplaceGlobalTempView("shared_five")
    assert sql.sql_query(spark, "SELECT * FROM global_temp.shared_five").count() == 5


def test_dense_index(spark):
    df = spark.range(1000).repartition(7)
    rows = dense_index(df, [df["id"].desc()], "at").collect()
    assert all(r["id"] + r["at"] == 999 for r in rows) and len(rows) == 1000


def test_samples_are_the_smallest_values_and_only_where_allowed(spark):
    df = spark.createDataFrame(
        [(1, "b", 0.5, None, [1]), (1, "b", 0.25, None, [2]), (2, None, 1e9, None, [3]), (3, "a'\n|", 0.5, None, [4]), (4, "", -1.0, None, [5])],
        "n int, s string, d double, none string, nested array<int>")
    assert tables.smallest_values(df) == {"n": ["1", "2", "3"], "s": ["", "a'\n|", "b"], "d": ["-1.0", "0.25", "0.5"], "none": [], "nested": []}
    assert tables.smallest_values(df.where("false"), 2)["n"] == []
    df.createOrReplaceTempView("sampled")
    shown = {r.column: r.samples for r in tables.schema_with_samples(spark, ["sampled"], allow_samples=True, k=2).collect()}
    assert shown["n"] == ["1", "2"] and shown["nested"] == []
    assert {r.samples for r in tables.schema_with_samples(spark, ["sampled"]).collect()} == {None}
