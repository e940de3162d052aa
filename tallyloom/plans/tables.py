"""The tables the registered queries read, derived by Spark from the given Parquet tables.

``transactions`` has the grain of one line item. Every join follows a foreign key that
matches exactly one row, so a query names the columns it needs and only the joins behind
those are planned. No join carries a hint: Spark broadcasts a side that it measures to be
under its threshold and sort-merges, with skew splitting, one that is not.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scratch import materialize

COLUMNS = [
    "order_id", "line_no", "customer_id", "order_date", "product_id", "product_category", "quantity",
    "unit_price", "discount", "revenue", "cost", "payment_method", "region",
]
_FROM_PART = {"product_category", "unit_price", "cost"}
_FROM_ORDERS = {"customer_id", "order_date", "payment_method", "region"}


# Declared, so that opening a table runs no job to look its schema up.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the transactions table (all by default)."""
    columns = columns or tuple(COLUMNS)
    cents = lambda c: F.col(c).cast("decimal(12,2)")
    kept = (F.lit(1) - F.col("l_discount").cast("decimal(3,2)")).cast("decimal(4,2)")
    expressions = {
        "order_id": F.col("l_orderkey"), "line_no": F.col("l_linenumber"), "customer_id": F.col("o_custkey"),
        "order_date": F.col("o_orderdate").cast("date"), "product_id": F.col("l_partkey"),
        "product_category": F.col("p_type"), "quantity": F.col("l_quantity"),
        "unit_price": F.col("p_retailprice"), "discount": F.col("l_discount"),
        "revenue": F.round(cents("l_extendedprice") * kept, 2).cast("double"),
        "cost": F.round(F.col("l_quantity").cast("decimal(6,2)") * cents("p_retailprice"), 2).cast("double"),
        "payment_method": F.col("o_orderpriority"), "region": F.col("r_name"),
    }
    rows = read(spark, sf_dir, "lineitem")
    if _FROM_PART & set(columns):
        rows = rows.join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if _FROM_ORDERS & set(columns):
        orders = read(spark, sf_dir, "orders")
        if "region" in columns:
            places = read(spark, sf_dir, "nation").join(
                read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
            )
            buyers = read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(*[expressions[c].alias(c) for c in columns])


def transactions_dirty(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """All transactions with planted nulls, outliers and exact duplicate rows.

    The remainders below only decide which rows get a defect. Duplicates come from a
    two-element array in the row, so the table is scanned once.
    """
    columns = columns or tuple(COLUMNS)
    needed = [c for c in COLUMNS if c in columns or c in ("order_id", "line_no")]
    base = transactions(spark, sf_dir, *needed)
    hole = (F.col("order_id") * 31 + F.col("line_no") * 7) % 20
    planted = {"quantity": 1, "unit_price": 2, "discount": 3, "region": 4}
    changed = {c: F.when(hole != r, F.col(c)).alias(c) for c, r in planted.items()}
    spike = (F.col("order_id") * 7 + F.col("line_no")) % 500 == 0
    changed["revenue"] = F.when(spike, F.col("revenue") * 20).otherwise(F.col("revenue")).alias("revenue")
    copies = F.when((F.col("order_id") + F.col("line_no")) % 33 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.select(
        *[changed.get(c, F.col(c)) for c in columns], F.explode(copies).alias("_copy")
    ).drop("_copy")


def stored_dirty(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``transactions_dirty`` written once, for operators that scan their input several times."""
    return materialize(transactions_dirty(spark, sf_dir, *columns))


def _k() -> F.Column:
    return F.regexp_extract("props", r"(\d+)", 1).cast("bigint")


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question): one question per event, and every conversation turn in full."""
    kind, k = F.col("event_type"), _k().cast("string")
    asked = (
        F.when(kind == "view", F.concat(
            F.lit("What was the average order value by region in "), F.date_format("ts", "yyyy"),
            F.lit(" for customer CUST_"), F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit("?"),
        ))
        .when(kind == "click", F.concat(F.lit("Show the top "), k, F.lit(" products by quantity")))
        .when(kind == "purchase", F.concat(F.lit("Forecast sales for next "), k, F.lit(" days")))
        .when(kind == "signup", F.concat(F.lit("Why is customer cust_"), F.col("user_id").cast("string"), F.lit(" at risk?")))
        .otherwise("Analyze")
    )
    events = read(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("question_id"), asked.alias("question")
    )
    turns = read(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.col("text").alias("question"),
    )
    return events.unionByName(turns)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run record per event: errors fail, the other kinds return results of their own."""
    kind, k, value = F.col("event_type"), _k(), F.col("value")
    none = F.lit(None).cast("map<string,string>")
    text = lambda c: c.cast("string")
    returned = (
        F.when(kind == "view", F.create_map(F.lit("sample_size"), text(k % 10), F.lit("trend"), F.lit("stable")))
        .when(kind == "signup", F.create_map(F.lit("total_customers"), text(k % 7), F.lit("accuracy"), text(k / 100)))
        .when((kind == "purchase") & (k % 5 == 0), F.create_map(F.lit("error"), F.lit("no convergence")))
        .when(kind == "purchase", F.create_map(F.lit("points_count"), text(k), F.lit("model_accuracy"), text(k / 50)))
        .otherwise(none)
    )
    metrics = F.when((kind == "click") & (k % 2 == 0), F.create_map(F.lit("clicks"), text(value))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    failed = kind == "error"
    message = F.when(failed & (k % 4 == 0), "KeyError: 'revenue_target'").when(
        failed & (k % 4 == 1), "IndexError: list index out of range"
    )
    stderr = F.when(failed & (k % 4 == 2), "Column revenue_target is missing").otherwise("")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), (~failed).alias("success"), message.alias("error_message"),
        stderr.alias("stderr"), returned.alias("return_value"), metrics.alias("extracted_metrics"),
    )


def claim_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per order; a run is a customer."""
    status, priority, total = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    claim = (
        F.when(status == "F", F.concat(F.lit("The order total rose because of priority "), priority))
        .when(status == "P", F.concat(F.lit("A late shipment resulted in revenue of "), F.format_string("%.2f", total)))
        .otherwise(F.concat(F.lit("Order total was "), F.format_string("%.2f", total)))
    )
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("run_id"), claim.alias("claim"),
        F.when(status == "P", "late_share").otherwise("order_total").alias("metric_name"),
        F.when(priority != "5-LOW", total).alias("metric_value"),
        F.when(priority == "1-URGENT", "RCT").when(priority == "2-HIGH", "Segment Aggregation").alias("test_name"),
        F.round(F.lit(1.0) - total / 1000000, 2).alias("confidence_score"),
    )


def requested_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, metric): what each customer's market segment asks for."""
    segment = F.col("c_mktsegment")
    words = lambda *names: F.array(*[F.lit(n) for n in names])
    wanted = (
        F.when(segment == "BUILDING", words("Revenue", "records"))
        .when(segment == "AUTOMOBILE", words("order_total"))
        .when(segment == "MACHINERY", words("late share", "churn"))
        .when(segment == "HOUSEHOLD", words("dataset"))
        .otherwise(words("gross_margin", "priority"))
    )
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.explode(wanted).alias("metric"))


def experience_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One past experience per event, with the steps taken and the failures met."""
    kind, k = F.col("event_type"), _k().cast("string")
    task = (
        F.when(kind == "view", "descriptive").when(kind == "purchase", "forecasting")
        .when(kind == "signup", "predictive").otherwise("statistical")
    )
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), task.alias("task_type"),
        F.array(F.concat(F.lit("read "), kind), F.concat(F.lit("used k = "), k)).alias("successful_steps"),
        F.when(kind == "error", F.array(F.concat(F.lit("error with k = "), k)))
        .otherwise(F.array().cast("array<string>")).alias("failures"),
    )


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the steps of their users: an error is a failed step, a purchase an insight."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("owner"), F.col("ts").alias("at"), F.col("event_id").alias("step_id"),
        F.when(kind == "purchase", "forecasting").when(kind == "signup", "predictive").otherwise("descriptive").alias("task_type"),
        kind.alias("step"), (kind != "error").alias("success"), F.when(kind == "error", F.col("props")).alias("message"),
        F.when(kind == "purchase", F.col("props")).alias("insight"))


def json_array_lines(batches):
    """The lines of one JSON array: an opening bracket, the given objects, a closing one."""
    opened = False
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 10):
            part = batch.column("value").slice(at, 1 << 10)
            heads = pa.array(["[" if not opened and i == 0 else "," for i in range(len(part))])
            opened = True
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(heads, part, "")], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]" if opened else "[]"])], ["value"])


# --- the same tables in SQL, for the checks ---------------------------------------------

TRANSACTIONS_SQL = """transactions AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS customer_id,
    CAST(o_orderdate AS DATE) AS order_date, l_partkey AS product_id, p_type AS product_category,
    l_quantity AS quantity, p_retailprice AS unit_price, l_discount AS discount,
    CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(3,2))), 2) AS DOUBLE) AS revenue,
    CAST(round(CAST(l_quantity AS DECIMAL(6,2)) * CAST(p_retailprice AS DECIMAL(12,2)), 2) AS DOUBLE) AS cost,
    o_orderpriority AS payment_method, r_name AS region
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""

DIRTY_SQL = TRANSACTIONS_SQL + """,
spoiled AS (
  SELECT order_id, line_no, customer_id, order_date, product_id, product_category,
    CASE WHEN (order_id*31 + line_no*7) % 20 <> 1 THEN quantity END AS quantity,
    CASE WHEN (order_id*31 + line_no*7) % 20 <> 2 THEN unit_price END AS unit_price,
    CASE WHEN (order_id*31 + line_no*7) % 20 <> 3 THEN discount END AS discount,
    CASE WHEN (order_id*7 + line_no) % 500 = 0 THEN revenue * 20 ELSE revenue END AS revenue,
    cost, payment_method,
    CASE WHEN (order_id*31 + line_no*7) % 20 <> 4 THEN region END AS region
  FROM transactions),
dirty AS (
  SELECT * FROM spoiled UNION ALL SELECT * FROM spoiled WHERE (order_id + line_no) % 33 = 0)"""

_K_SQL = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

QUESTIONS_SQL = f"""question_log AS (
  SELECT 'e' || event_id AS question_id, CASE event_type
    WHEN 'view' THEN 'What was the average order value by region in ' || year(ts) || ' for customer CUST_'
      || lpad(CAST(user_id AS VARCHAR), 4, '0') || '?'
    WHEN 'click' THEN 'Show the top ' || {_K_SQL} || ' products by quantity'
    WHEN 'purchase' THEN 'Forecast sales for next ' || {_K_SQL} || ' days'
    WHEN 'signup' THEN 'Why is customer cust_' || user_id || ' at risk?'
    ELSE 'Analyze' END AS question FROM events
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations)"""

RUNS_SQL = f"""run_log AS (SELECT event_id AS run_id, event_type, {_K_SQL} AS k, value FROM events)"""

CLAIMS_SQL = """claim_log AS (
  SELECT o_orderkey AS claim_id, o_custkey AS run_id,
    CASE o_orderstatus WHEN 'F' THEN 'The order total rose because of priority ' || o_orderpriority
      WHEN 'P' THEN 'A late shipment resulted in revenue of ' || printf('%.2f', o_totalprice)
      ELSE 'Order total was ' || printf('%.2f', o_totalprice) END AS claim,
    CASE WHEN o_orderstatus = 'P' THEN 'late_share' ELSE 'order_total' END AS metric_name,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS metric_value,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'RCT' WHEN '2-HIGH' THEN 'Segment Aggregation' END AS test_name,
    round(1.0::DOUBLE - o_totalprice / 1000000, 2) AS confidence_score
  FROM orders),
audited AS (
  SELECT *, CASE WHEN metric_value IS NULL THEN 'null_value'
      WHEN (contains(lower(claim), 'cause') OR contains(lower(claim), 'proves that')
        OR contains(lower(claim), 'leads directly to') OR contains(lower(claim), 'resulted in'))
        AND coalesce(test_name, '') NOT IN ('Instrumental Variables', 'Causal Inference', 'RCT') THEN 'causal_overreach'
      WHEN confidence_score < 0.6 THEN 'low_confidence' END AS issue
  FROM claim_log),
requested AS (
  SELECT c_custkey AS run_id, unnest(CASE c_mktsegment WHEN 'BUILDING' THEN ['revenue', 'records']
    WHEN 'AUTOMOBILE' THEN ['order_total'] WHEN 'MACHINERY' THEN ['late share', 'churn']
    WHEN 'HOUSEHOLD' THEN ['dataset'] ELSE ['gross_margin', 'priority'] END) AS metric
  FROM customer),
uncovered AS (
  SELECT run_id, metric FROM requested r WHERE metric NOT IN ('dataset', 'records', 'general', 'none')
    AND NOT EXISTS (SELECT 1 FROM claim_log c WHERE c.run_id = r.run_id
      AND (contains(lower(claim), metric) OR contains(lower(metric_name), metric)
        OR len(list_filter(string_split(replace(metric, '_', ' '), ' '),
          lambda w: length(w) > 2 AND (contains(lower(claim), w) OR contains(lower(metric_name), w)))) > 0)))"""
