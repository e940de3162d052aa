"""The registered queries: name -> function of (spark, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import settle_format
from ..functions.scratch import materialize, scratch_folder
from ..operators import (
    attribution, autoregression, churn, cleaning, encoding, evidence, experience, hypothesis, inspection, metrics, privacy,
    profile, questions, runs, series, statistics,
)
from ..sources import readers, sql, tables as stored
from . import tables as t
from .tables import read, stored_dirty, transactions, transactions_dirty

# A linear churn model given from outside, so that scores can be checked in SQL.
COEFFICIENTS = {
    "recency": 0.031, "frequency": -0.24, "monetary": -0.0000004, "avg_order_value": 0.00002,
    "avg_quantity": 0.015, "avg_discount": -1.5, "distinct_categories": -0.08,
}
INTERCEPT = 0.75
RISK_DAYS = 90

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _text(values: str, separator: str = "; ") -> F.Column:
    """An array column as one text, so that results compare as plain values."""
    return F.array_join(values, separator).alias(values)


def _rounded(df: DataFrame, names: list[str], digits: int) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- sources, catalog, SQL ----------------------------------------------------------------

@query
def scan_transactions(spark, d):
    return transactions(spark, d)


def _round_trip(spark, df, extension):
    path = f"{scratch_folder(spark)}.{extension}"
    writer = df.write.option("header", True).option("escape", '"') if extension == "csv" else df.write
    getattr(writer, extension)(path)
    return readers.load_dataset(spark, path, schema=df.schema)


@query
def scan_csv(spark, d):
    return _round_trip(spark, read(spark, d, "documents"), "csv")


@query
def scan_json(spark, d):
    return _round_trip(spark, read(spark, d, "customer"), "json")


@query
def scan_json_array(spark, d):
    """Documents through files that hold one JSON array each."""
    docs = read(spark, d, "documents")
    path = f"{scratch_folder(spark)}.json"
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).mapInArrow(t.json_array_lines, "value string").write.text(path)
    return readers.load_dataset(spark, path, schema=docs.schema, json_document=True)


@query
def write_table_summary(spark, d):
    return stored.save_table(transactions(spark, d), "stored_transactions", scratch_folder(spark))


def _register(spark, d, *names):
    for name in names:
        read(spark, d, name).createOrReplaceTempView(name)


#: Given tables, described by what their files say.
GIVEN = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders",
    "pages", "part", "region", "supplier",
)


def _register_given(spark, d):
    for name in GIVEN:
        spark.read.parquet(f"{d}/{name}.parquet").createOrReplaceTempView(name)


@query
def table_catalog(spark, d):
    _register_given(spark, d)
    return stored.table_catalog(spark, list(GIVEN))


#: Tables whose values are written alike in Spark and in the SQL they are checked against.
SAMPLED = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "labels": ("doc_id", "quality", "toxic"),
    "benchmark": ("item_id", "text"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


@query
def schema_with_samples(spark, d):
    _register_given(spark, d)
    found = stored.schema_with_samples(spark, list(SAMPLED), allow_samples=profile.MODES["STANDARD"])
    return found.withColumn("samples", F.array_join("samples", " | "))


@query
def schema_without_samples(spark, d):
    _register_given(spark, d)
    return stored.schema_with_samples(spark, list(SAMPLED), allow_samples=profile.MODES["STRICT"]).withColumn("samples", F.array_join("samples", " | "))


@query
def table_names(spark, d):
    _register_given(spark, d)
    names = spark.createDataFrame([(n,) for n in stored.table_names(spark)], "table_name string")
    return names.where(F.col("table_name").isin(*GIVEN))


@query
def detect_schema(spark, d):
    return inspection.detect_schema(stored_dirty(spark, d)).withColumn("sample_values", _text("sample_values"))


@query
def detect_schema_approximately(spark, d):
    found = inspection.detect_schema_approximately(transactions_dirty(spark, d)).drop("unique_count")
    return found.withColumn("sample_values", _text("sample_values"))


@query
def dataset_info(spark, d):
    return inspection.dataset_info(transactions(spark, d))


@query
def schema_fingerprint(spark, d):
    _register_given(spark, d)
    return stored.schema_fingerprint(spark, list(GIVEN))


def _sql(spark, d, text):
    transactions(spark, d).createOrReplaceTempView("transactions")
    return sql.sql_query(spark, text)


SQL_TEXTS = {
    "sql_readonly": "SELECT COUNT(*) AS n, MIN(order_date) AS first_day, MAX(order_date) AS last_day FROM transactions;",
    "sql_filter_agg": """SELECT payment_method, COUNT(*) AS n, ROUND(SUM(revenue), 2) AS revenue,
        ROUND(AVG(quantity), 4) AS avg_quantity FROM transactions
        WHERE payment_method LIKE '%I%' AND order_date >= DATE '1996-01-01' AND order_date < DATE '1999-01-01'
        GROUP BY payment_method""",
    "sql_revenue_by_category": """SELECT product_category, ROUND(SUM(revenue), 2) AS total_revenue
        FROM transactions GROUP BY product_category ORDER BY total_revenue DESC""",
    "sql_top_customers": """SELECT customer_id, ROUND(SUM(revenue), 2) AS total_revenue, COUNT(*) AS items
        FROM transactions GROUP BY customer_id ORDER BY total_revenue DESC, customer_id LIMIT 10""",
    "sql_join_star": """SELECT r_name, n_name, COUNT(*) AS orders, COUNT(DISTINCT o_custkey) AS buyers,
        ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    "sql_setops": """SELECT c_custkey FROM customer EXCEPT
        (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
         INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
        UNION SELECT o_custkey FROM orders WHERE o_totalprice > 450000""",
    "sql_window_rank": """SELECT region, product_category, revenue,
        RANK() OVER (PARTITION BY region ORDER BY revenue DESC) AS place
        FROM (SELECT region, product_category, ROUND(SUM(revenue), 2) AS revenue
              FROM transactions GROUP BY region, product_category) AS per_segment""",
    "sql_subquery": """SELECT c_mktsegment, COUNT(*) AS buyers FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >
                      (SELECT AVG(o_totalprice) FROM orders)) GROUP BY c_mktsegment""",
}


def _sql_query(text: str) -> Query:
    def run(spark, d):
        _register(spark, d, "customer", "nation", "orders", "region")
        return _sql(spark, d, text)
    return run


for _name, _statement in SQL_TEXTS.items():
    REGISTRY[_name] = _sql_query(_statement)


# --- cleaning -------------------------------------------------------------------------------

MEASURES = ["quantity", "unit_price", "discount", "revenue", "cost"]


@query
def missing_values(spark, d):
    return cleaning.missing_values(transactions_dirty(spark, d))


@query
def impute_median(spark, d):
    dirty = stored_dirty(spark, d, "order_id", "line_no", *MEASURES)
    return cleaning.fill_missing(dirty, cleaning.fit_fills(dirty))


@query
def impute_mode(spark, d):
    dirty = stored_dirty(spark, d, "order_id", "line_no", "payment_method", "region")
    return cleaning.fill_missing(dirty, cleaning.fit_fills(dirty))


@query
def impute_report(spark, d):
    return cleaning.impute_report(spark, cleaning.fit_fills(stored_dirty(spark, d)))


@query
def duplicate_count(spark, d):
    return cleaning.duplicate_count(transactions_dirty(spark, d))


@query
def deduplicate(spark, d):
    return cleaning.deduplicate(transactions_dirty(spark, d))


@query
def outliers_iqr(spark, d):
    dirty = stored_dirty(spark, d, *MEASURES)
    return cleaning.outlier_report(dirty, cleaning.fit_bounds(dirty))


@query
def cap_outliers(spark, d):
    dirty = stored_dirty(spark, d, "order_id", "line_no", *MEASURES)
    return _rounded(cleaning.cap_outliers(dirty, cleaning.fit_bounds(dirty, MEASURES)), MEASURES, 4)


@query
def clean_transactions(spark, d):
    return _rounded(cleaning.clean_data(stored_dirty(spark, d)).data, MEASURES, 4)


@query
def clean_report(spark, d):
    return cleaning.clean_data(stored_dirty(spark, d)).report()


# --- encoding and scaling ---------------------------------------------------------------------

ENCODED = ["product_category", "payment_method", "region"]


@query
def encode_labels(spark, d):
    return encoding.encode_labels(stored_dirty(spark, d, "order_id", "line_no", "revenue", *ENCODED))


@query
def encoding_map(spark, d):
    return encoding.encoding_map(transactions_dirty(spark, d, *ENCODED))


@query
def scale_zscore(spark, d):
    rows = materialize(transactions(spark, d, "order_id", "line_no", *MEASURES))
    return _rounded(encoding.scale_zscore(rows, MEASURES), MEASURES, 6)


@query
def scaler_info(spark, d):
    return encoding.preprocess(materialize(transactions(spark, d, "order_id", *MEASURES, *ENCODED)))[2]


# --- statistics and profile -------------------------------------------------------------------

@query
def column_statistics(spark, d):
    return statistics.column_statistics(stored_dirty(spark, d))


@query
def describe_table(spark, d):
    return statistics.describe_table(stored_dirty(spark, d))


@query
def correlation_matrix(spark, d):
    return statistics.correlation_matrix(stored_dirty(spark, d))


@query
def correlation_matrix_4dp(spark, d):
    return statistics.correlation_matrix(transactions(spark, d), digits=4)


@query
def column_summaries(spark, d):
    return statistics.column_summaries(transactions_dirty(spark, d))


@query
def top_values(spark, d):
    return statistics.top_values(transactions_dirty(spark, d, "order_date", *ENCODED))


@query
def profile_columns(spark, d):
    return profile.profile_columns(transactions_dirty(spark, d))


@query
def semantic_types(spark, d):
    return profile.semantic_types(transactions_dirty(spark, d)).select("column", "semantic_type")


@query
def profile_stats(spark, d):
    return profile.profile_stats(stored_dirty(spark, d))


@query
def profile_top5(spark, d):
    return profile.profile_top(transactions_dirty(spark, d, *ENCODED)).withColumn("sample_summary", _text("sample_summary"))


@query
def strong_correlations(spark, d):
    return profile.relationships(stored_dirty(spark, d))


@query
def date_ranges(spark, d):
    return profile.date_ranges(transactions_dirty(spark, d))


def _profile(spark, d, mode):
    whole = profile.sanitize_profile(profile.profile_table(stored_dirty(spark, d)), mode)
    return whole.select("*", "stats.*").drop("stats").withColumn("sample_summary", _text("sample_summary"))


@query
def profile_strict(spark, d):
    return _profile(spark, d, "STRICT")


@query
def profile_standard(spark, d):
    return _profile(spark, d, "STANDARD")


@query
def dataset_profile(spark, d):
    found = profile.dataset_profile(transactions_dirty(spark, d), "transactions")
    return found.withColumns({c: _text(c) for c in ("numeric_columns", "categorical_columns", "datetime_columns", "id_columns")})


@query
def shared_profile(spark, d):
    """What of the whole profile may leave under STRICT: how many items a section has and which facts are told of them."""
    found = profile.shared_profile(stored_dirty(spark, d), "transactions")
    facts = F.array_join(F.array_sort(F.map_keys("facts")), ", ")
    samples = F.coalesce(F.col("facts")["sample_summary"], F.lit("-"))
    return found.select("section", "item", facts.alias("facts"), samples.alias("samples"), "privacy_mode")


# --- privacy ------------------------------------------------------------------------------------

@query
def mask_pii(spark, d):
    return privacy.mask_text(read(spark, d, "documents").select("doc_id", "text"))


@query
def pii_counts(spark, d):
    return privacy.pii_counts(read(spark, d, "documents"), "source")


# --- business metrics -----------------------------------------------------------------------------

@query
def kpi_totals(spark, d):
    return metrics.kpi_totals(transactions(spark, d, "order_id", "customer_id", "revenue"))


@query
def revenue_by_category(spark, d):
    return metrics.revenue_by(transactions(spark, d, "product_category", "revenue"), "product_category")


@query
def revenue_by_region(spark, d):
    return metrics.revenue_by(transactions(spark, d, "region", "revenue"), "region")


@query
def monthly_revenue(spark, d):
    return metrics.monthly_revenue(transactions(spark, d, "order_date", "revenue"))


def _dates_as_text(spark, d):
    """Transactions whose dates are text with the month first."""
    rows = transactions(spark, d, "order_date", "revenue", "region")
    return rows.withColumn("order_date", F.date_format("order_date", "MM/dd/yyyy"))


@query
def monthly_revenue_from_text(spark, d):
    rows = _dates_as_text(spark, d)
    return metrics.monthly_revenue(rows, date_format=settle_format(rows, "order_date")[0])


@query
def daily_revenue_from_text(spark, d):
    rows = _dates_as_text(spark, d)
    return series.daily_values(rows, by=["region"], date_format=settle_format(rows, "order_date")[0])


@query
def date_ranges_from_text(spark, d):
    return profile.date_ranges(_dates_as_text(spark, d), ["order_date"])


@query
def dataset_info_from_text(spark, d):
    return inspection.dataset_info(_dates_as_text(spark, d))


@query
def discount_given_by_category(spark, d):
    """Sums of values with fractions of a cent."""
    rows = transactions(spark, d, "product_category", "quantity", "unit_price", "discount")
    given = rows.withColumn("given", F.col("quantity") * F.col("unit_price") * F.col("discount") / 7)
    return metrics.revenue_by(given, "product_category", "given")


@query
def top_customers(spark, d):
    return metrics.top_customers(transactions(spark, d, "customer_id", "revenue"))


@query
def orders_by_payment(spark, d):
    return metrics.count_by(transactions(spark, d, "payment_method"), "payment_method")


@query
def segment_breakdown(spark, d):
    return metrics.segment_breakdown(transactions_dirty(spark, d, "region", "revenue"), "region", "revenue")


@query
def segment_share_rank(spark, d):
    return metrics.segment_share_rank(transactions(spark, d, "customer_id", "revenue"), "customer_id", "revenue")


@query
def monthly_trend(spark, d):
    return metrics.monthly_trend(transactions(spark, d, "order_date", "revenue"))


@query
def filter_date_range(spark, d):
    rows = transactions(spark, d, "order_id", "line_no", "order_date", "quantity", "revenue")
    return metrics.filter_rows(rows, [F.col("quantity") > 40], "order_date", "1997-01-01", "1998-07-01")


@query
def aggregate_by(spark, d):
    return metrics.aggregate_by(stored_dirty(spark, d, "product_category", "revenue"), "product_category", "revenue")


# --- churn and attribution -------------------------------------------------------------------------

_CHURN_COLUMNS = ("customer_id", "order_id", "order_date", "revenue", "quantity", "discount", "product_category")


def _features(spark, d):
    return churn.churn_features(transactions(spark, d, *_CHURN_COLUMNS))


def _stored_features(spark, d):
    """Written once: the attributions read the features twice, for their means and themselves."""
    return materialize(_features(spark, d))


def _scores(features):
    return churn.score_customers(features, COEFFICIENTS, INTERCEPT)


@query
def churn_features(spark, d):
    features = _rounded(_features(spark, d), ["monetary"], 2)
    return _rounded(features, ["avg_order_value", "avg_quantity", "avg_discount"], 8)


@query
def churn_labels(spark, d):
    return churn.churn_labels(_features(spark, d)).select("customer_id", "recency", "churned")


@query
def stratified_split(spark, d):
    labeled = churn.churn_labels(_features(spark, d)).select("customer_id", "churned")
    return churn.stratified_split(materialize(labeled))


@query
def classification_report(spark, d):
    judged = churn.churn_labels(_features(spark, d)).withColumn("predicted", (F.col("recency") > RISK_DAYS).cast("int"))
    return churn.classification_report(judged, "churned", "predicted")


@query
def churn_scores(spark, d):
    return churn.predict_churn(transactions(spark, d, *_CHURN_COLUMNS))[0]


@query
def churn_scores_without_recency(spark, d):
    rows = transactions(spark, d, *_CHURN_COLUMNS)
    return churn.predict_churn(rows, exclude=["recency"], standardize=True)[0]


@query
def churn_fit_residuals(spark, d):
    """All zero: the fitted model is at its optimum."""
    features = [f for f in churn.FEATURES if f != "recency"]
    _, _, model, split = churn.predict_churn(transactions(spark, d, *_CHURN_COLUMNS), exclude=["recency"], standardize=True, tol=1e-9)
    train = split.where("not is_test")
    found = churn.fit_residuals(train, model, features, train.count())
    return found.select("term", (F.round("residual", 3) + 0.0).alias("residual"))


@query
def churn_summary(spark, d):
    return churn.churn_summary(_scores(_features(spark, d)))


@query
def churn_top_risk(spark, d):
    return churn.top_risk(_scores(_features(spark, d)))


@query
def linear_attribution(spark, d):
    return attribution.linear_attribution(_stored_features(spark, d), "customer_id", COEFFICIENTS)


@query
def attribution_base_value(spark, d):
    return attribution.base_value(_features(spark, d), COEFFICIENTS, INTERCEPT)


@query
def global_importance(spark, d):
    return attribution.global_importance(_stored_features(spark, d), COEFFICIENTS)


@query
def top_factors(spark, d):
    return attribution.top_factors(_stored_features(spark, d), "customer_id", COEFFICIENTS)


@query
def explain_customers(spark, d):
    features = _stored_features(spark, d)
    explained = attribution.explain_customers(features, _scores(features), "customer_id", COEFFICIENTS)
    return explained.drop("top_factors")


# --- time series --------------------------------------------------------------------------------------

def _daily(spark, d, *by):
    rows = transactions(spark, d, "order_date", "revenue", *by)
    return series.daily_values(rows, by=list(by))


@query
def daily_revenue(spark, d):
    return _daily(spark, d)


@query
def daily_gapfilled(spark, d):
    return series.fill_gaps(_daily(spark, d))


@query
def daily_gapfilled_by_category(spark, d):
    return series.fill_gaps(_daily(spark, d, "product_category"), ["product_category"])


@query
def history_tail(spark, d):
    return series.history_tail(_daily(spark, d))


@query
def forecast_linear(spark, d):
    return series.forecast_linear(_daily(spark, d))


@query
def forecast_width_offset(spark, d):
    """Width of the forecast's band around a series a billion higher; that of the series itself."""
    raised = series.fill_gaps(_daily(spark, d)).withColumn("value", F.col("value") + 1e9)
    return series.forecast_linear(raised).select("ds", F.round(F.col("upper") - F.col("lower"), 0).alias("width"))


@query
def forecast_linear_by_region(spark, d):
    return series.forecast_linear(_daily(spark, d, "region"), by=["region"])


@query
def forecast_summary(spark, d):
    return series.forecast_summary(_daily(spark, d))


@query
def forecast_summary_by_customer(spark, d):
    return series.forecast_summary(materialize(_daily(spark, d, "customer_id")), by=["customer_id"])


@query
def forecast_change(spark, d):
    rows = transactions(spark, d, "order_date", "revenue")
    return series.forecast_change(series.forecast_summary(series.daily_values(rows)), metrics.monthly_trend(rows))


@query
def forecast_evidence(spark, d):
    rows = transactions(spark, d, "order_date", "revenue")
    change = series.forecast_change(series.forecast_summary(series.daily_values(rows)), metrics.monthly_trend(rows))
    return series.forecast_evidence(change)


@query
def forecast_ar(spark, d):
    return series.forecast_ar(_daily(spark, d, "region"), by=["region"])


@query
def forecast_ar_first_order(spark, d):
    return series.forecast_ar(_daily(spark, d, "region"), by=["region"], order=1)


@query
def ar_orders(spark, d):
    return autoregression.ar_orders(_daily(spark, d, "region"), by=["region"])


@query
def forecast_ar_aic(spark, d):
    return autoregression.forecast_ar_aic(_daily(spark, d, "region"), by=["region"])


# --- questions, runs, evidence, experience -------------------------------------------------------------

@query
def tag_questions(spark, d):
    tagged = questions.tag_questions(t.question_log(spark, d)).drop("question")
    return tagged.withColumns({c: _text(c) for c in ("categories", "entities", "metrics", "constraints")})


@query
def extract_customer_id(spark, d):
    return questions.extract_customer_id(t.question_log(spark, d)).drop("question")


@query
def triage_runs(spark, d):
    log = t.run_log(spark, d).withColumn("step_id", F.lit(1))
    return runs.triage_runs(log).select("run_id", "outcome", "error_type", "suggested_action", "details", "target_step_id")


@query
def triage_summary(spark, d):
    return runs.triage_summary(t.run_log(spark, d))


def _churn_results(spark, d):
    """Two steps per region: how many customers may leave, and what the scores rest on."""
    features = _stored_features(spark, d)
    buyers = transactions(spark, d, "customer_id", "region").distinct()
    judged = churn.churn_labels(_scores(features).join(features, "customer_id")).join(buyers, "customer_id")
    counted = judged.groupBy("region").agg(
        F.count("*").alias("n"), F.count_if("churned_predicted").alias("p"),
        F.round(F.avg((F.col("churned_predicted").cast("int") == F.col("churned")).cast("double")), 4).alias("a"))
    text = lambda c: F.col(c).cast("string")
    scored = counted.select(
        F.col("region").alias("run_id"), F.lit(3).alias("step_id"), F.lit("score_customers(features)").alias("code"),
        F.create_map(F.lit("total_customers"), text("n"), F.lit("predicted_churned"), text("p"), F.lit("accuracy"), text("a")).alias("return_value"),
        F.lit(None).cast("array<struct<feature:string,importance:double>>").alias("importance"))
    ranked = attribution.global_importance(features, COEFFICIENTS).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("size"), "feature"))).alias("all"))
    weights = F.transform("all", lambda x: F.struct(x["feature"].alias("feature"), (-x["size"]).alias("importance")))
    explained = counted.select(
        F.col("region").alias("run_id"), F.lit(4).alias("step_id"), F.lit("global_importance(features)").alias("code"),
        F.create_map().cast("map<string,string>").alias("return_value"), ranked.select(weights).scalar().alias("importance"))
    return scored.unionByName(explained)


def _results(spark, d):
    """Four steps per region: revenue by category, its forecast, churn scores and what these rest on."""
    rows = transactions(spark, d, "region", "product_category", "order_date", "revenue")
    sums = rows.groupBy("region", "product_category").agg(
        F.round(F.sum("revenue"), 2).alias("sum"), F.round(F.avg("revenue"), 2).alias("mean"), F.count("*").alias("count")
    )
    segment = F.struct(
        F.lit("product_category").alias("dimension"), F.col("product_category").alias("segment"), "sum", "mean", "count"
    )
    text = lambda c: F.format_string("%.2f", c)
    none = F.create_map().cast("map<string,string>")
    breakdown = sums.groupBy("region").agg(
        F.collect_list(segment).alias("breakdown"), F.round(F.sum("sum"), 2).alias("total")
    ).select(
        F.col("region").alias("run_id"), F.lit(1).alias("step_id"), F.lit(True).alias("success"),
        F.lit("  revenue_by_category(df)\nshow()").alias("code"),
        F.create_map(F.lit("total_revenue"), text("total")).alias("return_value"),
        F.create_map(F.lit("total_revenue"), text("total"), F.lit("label"), F.lit("categories")).alias("extracted_metrics"),
        "breakdown",
    )
    summary = series.forecast_summary(series.daily_values(rows, by=["region"]), by=["region"])
    forecast = summary.select(
        F.col("region").alias("run_id"), F.lit(2).alias("step_id"), F.lit(True).alias("success"),
        F.lit("forecast_linear(daily)").alias("code"),
        F.create_map(
            F.lit("trend"), F.col("trend"), F.lit("forecast_avg"), text("forecast_avg"),
            F.lit("historical_avg"), text("last_30_days_avg"), F.lit("points_count"), F.col("forecast_periods").cast("string"),
        ).alias("return_value"),
        none.alias("extracted_metrics"), F.lit(None).cast(breakdown.schema["breakdown"].dataType).alias("breakdown"),
    )
    both = breakdown.unionByName(forecast).withColumn("importance", F.lit(None).cast("array<struct<feature:string,importance:double>>"))
    churned = _churn_results(spark, d).withColumns({
        "success": F.lit(True), "extracted_metrics": none, "breakdown": F.lit(None).cast(breakdown.schema["breakdown"].dataType)})
    return materialize(both.unionByName(churned))


@query
def evidence_rows(spark, d):
    return evidence.evidence_rows(_results(spark, d))


@query
def evidence_table(spark, d):
    return evidence.evidence_table(evidence.evidence_rows(_results(spark, d)))


@query
def audit_claims(spark, d):
    audited = evidence.audit_claims(t.claim_log(spark, d))
    return audited.select("claim_id", "run_id", "claim", "verdict", "issue")


@query
def uncovered_metrics(spark, d):
    return evidence.uncovered_metrics(t.requested_metrics(spark, d), t.claim_log(spark, d))


@query
def grounding_status(spark, d):
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))
    return evidence.grounding_status(customers, t.claim_log(spark, d), t.requested_metrics(spark, d))


@query
def grounding_issues(spark, d):
    return evidence.grounding_issues(t.claim_log(spark, d), t.requested_metrics(spark, d))


@query
def experience_topk(spark, d):
    asked = questions.tag_questions(t.question_log(spark, d)).select("task_type")
    found = experience.experience_topk(asked, t.experience_log(spark, d))
    return found.select("task_type", F.array_join(F.col("experiences").cast("array<string>"), ",").alias("experiences"), _text("heuristics"))


#: Minutes without an event that end a run.
PAUSE = 360


@query
def experiences(spark, d):
    """One experience per run of a user: events until a pause."""
    events = read(spark, d, "events")
    return experience.experiences(t.event_steps(spark, d), experience.dataset_signature(events), PAUSE)


@query
def experience_steps(spark, d):
    return experience.experience_steps(t.event_steps(spark, d), PAUSE)


# --- tests and regression -------------------------------------------------------------------------------

@query
def ttest(spark, d):
    return hypothesis.ttest(transactions(spark, d, "region", "revenue"), "region", "revenue", "ASIA", "EUROPE")


@query
def anova(spark, d):
    return hypothesis.anova(transactions(spark, d, "product_category", "revenue"), "product_category", "revenue")


@query
def anova_offset(spark, d):
    """The same F as ``anova``: a constant added to all values changes nothing."""
    rows = transactions(spark, d, "product_category", "revenue").withColumn("revenue", F.col("revenue") + 1e9)
    return _rounded(hypothesis.anova(rows, "product_category", "revenue"), ["f_statistic"], 3)


@query
def chi_square(spark, d):
    return hypothesis.chi_square(transactions(spark, d, "product_category", "payment_method"), "product_category", "payment_method")


@query
def regression_univariate(spark, d):
    return hypothesis.regression_univariate(transactions(spark, d, "quantity", "cost"), "quantity", "cost")


@query
def regression_multivariate(spark, d):
    """Revenue on three columns and on one that repeats the first, which is reported to add nothing."""
    rows = transactions(spark, d, "revenue", "quantity", "unit_price", "discount").withColumn("double_quantity", F.col("quantity") * 2)
    return hypothesis.regression_multivariate(rows, ["quantity", "unit_price", "discount", "double_quantity"], "revenue")
