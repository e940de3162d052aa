import datetime

import pytest

from tallyloom.functions.masking import mask_pii
from tallyloom.operators import encoding, inspection, metrics, privacy, profile, statistics
from pyspark.sql import functions as F


def test_profile_of_five_orders(five):
    table = {r["column"]: r for r in profile.profile_table(five).collect()}
    assert len(table) == 6 and table["revenue"]["row_count"] == 5
    assert table["revenue"]["semantic_type"] == "numeric"
    assert table["product_category"]["semantic_type"] == "categorical"
    assert table["order_id"]["semantic_type"] == "identifier" and table["order_date"]["semantic_type"] == "datetime"
    assert table["revenue"]["stats"]["mean"] == 260.0 and table["revenue"]["stats"]["min"] == 100.0
    assert table["product_category"]["sample_summary"] == ["Clothing (2)", "Electronics (2)", "Books (1)"]


def test_privacy_modes(five):
    whole = profile.profile_table(five)
    for mode in ("STRICT", "no such mode"):
        for row in profile.sanitize_profile(whole, mode).collect():
            assert row["sample_summary"] == ["[REDACTED_UNDER_STRICT_PRIVACY]"]
    standard = {r["column"]: r for r in profile.sanitize_profile(whole, "STANDARD").collect()}
    assert standard["product_category"]["sample_summary"] and "is_unique" not in standard["revenue"]


def test_relationships_and_date_range(five):
    edges = profile.relationships(five).collect()
    assert [(r["source"], r["target"]) for r in edges] == [("revenue", "quantity")]
    row = profile.date_ranges(five).head()
    assert (row["min"], row["max"], row["span_days"]) == ("2025-01-01 00:00:00", "2025-01-05 00:00:00", 4)


def test_semantic_rules(spark):
    df = spark.createDataFrame(
        [(1, 0, 5.0, 1.0), (2, 1, 5.0, 2.0)], "zip_code int, flag int, price double, lifetime_value double"
    )
    kinds = {r["column"]: r["semantic_type"] for r in profile.semantic_types(df).collect()}
    assert kinds == {"zip_code": "identifier", "flag": "categorical", "price": "numeric", "lifetime_value": "datetime"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = profile.profile_columns(df).collect()
    assert [(r["column"], r["row_count"], r["null_percentage"]) for r in rows] == [("a", 0, 0.0), ("b", 0, 0.0)]


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "x double, y double, c double")
    r = {(m["column"], m["other"]): m["r"] for m in statistics.correlation_matrix(df).collect()}
    assert r[("x", "y")] == r[("y", "x")] == 1.0 and r[("x", "x")] == 1.0
    assert r[("x", "c")] is None and r[("c", "c")] is None


def test_statistics(five):
    row = {r["column"]: r for r in statistics.column_statistics(five).collect()}["revenue"]
    assert (row["mean"], row["median"], row["min"], row["max"], row["q25"], row["q75"]) == (260.0, 250.0, 100.0, 500.0, 150.0, 300.0)
    assert row["std"] == 155.72


def test_inspection(five):
    info = inspection.dataset_info(five).head()
    assert (info["num_rows"], info["date_column"], info["date_min"]) == (5, "order_date", "2025-01-01 00:00:00")
    schema = {r["column"]: r for r in inspection.detect_schema(five).collect()}
    assert schema["revenue"]["sample_values"] == ["100.0", "150.0", "250.0"] and schema["quantity"]["unique_count"] == 4


def test_mostly_unparseable_text_is_no_date(spark):
    df = spark.createDataFrame([("2025-01-01",), ("x",), ("y",)], "when string")
    assert inspection.dataset_info(df).head()["date_column"] is None


@pytest.mark.parametrize("text,expected", [
    ("Contact user at test.user@example.com or 555-123-4567", "Contact user at [REDACTED_EMAIL] or [REDACTED_PHONE]"),
    ("card 1234 5678 9012 3456.", "card [REDACTED_CARD]."),
    ("no data here", "no data here"),
    ("tel (555) 123 4567", "tel ([REDACTED_PHONE]"),
    (None, None),
])
def test_masking(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    masked = df.select(mask_pii(F.col("t")).alias("t")).head()["t"]
    if text and text.startswith("tel"):
        assert "[REDACTED_PHONE]" in masked
    else:
        assert masked == expected


def test_pii_counts(spark):
    df = spark.createDataFrame(
        [("s", "a@b.co and c@d.org"), ("s", "555-123-4567"), ("t", None)], "source string, text string"
    )
    rows = {(r["source"], r["kind"]): (r["hits"], r["texts"]) for r in privacy.pii_counts(df, "source").collect()}
    assert rows[("s", "email")] == (2, 1) and rows[("s", "phone")] == (1, 1) and rows[("s", "card")] == (0, 0)


def test_label_encoding(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 3.0), ("b", 3.0)], "kind string, x_id double")
    codes = {r["label"]: r["code"] for r in encoding.encoding_map(df).collect()}
    assert codes == {"a": 0, "b": 1, "nan": 2}
    assert sorted(r["kind"] for r in encoding.encode_labels(df).collect()) == [0, 1, 1, 2]


def test_scaling_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "x double, same double")
    rows = sorted((r["x"], r["same"]) for r in encoding.scale_zscore(df).collect())
    assert rows == [(-1.0, 0.0), (1.0, 0.0)]
    info = {r["column"]: (r["mean"], r["std"]) for r in encoding.scaler_info(df).collect()}
    assert info == {"x": (2.0, 1.0), "same": (4.0, 1.0)}


def test_business_metrics(five):
    totals = metrics.kpi_totals(five).head()
    assert (totals["total_revenue"], totals["average_order_value"], totals["total_orders"], totals["total_customers"]) == (1300.0, 260.0, 5, 3)
    assert [tuple(r) for r in metrics.revenue_by(five, "product_category").collect()] == [
        ("Clothing", 550.0), ("Books", 500.0), ("Electronics", 250.0)
    ]
    assert [tuple(r) for r in metrics.top_customers(five, k=1).collect()] == [("C2", 550.0)]
    assert [tuple(r) for r in metrics.monthly_revenue(five).collect()] == [("2025-01", 1300.0)]


def test_segments(five):
    rows = {r["segment"]: r for r in metrics.segment_breakdown(five, "product_category", "revenue").collect()}
    assert (rows["Clothing"]["sum"], rows["Clothing"]["mean"], rows["Clothing"]["count"]) == (550.0, 275.0, 2)
    assert rows[None]["is_total"] and rows[None]["sum"] == 1300.0 and rows[None]["mean"] == 260.0
    ranks = {r["segment"]: (r["rank"], r["share"]) for r in metrics.segment_share_rank(five, "product_category", "revenue").collect()}
    assert ranks == {"Clothing": (1, 42.31), "Books": (2, 38.46), "Electronics": (3, 19.23)}
    medians = {r["product_category"]: r["median"] for r in metrics.aggregate_by(five, "product_category", "revenue").collect()}
    assert medians == {"Clothing": 275.0, "Books": 500.0, "Electronics": 125.0}


def test_rank_ties(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 1.0)], "k string, v double")
    assert {r["segment"]: r["rank"] for r in metrics.segment_share_rank(df, "k", "v").collect()} == {"a": 1, "b": 1, "c": 3}


def test_filter_on_text_dates(five):
    kept = metrics.filter_rows(five, [F.col("revenue") > 120], "order_date", "2025-01-02", "2025-01-05")
    assert sorted(r["order_id"] for r in kept.collect()) == ["O2", "O3", "O4"]


def test_facts_of_columns_are_found_once(five, monkeypatch):
    calls, whole = [], profile.column_facts
    monkeypatch.setattr(profile, "column_facts", lambda df: calls.append(df) or whole(df))
    found = profile.shared_profile(five, "orders").collect()
    assert len(calls) == 1 and {r["section"] for r in found} >= {"dataset", "column", "date_range"}
    expected = {r["column"]: r["unique_count"] for r in profile.semantic_types(five).collect()}
    assert {r["item"]: int(r["facts"]["unique_count"]) for r in found if r["section"] == "column"} == expected


def test_dates_are_parsed_only_where_their_shape_fits(spark):
    from tallyloom.functions.columns import DATE_FORMATS, parsed_date

    texts = ["01/31/2024", "31/01/2024", "02/30/2024", "2024/01/31", "31.01.2024", "31-01-2024", "20240131", "Jan 3, 2024", "13 Feb 2024", "feb 03, 2024",
             "01/31/+12024", "1/3/2024", "01/31/24", "01/31/2024 ", "STANDARD BRASS", "", None, "Sept 3, 2024", "3 May -2024"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for f in DATE_FORMATS[1:]:
        assert "RLIKE" in parsed_date(F.col("t"), f)._jc.toString().upper()
        rows = df.select(parsed_date(F.col("t"), f).alias("a"), F.try_to_timestamp("t", F.lit(f)).alias("b")).select(F.col("a").eqNullSafe(F.col("b")).alias("same"), F.col("b").isNotNull().alias("read")).collect()
        assert all(r["same"] for r in rows) and any(r["read"] for r in rows)
