import pandas as pd
import pytest

from tallyloom.operators import cleaning


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(
        [
            (1, 10.0, "b", None, 5.0), (2, None, "a", None, 5.0), (2, None, "a", None, 5.0),
            (3, 12.0, None, None, 5.0), (4, 11.0, "b", None, 5.0), (5, 900.0, "a", None, 5.0),
            (6, 13.0, "c", None, 5.0),
        ],
        "id int, price double, kind string, empty string, same double",
    )


def test_missing_values(messy):
    found = {r["column"]: (r["missing_count"], r["missing_percentage"]) for r in cleaning.missing_values(messy).collect()}
    assert found == {"price": (2, 28.57), "kind": (1, 14.29), "empty": (7, 100.0)}


def test_fills_median_mode_tie_and_unknown(messy):
    fills = {f.column: (f.method, f.value, f.filled) for f in cleaning.fit_fills(messy)}
    assert fills["price"] == ("median", 12.0, 2)
    assert fills["kind"] == ("mode", "a", 1)
    assert fills["empty"] == ("mode", "Unknown", 7)


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "kind string")
    assert cleaning.fit_fills(df)[0].value == "a"


def test_integer_column_with_fractional_median(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    filled = cleaning.fill_missing(df, cleaning.fit_fills(df))
    assert sorted(r["n"] for r in filled.collect()) == [1.0, 1.5, 2.0]


def test_duplicates_count_nulls_as_equal(messy):
    assert cleaning.duplicate_count(messy).head()[0] == 1
    assert cleaning.deduplicate(messy).count() == 6


def test_fences_follow_pandas(messy):
    bounds = {b.column: b for b in cleaning.fit_bounds(messy)}
    price = pd.Series([10.0, 12, 11, 900, 13])
    q1, q3 = price.quantile(0.25), price.quantile(0.75)
    assert (bounds["price"].lower, bounds["price"].upper) == (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    assert bounds["price"].hit and not bounds["same"].hit
    report = cleaning.outlier_report(messy, list(bounds.values())).collect()
    assert [(r["column"], r["capped_lower"], r["capped_upper"]) for r in report] == [("price", 0, 1)]


def test_capping_keeps_nulls(messy):
    capped = cleaning.cap_outliers(messy, cleaning.fit_bounds(messy))
    values = [r["price"] for r in capped.collect()]
    assert values.count(None) == 2 and max(v for v in values if v is not None) == 16.0


def test_clean_data_run(messy):
    cleaned = cleaning.clean_data(messy)
    rows = cleaned.data.collect()
    assert len(rows) == 6 and not any(v is None for r in rows for v in r)
    report = {(r["column"], r["metric"]): r["value"] for r in cleaned.report().collect()}
    assert report[(None, "initial_rows")] == 7 and report[(None, "final_rows")] == 6
    assert report[(None, "duplicates_removed")] == 1 and report[(None, "total_missing")] == 10
