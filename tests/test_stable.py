"""Sums and statistics that keep their digits."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.columns import money_sum
from tallyloom.functions.scratch import materialize, release
from tallyloom.operators import hypothesis, metrics, series


@pytest.mark.parametrize("values, total", [
    ([0.004] * 1000, 4.0), ([2e16, 1.0], 2e16 + 1), ([1e300, 1e300], 2e300), ([], 0.0), ([None, 1.5], 1.5), ([1 / 3] * 3, 1.0),
    ([9e15] * 20, 1.8e17), ([-0.005, 0.005], 0.0),
])
def test_money_is_never_cut(spark, values, total):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(money_sum(F.col("v")).alias("s")).head()["s"] == pytest.approx(total, rel=1e-15)


def test_revenue_operators_agree_on_fractions_of_a_cent(spark):
    df = spark.createDataFrame([("a", "2025-01-01", 0.004)] * 1000, "key string, order_date string, revenue double")
    assert metrics.revenue_by(df, "key").head()["revenue"] == 4.0
    assert metrics.segment_breakdown(df, "key", "revenue").where("segment = 'a'").head()["sum"] == 4.0
    assert series.daily_values(df).head()["value"] == 4.0


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_anova_ignores_an_offset(spark, offset):
    df = spark.createDataFrame([(g, offset + g * 0.5 + (i * 7 % 11)) for g in range(3) for i in range(40)], "g int, v double")
    expected = hypothesis.anova(df.withColumn("v", F.col("v") - offset), "g", "v").head()["f_statistic"]
    assert hypothesis.anova(df, "g", "v").head()["f_statistic"] == pytest.approx(expected, abs=1e-3)


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_forecast_band_ignores_an_offset(spark, offset):
    rows = [(f"2025-01-{d:02d}", offset + 1e4 + (2.0 if d % 2 else 0.0)) for d in range(1, 32)]
    df = spark.createDataFrame(rows, "ds string, value double").withColumn("ds", F.to_date("ds"))
    found = series.forecast_linear(df).orderBy("ds").head()
    assert found["upper"] - found["lower"] == pytest.approx(2 * 1.96 * 0.9993, abs=0.02)


def test_trend_of_a_series_with_gaps_equals_that_of_the_filled_one(spark):
    rows = [("2025-01-01", 5.0), ("2025-01-02", 9.0), ("2025-01-20", 3.0), ("2025-02-14", 40.0)]
    df = spark.createDataFrame(rows, "ds string, value double").withColumn("ds", F.to_date("ds"))
    sparse = [tuple(r) for r in series.forecast_linear(df).collect()]
    filled = [tuple(r) for r in series.forecast_linear(series.fill_gaps(df)).collect()]
    assert sorted(sparse) == sorted(filled)


def test_chi_square_with_an_empty_cell_and_many_rows(spark):
    small = [("a", "x", 10), ("a", "y", 20), ("b", "x", 30)]
    for times in (1, 1000):
        df = spark.createDataFrame(small, "l string, r string, n int").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") * times)))
        n, want = 60 * times, 0.0
        for l, r, o in [("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 0)]:
            e = {"a": 30, "b": 30}[l] * {"x": 40, "y": 20}[r] / 60 * times
            want += (o * times - e) ** 2 / e
        assert hypothesis.chi_square(df, "l", "r").head()["chi_square"] == pytest.approx(want, abs=1e-3)


def test_a_copy_can_be_dropped(spark):
    import os

    kept = materialize(spark.range(3))
    path = kept.stored_at.removeprefix("file:")
    assert os.path.isdir(path) and kept.count() == 3
    release(kept)
    assert not os.path.exists(path)
    release(spark.range(1))
