import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.distributions import chi_square_p_value, f_p_value, t_p_value
from tallyloom.functions.moments import pair_moments
from tallyloom.operators import attribution, churn, hypothesis, series

COLUMNS = "customer_id int, order_id int, order_date date, revenue double, quantity double, discount double, product_category string"


@pytest.fixture(scope="module")
def orders(spark):
    rng = np.random.default_rng(3)
    start = datetime.date(2024, 1, 1)
    rows = []
    for i in range(1500):
        customer = int(rng.integers(0, 60)) if rng.random() > 0.34 else 7
        last = 360 if customer % 2 else 250
        rows.append((
            customer, i // 2, start + datetime.timedelta(days=int(rng.integers(0, last))),
            round(float(rng.random() * 100), 2), float(rng.integers(1, 9)), 0.1, f"c{int(rng.integers(0, 4))}",
        ))
    return spark.createDataFrame(rows, COLUMNS)


def test_features_match_pandas(orders):
    frame = orders.toPandas()
    mine = churn.churn_features(orders).toPandas().set_index("customer_id").sort_index()
    grouped = frame.groupby("customer_id")
    assert mine["frequency"].tolist() == grouped["order_id"].nunique().tolist()
    assert mine["monetary"].tolist() == pytest.approx(grouped["revenue"].sum().tolist())
    assert mine["avg_order_value"].tolist() == pytest.approx(grouped["revenue"].mean().tolist())
    assert mine["distinct_categories"].tolist() == grouped["product_category"].nunique().tolist()
    latest = frame["order_date"].max()
    assert mine["recency"].tolist() == [(latest - d).days for d in grouped["order_date"].max()]


def test_split_is_exact_and_disjoint(orders):
    labeled = churn.churn_labels(churn.churn_features(orders))
    split = churn.stratified_split(labeled).toPandas()
    assert sorted(split["customer_id"]) == sorted(r["customer_id"] for r in labeled.select("customer_id").collect())
    for _, part in split.groupby("churned"):
        assert part["is_test"].sum() == math.ceil(0.2 * len(part))


def test_split_of_equal_hash_buckets(spark):
    df = spark.range(5000).select((F.col("id")).alias("customer_id"), (F.col("id") % 7 == 0).cast("int").alias("churned"))
    counts = {r["churned"]: r["n"] for r in churn.stratified_split(df).where("is_test").groupBy("churned").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: math.ceil(0.2 * 4285), 1: math.ceil(0.2 * 715)}


def test_training_guards(spark):
    few = spark.createDataFrame([(i, i % 2) for i in range(10)], "customer_id int, churned int")
    one = spark.createDataFrame([(i, 1) for i in range(30)], "customer_id int, churned int")
    for table in (few, one):
        with pytest.raises(ValueError):
            churn.check_trainable(table)


def test_predict_churn(orders):
    scores, report, model, _ = churn.predict_churn(orders, exclude=["recency"], standardize=True)
    summary = churn.churn_summary(scores).head()
    assert summary["predicted_churned"] + summary["predicted_retained"] == summary["total_customers"] == 60
    rows = {r["label"]: r for r in report.collect()}
    assert rows["0"]["support"] + rows["1"]["support"] == rows["accuracy"]["support"] == rows["macro avg"]["support"]
    probabilities = [r["churn_probability"] for r in scores.collect()]
    assert probabilities == sorted(probabilities, reverse=True) and all(0 <= p <= 1 for p in probabilities)


def test_classification_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int")
    rows = {r["label"]: tuple(r)[1:] for r in churn.classification_report(df, "y", "p").collect()}
    assert rows["0"] == (0.67, 1.0, 0.8, 2) and rows["1"] == (1.0, 0.5, 0.67, 2)
    assert rows["accuracy"] == (None, None, 0.75, 4) and rows["macro avg"] == (0.83, 0.75, 0.73, 4)
    never = spark.createDataFrame([(0, 0)], "y int, p int")
    assert {r["label"]: r["f1"] for r in churn.classification_report(never, "y", "p").collect()}["1"] == 0.0


def test_contributions_add_up_to_the_logit(spark):
    table = spark.createDataFrame([(1, 2.0, 10.0), (2, 4.0, 30.0)], "id int, a double, b double")
    weights, intercept = {"a": 0.5, "b": -0.1}, 1.0
    base = attribution.base_value(table, weights, intercept).head()[0]
    sums = {r["id"]: r["s"] for r in attribution.linear_attribution(table, "id", weights).groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    assert base + sums[1] == pytest.approx(1 + 0.5 * 2 - 0.1 * 10) and base + sums[2] == pytest.approx(1 + 0.5 * 4 - 0.1 * 30)
    importance = [tuple(r) for r in attribution.global_importance(table, weights).collect()]
    assert importance == [("b", 1.0), ("a", 0.5)]
    factors = attribution.top_factors(table, "id", weights, k=1).collect()
    assert {(r["id"], r["feature"], r["direction"]) for r in factors} == {(1, "b", "increases churn"), (2, "b", "decreases churn")}


def test_explain_one_customer(spark):
    table = spark.createDataFrame([(1, 2.0), (2, 4.0)], "id int, a double")
    scores = churn.score_customers(table, {"a": 1.0}, 0.0, key="id")
    explained = attribution.explain_customers(table, scores, "id", {"a": 1.0})
    assert "leaves with probability 88.1%" in attribution.explain_customer(explained, "id", 1).head()["summary"]
    with pytest.raises(LookupError):
        attribution.explain_customer(explained, "id", 99)


@pytest.fixture(scope="module")
def sparse(spark):
    """Two series with gaps: 40 days and 29 days long."""
    rows = [("long", datetime.date(2025, 1, 1) + datetime.timedelta(days=d), 10.0 + 3 * d) for d in range(0, 40, 3)]
    rows += [("short", datetime.date(2025, 1, 1) + datetime.timedelta(days=d), 5.0) for d in (0, 28)]
    return spark.createDataFrame(rows, "name string, ds date, value double")


def test_gap_fill(sparse):
    filled = series.fill_gaps(sparse, ["name"]).toPandas()
    assert filled.groupby("name").size().to_dict() == {"long": 40, "short": 29}
    assert filled["value"].sum() == pytest.approx(sparse.toPandas()["value"].sum())


def test_trend_equals_a_fit_on_the_filled_series(sparse):
    one = sparse.where("name = 'long'").drop("name")
    y = series.fill_gaps(one).orderBy("ds").toPandas()["value"].to_numpy()
    slope, intercept = np.polyfit(np.arange(len(y)), y, 1)
    spread = np.std(y - (slope * np.arange(len(y)) + intercept))
    forecast = series.forecast_linear(one).orderBy("ds").toPandas()
    assert len(forecast) == 90 and (forecast["value"] >= 0).all() and (forecast["lower"] >= 0).all()
    assert forecast["ds"][0] == datetime.date(2025, 2, 10)
    point = slope * len(y) + intercept
    assert forecast["value"][0] == pytest.approx(point, abs=0.006)
    assert forecast["upper"][0] == pytest.approx(point + 1.96 * spread, abs=0.006)
    summary = series.forecast_summary(one).head()
    assert summary["last_30_days_avg"] == pytest.approx(y[-30:].mean(), abs=0.006)
    assert summary["forecast_avg"] == pytest.approx(forecast["value"].mean(), abs=0.006)
    assert summary["trend"] == ("increasing" if forecast["value"].mean() > y[-30:].mean() else "decreasing")


def test_short_series_has_no_forecast(sparse):
    assert {r["name"] for r in series.forecast_linear(sparse, by=["name"]).collect()} == {"long"}
    assert {r["name"] for r in series.forecast_ar(sparse, by=["name"]).collect()} == {"long"}
    with pytest.raises(ValueError):
        series.check_history(sparse.where("name = 'short'"))
    series.check_history(sparse.where("name = 'long'"))


def test_history_tail_counts_calendar_days(sparse):
    tail = series.history_tail(sparse, days=35, by=["name"]).toPandas()
    assert tail.groupby("name").size().to_dict() == {"long": 35, "short": 29}


def test_ar_forecast_continues_a_straight_line():
    points, errors = series._fit_ar(np.arange(60.0) * 2, 5, 4)
    assert points == pytest.approx([120, 122, 124, 126], abs=1e-6) and (errors < 1e-6).all()


def test_hypothesis(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 6.0)], "g string, v double")
    t = hypothesis.ttest(df, "g", "v", "a", "b").head()
    assert t["t_statistic"] == pytest.approx(-3 / math.sqrt(1 / 3 + 1), abs=1e-4)
    f = hypothesis.anova(df, "g", "v").head()
    assert (f["f_statistic"], f["df_between"], f["df_within"]) == (pytest.approx(8.1, abs=1e-4), 1, 3)
    line = hypothesis.regression_univariate(spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)], "x double, y double"), "x", "y").head()
    assert (line["slope"], line["intercept"], line["r_squared"], line["rmse"]) == (2.0, 1.0, 1.0, 0.0)
    cells = spark.createDataFrame([("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30, "l string, r string")
    table = np.array([[10, 20], [30, 0]])
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    chi = hypothesis.chi_square(cells, "l", "r").head()
    assert chi["chi_square"] == pytest.approx(((table - expected) ** 2 / expected).sum(), abs=1e-4) and chi["degrees_of_freedom"] == 1


#: (statistic, degrees of freedom ..., probability) as printed in tables.
TABLED = {
    "t": [(2.228, 10, 0.05), (12.706, 1, 0.05), (2.7764, 4, 0.05), (1.9600, 10 ** 9, 0.05), (-3.169, 10, 0.01), (0.0, 7, 1.0), (1.984, 100, 0.05)],
    "f": [(4.10, 2, 10, 0.05), (161.45, 1, 1, 0.05), (5.05, 5, 5, 0.05), (2.37, 4, 10 ** 8, 0.05), (3.02, 9, 9, 0.0575), (0.0, 3, 8, 1.0)],
    "chi": [(3.841, 1, 0.05), (18.307, 10, 0.05), (124.342, 100, 0.05), (1074.68, 1000, 0.05), (23.209, 10, 0.01), (0.0, 3, 1.0), (0.0039, 1, 0.95)],
}


def test_p_values_against_tables(spark):
    for name, rows in TABLED.items():
        df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ["x", "a", "b", "p"] if name == "f" else ["x", "a", "p"])
        p = {"t": lambda: t_p_value(F.col("x"), F.col("a")), "f": lambda: f_p_value(F.col("x"), F.col("a"), F.col("b")), "chi": lambda: chi_square_p_value(F.col("x"), F.col("a"))}[name]()
        for r in df.withColumn("found", p).collect():
            assert r["found"] == pytest.approx(r["p"], rel=0.004), r
    odd = spark.createDataFrame([(None, 3.0), (1.0, 0.0), (1.0, None)], "x double, a double")
    assert [r[0] for r in odd.select(t_p_value(F.col("x"), F.col("a"))).collect()] == [None] * 3
    assert [r[0] for r in odd.select(chi_square_p_value(F.col("x"), F.col("a"))).collect()] == [None] * 3


def test_p_values_agree_with_one_another(spark):
    """F of one and n degrees is t squared, chi-squared is F without end, two tails of it are an exponential."""
    df = spark.range(1, 60).select((F.col("id") / 7).alias("x"), (F.col("id") * 3.0).alias("a"))
    rows = df.select(
        "x", t_p_value(F.col("x"), F.col("a")).alias("t"), f_p_value(F.col("x") * F.col("x"), F.lit(1.0), F.col("a")).alias("f"),
        chi_square_p_value(F.col("x"), F.lit(2.0)).alias("two"), chi_square_p_value(F.col("x") * 5, F.lit(5.0)).alias("c"), f_p_value(F.col("x"), F.lit(5.0), F.lit(1e12)).alias("e")).collect()
    for r in rows:
        assert r["t"] == pytest.approx(r["f"], rel=1e-9) and r["two"] == pytest.approx(math.exp(-r["x"] / 2), rel=1e-10) and r["c"] == pytest.approx(r["e"], abs=1e-9)


def _frame(spark, columns, parts=3):
    names = list(columns)
    return spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in zip(*columns.values())], ", ".join(f"{n} double" for n in names)).repartition(parts)


@pytest.mark.parametrize("offset", [0.0, 1e7])
def test_regression_on_several_columns(spark, offset):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=400) + offset, rng.normal(size=400) * 1000
    y = 3 * (a - offset) - 0.02 * b + 5 + rng.normal(size=400)
    y[:7], a[7:9], b[20] = np.nan, np.nan, np.nan
    df = _frame(spark, {"a": a, "b": b, "sum": a + 2 * b, "flat": np.ones(400), "y": y})
    rows = {r.term: r for r in hypothesis.regression_multivariate(df, ["a", "b", "sum", "flat"], "y").collect()}
    there = ~np.isnan(a + b + y)
    x = np.column_stack([np.ones(there.sum()), a[there] - offset, b[there]])
    weights, rest, *_ = np.linalg.lstsq(x, y[there], rcond=None)
    errors = np.sqrt(rest[0] / (len(x) - 3) * np.diag(np.linalg.inv(x.T @ x)))
    assert [rows[t].coefficient for t in ("a", "b")] == pytest.approx(weights[1:], abs=2e-4)
    assert [rows[t].std_error for t in ("a", "b")] == pytest.approx(errors[1:], abs=2e-4)
    assert rows["sum"].coefficient is None and rows["flat"].coefficient is None and rows["sum"].p_value is None
    assert rows["a"].n == there.sum() and rows["a"].rank == 2 and rows["a"].p_value == 0.0
    if not offset:
        assert rows["intercept"].coefficient == pytest.approx(weights[0], abs=2e-4) and rows["intercept"].std_error == pytest.approx(errors[0], abs=2e-4)


def test_regression_on_too_few_rows(spark):
    df = _frame(spark, {"a": np.array([1.0, 2.0]), "b": np.array([1.0, 4.0]), "y": np.array([3.0, 5.0])})
    rows = {r.term: r for r in hypothesis.regression_multivariate(df, ["a", "b"], "y").collect()}
    assert rows["a"].coefficient == 2.0 and rows["b"].coefficient is None and rows["a"].std_error is None and rows["intercept"].coefficient == 1.0
    none = hypothesis.regression_multivariate(df.where("a > 9"), ["a"], "y").collect()
    assert [(r.coefficient, r.n) for r in none] == [(None, 0)] * 2
    for bad in ([], ["a", "a"], ["y"]):
        with pytest.raises(ValueError):
            hypothesis.regression_multivariate(df, bad, "y")


def test_moments_of_pairs_with_gaps(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(300, 4)) + np.array([0, 1e9, -5, 0])
    values[rng.random((300, 4)) < 0.3] = np.nan
    values[:, 3] = np.where(np.isnan(values[:, 3]), np.nan, 0.1)
    values[:, 2][rng.random(300) < 0.98] = np.nan
    df = _frame(spark, {f"v{k}": values[:, k] for k in range(4)}, 20)
    for r in pair_moments(df, [F.col(c) for c in df.columns]).collect():
        x, y = values[:, r.i], values[:, r.j]
        there = ~np.isnan(x + y)
        x, y = x[there], y[there]
        assert r.n == len(x) and r.mx == pytest.approx(x.mean()) and r.my == pytest.approx(y.mean())
        for found, want in ((r.sxx, (x - x.mean()) @ (x - x.mean())), (r.syy, (y - y.mean()) @ (y - y.mean())), (r.sxy, (x - x.mean()) @ (y - y.mean()))):
            assert found == pytest.approx(want, abs=1e-4)
        if 3 in (r.i, r.j):
            assert (r.sxx if r.i == 3 else r.syy) == 0.0 and r.sxy == 0.0
    assert pair_moments(df.where("v0 > 99"), [F.col("v0")]).collect() == []
