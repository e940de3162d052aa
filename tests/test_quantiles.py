import math

import numpy as np
import pandas as pd
import pytest

from tallyloom.functions import quantiles
from tallyloom.functions.quantiles import approximate_quantiles, exact_quantiles, grouped_quantile

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
NAMES = ["smooth", "hot", "few", "constant", "holes"]


def _table(spark, n):
    rng = np.random.default_rng(5)
    third = rng.random(n) < 0.34
    frame = pd.DataFrame({
        "smooth": rng.lognormal(3, 2, n),
        "hot": np.where(third, 7.0, rng.normal(7, 3, n)),
        "few": rng.integers(0, 4, n).astype(float),
        "constant": np.ones(n),
        "holes": np.where(rng.random(n) < 0.2, np.nan, rng.random(n)),
        "key": np.where(third, "hot", rng.integers(0, 5, n).astype(str)),
    })
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("rows", [1, 2, 7, 15_000])
def test_exact_quantiles_match_numpy(spark, rows):
    frame, df = _table(spark, rows)
    found = exact_quantiles(df, NAMES, PROBABILITIES)
    for name in NAMES:
        values = frame[name].dropna()
        if not len(values):
            assert found[name].quantiles == [None] * len(PROBABILITIES)
            continue
        assert found[name].count == len(values)
        assert found[name].mean == pytest.approx(values.mean())
        assert (found[name].std is None) if len(values) < 2 else found[name].std == pytest.approx(values.std())
        assert found[name].quantiles == pytest.approx([values.quantile(p) for p in PROBABILITIES], abs=1e-9)


def test_wide_brackets_few_cells_and_many_columns(spark, monkeypatch):
    frame, df = _table(spark, 4_000)
    monkeypatch.setattr(quantiles, "_GROUPS", 8)
    monkeypatch.setattr(quantiles, "_CELLS", 3)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    found = exact_quantiles(df, NAMES, [0.25, 0.5])
    for name in NAMES:
        values = frame[name].dropna()
        assert found[name].quantiles == pytest.approx([values.quantile(0.25), values.quantile(0.5)], abs=1e-9)


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    frame, df = _table(spark, 3_000)
    monkeypatch.setattr(quantiles, "_bracket", lambda rows, k: (min(r["q"][0] for r in rows), min(r["q"][0] for r in rows)))
    found = exact_quantiles(df, ["smooth"], [0.1, 0.9])
    assert found["smooth"].quantiles == pytest.approx([frame["smooth"].quantile(p) for p in (0.1, 0.9)])


def test_the_table_is_scanned_twice(spark, monkeypatch):
    scans = []
    values = quantiles.column_values
    monkeypatch.setattr(quantiles, "column_values", lambda *a: scans.append(1) or values(*a))
    exact_quantiles(_table(spark, 15_000)[1], NAMES, PROBABILITIES)
    assert len(scans) == 2


def test_extreme_values(spark):
    values = [-1e308, 1e308, -math.inf, math.inf, 0.0, 5e-324, 1.0, 2.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values * 50], "v double")
    assert exact_quantiles(df, ["v"], [0.5])["v"].quantiles == [1.0]


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    found = exact_quantiles(df, ["a", "b"], [0.5])
    assert found["a"].quantiles == [None] and found["b"].quantiles == [1.0]
    assert exact_quantiles(df.where("false"), ["a"], [0.5])["a"].quantiles == [None]
    assert approximate_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}


@pytest.mark.parametrize("accuracy", [100_000, 200, 20])
@pytest.mark.parametrize("rows", [12, 9_000])
def test_grouped_quantile(spark, accuracy, rows):
    frame, df = _table(spark, rows)
    for p in (0.5, 0.9):
        found = grouped_quantile(df, ["key"], "smooth", p, "m", accuracy=accuracy).collect()
        assert {r["key"]: r["m"] for r in found} == pytest.approx(frame.groupby("key")["smooth"].quantile(p).to_dict())


def test_grouped_quantile_widens_a_bracket_that_misses(spark, monkeypatch):
    frame, df = _table(spark, 2_000)
    monkeypatch.setattr(quantiles, "_around", lambda p, slack: (0.9, 0.9))
    found = grouped_quantile(df, ["key"], "smooth", 0.5, "m").collect()
    assert {r["key"]: r["m"] for r in found} == pytest.approx(frame.groupby("key")["smooth"].median().to_dict())


def test_few_groups_are_not_shuffled_to_meet_their_brackets(spark):
    _, df = _table(spark, 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        bounds = spark.createDataFrame([("hot", 0.0, 9.0, 3.0)], "key string, _lo double, _hi double, _pos double")
        plan = quantiles._ranked(df.withColumn("_v", df["smooth"]), bounds, ["key"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
