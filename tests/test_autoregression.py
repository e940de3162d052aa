"""Orders and forecasts against Yule-Walker equations solved whole, and forecasts step by step."""

import datetime

import numpy as np
import pytest

from tallyloom.operators import autoregression

FIRST = datetime.date(2024, 1, 1)


def brute(values, most, periods):
    """(orders with variance and criterion, chosen order, forecasts with errors) by solving every order's equations."""
    steps = np.diff(values)
    mean, n = steps.mean(), len(steps)
    c = steps - mean
    gamma = np.array([c[k:] @ c[:n - k] / n for k in range(most + 1)])
    fits = []
    for order in range(0, min(most, max(1, n // 4)) + 1):
        weights = np.linalg.solve(np.array([[gamma[abs(i - j)] for j in range(order)] for i in range(order)]), gamma[1:order + 1]) if order and gamma[0] > 0 else np.zeros(order)
        variance = gamma[0] - weights @ gamma[1:order + 1]
        fits.append((order, variance, n * np.log(variance) + 2 * (order + 1) if gamma[0] > 0 else None, weights))
    order, variance, _, weights = min(fits, key=lambda f: (f[2], f[0])) if gamma[0] > 0 else fits[0]
    past, level, out = list(c[::-1]), values[-1], []
    response = [1.0]
    for h in range(periods):
        move = sum(w * past[i] for i, w in enumerate(weights))
        past.insert(0, move)
        level += mean + move
        if h:
            response.insert(0, sum(w * response[i] for i, w in enumerate(weights) if i < len(response)))
        shocks = np.cumsum(response[::-1])
        out.append((level, np.sqrt(variance * (shocks @ shocks))))
    return fits, order, out


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(11)
    second = np.zeros(400)
    for i in range(2, 400):
        second[i] = 0.5 * second[i - 1] - 0.6 * second[i - 2] + rng.normal()
    series = {"walk": 1000 + np.cumsum(rng.normal(size=200)), "second": 5000 + np.cumsum(second), "flat": np.full(60, 7.0), "line": np.arange(50) * 3.0, "brief": rng.normal(size=31) + 90, "short": np.ones(12)}
    rows = [(name, FIRST + datetime.timedelta(days=i), float(v)) for name, values in series.items() for i, v in enumerate(values)]
    return series, spark.createDataFrame(rows, "name string, ds date, value double").repartition(4)


def test_orders_solve_their_equations(many):
    series, daily = many
    rows = autoregression.ar_orders(daily, by=["name"]).collect()
    for name, values in series.items():
        own = sorted((r for r in rows if r.name == name), key=lambda r: r.order)
        if len(values) < 30:
            assert not own
            continue
        fits, chosen, _ = brute(values, 5, 1)
        assert [r.order for r in own] == [f[0] for f in fits] and [r.order for r in own if r.chosen] == [chosen]
        for r, (_, variance, aic, _) in zip(own, fits):
            assert r.deviation == pytest.approx(np.sqrt(variance), abs=0.006) and (r.aic is None if aic is None else r.aic == pytest.approx(aic, abs=1e-3))
    assert [r.order for r in rows if r.name == "second" and r.chosen][0] >= 2
    assert [r.aic for r in rows if r.name in ("flat", "line")] == [None] * 12


def test_forecasts_follow_step_by_step(many):
    series, daily = many
    rows = autoregression.forecast_ar_aic(daily, 20, by=["name"]).collect()
    assert {r.name for r in rows} == set(series) - {"short"}
    for name in set(series) - {"short"}:
        own = sorted((r for r in rows if r.name == name), key=lambda r: r.ds)
        _, order, ahead = brute(series[name], 5, 20)
        assert own[0].ds == FIRST + datetime.timedelta(days=len(series[name])) and {r.order for r in own} == {order}
        for r, (level, error) in zip(own, ahead):
            for found, want in ((r.value, level), (r.lower, level - 1.96 * error), (r.upper, level + 1.96 * error)):
                assert found == pytest.approx(max(0.0, want), abs=0.006)


def test_one_series_with_gaps_and_an_empty_table(many):
    series, daily = many
    one = daily.where("name = 'walk'").select("ds", "value")
    gaps = one.where("day(ds) <> 3")
    values = [0.0 if (FIRST + datetime.timedelta(days=i)).day == 3 else v for i, v in enumerate(series["walk"])]
    rows = sorted(autoregression.forecast_ar_aic(gaps, 5).collect(), key=lambda r: r.ds)
    assert [r.value for r in rows] == pytest.approx([max(0.0, x) for x, _ in brute(np.array(values), 5, 5)[2]], abs=0.006)
    assert autoregression.forecast_ar_aic(one.where("false"), 5).collect() == [] and autoregression.ar_orders(one.where("false")).collect() == []
