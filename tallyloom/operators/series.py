"""Daily series: aggregation, gap filling, forecasts and their explanation.

Every function takes ``by``: the columns that tell series apart (none for one series).
A daily table is bounded by the calendar per series, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_day, col, money_sum, present, settled

HORIZON = 90
MIN_DAYS = 30
Z95 = 1.96


def daily_values(df: DataFrame, date="order_date", value="revenue", by: list[str] = (), date_format: str = "") -> DataFrame:
    """(by..., ds, value): sums per day with data. Unparseable dates and null keys drop out."""
    rows = df.select(
        *[col(b).alias(b) for b in by], as_day(df, date, date_format).alias("ds"), present(df, value).alias("_v")
    ).where(" and ".join(f"`{c}` is not null" for c in [*by, "ds"]))
    return rows.groupBy(*by, "ds").agg(money_sum(F.col("_v")).alias("value"))


def fill_gaps(daily: DataFrame, by: list[str] = ()) -> DataFrame:
    """Every day from the first to the last of each series, missing ones 0."""
    spans = daily.groupBy(*by).agg(F.min("ds").alias("_lo"), F.max("ds").alias("_hi")).where("_lo is not null")
    calendar = spans.select(*by, F.explode(F.sequence("_lo", "_hi")).alias("ds"))
    return calendar.join(daily, [*by, "ds"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def history_tail(daily: DataFrame, days: int = 90, by: list[str] = ()) -> DataFrame:
    """The last ``days`` calendar days of each series, missing ones 0.

    The window is cut by date from each series' end, not by sorting its rows.
    """
    spans = daily.groupBy(*by).agg(F.min("ds").alias("_first"), F.max("ds").alias("_hi")).where("_hi is not null")
    lo = F.greatest(F.col("_first"), F.date_sub("_hi", days - 1))
    calendar = spans.select(*by, F.explode(F.sequence(lo, F.col("_hi"))).alias("ds"))
    recent = calendar.join(daily, [*by, "ds"], "left")
    return recent.withColumn("value", settled(F.coalesce("value", F.lit(0.0)), 2))


def _trends(daily: DataFrame, by: list[str], min_days: int) -> DataFrame:
    """Least-squares line of each gap-filled series against its day index.

    Only the days that exist are read: no calendar is generated for millions of sparse series.
    Their central moments come from Spark's own stable aggregates; the days without data are a second
    part with value 0 whose moments are known, and the two parts are merged as parallel variances are.
    """
    day = F.unix_date("ds").cast("double")
    moments = daily.groupBy(*by).agg(
        F.min("ds").alias("first_day"), F.max("ds").alias("last_day"), F.count("value").alias("_k"),
        F.avg("value").alias("_m"), F.var_pop("value").alias("_v"), F.avg(day).alias("_t"),
        F.covar_pop(day, F.col("value")).alias("_c"),
    ).where("first_day is not null and _k > 0")
    n, k = F.col("n").cast("double"), F.col("_k").cast("double")
    middle = F.unix_date("first_day").cast("double") + (n - 1) / 2
    share = (n - k) / n
    # The days without data lie, on average, as far on the other side of the middle as their number tells.
    apart = F.when(n > k, (F.col("_t") - middle) / share).otherwise(0.0)
    fitted = (
        moments.withColumn("n", F.date_diff("last_day", "first_day") + 1)
        .where(F.col("n") >= min_days)
        .withColumn("_syy", k * (F.col("_v") + F.col("_m") * F.col("_m") * share))
        .withColumn("_sxy", k * (F.col("_c") + apart * F.col("_m") * share))
        .withColumn("slope", F.try_divide(F.col("_sxy"), n * (n * n - 1) / 12))
        .withColumn("intercept", F.col("_m") * k / n - F.col("slope") * (n - 1) / 2)
        .withColumn("_sse", F.col("_syy") - F.col("slope") * F.col("_sxy"))
        .withColumn("residual_std", F.sqrt(F.greatest(F.col("_sse"), F.lit(0.0)) / n))
    )
    return fitted.select(*by, "first_day", "last_day", "n", "slope", "intercept", "residual_std")


def _predicted(step: Column) -> Column:
    """Point forecast ``step`` days after the last one, not below 0."""
    return F.greatest(F.lit(0.0), F.col("slope") * (F.col("n") + step - 1) + F.col("intercept"))


def forecast_linear(daily: DataFrame, periods: int = HORIZON, by: list[str] = (), min_days: int = MIN_DAYS) -> DataFrame:
    """(by..., ds, value, lower, upper) for the days after each series' end.

    Series shorter than ``min_days`` have no forecast (see ``check_history``).
    """
    steps = _trends(daily, list(by), min_days).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    point = _predicted(F.col("step"))
    margin = F.col("residual_std") * Z95
    floor = lambda c: settled(F.greatest(F.lit(0.0), c), 2)
    return steps.select(
        *by, F.date_add("last_day", F.col("step")).alias("ds"), settled(point, 2).alias("value"),
        floor(point - margin).alias("lower"), floor(point + margin).alias("upper"),
    )


def check_history(daily: DataFrame, min_days: int = MIN_DAYS) -> None:
    """Raise if a single series spans fewer than ``min_days`` days."""
    span = daily.agg(F.date_diff(F.max("ds"), F.min("ds"))).head()[0]
    if span is None or span + 1 < min_days:
        raise ValueError(f"the series spans too few days to project it; {min_days} are the least")


def forecast_summary(daily: DataFrame, periods: int = HORIZON, by: list[str] = (), min_days: int = MIN_DAYS) -> DataFrame:
    """(by..., last_30_days_avg, forecast_avg, trend, forecast_periods, percentage_change).

    The forecast mean is taken over an array inside the row instead of exploding it.
    """
    by = list(by)
    trends = _trends(daily, by, min_days)
    ends = daily.groupBy(*by).agg(F.max("ds").alias("_end"))
    joined = daily.join(ends, by) if by else daily.withColumn("_end", daily.agg(F.max("ds")).scalar())
    recent = joined.where(F.col("ds") > F.date_sub("_end", 30)).groupBy(*by).agg((F.sum("value") / 30.0).alias("_last"))
    values = F.transform(
        F.sequence(F.lit(1), F.lit(periods)), lambda s: settled(_predicted(s), 2)
    )
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / periods
    if by:
        both = trends.join(recent, by)
    else:
        both = trends.withColumn("_last", recent.select("_last").scalar())
    both = both.withColumn("_forecast", mean)
    last, ahead = settled("_last", 2), settled("_forecast", 2)
    return both.select(
        *by, last.alias("last_30_days_avg"), ahead.alias("forecast_avg"),
        F.when(F.col("_forecast") > F.col("_last"), "increasing")
        .when(F.col("_forecast") < F.col("_last"), "decreasing").otherwise("stable").alias("trend"),
        F.lit(periods).alias("forecast_periods"),
        settled(F.when(last > 0, (ahead - last) / last * 100).otherwise(0.0), 2).alias("percentage_change"),
    )


def forecast_change(summary: DataFrame, monthly: DataFrame) -> DataFrame:
    """Evidence behind one forecast: averages, projected change, the last month's direction, and a sentence on each."""
    latest = monthly.orderBy(F.desc("month")).limit(1).select("direction").scalar()
    return summary.select(
        "trend", "percentage_change", "last_30_days_avg", "forecast_avg",
        latest.alias("recent_monthly_trend"),
        F.format_string(
            "Over the next %d days the daily mean is seen %s (%+.1f%%).", "forecast_periods", "trend", "percentage_change"
        ).alias("forecast_summary"),
        F.format_string(
            "From %,.2f a day in the last 30 days to %,.2f a day ahead.", "last_30_days_avg", "forecast_avg"
        ).alias("trend_detail"),
    )


def forecast_evidence(change: DataFrame) -> DataFrame:
    """(position, metric, value): what ``forecast_change`` rests on, one row per figure that is known."""
    money = lambda c: F.format_string("%,.2f", c)
    rows = [
        ("last_30_days_avg", money("last_30_days_avg")), ("forecast_avg", money("forecast_avg")),
        ("percentage_change", F.format_string("%+.1f%%", "percentage_change")), ("recent_monthly_trend", F.col("recent_monthly_trend")),
    ]
    listed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), v.alias("value")) for i, (m, v) in enumerate(rows)])
    return change.select(F.inline(listed)).where("value is not null")


def _fit_ar(values: np.ndarray, order: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares AR on first differences: point forecasts and their standard errors."""
    steps = np.diff(values)
    order = min(order, max(1, len(steps) // 4))
    lags = np.column_stack([steps[order - k - 1: len(steps) - k - 1] for k in range(order)])
    design = np.column_stack([np.ones(len(lags)), lags])
    target = steps[order:]
    weights, *_ = np.linalg.lstsq(design, target, rcond=None)
    sigma = float(np.std(target - design @ weights))
    recent, points, level = list(steps[::-1][:order]), [], values[-1]
    impulse, psi = [0.0] * order, []
    for step in range(periods):
        move = weights[0] + float(np.dot(weights[1:], recent))
        recent = [move] + recent[:-1]
        level += move
        points.append(level)
        effect = 1.0 if step == 0 else float(np.dot(weights[1:], impulse))
        impulse = [effect] + impulse[:-1]
        psi.append(effect)
    errors = sigma * np.sqrt(np.cumsum(np.cumsum(psi) ** 2))
    return np.array(points), errors


def forecast_ar(daily: DataFrame, periods: int = HORIZON, by: list[str] = (), order: int = 5, min_days: int = MIN_DAYS) -> DataFrame:
    """Autoregressive forecast per series: (by..., ds, value, lower, upper).

    An AR fit by least squares on the differenced, gap-filled series. It is not the
    maximum-likelihood fit of a full ARIMA model and its numbers differ from one. A task
    holds one series' days at a time; their number is bounded by the calendar.
    """
    by = list(by)
    keys = by or ["_series"]
    source = daily if by else daily.withColumn("_series", F.lit(0))
    types = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        series = pdf.assign(ds=pd.to_datetime(pdf["ds"])).set_index("ds")["value"].sort_index().asfreq("D", fill_value=0.0)
        if len(series) < min_days:
            return pd.DataFrame(columns=[*keys, "ds", "value", "lower", "upper"])
        points, errors = _fit_ar(series.to_numpy(float), order, periods)
        days = pd.date_range(series.index[-1] + pd.Timedelta(days=1), periods=periods, freq="D")
        clip = lambda a: np.round(np.maximum(0.0, a), 2)
        return pd.DataFrame({
            **{k: [pdf[k].iloc[0]] * periods for k in keys}, "ds": days.date,
            "value": clip(points), "lower": clip(points - Z95 * errors), "upper": clip(points + Z95 * errors),
        })

    forecast = source.groupBy(*keys).applyInPandas(one, f"{types}, ds date, value double, lower double, upper double")
    return forecast if by else forecast.drop("_series")
