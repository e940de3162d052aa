"""Autoregressive forecasts whose order the data choose: autocovariances, Levinson's recursion and forecasts as column expressions.

Series are differenced once. Lagged products come from windows over the days of a series, which the calendar bounds; all that follows is
one row a series: orders are fitted one from the other by a fold over the lags, and compared by Akaike's criterion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import settled
from .series import HORIZON, MIN_DAYS, Z95, fill_gaps


def _none() -> Column:
    return F.array().cast("array<double>")


def _dot(left: Column, right: Column) -> Column:
    """The sum of products of two arrays, as far as the shorter goes."""
    both = F.slice(F.arrays_zip(left.alias("a"), right.alias("b")), F.lit(1), F.least(F.size(left), F.size(right)))
    return F.aggregate(both, F.lit(0.0), lambda s, p: s + p["a"] * p["b"])


def _moments(daily: DataFrame, by: list[str], most: int, min_days: int) -> DataFrame:
    """One row a series: n steps, their mean, autocovariances up to ``most``, the last steps about the mean, last day and value."""
    days = fill_gaps(daily, by).withColumn("_all", F.lit(0))
    each, order = Window.partitionBy("_all", *by), Window.partitionBy("_all", *by).orderBy("ds")
    steps = days.withColumn("_d", F.col("value") - F.lag("value").over(order)).withColumn("_mean", F.avg("_d").over(each))
    steps = steps.withColumn("_c", F.col("_d") - F.col("_mean"))
    lagged = steps.withColumns({f"_l{k}": F.lag("_c", k).over(order) for k in range(1, most + 1)})
    at = ["_c", *[f"_l{k}" for k in range(1, most + 1)]]
    n = F.count("_c")
    found = lagged.groupBy("_all", *by).agg(
        n.alias("n"), F.first("_mean", ignorenulls=True).alias("mean"), F.max("ds").alias("last_day"), F.max_by("value", "ds").alias("level"),
        F.array(*[F.coalesce(F.sum(F.col("_c") * F.col(c)), F.lit(0.0)) / n for c in at]).alias("covariances"), F.max_by(F.array(*at[:most]), "ds").alias("recent"))
    return found.where(F.col("n") + 1 >= min_days).drop("_all")


def _fits(most: int) -> Column:
    """Levinson's recursion: struct(aic, order, variance, weights) of every order from 0 to ``most`` that the series is long enough for."""
    n = F.col("n").cast("double")
    entry = lambda order, variance, weights: F.struct(
        (n * F.log(variance) + 2 * (order + 1)).alias("aic"), order.cast("int").alias("order"), variance.alias("variance"), weights.alias("weights"))
    state = lambda weights, variance, fits: F.struct(weights.alias("weights"), variance.alias("variance"), fits.alias("fits"))
    start = F.col("covariances")[0]

    def step(s: Column, m: Column) -> Column:
        a, before = s["weights"], F.reverse(F.slice("covariances", F.lit(2), m - 1))
        k = F.try_divide(F.element_at("covariances", m + 1) - _dot(a, before), s["variance"])
        k = F.coalesce(k, F.lit(0.0))
        turned = F.reverse(a)
        weights = F.concat(F.transform(a, lambda x, i: x - k * turned[i]), F.array(k))
        variance = s["variance"] * (1 - k * k)
        return state(weights, variance, F.concat(s["fits"], F.array(entry(m, variance, weights))))

    enough = F.least(F.lit(most), F.greatest(F.lit(1), (F.col("n") / 4).cast("int")))
    return F.aggregate(F.sequence(F.lit(1), enough), state(_none(), start, F.array(entry(F.lit(0), start, _none()))), step, lambda s: s["fits"])


def _chosen(fits: Column) -> Column:
    """The fit with the smallest criterion, of equals the lowest order; a series that does not vary has no criterion and order 0."""
    return F.coalesce(F.array_min(F.filter(fits, lambda f: f["aic"].isNotNull())), fits[0])


def ar_orders(daily: DataFrame, by: list[str] = (), most: int = 5, min_days: int = MIN_DAYS) -> DataFrame:
    """(by..., order, deviation, aic, chosen): what each order from 0 leaves unexplained of the daily steps, and which one the forecast takes.

    Orders are bounded by ``most`` and a quarter of the steps. aic is n ln(variance) + 2 (order + 1), null where nothing varies.
    """
    by = list(by)
    rows = _moments(daily, by, most, min_days).withColumn("_fits", _fits(most)).withColumn("_best", _chosen(F.col("_fits"))["order"])
    fits = rows.select(*by, "_best", F.inline("_fits"))
    return fits.select(*by, "order", settled(F.sqrt("variance"), 2).alias("deviation"), settled("aic", 4).alias("aic"), (F.col("order") == F.col("_best")).alias("chosen"))


def forecast_ar_aic(daily: DataFrame, periods: int = HORIZON, by: list[str] = (), most: int = 5, min_days: int = MIN_DAYS) -> DataFrame:
    """(by..., ds, order, value, lower, upper): forecasts of the order with the least criterion, with 95 % bounds, none below 0.

    Yule-Walker estimates on the differences of the gap-filled series (``forecast_ar`` takes least squares of one given order). The error of a day grows with the
    sum of the responses to a shock so far. Series of fewer than ``min_days`` days have no rows.
    """
    by = list(by)
    rows = _moments(daily, by, most, min_days).withColumn("_fit", _chosen(_fits(most)))
    a = F.col("_fit.weights")
    size = F.size(a)
    names = ("recent", "level", "shock", "response", "square", "days")
    state = lambda *parts: F.struct(*[p.alias(n) for p, n in zip(parts, names)])
    day = lambda h, level, square: F.struct(h.alias("h"), level.alias("level"), F.sqrt(square).alias("error"))
    begin = F.array(day(F.lit(0), F.col("level"), F.lit(0.0)))

    def step(s: Column, h: Column) -> Column:
        move = _dot(a, s["recent"])
        shock = F.when(h == 1, 1.0).otherwise(_dot(a, s["shock"]))
        level, response = s["level"] + F.col("mean") + move, s["response"] + shock
        square = s["square"] + response * response
        first = lambda x, rest: F.slice(F.concat(F.array(x), rest), F.lit(1), size)
        return state(first(move, s["recent"]), level, first(shock, s["shock"]), response, square, F.concat(s["days"], F.array(day(h, level, square))))

    ahead = F.aggregate(
        F.sequence(F.lit(1), F.lit(periods)), state(F.slice("recent", F.lit(1), size), F.col("level"), _none(), F.lit(0.0), F.lit(0.0), begin),
        step, lambda s: F.slice(s["days"], 2, periods))
    told = rows.select(*by, "last_day", F.col("_fit.order").alias("order"), F.sqrt("_fit.variance").alias("_sd"), F.explode(ahead).alias("at"))
    level, error = F.col("at.level"), F.col("at.error") * F.col("_sd") * Z95
    shown = lambda v: settled(F.greatest(F.lit(0.0), v), 2)
    return told.select(
        *by, F.date_add("last_day", F.col("at.h")).alias("ds"), "order", shown(level).alias("value"), shown(level - error).alias("lower"), shown(level + error).alias("upper"))
