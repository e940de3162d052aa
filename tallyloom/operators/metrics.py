"""Business metrics of a transactions table.

Column names are arguments with the usual names as defaults. Rows without a key are left
out of a breakdown; totals include them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import as_day, as_double, col, money_sum, present, settled
from ..functions.quantiles import grouped_quantile
from ..functions.ranking import dense_index


def kpi_totals(df: DataFrame, revenue="revenue", order="order_id", customer="customer_id") -> DataFrame:
    """Total revenue, revenue per row and per order, distinct orders and customers."""
    total, orders = money_sum(present(df, revenue)), F.count_distinct(col(order))
    return df.agg(
        settled(total, 2).alias("total_revenue"),
        settled(F.try_divide(total, F.count(present(df, revenue))), 2).alias("average_order_value"),
        settled(F.try_divide(total, orders), 2).alias("revenue_per_order"),
        orders.alias("total_orders"),
        F.count_distinct(col(customer)).alias("total_customers"),
    )


def revenue_by(df: DataFrame, key: str, revenue: str = "revenue") -> DataFrame:
    """(key, revenue), largest first."""
    summed = df.where(col(key).isNotNull()).groupBy(col(key).alias(key)).agg(
        settled(money_sum(present(df, revenue)), 2).alias("revenue")
    )
    return summed.orderBy(F.desc("revenue"), F.asc(key))


def monthly_revenue(df: DataFrame, date: str = "order_date", revenue: str = "revenue", date_format: str = "") -> DataFrame:
    """(month, revenue) in time order. Dates that do not parse are left out; ``settle_format`` counts them."""
    month = F.date_format(as_day(df, date, date_format), "yyyy-MM")
    return (
        df.select(month.alias("month"), present(df, revenue).alias("_v"))
        .where("month is not null")
        .groupBy("month").agg(settled(money_sum(F.col("_v")), 2).alias("revenue"))
        .orderBy("month")
    )


def top_customers(df: DataFrame, k: int = 10, customer="customer_id", revenue="revenue") -> DataFrame:
    """The k customers with the highest revenue. Only k rows per task reach the final sort."""
    return revenue_by(df, customer, revenue).limit(k)


def count_by(df: DataFrame, key: str) -> DataFrame:
    """(key, orders): row counts per value, largest first."""
    counted = df.where(col(key).isNotNull()).groupBy(col(key).alias(key)).agg(F.count("*").alias("orders"))
    return counted.orderBy(F.desc("orders"), F.asc(key))


def segment_breakdown(df: DataFrame, key: str, value: str) -> DataFrame:
    """(segment, sum, mean, count), keys ascending, then the grand total as segment null.

    The total is added up from the segment sums, so the data is grouped once. Rows without
    a segment count in the total only.
    """
    number = as_double(df, value)
    sums = df.groupBy(col(key).cast("string").alias("segment")).agg(
        money_sum(number).alias("_sum"), F.count(number).alias("count")
    )
    total = sums.agg(
        F.coalesce(F.sum("_sum"), F.lit(0.0)).alias("_sum"), F.coalesce(F.sum("count"), F.lit(0)).alias("count")
    )
    both = sums.where("segment is not null").select("segment", "_sum", "count", F.lit(False).alias("is_total")).unionByName(
        total.select(F.lit(None).cast("string").alias("segment"), "_sum", "count", F.lit(True).alias("is_total"))
    )
    return both.select(
        "segment", settled("_sum", 2).alias("sum"),
        settled(F.try_divide("_sum", "count"), 2).alias("mean"), "count", "is_total",
    )


def segment_share_rank(df: DataFrame, key: str, value: str) -> DataFrame:
    """(segment, sum, share, rank): percentage of the total and rank by sum, ties alike.

    Ranks are positions in a range sort of the segment sums, so segments may be as many as
    customers; the total is a one-row subquery.
    """
    number = as_double(df, value)
    sums = df.where(col(key).isNotNull()).groupBy(col(key).cast("string").alias("segment")).agg(
        settled(money_sum(number), 2).alias("sum")
    )
    placed = dense_index(sums, [F.desc("sum"), F.asc("segment")], "_position")
    ranks = placed.groupBy(F.col("sum").alias("_sum")).agg((F.min("_position") + 1).alias("rank"))
    total = placed.agg(F.sum("sum")).scalar()
    return placed.join(ranks, F.col("sum") == F.col("_sum")).select(
        "segment", "sum", settled(F.try_divide(F.col("sum") * 100.0, total), 2).alias("share"), "rank"
    )


def monthly_trend(df: DataFrame, date: str = "order_date", revenue: str = "revenue", date_format: str = "") -> DataFrame:
    """(month, revenue, previous, direction): growing or declining against the month before.

    The window runs over the monthly table, which the calendar bounds.
    """
    before = F.lag("revenue").over(Window.orderBy("month"))
    return monthly_revenue(df, date, revenue, date_format).withColumn("previous", before).select(
        "month", "revenue", "previous",
        F.when(F.col("previous").isNotNull(), F.when(F.col("revenue") > F.col("previous"), "growing").otherwise("declining"))
        .alias("direction"),
    )


# --- declared plan operations ---------------------------------------------------------

def filter_rows(df: DataFrame, conditions: list[Column] = (), date: str | None = None, start=None, end=None) -> DataFrame:
    """All conditions, and ``start <= date < end``. Plain comparisons reach the scan."""
    wanted = list(conditions)
    if date is not None:
        typed = as_day(df, date) if isinstance(df.schema[date].dataType, T.StringType) else col(date)
        wanted += [typed >= F.lit(start).cast("date")] if start else []
        wanted += [typed < F.lit(end).cast("date")] if end else []
    return df.where(reduce(lambda a, b: a & b, wanted)) if wanted else df


def aggregate_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, sum, mean, median, count) per key; the median is exact for any group size."""
    keyed = df.where(col(key).isNotNull()).select(col(key).alias(key), as_double(df, value).alias("_x"))
    moments = [F.sum("_x").alias("_sum"), F.avg("_x").alias("_mean"), F.count("_x").alias("count")]
    found = grouped_quantile(keyed, [key], "_x", 0.5, "_median", also=moments)
    return found.select(
        key, settled(F.coalesce("_sum", F.lit(0.0)), 2).alias("sum"), settled("_mean", 2).alias("mean"),
        settled("_median", 2).alias("median"), "count",
    )
