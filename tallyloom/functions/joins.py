"""Joins of many rows with a few groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Groups that may be broadcast, by a count taken before the join.
MOST_ROWS = 10_000


def join_small(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", most: int = MOST_ROWS) -> DataFrame:
    """``groups`` (a stored table, one row a key) are broadcast if they are counted to be few.

    Otherwise Spark joins them as it sees fit, by sorting with split skewed keys if they are large. Few keys are
    the case in which a shuffle by key would pile the rows up in a few tasks.
    """
    return rows.join(F.broadcast(groups) if groups.count() <= most else groups, keys, how)
