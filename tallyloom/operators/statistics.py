"""Descriptive statistics, correlations and value summaries."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import as_double, numeric_columns, settled
from ..functions.frequencies import column_facts, top_frequencies
from ..functions.moments import pair_moments
from ..functions.quantiles import exact_quantiles

_QUARTILES = [0.25, 0.5, 0.75]
_STATISTICS = (
    "column string, count bigint, mean double, std double, min double, q25 double, median double, "
    "q75 double, max double"
)


def summary_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Unrounded count, mean, sample deviation, minimum, quartiles and maximum per column.

    Moments ride along with the first quantile pass.
    """
    columns = columns or numeric_columns(df)
    found = exact_quantiles(df, columns, _QUARTILES)
    rows = [
        (c, s.count, s.mean, s.std, s.min, *s.quantiles, s.max) for c, s in found.items()
    ]
    return df.sparkSession.createDataFrame(rows, _STATISTICS)


def _rounded(names: list[str], digits: int) -> list[Column]:
    return [settled(n, digits).alias(n) for n in names]


def column_statistics(df: DataFrame, columns: list[str] | None = None, digits: int = 2) -> DataFrame:
    names = ["mean", "median", "std", "min", "max", "q25", "q75"]
    return summary_statistics(df, columns).select("column", *_rounded(names, digits))


def describe_table(df: DataFrame, columns: list[str] | None = None, digits: int = 2) -> DataFrame:
    names = ["mean", "std", "min", "q25", "median", "q75", "max"]
    return summary_statistics(df, columns).select("column", "count", *_rounded(names, digits))


def pair_correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(left_ordinal, right_ordinal, source, target, r) per unordered pair, diagonal included.

    Pearson over the rows where both are present, null if either does not vary. One scan (see ``pair_moments``).
    """
    columns = columns or numeric_columns(df)
    names = df.sparkSession.createDataFrame(
        [(i, j, columns[i], columns[j]) for i, j in combinations_with_replacement(range(len(columns)), 2)],
        "left_ordinal int, right_ordinal int, source string, target string",
    )
    if not columns:
        return names.withColumn("r", F.lit(None).cast("double"))
    found = pair_moments(df, [as_double(df, c) for c in columns])
    spread = F.sqrt("sxx") * F.sqrt("syy")
    r = F.greatest(F.least(F.try_divide("sxy", F.nullif(spread, F.lit(0.0))), F.lit(1.0)), F.lit(-1.0))
    kept = found.select(F.col("i").alias("left_ordinal"), F.col("j").alias("right_ordinal"), F.when((F.col("sxx") > 0) & (F.col("syy") > 0), r).alias("r"))
    return names.join(kept, ["left_ordinal", "right_ordinal"], "left").select("left_ordinal", "right_ordinal", "source", "target", "r")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, digits: int = 3) -> DataFrame:
    """(column, other, r) in both directions and on the diagonal, without a second pass."""
    both = F.inline(F.when(
        F.col("source") == F.col("target"),
        F.array(F.struct(F.col("source").alias("column"), F.col("target").alias("other"), F.col("r"))),
    ).otherwise(F.array(
        F.struct(F.col("source").alias("column"), F.col("target").alias("other"), F.col("r")),
        F.struct(F.col("target").alias("column"), F.col("source").alias("other"), F.col("r")),
    )))
    return pair_correlations(df, columns).select(both).withColumn("r", settled("r", digits))


def strong_correlations(df: DataFrame, columns: list[str], threshold: float = 0.4) -> DataFrame:
    """Edge table of the pairs with |r| at or above the threshold."""
    pairs = pair_correlations(df, columns).where(F.col("left_ordinal") < F.col("right_ordinal"))
    return pairs.where(F.abs("r") >= threshold).select(
        F.lit("correlation").alias("type"), "source", "target", settled("r", 3).alias("strength"),
        F.format_string("%s and %s move together with r = %.2f", "source", "target", "r").alias("description"),
    )


def column_summaries(df: DataFrame) -> DataFrame:
    """(column, kind, non_null, unique_count) for every column."""
    numeric = set(numeric_columns(df))
    return column_facts(df).select(
        "column",
        F.when(F.col("column").isin(*numeric), "numeric").otherwise("categorical").alias("kind")
        if numeric else F.lit("categorical").alias("kind"),
        "non_null", "unique_count",
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """(column, position, value, n): the commonest values of the non-numeric columns."""
    columns = columns or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
    return top_frequencies(df, columns, k).select("column", "position", "value", "n")
