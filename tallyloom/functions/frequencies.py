"""One long frequency table for many columns from a single scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .columns import present, to_rows

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ordinal, column, as_long, as_double, as_text, n): how often each value occurs.

    A value sits in the slot of its own type so that numbers are hashed as numbers; all
    slots null means the value is missing. Rows are pre-aggregated before the shuffle, so
    a value that fills a third of the table arrives as one row per task.
    """
    structs = []
    for i, c in enumerate(columns):
        dtype, value = df.schema[c].dataType, present(df, c)
        structs.append(F.struct(
            F.lit(i).alias("ordinal"),
            (value if isinstance(dtype, _INTEGRAL) else F.lit(None)).cast("bigint").alias("as_long"),
            (value if isinstance(dtype, _FLOATING) else F.lit(None)).cast("double").alias("as_double"),
            (value if not isinstance(dtype, _INTEGRAL + _FLOATING) else F.lit(None))
            .cast("string").alias("as_text"),
        ))
    long = df.select(to_rows(structs))
    names = F.array(*[F.lit(c) for c in columns])
    return (
        long.groupBy("ordinal", "as_long", "as_double", "as_text")
        .agg(F.count("*").alias("n"))
        .withColumn("column", names[F.col("ordinal")])
    )


def value_text() -> Column:
    return F.coalesce(F.col("as_text"), F.col("as_long").cast("string"), F.col("as_double").cast("string"))


def column_facts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: row count, non-null, null and distinct (non-null) counts."""
    columns = columns or df.columns
    missing = F.col("as_long").isNull() & F.col("as_double").isNull() & F.col("as_text").isNull()
    measured = frequencies(df, columns).groupBy("ordinal").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(missing, F.lit(0)).otherwise(F.col("n"))).alias("non_null"),
        F.count_if(~missing).alias("unique_count"),
    )
    listed = df.sparkSession.createDataFrame(
        [(i, c, df.schema[c].dataType.simpleString()) for i, c in enumerate(columns)],
        "ordinal int, column string, dtype string",
    )
    zero = F.lit(0).cast("bigint")
    return listed.join(measured, "ordinal", "left").select(
        "ordinal", "column", "dtype",
        F.coalesce("row_count", zero).alias("row_count"),
        F.coalesce("non_null", zero).alias("non_null"),
        (F.coalesce("row_count", zero) - F.coalesce("non_null", zero)).alias("null_count"),
        F.coalesce("unique_count", zero).alias("unique_count"),
    )


def top_frequencies(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(ordinal, column, position, value, n): the k commonest values, ties by value.

    The rank filter lets Spark keep k rows per column and task before the shuffle.
    """
    order = Window.partitionBy("ordinal").orderBy(F.desc("n"), F.asc("value"))
    return (
        frequencies(df, columns)
        .select("ordinal", "column", value_text().alias("value"), "n")
        .where("value is not null")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
    )


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Commonest value per text column as text, the smallest one on a tie."""
    if not columns:
        return {}
    best = (
        frequencies(df, columns)
        .where("as_text is not null")
        .groupBy("column")
        .agg(F.min(F.struct(-F.col("n"), F.col("as_text")))["as_text"].alias("mode"))
    )
    return {c: None for c in columns} | {r["column"]: r["mode"] for r in best.collect()}
