"""Dataset profile: column facts, semantic types, statistics, relationships, date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import as_timestamp, contains_any, is_temporal, numeric_columns, settle_formats, settled, to_rows
from ..functions.frequencies import column_facts, top_frequencies
from ..functions.scratch import materialize
from .statistics import strong_correlations, summary_statistics

# Name parts that decide a semantic type.
IDENTIFIER_WORDS = ["id", "code", "key"]
DATETIME_WORDS = ["date", "time"]
MEASURE_WORDS = ["amount", "revenue", "price", "cost", "quantity", "discount"]
FEW_VALUES = 5

# Privacy modes, what they allow, and the marker for withheld samples.
MODES = {"STRICT": False, "STANDARD": True, "FULL": True}
REDACTED = "[REDACTED_UNDER_STRICT_PRIVACY]"


def profile_columns(df: DataFrame) -> DataFrame:
    """Type, null count and share, distinct count and uniqueness of every column."""
    return column_facts(df).select(
        "ordinal", "column", "dtype", "row_count", "null_count",
        F.coalesce(settled(F.try_divide(F.col("null_count") * 100.0, F.col("row_count")), 2), F.lit(0.0))
        .alias("null_percentage"),
        "unique_count", (F.col("unique_count") == F.col("row_count")).alias("is_unique"),
    )


def _semantic_type(df: DataFrame) -> Column:
    name = F.lower("column")
    numeric = F.col("column").isin(*(numeric_columns(df) or [""]))
    temporal = F.col("column").isin(*([f.name for f in df.schema.fields if is_temporal(f.dataType)] or [""]))
    flag = F.col("column").isin(*([f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)] or [""]))
    return (
        F.when(F.col("is_unique") & contains_any(name, IDENTIFIER_WORDS), "identifier")
        .when(temporal | contains_any(name, DATETIME_WORDS), "datetime")
        .when(flag, "categorical")
        .when(numeric & (F.col("unique_count") <= FEW_VALUES) & ~contains_any(name, MEASURE_WORDS), "categorical")
        .when(numeric, "numeric")
        .otherwise("categorical")
    )


def semantic_types(df: DataFrame) -> DataFrame:
    """Column facts plus identifier / datetime / numeric / categorical; first rule wins."""
    return profile_columns(df).withColumn("semantic_type", _semantic_type(df))


def columns_of_type(df: DataFrame, semantic_type: str, facts: DataFrame | None = None) -> list[str]:
    found = (semantic_types(df) if facts is None else facts).where(F.col("semantic_type") == semantic_type)
    return [r["column"] for r in found.orderBy("ordinal").collect()]


def profile_stats(df: DataFrame) -> DataFrame:
    """Statistics of the numeric columns with values, 2 decimals; deviation 0 for one value."""
    two = {n: settled(n, 2).alias(n) for n in ("min", "max", "mean", "median", "q25", "q75")}
    return summary_statistics(df).where("count > 0").select(
        "column", two["min"], two["max"], two["mean"], two["median"],
        settled(F.coalesce("std", F.lit(0.0)), 2).alias("std"), two["q25"], two["q75"],
        settled(F.col("q75") - F.col("q25"), 2).alias("iqr"),
    )


def profile_top(df: DataFrame, k: int = 5) -> DataFrame:
    """(column, sample_summary): ``value (count)`` of the commonest values of the
    categorical columns that are not numeric, as an array in rank order."""
    columns = [
        f.name for f in df.schema.fields
        if not isinstance(f.dataType, (T.NumericType, T.BooleanType)) and not is_temporal(f.dataType)
        and not any(w in f.name.lower() for w in DATETIME_WORDS)
    ]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, sample_summary array<string>")
    entry = F.struct("position", F.format_string("%s (%d)", "value", "n").alias("text"))
    return (
        top_frequencies(df, columns, k)
        .groupBy("column")
        .agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]).alias("sample_summary"))
    )


def profile_table(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The full profile, one row per column with a statistics struct and a sample array.

    Identifier text columns carry no samples, as their values single out one row each. ``facts`` are the
    ``semantic_types`` where they are known.
    """
    names = ["min", "max", "mean", "median", "std", "q25", "q75", "iqr"]
    stats = profile_stats(df).select("column", F.struct(*names).alias("stats"))
    categorical = F.col("semantic_type") == "categorical"
    return (
        (semantic_types(df) if facts is None else facts)
        .join(stats, "column", "left")
        .join(profile_top(df), "column", "left")
        .withColumn(
            "sample_summary",
            F.coalesce(F.when(categorical, F.col("sample_summary")), F.array().cast("array<string>")),
        )
    )


def sanitize_profile(profile: DataFrame, mode: str = "STRICT") -> DataFrame:
    """What of a profile may leave: samples only in modes that allow them, no uniqueness flag.

    An unknown mode is treated as STRICT. Statistics are kept in every mode.
    """
    allowed = MODES.get(mode, MODES["STRICT"])
    samples = F.col("sample_summary") if allowed else F.array(F.lit(REDACTED))
    return profile.select(
        "ordinal", "column", "dtype", "semantic_type", "null_count", "null_percentage", "unique_count",
        samples.alias("sample_summary"), "stats", F.lit(mode).alias("privacy_mode"),
    )


NOTICES = {
    "STRICT": "only schema and aggregates are shown; sample values are withheld",
    "STANDARD": "schema, aggregates and the commonest values are shown",
    "FULL": "schema, aggregates and the commonest values are shown",
}


def dataset_profile(df: DataFrame, name: str, mode: str = "STRICT", facts: DataFrame | None = None) -> DataFrame:
    """One row on the whole table: counts, its columns by semantic type, a description, the privacy mode and its notice.

    Column facts, relationships and date ranges are tables of their own.
    """
    kinds = {"numeric": "numeric_columns", "categorical": "categorical_columns", "datetime": "datetime_columns", "identifier": "id_columns"}
    facts = semantic_types(df) if facts is None else facts
    listed = [
        F.transform(F.array_sort(F.collect_list(F.when(F.col("semantic_type") == k, F.struct("ordinal", "column")))), lambda c: c["column"]).alias(n)
        for k, n in kinds.items()
    ]
    whole = facts.agg(F.max("row_count").alias("row_count"), F.count("*").alias("column_count"), *listed)
    said = lambda n: F.when(F.size(n) > 0, F.array_join(n, ", ")).otherwise("none")
    described = F.concat(
        F.lit(f"{name}: "), F.col("row_count").cast("string"), F.lit(" rows of "), F.col("column_count").cast("string"), F.lit(" columns; told apart by "),
        said("id_columns"), F.lit("; measured in "), said("numeric_columns"), F.lit("; grouped by "), said("categorical_columns"), F.lit("."))
    known = mode if mode in MODES else "STRICT"
    return whole.select(
        F.lit(name).alias("dataset_name"), "row_count", "column_count", *kinds.values(), described.alias("description"),
        F.lit(mode).alias("privacy_mode"), F.lit(NOTICES[known]).alias("privacy_notice"))


def shared_profile(df: DataFrame, name: str, mode: str = "STRICT") -> DataFrame:
    """All of a profile that may leave, in one table: section, item, facts (a map of texts), privacy_mode.

    Sections are dataset, column, relationship and date_range; facts without a value are left out. ``sanitize_profile`` decides on columns, aggregates are in every mode.
    The facts of the columns, which take all their distinct values, are found once and written for the three sections that need them.
    """
    facts = materialize(semantic_types(df))
    whole = dataset_profile(df, name, mode, facts).drop("privacy_mode")
    columns = sanitize_profile(profile_table(df, facts), mode).select("*", "stats.*").drop("stats", "privacy_mode", "ordinal")
    parts = {
        "dataset": (whole, F.col("dataset_name")), "column": (columns, F.col("column")),
        "relationship": (relationships(df, facts=facts), F.concat_ws(" - ", "source", "target")), "date_range": (date_ranges(df), F.col("column")),
    }

    def told(section: str, rows: DataFrame, item: Column) -> DataFrame:
        texts = [
            F.struct(F.lit(f.name).alias("key"), (F.array_join(f.name, "; ") if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast("string")).alias("value"))
            for f in rows.schema.fields]
        kept = F.filter(F.array(*texts), lambda p: p["value"].isNotNull())
        return rows.select(F.lit(section).alias("section"), item.alias("item"), F.map_from_entries(kept).alias("facts"), F.lit(mode).alias("privacy_mode"))

    first, *others = [told(section, *part) for section, part in parts.items()]
    for other in others:
        first = first.unionByName(other)
    return first


def relationships(df: DataFrame, threshold: float = 0.4, facts: DataFrame | None = None) -> DataFrame:
    """Strong correlations among the columns of numeric semantic type."""
    return strong_correlations(df, columns_of_type(df, "numeric", facts), threshold)


def date_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min, max, span_days) of the datetime columns; text is read in the one format that fits it best.

    Text that this format does not read is ignored; ``settle_formats`` counts it.
    """
    columns = columns or [
        f.name for f in df.schema.fields
        if is_temporal(f.dataType) or any(w in f.name.lower() for w in DATETIME_WORDS)
    ]
    formats = settle_formats(df, columns)
    moments = [as_timestamp(df, c, formats[c][0]) for c in columns]
    measured = df.agg(*[m for i, t in enumerate(moments) for m in (F.min(t).alias(f"lo{i}"), F.max(t).alias(f"hi{i}"))])
    text = "yyyy-MM-dd HH:mm:ss"
    return measured.select(to_rows([
        F.struct(
            F.lit(c).alias("column"), F.date_format(f"lo{i}", text).alias("min"),
            F.date_format(f"hi{i}", text).alias("max"),
            F.timestamp_diff("DAY", F.col(f"lo{i}"), F.col(f"hi{i}")).alias("span_days"),
        )
        for i, c in enumerate(columns)
    ])).where("min is not null")
