"""First look at a table: schema, completeness, samples, date column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.columns import as_timestamp, is_temporal, present, settle_formats
from ..functions.frequencies import column_facts, frequencies, value_text


def detect_schema_approximately(df: DataFrame, relative_error: float = 0.02) -> DataFrame:
    """``detect_schema`` without a table of distinct values: their number is estimated, within ``relative_error``.

    One aggregate over all columns for the counts and the smallest value, and one each for the second and the
    third: the smallest value above the one before. Nothing but a row a task and column is shuffled.
    """
    values = [present(df, c) for c in df.columns]
    first = df.agg(F.count(F.lit(1)).alias("rows"), *[
        m for i, v in enumerate(values) for m in (
            F.count(v).alias(f"n{i}"), F.approx_count_distinct(v, relative_error).alias(f"d{i}"), F.min(v).alias(f"s{i}_0"))
    ]).head()
    samples = {i: [first[f"s{i}_0"]] for i in range(len(values)) if first[f"s{i}_0"] is not None}
    for k in (1, 2):
        open_ = [i for i in samples if len(samples[i]) == k]
        if open_:
            more = df.agg(*[F.min(F.when(values[i] > F.lit(samples[i][-1]), values[i])).alias(f"s{i}") for i in open_]).head()
            for i in open_:
                samples[i] += [] if more[f"s{i}"] is None else [more[f"s{i}"]]
    rows = [(i, c, df.schema[c].dataType.simpleString(), first[f"n{i}"], first["rows"] - first[f"n{i}"], first[f"d{i}"]) for i, c in enumerate(df.columns)]
    found = df.sparkSession.createDataFrame(rows, "ordinal int, column string, dtype string, non_null bigint, null_count bigint, unique_count bigint")
    listed = F.lit(None).cast("array<string>")
    for i, c in enumerate(df.columns):
        values_of = [F.lit(v).cast(df.schema[c].dataType).cast("string") for v in samples.get(i, [])]
        listed = F.when(F.col("ordinal") == i, F.array(*values_of).cast("array<string>")).otherwise(listed)
    return found.withColumn("sample_values", listed)


def detect_schema(df: DataFrame) -> DataFrame:
    """Per column: type, non-null, null and distinct counts, three sample values.

    Samples are the three smallest distinct values; "the first rows" has no meaning in a
    distributed table. Sorting missing values last (instead of filtering them early) and
    keeping ``n`` leaves their frequency table the same as that of the counts, so Spark
    scans and shuffles once for both.
    """
    order = Window.partitionBy("ordinal").orderBy(F.col("value").isNull(), "as_long", "as_double", "as_text")
    samples = (
        frequencies(df, df.columns)
        .withColumn("value", value_text())
        .withColumn("position", F.row_number().over(order))
        .where("position <= 3")
        .where("value is not null")
        .groupBy("ordinal")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("position", "value", "n"))), lambda s: s["value"]
        ).alias("sample_values"))
    )
    return (
        column_facts(df)
        .join(samples, "ordinal", "left")
        .select(
            "ordinal", "column", "dtype", "non_null", "null_count", "unique_count",
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        )
    )


def dataset_info(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Row and column counts and the first date column with its range.

    A column counts as dates if its type says so, or if it is text of which more than
    ``share`` of all rows parse in the one format that fits it best. All candidates are tested together.
    """
    candidates = [
        f for f in df.schema.fields if is_temporal(f.dataType) or isinstance(f.dataType, T.StringType)
    ]
    formats = settle_formats(df, [f.name for f in candidates])
    rows = F.count(F.lit(1))
    measures = [rows.alias("num_rows")]
    for i, f in enumerate(candidates):
        moment = as_timestamp(df, f.name, formats[f.name][0])
        is_date = F.lit(True) if is_temporal(f.dataType) else F.count(moment) > rows * share
        measures.append(F.struct(
            is_date.alias("is_date"), F.lit(f.name).alias("column"),
            F.min(moment).alias("lo"), F.max(moment).alias("hi"),
        ).alias(f"c{i}"))
    measured = df.agg(*measures)
    found = F.array_compact(F.array(*[
        F.when(F.col(f"c{i}.is_date"), F.col(f"c{i}")) for i in range(len(candidates))
    ])) if candidates else F.array().cast("array<struct<column:string,lo:timestamp,hi:timestamp>>")
    first = F.get(found, F.lit(0))
    as_text = "yyyy-MM-dd HH:mm:ss"
    return measured.select(
        "num_rows", F.lit(len(df.columns)).alias("num_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
        first["column"].alias("date_column"),
        F.date_format(first["lo"], as_text).alias("date_min"),
        F.date_format(first["hi"], as_text).alias("date_max"),
    )
