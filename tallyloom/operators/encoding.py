"""Label encoding and z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, col, numeric_columns, settled, string_columns, to_rows
from ..functions.frequencies import frequencies
from ..functions.ranking import dense_index
from ..functions.scratch import materialize

# A column whose name contains one of these is neither encoded nor scaled.
SKIP_ENCODING = ("_id", "date")
SKIP_SCALING = ("_id",)
MISSING_LABEL = "nan"


def encodable_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    columns = columns or string_columns(df)
    return [c for c in columns if not any(p in c.lower() for p in SKIP_ENCODING)]


def scalable_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if not any(p in c.lower() for p in SKIP_SCALING)]


def encoding_map(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, label, code): labels sorted ascending per column, coded 0, 1, 2, ...

    Missing values form the label ``nan``. All columns share one scan, and the codes are
    positions in one range sort of the distinct labels, so neither a free-text column nor
    a hot label ends up in a single task. The result is a small written table.
    """
    columns = encodable_columns(df, columns)
    texts = df.select(*[col(c).cast("string").alias(c) for c in columns])
    labels = (
        frequencies(texts, columns)
        .select("ordinal", "column", F.coalesce("as_text", F.lit(MISSING_LABEL)).alias("label"))
        .distinct()
    )
    placed = dense_index(labels, [F.col("ordinal"), F.col("label")], "_position")
    starts = placed.groupBy("ordinal").agg(F.min("_position").alias("_start"))
    coded = placed.join(starts, "ordinal").select(
        "column", "label", (F.col("_position") - F.col("_start")).alias("code")
    )
    return materialize(coded)


def encode_labels(df: DataFrame, columns: list[str] | None = None, classes: DataFrame | None = None) -> DataFrame:
    """Replace text columns by their codes.

    Each join is an equi-join on the label: Spark broadcasts a class table that is under
    its size threshold and sort-merges (with skew splitting) one that is not.
    """
    columns = encodable_columns(df, columns)
    classes = encoding_map(df, columns) if classes is None else classes
    result = df
    for i, c in enumerate(columns):
        mine = classes.where(F.col("column") == c).select(F.col("label").alias(f"_l{i}"), F.col("code").alias(f"_c{i}"))
        label = F.coalesce(result[c].cast("string"), F.lit(MISSING_LABEL))
        result = result.join(mine, label == F.col(f"_l{i}"), "left").drop(f"_l{i}")
    codes = {c: F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)}
    return result.select(*[codes.get(c, col(c)) for c in df.columns])


def _moments(df: DataFrame, columns: list[str]) -> Column:
    """Mean and population deviation of every column, as a scalar subquery of one row."""
    return df.agg(F.struct(*[
        m for i, c in enumerate(columns) for m in (
            F.avg(as_double(df, c)).alias(f"mean{i}"), F.stddev_pop(as_double(df, c)).alias(f"std{i}"),
        )
    ])).scalar()


def _divisor(std: Column) -> Column:
    return F.coalesce(F.nullif(std, F.lit(0.0)), F.lit(1.0))


def scale_zscore(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Subtract the mean and divide by the population deviation (by 1 if that is 0)."""
    columns = columns or scalable_columns(df)
    moments = _moments(df, columns)
    scaled = {
        c: ((as_double(df, c) - moments[f"mean{i}"]) / _divisor(moments[f"std{i}"])).alias(c)
        for i, c in enumerate(columns)
    }
    return df.select(*[scaled.get(c, col(c)) for c in df.columns])


def scaler_info(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, mean, std) that ``scale_zscore`` would use, 4 decimals."""
    columns = columns or scalable_columns(df)
    measured = df.agg(*[
        m for i, c in enumerate(columns) for m in (
            F.avg(as_double(df, c)).alias(f"mean{i}"), F.stddev_pop(as_double(df, c)).alias(f"std{i}"),
        )
    ])
    return measured.select(to_rows([
        F.struct(
            F.lit(c).alias("column"), settled(f"mean{i}", 4).alias("mean"),
            settled(_divisor(F.col(f"std{i}")), 4).alias("std"),
        )
        for i, c in enumerate(columns)
    ]))


def preprocess(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Encoded table, encoding map and the scaler report of the encoded table."""
    classes = encoding_map(df)
    encoded = encode_labels(df, classes=classes)
    return encoded, classes, scaler_info(encoded)
