"""Missing values, duplicate rows, outliers, and the whole cleaning run.

Each step is a fit that returns a few numbers per column and an apply that uses them as
literals, so applying adds no join and no shuffle to the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import as_double, col, numeric_columns, present, settled, to_rows
from ..functions.frequencies import modes
from ..functions.quantiles import exact_quantiles
from ..functions.scratch import materialize

UNKNOWN = "Unknown"


@dataclass(frozen=True)
class Fill:
    column: str
    filled: int
    method: str
    value: float | str


@dataclass(frozen=True)
class Bounds:
    """Fences of a column and whether any value lies beyond them."""

    column: str
    lower: float
    upper: float
    hit: bool


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and percentage. One aggregate row, turned into rows."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(present(df, c).isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)],
    )
    structs = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing_count"),
            settled(F.try_divide(F.col(f"_m{i}") * 100.0, F.col("_rows")), 2).alias("missing_percentage"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counted.select(to_rows(structs)).where("missing_count > 0")


def fit_fills(df: DataFrame) -> list[Fill]:
    """Fill value per column with nulls: the median, or the commonest value if not numeric."""
    return _fit(df)[2]


def _fit(df: DataFrame) -> tuple[int, int, list[Fill]]:
    """Rows, missing cells and fills. An all-null numeric column has no median and stays null."""
    head = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(present(df, c).isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)],
    ).head()
    missing = {c: head[f"_m{i}"] for i, c in enumerate(df.columns) if head[f"_m{i}"]}
    numeric = [c for c in numeric_columns(df) if c in missing]
    other = [c for c in df.columns if c in missing and c not in numeric]
    medians = exact_quantiles(df, numeric, [0.5])
    common = modes(df, other)
    fills = []
    for c in df.columns:
        if c in numeric:
            if medians[c].quantiles[0] is not None:
                fills.append(Fill(c, missing[c], "median", medians[c].quantiles[0]))
        elif c in missing:
            fills.append(Fill(c, missing[c], "mode", UNKNOWN if common[c] is None else common[c]))
    return head["_rows"], sum(missing.values()), fills


def fill_missing(df: DataFrame, fills: list[Fill]) -> DataFrame:
    """Replace nulls by the fitted values. A filled integer column becomes double if its
    median is fractional, since the value would otherwise change on the way in."""
    chosen = {f.column: f for f in fills}
    columns = []
    for c in df.columns:
        fill = chosen.get(c)
        if fill is None:
            columns.append(col(c))
        elif fill.method == "median":
            dtype = df.schema[c].dataType
            whole = isinstance(dtype, T.IntegralType) and float(fill.value).is_integer()
            target = dtype if whole else T.DoubleType()
            columns.append(F.coalesce(present(df, c).cast(target), F.lit(fill.value).cast(target)).alias(c))
        else:
            dtype = df.schema[c].dataType
            target = T.StringType() if fill.value == UNKNOWN else dtype
            columns.append(F.coalesce(col(c).cast(target), F.lit(fill.value).cast(target)).alias(c))
    return df.select(*columns)


def impute_report(spark: SparkSession, fills: list[Fill]) -> DataFrame:
    return spark.createDataFrame(
        [(f.column, f.filled, f.method, str(f.value)) for f in fills],
        "column string, filled bigint, method string, fill_value string",
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical row (nulls equal).

    Grouping on every column spreads the work by whole-row hash, and map-side counting
    folds a row repeated a billion times into one per task.
    """
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_copies"))
    return groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def deduplicate(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fit_bounds(df: DataFrame, columns: list[str] | None = None) -> list[Bounds]:
    """Outlier fences, quartile -/+ 1.5 IQR, per column that has values.

    The extremes from the first quantile pass tell whether anything lies beyond a fence.
    """
    columns = columns or numeric_columns(df)
    bounds = []
    for c, summary in exact_quantiles(df, columns, [0.25, 0.75]).items():
        q1, q3 = summary.quantiles
        if q1 is not None:
            lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            bounds.append(Bounds(c, lo, hi, summary.min < lo or summary.max > hi))
    return bounds


def outlier_report(df: DataFrame, bounds: list[Bounds]) -> DataFrame:
    """Columns with outliers: count in total, strictly below and above, and the fences."""
    hit = [b for b in bounds if b.hit]
    schema = (
        "column string, outlier_count bigint, capped_lower bigint, capped_upper bigint, "
        "lower_bound double, upper_bound double"
    )
    if not hit:
        return df.sparkSession.createDataFrame([], schema)
    counted = df.agg(*[
        m for i, b in enumerate(hit) for m in (
            F.count_if(as_double(df, b.column) < b.lower).alias(f"_b{i}"),
            F.count_if(as_double(df, b.column) > b.upper).alias(f"_a{i}"),
        )
    ])
    return counted.select(to_rows([
        F.struct(
            F.lit(b.column).alias("column"), (F.col(f"_b{i}") + F.col(f"_a{i}")).alias("outlier_count"),
            F.col(f"_b{i}").alias("capped_lower"), F.col(f"_a{i}").alias("capped_upper"),
            settled(F.lit(b.lower), 2).alias("lower_bound"), settled(F.lit(b.upper), 2).alias("upper_bound"),
        )
        for i, b in enumerate(hit)
    ]))


def cap_outliers(df: DataFrame, bounds: list[Bounds]) -> DataFrame:
    """Pull values beyond the unrounded fences back to them; nulls stay null.

    Flag-like columns with equal quartiles collapse to one value; pass ``columns`` to
    ``fit_bounds`` to leave them out.
    """
    hit = {b.column: b for b in bounds if b.hit}
    columns = []
    for c in df.columns:
        if c not in hit:
            columns.append(col(c))
            continue
        value = as_double(df, c)
        capped = F.greatest(F.lit(hit[c].lower), F.least(F.lit(hit[c].upper), value))
        columns.append(F.when(value.isNotNull(), capped).alias(c))
    return df.select(*columns)


@dataclass(frozen=True)
class Cleaned:
    """The cleaned table and what was done to it. ``unique`` is the table before capping."""

    data: DataFrame
    unique: DataFrame
    initial_rows: int
    initial_columns: int
    total_missing: int
    fills: list[Fill]
    bounds: list[Bounds]

    def report(self) -> DataFrame:
        """(section, column, metric, value) of the whole run."""
        final = self.unique.count()
        rows = [
            ("summary", None, "initial_rows", float(self.initial_rows)),
            ("summary", None, "initial_columns", float(self.initial_columns)),
            ("summary", None, "total_missing", float(self.total_missing)),
            ("summary", None, "duplicates_removed", float(self.initial_rows - final)),
            ("summary", None, "final_rows", float(final)),
            ("summary", None, "final_columns", float(len(self.data.columns))),
        ]
        rows += [("missing", f.column, "filled", float(f.filled)) for f in self.fills]
        table = self.data.sparkSession.createDataFrame(rows, "section string, column string, metric string, value double")
        capped = outlier_report(self.unique, self.bounds)
        names = ["capped_lower", "capped_upper", "lower_bound", "upper_bound"]
        long = capped.select("column", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
            "column", names, "metric", "value"
        )
        return table.unionByName(long.select(F.lit("outliers").alias("section"), "column", "metric", "value"))


def clean_data(df: DataFrame) -> Cleaned:
    """Fill, drop duplicates, then cap: fills are fitted before and fences after dropping.

    The deduplicated table is written once to the shared scratch folder. Without it every
    fence pass would shuffle the whole table again.
    """
    rows, missing, fills = _fit(df)
    unique = materialize(deduplicate(fill_missing(df, fills)))
    bounds = fit_bounds(unique)
    return Cleaned(cap_outliers(unique, bounds), unique, rows, len(df.columns), missing, fills, bounds)
