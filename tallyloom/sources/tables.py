"""Write tables and describe the ones that are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions.columns import col, to_rows


def save_table(df: DataFrame, name: str, path: str, mode: str = "overwrite") -> DataFrame:
    """Write Parquet (``overwrite`` or ``append``), register it as a view and report it.

    The row count is observed while writing, so reporting costs no second scan.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode}")
    spark = df.sparkSession
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    spark.read.schema(df.schema).parquet(path).createOrReplaceTempView(name)
    return spark.createDataFrame(
        [(name, seen.get["rows"], len(df.columns), ",".join(df.columns), "success")],
        "table_name string, rows_loaded bigint, column_count int, columns string, status string",
    )


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def table_catalog(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(table_name, ordinal, column, type, nullable, row_count) of registered tables."""
    parts = []
    for name in names or table_names(spark):
        df = spark.table(name)
        described = [
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(f.nullable).alias("nullable"), F.col("row_count"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(counted.select(F.lit(name).alias("table_name"), to_rows(described)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def sample_rows(spark: SparkSession, name: str, allow_samples: bool = False, k: int = 3) -> DataFrame:
    """A few rows of a table, only where the privacy policy allows values to be shown."""
    if not allow_samples:
        raise PermissionError("the active privacy mode does not allow sample values")
    return spark.table(name).limit(k)


def smallest_values(df: DataFrame, k: int = 3) -> dict[str, list[str]]:
    """The ``k`` smallest distinct values of every column, as text; none of nested and binary columns.

    Each scan takes the smallest value above the ones found so far, of all columns at once: no distinct values are shuffled.
    """
    plain = [f for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType)]
    found: dict[str, list[str]] = {f.name: [] for f in df.schema.fields}
    left = list(plain)
    for _ in range(k):
        if not left:
            break
        above = [F.when(col(f.name) > F.lit(found[f.name][-1]).cast(f.dataType), col(f.name)) if found[f.name] else col(f.name) for f in left]
        least = df.agg(*[F.min(c).cast("string").alias(f"c{i}") for i, c in enumerate(above)]).head()
        for f, value in zip(left, least):
            if value is not None:
                found[f.name].append(value)
        left = [f for f, value in zip(left, least) if value is not None]
    return found


def schema_with_samples(spark: SparkSession, names: list[str] | None = None, allow_samples: bool = False, k: int = 3) -> DataFrame:
    """``table_catalog`` with ``samples``: the ``k`` smallest distinct values of a column where the privacy policy allows values to be shown, else null.

    What may not be shown is not read either.
    """
    names = names or table_names(spark)
    rows = [(n, c, v) for n in names for c, v in smallest_values(spark.table(n), k).items()] if allow_samples else []
    samples = spark.createDataFrame(rows, "table_name string, column string, samples array<string>")
    return table_catalog(spark, names).join(F.broadcast(samples), ["table_name", "column"], "left")


def schema_fingerprint(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Per registered table the first 12 hex digits of the md5 of its sorted column names joined by ``_``."""
    names = names or table_names(spark)
    columns = spark.createDataFrame([(n, spark.table(n).columns) for n in names], "table_name string, names array<string>")
    joined = F.concat_ws("_", F.array_sort("names"))
    return columns.select(
        "table_name", F.size("names").alias("column_count"), F.substring(F.md5(joined), 1, 12).alias("fingerprint"),
    )
