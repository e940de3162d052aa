"""Load a dataset by its file extension."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.types import StructType

from ..functions.columns import col
from ..functions.scratch import materialize
from .records import Csv, JsonArray, whole_records

# Texts of a CSV cell that stand for no value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
#: Types tried for a CSV column without a schema, the narrowest first.
_TYPES = ("bigint", "double", "boolean")


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = True, missing: tuple[str, ...] = MISSING,
) -> DataFrame:
    """A CSV with header and doubled quotes inside quoted cells; cells in ``missing`` are null.

    ``multi_line`` lets quoted cells hold line feeds. Files are split over tasks all the same (see ``records``), which takes three scans of
    the text; a cell that holds a quote must be quoted, as every writer does. Pass False to read lines in one scan. A value that does not fit its
    type in ``schema`` is null; without a schema one aggregate over all columns finds the narrowest that fits all values.
    """
    options = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}
    raw = spark.read.csv(path, header=True, multiLine=multi_line, **options)
    if not raw.columns:  # an empty file
        return raw if schema is None else spark.createDataFrame([], schema)
    if multi_line:
        # A line feed before the end of a record is part of a cell, a carriage return may belong to the line's end.
        names = raw.columns
        record = F.regexp_replace("record", "\r$", "")
        lines = whole_records(spark, path, Csv, header=True).select(record.alias("record")).where("record <> ''")
        cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        parsed = lines.select(F.from_csv("record", cells.simpleString()[7:-1].replace(":", " "), options).alias("row")).select("row.*").toDF(*names)
        raw = parsed if schema is not None else materialize(parsed)
    value = {c: F.when(~col(c).isin(*missing), col(c)) for c in raw.columns} if missing else {c: col(c) for c in raw.columns}
    if schema is not None:
        declared = schema if isinstance(schema, StructType) else T.StructType.fromDDL(schema)
        return raw.select(*[value[c].try_cast(f.dataType).alias(f.name) for c, f in zip(raw.columns, declared.fields)])
    fits = raw.agg(*[
        F.bool_and(value[c].isNull() | value[c].try_cast(t).isNotNull()).alias(f"c{i}_{t}") for i, c in enumerate(raw.columns) for t in _TYPES
    ] + [F.count(value[c]).alias(f"c{i}") for i, c in enumerate(raw.columns)]).head()
    kinds = [next((t for t in _TYPES if fits[f"c{i}"] and fits[f"c{i}_{t}"]), "string") for i in range(len(raw.columns))]
    return raw.select(*[value[c].try_cast(k).alias(c) for c, k in zip(raw.columns, kinds)])


def load_dataset(
    spark: SparkSession, path: str, schema: StructType | str | None = None, json_document: bool = False, **csv_options,
) -> DataFrame:
    """Read a CSV (see ``read_csv``), JSON or Parquet file or folder.

    Pass ``schema`` for large text inputs: without it Spark reads them once more to infer
    one. JSON is read as one record per line; files that hold one array of objects each need ``json_document=True`` and are split over
    tasks too (see ``records``).
    """
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in (".csv", ".json", ".parquet"):
        raise ValueError(f"{extension or path} is no format that can be read: .csv, .json or .parquet")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(f"there is nothing at {path}")
    if extension == ".csv":
        return read_csv(spark, path, schema, **csv_options)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if extension == ".parquet":
        return reader.parquet(path)
    if json_document:
        return read_json_arrays(spark, path, schema)
    return reader.json(path)


def read_json_arrays(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The objects of files that hold one JSON array each; what is no object is left out, a broken object is a row of nulls.

    Pass ``schema`` for large files: without it the records are written and read once more to infer one.
    """
    inside = F.regexp_replace("record", r"^[^{]*", "")
    records = whole_records(spark, path, JsonArray).select(inside.alias("record")).where("record <> ''")
    records = records.select(F.concat("record", F.lit("}")).alias("record"))
    if schema is not None:
        declared = schema if isinstance(schema, StructType) else T.StructType.fromDDL(schema)
        return records.select(F.from_json("record", declared).alias("row")).select("row.*")
    stored = materialize(records)
    texts = getattr(stored._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark._jsparkSession.read().json(texts), spark)
