import pytest
from pyspark.sql import types as T

from odd_documents import CLASHES, ODD


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """The documents above with clashing columns, stored in three files."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in CLASHES]])
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 2}", None if t is None else len(t), *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate(ODD)]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    odd.where("false").coalesce(1).write.parquet(path)
    return spark.read.schema(odd.schema).parquet(path)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(8, 1, 0), (17, 1, 0), (10, 1, 1), (11, 1, 0), (19, 0, 0), (16, 0, 1), (19, 0, 0), (None, 1, None), (99, 1, 0), (18, None, 0)], "doc_id long, quality int, toxic int")
