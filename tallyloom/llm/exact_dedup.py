"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep one row a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scratch import materialize
from .common import ascii_lower, numbered, salted_join, stored, without


#: Repeated hashes, of 16 bytes each, that may be broadcast to spare the texts a shuffle.
BROADCAST = 200_000


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower, content_hash: Callable[[Column], Column] = hash128,
) -> DataFrame:
    """Every row's group of equal texts: _row, id, keep_id, group_size, kept, text_sha256.

    A ``docs`` that is no stored table is written first (see ``stored``). Texts are equal when their normalised
    bytes are; null counts as empty, and empty texts equal one another. The row with the smallest
    (or ``keep="largest"``) id stays, a null id last of all; of rows with the same id the
    first (last) stored.
    Only narrow digests are grouped. Texts move once, and only to be compared: those whose hash
    occurs again are counted by (hash, text), combined before the shuffle, so that a group of any
    size costs one row a task. A hash with two texts is split by the texts themselves.
    """
    rows = numbered(stored(docs)).select("_row", F.col(id_col).alias("_id"), normalise(F.col(text_col)).alias("_norm"))
    rows = rows.withColumn("_hash", content_hash(F.col("_norm")))
    digests = materialize(rows.select("_row", "_id", "_hash", F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha")))
    repeated = materialize(digests.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1"))
    texts = salted_join(rows, repeated.select("_hash"), "_hash", "left_semi", most=BROADCAST, sizes=repeated).groupBy("_hash", "_norm").agg(F.count("*").alias("_n"))
    mixed = texts.groupBy("_hash").agg(F.count("*").alias("_texts")).where("_texts > 1").select("_hash")
    mixed = materialize(mixed)
    if mixed.head(1):
        by_text = Window.partitionBy("_hash").orderBy("_norm")
        split = salted_join(rows, mixed, "_hash", "left_semi")
        variants = split.groupBy("_hash", "_norm").agg(F.count("*").alias("_n")).withColumn("_variant", F.rank().over(by_text))
        variant = salted_join(split, variants.drop("_n"), ["_hash", "_norm"], "inner").select("_row", "_variant")
        digests = digests.join(variant, "_row", "left")
    else:
        digests = digests.withColumn("_variant", F.lit(None).cast("int"))
    digests = digests.withColumn("_key", F.struct("_hash", F.coalesce("_variant", F.lit(0)).alias("_variant")))
    best = F.min if keep == "smallest" else F.max
    known = F.col("_id").isNull() if keep == "smallest" else F.col("_id").isNotNull()
    first = F.struct(known.alias("_known"), "_id", "_row")
    groups = digests.groupBy("_key").agg(F.count("*").alias("group_size"), best(first).alias("_first"))
    many = groups.where("group_size > 1")
    found = salted_join(digests, many, "_key", "left", sizes=many.withColumnRenamed("group_size", "_n"))
    alone = F.col("_first").isNull()
    return found.select(
        "_row", F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_first._id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_first._row") == F.col("_row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    docs = stored(docs)
    gone = materialize(exact_duplicates(docs, id_col, text_col, keep, **options).where("not kept").select("_row"))
    return without(docs, gone)
