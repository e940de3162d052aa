"""Helpers that several operators of the subpackage share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scratch import materialize

#: Rows of one key that may meet in a task, and keys that may have more than one share (their shares are broadcast).
LOAD, HOT_KEYS = 1 << 16, 100_000
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` itself if it reads a stored table, else a copy written to the shared folder."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return materialize(df)
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a stored table whose place is not among ``gone`` (_row), with their own columns."""
    name = free_name(df, "_row")
    return numbered(df, name).join(gone.withColumnRenamed("_row", name), name, "left_anti").select(*[f"`{c}`" for c in df.columns])


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Rows of a stored table with their place: file (a hash of its path) and row in the file.

    Every read gives a row the same place, however Spark splits the files, so repeated rows and null
    ids can be told apart over several passes.
    """
    source = df.metadataColumn("_metadata")
    return df.withColumn(name, F.struct(F.xxhash64(source["file_path"]).alias("file"), source["row_index"].alias("at")))


def ascii_lower(text: Column) -> Column:
    """A-Z alone in lower case; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), *LOWER)


def salted_join(
    rows: DataFrame, groups: DataFrame, key: str | list[str], how: str, spread: str = "_row", most: int = 0, sizes: DataFrame | None = None,
) -> DataFrame:
    """Join many rows a key with one row a key, so that no more than a load of a key's rows meet in one task.

    ``groups`` of at most ``most`` rows (counted; for stored tables only) are broadcast. Else the rows of each key are counted
    (``sizes``, key and _n, has these counts where they are known). A key with more than ``LOAD`` is dealt to as many shares as its
    count asks, by ``spread``, and its group repeated once a share; any other key has one share. Keys are not null.
    The shares are broadcast: they are those of the ``HOT_KEYS`` largest keys at most, and any key after these has less than
    one row in ``HOT_KEYS`` of all.
    """
    keys = [key] if isinstance(key, str) else key
    if most and groups.count() <= most:
        return rows.join(F.broadcast(groups), keys, how)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")) if sizes is None else sizes.select(*keys, "_n")
    hot = counted.where(F.col("_n") > LOAD).orderBy(F.desc("_n"), *keys).limit(HOT_KEYS)
    shares = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / LOAD).cast("int").alias("_shares")))
    share = F.coalesce("_shares", F.lit(1))
    dealt = rows.join(shares, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(F.lit(7), spread), share).cast("int")).drop("_shares")
    copies = groups.join(shares, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), share - 1))).drop("_shares")
    return dealt.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")
