"""Mask personal data in a text column and count what was masked."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from ..functions.masking import REPLACEMENTS, add_pii_hits, mask_pii


def mask_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, mask_pii(col(text)))


def pii_counts(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, kind, hits, texts): masked items and affected texts per kind and source."""
    marked = add_pii_hits(df.select(col(by).alias(by), col(text).alias("_source_text")), "_source_text")
    sums = marked.groupBy(by).agg(*[
        m for kind in REPLACEMENTS for m in (
            F.sum(F.col(f"_{kind}").cast("bigint")).alias(f"{kind}_hits"),
            F.count_if(F.col(f"_{kind}") > 0).alias(f"{kind}_texts"),
        )
    ])
    rows = [
        F.struct(F.lit(k).alias("kind"), F.col(f"{k}_hits").alias("hits"), F.col(f"{k}_texts").alias("texts"))
        for k in REPLACEMENTS
    ]
    return sums.select(by, F.inline(F.array(*rows)))
