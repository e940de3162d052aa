"""The corpus pipeline: documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, folder of the given tables) and returns a DataFrame that is written as
Parquet and read again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.scratch import materialize
from tallyloom.llm import exact_dedup, packing, quality_classifier, simhash, substring_dedup
from tallyloom.llm.common import read


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.drop_rejected(docs, read(spark, folder, "labels"))


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, that with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, that with the smallest id stays.

    Prints four bits apart at most are candidates by SimHash, MinHash adds those whose prints lie further apart, and all are compared exactly.
    """
    return simhash.drop_similar(docs, words=5, least=0.8, bits=4)


def substring(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Words in passages that a document with a smaller id has go; n_chars follows where it is there."""
    cut = substring_dedup.drop_repeated_words(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in cut.columns else cut


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with a checksum of their ids."""
    found = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("substring_dedup", substring), ("packing", pack)]
#: No SQL expresses the classifier, the links or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
