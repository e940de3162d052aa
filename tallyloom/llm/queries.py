"""The registered queries of the subpackage and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, fill_in_middle, html_text, lexical_search, packing, personal_data, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, warc
from .common import read

QUERIES = {}
ORACLE = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op7_exact_dedup(spark, folder):
    found = exact_dedup.exact_duplicates(read(spark, folder, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op7_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


@query
def op1_simhash_dedup(spark, folder):
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_substring_dedup(spark, folder):
    return substring_dedup.repeated_words(read(spark, folder, "documents"))


@query
def op5_quality_rules(spark, folder):
    found = quality_rules.cascade(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select("_doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


@query
def op6_quality_classifier(spark, folder):
    found = quality_classifier.classified(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("host_mean", "path_mean", "score")], "kept")


def packed_pieces(docs):
    """Pieces of ``docs`` in windows of 2048, with a checksum in place of the ids."""
    found = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_packing(spark, folder):
    return packed_pieces(read(spark, folder, "documents"))


@query
def op8_warc(spark, folder):
    found = warc.round_trip(spark, read(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_html_text(spark, folder):
    return html_text.main_texts(read(spark, folder, "pages"))


@query
def op3_suffix_dedup(spark, folder):
    return suffix_dedup.repeated_bytes(read(spark, folder, "documents"))


@query
def op2_byte_bpe(spark, folder):
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(read(spark, folder, "documents"), file, public_tokenizers.PATTERN)


@query
def op13_fill_in_middle(spark, folder):
    found = fill_in_middle.fill_in_middle(read(spark, folder, "documents").select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


ORACLE["op13_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h, length(coalesce(text, '')) AS n FROM documents
), c AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), s AS (
  SELECT *, substring(text, 1, least(a, b)) AS prefix, substring(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle,
    substring(text, greatest(a, b) + 1) AS suffix
  FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""


@query
def op11_lexical_search(spark, folder):
    return lexical_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"), k=10)


ORACLE["op11_lexical_search"] = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, docs),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), s AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY ALL
), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


@query
def op12_personal_data(spark, folder):
    found = personal_data.personal_data(read(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in personal_data.KINDS],
        F.sha2(personal_data.listed("base").cast("binary"), 256).alias("base_sha256"), personal_data.listed("spans").alias("spans"))
