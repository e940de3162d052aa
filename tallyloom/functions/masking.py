"""Personal data in text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The patterns and their replacements, applied in this order.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"
REPLACEMENTS = {"email": (EMAIL, "[REDACTED_EMAIL]"), "phone": (PHONE, "[REDACTED_PHONE]"), "card": (CARD, "[REDACTED_CARD]")}


# Text that lacks these cannot match: most text is passed over without the full patterns.
_NEEDS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "phone": lambda text: text.rlike(r"(?U)\d{3}[-.\s]?\d{4}"),
    "card": lambda text: text.rlike(r"(?U)\d{4}[-\s]?\d{4}"),
}


def _masked(text: Column, kind: str) -> Column:
    pattern, marker = REPLACEMENTS[kind]
    # (?U): digits, spaces and word ends of every script count, not only ASCII ones.
    replaced = F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(marker))
    return F.when(_NEEDS[kind](text), replaced).otherwise(text)


def mask_pii(text: Column) -> Column:
    """Replace e-mail addresses, then phone numbers, then card numbers."""
    for kind in REPLACEMENTS:
        text = _masked(text, kind)
    return text


def add_pii_hits(df: DataFrame, text: str) -> DataFrame:
    """Adds _email, _phone, _card: hits per kind in the text the earlier kinds are masked in."""
    df = df.withColumn("_text", F.col(text))
    for kind, (pattern, _) in REPLACEMENTS.items():
        found = F.regexp_count("_text", F.lit("(?U)" + pattern))
        df = df.withColumn(f"_{kind}", F.when(_NEEDS[kind](F.col("_text")), found).otherwise(0))
        df = df.withColumn("_text", F.when(F.col(f"_{kind}") > 0, _masked(F.col("_text"), kind)).otherwise(F.col("_text")))
    return df.drop("_text")
