"""Documents and helpers that the tests share."""

import hashlib

PASSAGE = " ".join(f"pass{i}age" for i in range(120))
LONG_WORD = "x" * 30_000
LONG_TEXT = " ".join(hashlib.md5(str(i).encode()).hexdigest()[: 3 + i % 7] for i in range(12_000))
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards box with dozens of liquor jugs. " * 3

#: id, text: nulls, empty and very long texts, ties, repeated rows, copies, shared passages, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (None, "a text without id " + PASSAGE), (None, None), (None, "a text without id " + PASSAGE),
    (5, LONG_WORD), (6, LONG_TEXT), (7, LONG_TEXT), (7, LONG_TEXT), (8, PROSE), (9, PROSE.upper()), (10, "before it " + PASSAGE + " and after"),
    (11, "elsewhere " + PASSAGE + " again"), (12, "word"), (13, "two words"), (14, "Word"), (15, "é́   naïve 日本語 İstanbul ΣΑΣ 🙂‍↔️ \u0001 '´ don't 12ab"),
    (16, "a a a a a a a a " * 30), (17, PROSE + " one more word"), (18, "tail\n\n\nline\nline\n\n"), (19, "|" * 500), (20, "　wide　space"),
    (21, "ab" * 700), (22, "ab" * 700 + "c"),
]
#: Columns that carry names the operators use inside.
CLASHES = ["_row", "_id", "_text", "_file", "_block", "hash", "n", "kept", "n_words", "_words", "ids", "_key", "score", "_DOC", "_metadata2"]


def stored_again(spark, tmp_path, df, files: int = 4):
    path = str(tmp_path / "stored.parquet")
    df.repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def unchanged(df, before):
    """Rows kept as they were: every row of ``df`` is one of ``before``, in all columns."""
    assert df.columns == before.columns
    there = [tuple(r) for r in before.collect()]
    for row in (tuple(r) for r in df.collect()):
        there.remove(row)
    return True
