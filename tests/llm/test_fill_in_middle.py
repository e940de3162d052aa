"""Fill-in-the-middle against slices of Python strings."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import fill_in_middle
from tallyloom.llm.fill_in_middle import cut, restored


def brute(doc_id, text, seed="1", plain=10, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return len(text), "plain", None, None, text
    parts = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return len(text), "spm", a, b - a, f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return len(text), "psm", a, b - a, f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def check(df, before, **options):
    found = fill_in_middle.fill_in_middle(df, **options)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = found.select("*", restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    mine = sorted((tuple(r) for r in rows), key=key)
    assert mine == sorted(((i, *brute(i, t), t or "") for i, t in before), key=key)


def test_odd_documents(odd):
    check(odd, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_empty_table(empty):
    assert fill_in_middle.fill_in_middle(empty).collect() == []


def test_marks_and_brackets_in_texts(spark):
    texts = ["<P>", "a<S>b", "<M", "<<P", "<P<S<M", "S>P>M>", "<", ">", "< P>", "<p>", "﻿é<\x00>"] * 12
    rows = list(enumerate(texts))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    forms = {brute(*r)[1] for r in rows}
    assert forms == {"plain", "psm", "spm"}


def test_a_text_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "CHUNK", 64)
    texts = ["é" * 100, "", "x", "日本語" * 50, "🙂" * 16, "ab" * 32, "c" * 63]
    numbers = np.arange(len(texts)) * 7 + 3, np.arange(len(texts)) * 31 + 5
    found = cut(pa.array(texts), *numbers)
    for i, text in enumerate(texts):
        a, b = sorted(int(n[i]) % (len(text) + 1) for n in numbers)
        assert [int(found[k][i]) for k in found] == [len(text), a, b, len(text[:a].encode()), len(text[:b].encode())]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=12), st.booleans())
def test_cuts_of_any_texts(rows, wide):
    texts, first, second = zip(*rows) if rows else ((), (), ())
    column = pa.array(texts, pa.large_string() if wide else pa.string())
    found = cut(column, np.array(first, np.int64), np.array(second, np.int64))
    for i, (text, a, b) in enumerate(rows):
        a, b = sorted((a % (len(text) + 1), b % (len(text) + 1)))
        assert [int(found[k][i]) for k in found] == [len(text), a, b, len(text[:a].encode()), len(text[:b].encode())]


def test_a_slice_of_a_column():
    column = pa.array(["before", "née", "日本"])[1:]
    assert cut(column, np.array([1, 1]), np.array([2, 2]))["upto_bytes"].tolist() == [3, 6]


@pytest.mark.parametrize("options", [{"seed": "7"}, {"plain_percent": 0, "suffix_first_percent": 100}])
def test_options(spark, options):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    rows = fill_in_middle.fill_in_middle(df, **options).collect()
    kw = {"seed": options.get("seed", "1"), "plain": options.get("plain_percent", 10), "spm": options.get("suffix_first_percent", 20)}
    assert [tuple(r) for r in rows] == [(i, *brute(i, f"text {i}", **kw)) for i in range(30)]
