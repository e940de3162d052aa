import hashlib
import random

import pytest
from pyspark.sql import functions as F

from odd_documents import ODD, stored_again, unchanged
from tallyloom.llm import blocks, substring_dedup as sd


def brute(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    rank = lambda i: sd.NO_ID if i is None else i
    for i, words in texts:
        for at in range(len(words) - window + 1):
            key = tuple(words[at:at + window])
            least[key] = min(least.get(key, rank(i)), rank(i))
    out = []
    for i, words in texts:
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if least[tuple(words[at:at + window])] < rank(i):
                gone[at:at + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in sd.repeated_words(df, **options).collect()), key=str)


@pytest.mark.parametrize("window", [13, 2, 5])
def test_odd_documents(odd, window):
    assert found(odd, window=window) == brute(ODD, window)


@pytest.mark.parametrize("block", [1, 7, 1 << 14])
def test_random_documents_over_many_blocks_and_steps(spark, tmp_path, monkeypatch, block):
    random.seed(block)
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(sd, "STEP_WORDS", 50)
    passages = [" ".join(random.choices("abcdefg", k=random.randint(5, 40))) for _ in range(6)]
    rows = [(random.choice([None, *range(40)]), "  ".join(random.choices(passages + ["x y", "z"], k=random.randint(0, 5)))) for _ in range(80)]
    df = stored_again(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string"))
    assert found(df) == brute(rows, 13)


def test_words_are_taken_out_and_the_rest_stays(odd):
    left = sd.drop_repeated_words(odd)
    assert left.columns == odd.columns and left.count() == len(ODD)
    assert unchanged(left.drop("text"), odd.drop("text"))
    texts = {r["doc_id"]: r["text"] for r in left.collect() if r["doc_id"] is not None}
    assert texts[10] == dict(ODD)[10] and texts[11] == "elsewhere again" and texts[7] == "" and texts[1] is None
    assert texts[18] == "tail\n\n\nline\nline\n\n"


def test_empty(empty):
    assert sd.repeated_words(empty).count() == 0 and sd.drop_repeated_words(empty).columns == empty.columns
    with pytest.raises(ValueError):
        sd.repeated_words(empty, window=1)


def test_documents_are_not_shuffled(odd):
    plan = sd.repeated_words(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_words_are_hashed_without_a_table_of_them():
    words = [b"a", b"b", "été".encode(), b"a", b"x" * 500]
    whole = [sd.xxhash.xxh3_128_intdigest(w) for w in words]
    low, high = sd._hashes(words)
    assert low.tolist() == [x & (1 << 64) - 1 for x in whole] and high.tolist() == [x >> 64 for x in whole]
    assert [len(x) for x in sd._hashes([])] == [0, 0] and not hasattr(sd, "_Words")
