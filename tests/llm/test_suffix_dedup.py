import hashlib
import random

import numpy as np
import pytest

from odd_documents import LONG_TEXT, ODD, stored_again
from tallyloom.llm import blocks, suffix_dedup as sd


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = {}
    for _, t in texts:
        for at in range(len(t) - length + 1):
            key = hash(t[at:at + length])
            times[key] = times.get(key, 0) + 1
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for at in range(len(t) - length + 1):
            if times[hash(t[at:at + length])] > 1:
                gone[at] += 1
                gone[at + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone.tolist()) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in sd.repeated_bytes(df, **options).collect()), key=str)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_odd_documents(spark, odd, tmp_path, hot):
    rows = [(i, t) for i, t in ODD if t != LONG_TEXT]
    df = stored_again(spark, tmp_path, odd.where(f"text is null or length(text) <> {len(LONG_TEXT)}"))
    assert found(df, hot=hot) == brute(rows, 400)


@pytest.mark.parametrize("hot", [20_000, 1])
@pytest.mark.parametrize("block", [3, 1 << 14])
def test_random_documents(spark, tmp_path, monkeypatch, block, hot):
    random.seed(block + hot)
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(sd, "CHUNK", 700)
    monkeypatch.setattr(sd, "BATCH", 900)
    pieces = ["".join(random.choices("abé", k=random.randint(30, 260))) for _ in range(5)] + ["a" * 300, "ab" * 150, "\x00\x01" * 80]
    rows = [(k, "".join(random.choices([*pieces, "q", "rs"], k=random.randint(0, 7)))) for k in range(60)]
    df = stored_again(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string"))
    assert found(df, length=100, hot=hot) == brute(rows, 100)


def test_two_stage_order_is_the_order_of_the_suffixes():
    random.seed(9)
    for _ in range(60):
        strings = [bytes(random.choices(random.choice([b"ab", b"abc", b"a", bytes(range(256))]), k=random.randint(1, 40))) for _ in range(random.randint(1, 8))]
        data, ends = b"".join(strings), np.cumsum([len(s) for s in strings])
        first = ends - [len(s) for s in strings]
        count = np.array([random.randint(1, len(s)) for s in strings])
        order = sd.two_stage_order(data, ends, first, count, 1000).tolist()
        end_of = {a: e for f, n, e in zip(first.tolist(), count.tolist(), ends.tolist()) for a in range(f, f + n)}
        assert sorted(order) == sorted(end_of)
        suffixes = [data[a:end_of[a]] for a in order]
        assert suffixes == sorted(suffixes)


def test_kept_bytes_and_spans(spark, tmp_path):
    df = stored_again(spark, tmp_path, spark.createDataFrame([(1, "one" + "x" * 150 + "two"), (2, "y" * 10 + "x" * 120), (3, None)], "doc_id long, text string"))
    rows = {r["doc_id"]: (bytes(r["kept"]), r["spans"]) for r in sd.without_repeated_bytes(df, length=100).collect()}
    assert rows == {1: (b"onetwo", [3, 153]), 2: (b"y" * 10, [10, 130]), 3: (b"", [])}


def test_empty_and_wrong_length(empty):
    assert sd.repeated_bytes(empty).count() == 0
    with pytest.raises(ValueError):
        sd.repeated_bytes(empty, length=10)
