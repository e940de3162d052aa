"""Lexical search against scores of every document, and its parts against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tallyloom.llm import lexical_search
from tallyloom.llm.lexical_search import Lists, TERM, best, impact, pack, postings, unpack

ITEMS = [
    (1, "fox fox dog wizards"), (2, "pass5age pass5age the naïve 日本語"), (3, ""), (4, None), (5, "nowhere known"), (None, "elsewhere word"), (None, "word"),
    (6, "a THE İstanbul istanbul Σας ΣΑΣ"), (6, "x" * 30_000 + " abababab"), (7, " ".join(f"pass{i}age" for i in range(120)) + " the"),
]


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(TERM, lower)


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    documents = sum(bool(c) for _, c in counts)
    total = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for place, (doc, c) in enumerate(counts):
            m = 25 + 75 * c.total() * documents // total if total else 0
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, place))
        out += [(item, rank + 1, None if s[1] else s[2], -s[0]) for rank, s in enumerate(sorted(scores)[:k])]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("k", [1, 3, 10])
@pytest.mark.parametrize("small", [False, True])
def test_odd_documents(odd, items, monkeypatch, k, small):
    if small:  # several shards a task, several blocks a list, several windows a shard, a long text in pieces
        for name, value in {"SHARD_DOCS": 4, "BLOCK": 2, "WINDOW": 2, "PIECE": 1 << 10, "HELD": 2, "ITEMS": 3}.items():
            monkeypatch.setattr(lexical_search, name, value)
    found = lexical_search.search(odd, items, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert ordered(found.collect()) == ordered(brute(docs, ITEMS, k))


def test_empty_tables(spark, odd, empty, items):
    assert lexical_search.search(empty, items).collect() == []
    assert lexical_search.search(odd, items.where("false")).collect() == []


def test_ids_of_another_type(spark, items):
    docs = spark.createDataFrame([("b", "fox"), ("a", "fox"), (None, "fox"), ("c", "dog dog")], "doc_id string, text string")
    rows = lexical_search.search(docs, items.where("item_id = 1"), 2).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, "c"), (2, "a")]


def test_more_ties_than_ranks(spark, items):
    docs = spark.createDataFrame([(i, "fox and dog") for i in range(400, 0, -1)], "doc_id long, text string").repartition(7)
    rows = lexical_search.search(docs, items.where("item_id = 1"), 10).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in rows) == [(i, i) for i in range(1, 11)]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_packing_is_undone(values):
    octets, ends = pack(np.array(values, np.int64))
    assert (unpack(octets).tolist() if values else []) == values
    assert len(octets) == (ends[-1] if values else 0)


def shard(counts, lengths, block):
    rows = sorted((t, d, n) for (t, d), n in counts.items())
    columns = [np.array(x, np.int64) for x in zip(*rows)]
    present = sorted({t for t, _, _ in rows})
    columns[0] = np.searchsorted(present, columns[0])
    lists = postings(*columns, lengths)
    names = [n for n, _ in lexical_search._LISTS]
    lists |= {"_term": pa.array([b"%d" % t for t in present], pa.binary()), "_total": pa.nulls(len(present), pa.int64())}
    return pa.RecordBatch.from_arrays([lists[n] for n in names], names)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_best_of_a_shard_with_any_blocks_and_windows(data):
    documents = data.draw(st.integers(1, 60))
    counts = data.draw(st.dictionaries(st.tuples(st.integers(0, 6), st.integers(0, documents - 1)), st.integers(1, 9), min_size=1, max_size=150))
    lengths = np.zeros(documents, np.int64)
    for (_, d), n in counts.items():
        lengths[d] += n
    block, window = lexical_search.BLOCK, lexical_search.WINDOW
    lexical_search.BLOCK, lexical_search.WINDOW = data.draw(st.integers(1, 5)), data.draw(st.integers(1, 20))
    try:
        part = shard(counts, lengths, lexical_search.BLOCK)
        lists = Lists(pa.array(range(documents)), lengths, [part], documents, int(lengths.sum()))
        weights = data.draw(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 50)), unique_by=lambda x: x[0]))
        k, floor = data.draw(st.integers(1, 8)), data.draw(st.integers(0, 2 * 10**7))
        scores = np.zeros(documents, np.int64)
        for (t, d), n in counts.items():
            scores[d] += dict(weights).get(t, 0) * impact(np.array([n]), lists.m[d:d + 1])[0]
        expected = sorted((-int(s), d) for d, s in enumerate(scores) if s >= max(floor, 1))[:k]
        found = best(lists, [(b"%d" % t, w) for t, w in weights], k, floor)
        assert [(-s, p) for s, p in zip(*(x.tolist() for x in found))] == expected
    finally:
        lexical_search.BLOCK, lexical_search.WINDOW = block, window


def test_blocks_that_cannot_matter_stay_packed():
    """One rare term decides; of the common one only the blocks around its documents are opened."""
    documents = 4000
    counts = {(0, d): 1 for d in range(documents)} | {(1, d): 50 for d in (10, 2000)}
    lengths = np.full(documents, 60, np.int64)
    lists = Lists(pa.array(range(documents)), lengths, [shard(counts, lengths, lexical_search.BLOCK)], documents, int(lengths.sum()))
    scores, places = best(lists, [(b"0", 1), (b"1", 7000)], 2, floor=10**9)
    assert sorted(places.tolist()) == [10, 2000] and len(scores) == 2
    assert lists.opened == 1 + 2


def test_a_block_keeps_its_largest_impact_at_any_average():
    rng = np.random.default_rng(5)
    counts = {(0, d): int(rng.integers(1, 30)) for d in range(500)}
    lengths = rng.integers(30, 3000, 500)
    part = shard(counts, lengths, lexical_search.BLOCK)
    for total in (1, 500, 10**5, 10**8):
        lists = Lists(pa.array(range(500)), lengths, [part], 500, total)
        for b in range(4):
            assert lists.most[b] == lists.block(0, b)[1].max()
