import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from odd_documents import ODD
from tallyloom.llm import byte_bpe as bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(FILE)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_documents_round_trip(odd, reference):
    rows = bpe.round_trip(odd, FILE, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in ODD:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in rows), key=str) == sorted(want, key=str)


def test_encode_then_decode(odd):
    tokens = bpe.encoded(odd, FILE, public_tokenizers.PATTERN)
    texts = bpe.decoded(tokens, FILE).collect()
    assert sorted(((r["doc_id"], bytes(r["bytes"])) for r in texts), key=str) == sorted(((i, (t or "").encode()) for i, t in ODD), key=str)


def test_the_ascii_form_splits_alike():
    import regex

    plain, full = bpe.ascii_form(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    random.seed(5)
    for _ in range(3000):
        text = "".join(random.choices(" \t\n\r\x0b\x0c\x1c\x1f\x00aZ09'st_-.ll'", k=random.randint(0, 25)))
        assert plain.findall(text) == full.findall(text)
    assert bpe.ascii_form(r"\p{Lu}+") is None and bpe.ascii_form(r"[\p{L}\s]+|\p{N}").pattern == r"[A-Za-z\s]+|[0-9]"


def test_long_words_merge_like_short_ones(reference):
    ranks = bpe.read_ranks(FILE)
    random.seed(2)
    for _ in range(200):
        word = "".join(random.choices("aeiounrst", k=random.randint(1, 60)))
        if word.encode() not in ranks:
            assert bpe.merge_long(word.encode(), ranks) == reference._encode_single_piece(word)


def test_the_fold_equals_the_merges(spark):
    ranks = bpe.read_ranks(FILE)
    table = bpe.rank_map(bpe.pair_ranks(ranks))
    random.seed(3)
    words = [bytes(random.choices(b"aeiounrst \xc3\xa9\xff", k=random.randint(0, 14))) for _ in range(150)]
    single = [ranks[bytes([b])] for b in range(256)]
    df = spark.createDataFrame([([[single[b] for b in w] for w in words],)], "w array<array<int>>")
    literal = spark.createDataFrame([([int(x) for x in table],)], "ranks array<long>")
    folded = df.withColumn("ranks", literal.scalar()).select(bpe.fold("w", "ranks", len(table)).alias("f")).head()["f"]
    assert folded == [bpe.merge_long(w, ranks) for w in words]


def test_every_pair_is_found_in_the_map():
    pairs = bpe.pair_ranks(bpe.read_ranks(FILE))
    table = bpe.rank_map(pairs)
    for key in list(pairs)[::97]:
        assert any(table[at] == key << 16 | pairs[key] for at in bpe._places(key, len(table)))
    assert (table >= 0).sum() == len(pairs)


def test_documents_are_not_shuffled_and_the_map_is_no_column_of_the_fold(odd, empty):
    found = bpe.encoded(odd, FILE, public_tokenizers.PATTERN)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert bpe.round_trip(empty, FILE, public_tokenizers.PATTERN).count() == 0


def test_a_word_that_is_merged_takes_no_more_steps(spark):
    """Ranks are looked up for the merges and once more, not for every byte of the word."""
    steps = bpe.fold("w", "ranks", 16)._jc.toString()
    assert "-1" in steps and "slice" in steps
    df = spark.createDataFrame([([[5, 6, 7, 8], [9], [], [5, 5]],)], "w array<array<int>>")
    literal = spark.createDataFrame([([int(x) for x in bpe.rank_map({5 << 16 | 6: 300, 300 << 16 | 7: 301})],)], "ranks array<long>")
    size = len(bpe.rank_map({5 << 16 | 6: 300, 300 << 16 | 7: 301}))
    assert df.withColumn("ranks", literal.scalar()).select(bpe.fold("w", "ranks", size).alias("f")).head()["f"] == [[301, 8], [9], [], [5, 5]]


def test_a_merge_looks_up_the_ranks_beside_it_alone(spark):
    """Ranks of all neighbours are found once, then two a merge; the place of a pair is not searched."""
    pairs = {5 << 16 | 6: 300, 7 << 16 | 8: 300, 300 << 16 | 300: 400, 8 << 16 | 300: 250, 9 << 16 | 9: 500, 500 << 16 | 500: 200, 500 << 16 | 9: 100}
    words = [[7, 8, 5, 6], [5, 6, 7, 8], [7, 7, 8, 5, 6, 9], [9] * 7, [9] * 256, [5, 6] * 40, [1, 2], [8, 5, 6], [1, 5, 6], [65535, 9, 9]]

    def merged(word):
        word = list(word)
        while found := [(r, i) for i, p in enumerate(zip(word, word[1:])) if (r := pairs.get(p[0] << 16 | p[1])) is not None]:
            rank, i = min(found)
            word[i:i + 2] = [rank]
        return word

    table = bpe.rank_map(pairs)
    folded = bpe.fold("w", "ranks", len(table))
    assert "array_position" not in folded._jc.toString() and "zip_with" not in folded._jc.toString()
    literal = spark.createDataFrame([([int(x) for x in table],)], "ranks array<long>")
    df = spark.createDataFrame([(words,)], "w array<array<int>>").withColumn("ranks", literal.scalar())
    assert df.select(folded.alias("f")).head()["f"] == [merged(w) for w in words]


def test_the_wide_form_splits_alike(monkeypatch):
    import regex

    full = regex.compile(public_tokenizers.PATTERN)
    random.seed(8)
    some = " \t\n\r\x0b\x0c\x1c\x1f\x00\x85\xa0\u2003\u2028\u3000aZ09'st_-.llé ñßµªº²½Ⅷ٣一日語Σİ\u0301\u200d\ufeffʰ‘—…\uffff"
    texts = ["".join(random.choice(some) for _ in range(random.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000), "🙂 𝒳𝟙 𐐀 a" + some]
    assert [bpe.wide_form(public_tokenizers.PATTERN).findall(t) for t in texts[:-1]] == [full.findall(t) for t in texts[:-1]]
    assert [bpe.splitter(public_tokenizers.PATTERN)(t) for t in texts] == [full.findall(t) for t in texts]
    assert all(bpe.wide_form(p) is None for p in (r"\p{Lu}+", r"(?i:'s)|\p{L}+", r"\w+", r"[\S]+"))
