import random

import numpy as np
import pytest
import xxhash

from odd_documents import ODD, unchanged
from tallyloom.llm import simhash
from tallyloom.llm.components import components


def plain(text):
    """Bit by bit, as the definition says."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, ids, bits=4):
    label = list(range(len(ids)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(least.get(top(i), x), x)
    return [least.get(top(i)) for i in range(len(ids))]


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 300)
    for _, text in ODD:
        if text is None or len(text) < 100_000 or " " not in text:
            assert simhash.fingerprint(text) == plain(text)


def test_spark_hashes_alike(spark):
    assert spark.sql("SELECT xxhash64('ab cd')").head()[0] == np.array([xxhash.xxh64_intdigest(b"ab cd", 42)], np.uint64).view(np.int64)[0]


def test_classes_equal_brute_force(odd):
    rows = simhash.near_duplicates(odd).collect()
    prints = [r["_print"] & (1 << 64) - 1 for r in rows]
    ids = [r["doc_id"] for r in rows]
    assert [r["component_id"] for r in rows] == classes(prints, ids)
    assert sorted(ids, key=str) == sorted((i for i, _ in ODD), key=str)


def test_dense_and_chained_fingerprints(spark, monkeypatch):
    """Prints within a few bits of one another, chains of exactly four bits, signs and random ones."""
    random.seed(4)
    base = 0xF0F0_1234_8000_0001
    prints = {base, base ^ 0xF, base ^ 0xFF, base ^ 0xFFF, base ^ 0xFFFF, 0, (1 << 64) - 1, base ^ (0x3 << 30) ^ (0x3 << 33)}
    while len(prints) < 400:
        prints.add(base ^ sum(1 << b for b in random.sample(range(20, 44), random.randint(1, 6))) if len(prints) < 250 else random.getrandbits(64))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([((0, i), i, p) for i, p in enumerate(signed)], "_row struct<file:long,at:long>, _id long, _print long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: table)
    for bits in (0, 2, 4, 5):
        rows = simhash.near_duplicates(None, bits=bits).orderBy("doc_id").collect()
        assert [r["component_id"] for r in rows] == classes(prints, list(range(len(prints))), bits)
    with pytest.raises(ValueError):
        simhash.near_duplicates(None, bits=6)


def test_a_bucket_across_batches():
    import pyarrow as pa

    keys, prints = np.array([1, 1, 1, 2, 2, 2]), np.array([0, 1, -1, 8, 9, 11])
    batches = [pa.RecordBatch.from_pydict({"_bucket": keys[a:b], "_print": prints[a:b]}) for a, b in ((0, 0), (0, 2), (2, 4), (4, 6))]
    links = {(r["a"], r["b"]) for batch in simhash._link(4)(iter(batches)) for r in batch.to_pylist()}
    assert links == {(0, 1), (8, 9), (8, 11)}


def test_components(spark):
    random.seed(1)
    links = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 700)] + [(800, 800), (900, 901), (901, 900)]
    links += [(random.randrange(1000, 1300), random.randrange(1000, 1300)) for _ in range(250)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    label = {x: x for l in links for x in l}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    assert found == {x: top(x) for l in links for x in l if l[0] != l[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dropping_keeps_one_a_class(odd):
    left = simhash.drop_near_duplicates(odd)
    found = simhash.near_duplicates(odd).collect()
    keys = {(r["component_id"], r["_print"] if r["component_id"] is None else 0) for r in found}
    assert unchanged(left, odd) and left.count() == len(keys)


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).columns == empty.columns


def jaccard(a, b):
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Texts with 0 to 5 words of 200 changed, chains of such changes, and a line that all of them share."""
    random.seed(9)
    texts = []
    for family in range(12):
        base = [f"w{random.randrange(5000)}" for _ in range(200)]
        for copy in range(10):
            words = list(base)
            for at in random.sample(range(200), (copy + family % 3) // 2):
                words[at] = f"x{random.randrange(5000)}"
            texts.append(" ".join(["all", "of", "these", "share", "one", "line", "here", *words]))
            if family % 4 == 0:
                base = words
    random.shuffle(texts)
    path = str(tmp_path_factory.mktemp("planted") / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path), texts


def test_the_near_stage_finds_what_is_similar(spark, planted):
    """Against all pairs: texts of Jaccard 0.8 and more are joined, others are not."""
    import corpus_pipeline

    docs, texts = planted
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert len(links) > 100
    assert len(set(label)) > 20
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()} == dict(enumerate(label))
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()} == set(label)


def brute_alike(sets, least):
    label = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j] and len(sets[i] & sets[j]) * 1000 >= round(least * 1000) * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("least", [0.3, 0.6, 0.8, 1.0])
def test_alike_joins_what_all_pairs_join(least):
    random.seed(2)
    for _ in range(60):
        base = [set(random.sample(range(60), random.randint(0, 25))) for _ in range(4)]
        sets = [set(x for x in random.choice(base) if random.random() < 0.9) | set(random.sample(range(60), random.randint(0, 2))) for _ in range(random.randint(1, 40))]
        arrays = [np.array(sorted(x), np.uint64) for x in sets]
        links = simhash.alike(arrays, np.arange(len(sets)), least)
        label = list(range(len(sets)))
        for _ in sets:
            for i, j in links:
                label[i] = label[j] = min(label[i], label[j])
        assert label == brute_alike(sets, least) and len(links) == len(sets) - len(set(label))


def test_alike_goes_on_from_classes():
    arrays = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [9], [1, 2, 3, 5], [9, 8], [1, 2, 3, 4, 6])]
    assert simhash.alike(arrays, np.array([0, 0, 7, 7, 8]), 0.8) == [(0, 4)]
    assert simhash.alike(arrays, np.array([0, 1, 0, 1, 0]), 0.5) == [] and len(simhash.alike(arrays, np.array([0, 1, 2, 1, 4]), 0.5)) == 2


def family_of(size, seed, changes=4, words=200):
    """A text and copies with some words changed; copies are less like one another than like the text."""
    random.seed(seed)
    base = [f"w{random.randrange(5000)}" for _ in range(words)]
    texts = [" ".join(base)]
    for _ in range(size):
        copy = list(base)
        for at in random.sample(range(words), changes):
            copy[at] = f"x{random.randrange(10 ** 6)}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("kept", [True, False])
def test_a_large_family(spark, tmp_path, monkeypatch, parts, kept):
    """300 copies of one text, with the text or without it, in one task or in several."""
    texts = family_of(300, 4)[0 if kept else 1:] + family_of(3, 5, 1)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    monkeypatch.setattr(simhash, "FAMILY", -(-len(texts) // parts))
    monkeypatch.setattr(simhash, "CENTERS", 3)
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.read.parquet(path)).collect()}
    assert found == dict(enumerate(brute_alike(sets, 0.8)))


def test_similar_on_odd_texts(odd, empty):
    rows = simhash.similar(odd).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, _ in ODD), key=str)
    assert unchanged(simhash.drop_similar(odd), odd) and simhash.drop_similar(empty).count() == 0


def test_one_hashing_gives_set_and_print():
    for _, text in ODD:
        if text is None or len(text) < 100_000 or " " not in text:
            found, print_ = simhash._set_and_print(text, 4, 42)
            assert print_ == plain(text) and np.array_equal(found, simhash.shingle_set(text, 4))


def test_simhash_finds_candidates_that_share_no_band(spark, tmp_path):
    """Two texts that repeat one phrase have near prints, whatever a few words at their ends; a third has no such print."""
    for n in range(1000):
        texts = [" ".join(["one two three four five six seven"] * 200 + [f"{end}{n}x{i}" for i in range(2)]) for end in "ab"]
        sets = [simhash.shingle_set(t) for t in texts]
        if not np.intersect1d(simhash.bands(sets[0]), simhash.bands(sets[1])).size:
            break
    assert 0.3 <= len(np.intersect1d(*sets)) / len(np.union1d(*sets)) and bin(simhash.fingerprint(texts[0], 5) ^ simhash.fingerprint(texts[1], 5)).count("1") <= 4
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate([*texts, "quite another text of some words", None])), "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, least=0.3).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert simhash.drop_similar(docs, least=0.8).count() == 4  # a near print alone does not remove a text


def test_simhash_meetings(spark):
    rows = [(9, 0b0), (4, 0b1111), (5, 0b1111), (7, 0b11111 << 40), (8, 0b1 << 40)]
    met = simhash._simhash_meetings(spark.createDataFrame(rows, "_print long, _simhash long"), 4)
    roots = {r["node"]: r["root"] for r in components(met.where("_print <> _lead").selectExpr("_lead as a", "_print as b")).collect()}
    assert len({roots[x] for x, _ in rows}) == 1
    met = simhash._simhash_meetings(spark.createDataFrame(rows[:4], "_print long, _simhash long"), 4)
    assert {r["_print"] for r in met.collect()} == {9, 4, 5}
