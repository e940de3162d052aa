import hashlib

import pytest
from pyspark.sql import functions as F

from odd_documents import ODD, unchanged
from tallyloom.llm import common, exact_dedup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(keep):
    groups = {}
    for i, t in ODD:
        groups.setdefault(lowered(t), []).append(i)
    order = (lambda i: (i is None, i or 0)) if keep == "smallest" else (lambda i: (i is None, -(i or 0)))
    out = []
    for text, ids in groups.items():
        first = sorted(ids, key=order)[0]
        out += [(i, first, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_groups_equal_brute_force(odd, monkeypatch, keep, weak):
    monkeypatch.setattr(exact_dedup, "BROADCAST", 0 if weak else 200_000)
    # A hash of the length alone: texts of equal length collide and are told apart by their bytes.
    options = {"content_hash": lambda t: F.length(t) % 3} if weak else {}
    rows = exact_dedup.exact_duplicates(odd, keep=keep, **options).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str) == expected(keep)
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert len(kept) == len(set(kept)) == len({lowered(t) for _, t in ODD})
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_dropping_keeps_rows_whole(odd):
    left = exact_dedup.drop_exact_duplicates(odd, keep="largest")
    assert unchanged(left, odd) and left.count() == len({lowered(t) for _, t in ODD})


def test_an_input_that_is_no_stored_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string").repartition(2)
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(df).collect()) == [1, 3]


def test_empty(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).columns == empty.columns


def test_salted_join_spreads_one_key(spark):
    rows = spark.range(2000).select(F.struct(F.lit(1).alias("file"), F.col("id").alias("at")).alias("_row"), F.lit("hot").alias("k"))
    groups = spark.createDataFrame([("hot", 5)], "k string, v int")
    joined = common.salted_join(rows, groups, "k", "inner")
    assert joined.count() == 2000 and "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
