import collections
import re

import pytest
from pyspark.sql import functions as F

from odd_documents import ODD, PROSE, unchanged
from tallyloom.llm import quality_rules as rules


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    times, repeated = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            repeated |= {i, i + 1, i + 2}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated),
            n < 50 or 100 * len(repeated) > 50 * n)


def test_counts_equal_brute_force(odd):
    rows = rules.cascade(odd).select("_doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted((tuple(r) for r in rows), key=str) == sorted(((i, *brute(t)) for i, t in ODD), key=str)


GOOD = " ".join(f"{a} {b}" for a in "river stone window garden yellow morning quiet".split() for b in "walks beside early under within across around".split())


@pytest.mark.parametrize("text, rule", [
    (GOOD, None), (GOOD.replace(" ", "%%% "), "symbols"), (GOOD.upper(), "capitals"), (GOOD.replace(" ", "!! "), "exclamations"),
    (" ".join(f"{i}{j}" for i in range(10) for j in range(10, 20)), "letters"), (" ".join("q" * (40 + i) for i in range(60)), "word_length"),
    (GOOD + "".join(f"\nmenu{i % 3}" for i in range(60)), "duplicate_lines"), ("few words", "base"), ("a b c " * 60, "base"), (None, "base"),
])
def test_each_rule_rejects_its_kind(spark, text, rule):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = rules.cascade(df).head()
    assert row["failed_rule"] == rule and row["kept"] == (rule is None)


def test_the_order_changes_no_verdict_and_puts_cheap_rejections_first(spark, monkeypatch):
    df = spark.createDataFrame([(i, (GOOD, GOOD.upper(), GOOD.replace(" ", "# "))[i % 3]) for i in range(30)], "doc_id long, text string")
    made = [rules.Rule("never", F.lit(False)), *rules.default_rules()]
    chosen = rules.ordered(df, made)
    assert chosen[-1][2] == 0.0 and {r.name for r, _, _ in chosen} == {r.name for r in made}
    worth = [x[2] / max(x[1], 1.0) for x in chosen]
    assert worth == sorted(worth, reverse=True)
    cost = {r.name: c for r, c, _ in chosen}
    assert cost["symbols"] == 1.0 and cost["capitals"] == 2 * cost["letters"] > cost["symbols"]
    assert all([r.name for r, _, _ in rules.ordered(df, made)] == [r.name for r, _, _ in chosen] for _ in range(3))
    verdicts = []
    for order in (made, made[::-1]):
        monkeypatch.setattr(rules, "ordered", lambda *a, order=order: [(r, 0.0, 0.0) for r in order])
        verdicts.append(sorted((r["_doc"]["doc_id"], r["kept"]) for r in rules.cascade(df, made).collect()))
    assert verdicts[0] == verdicts[1] and sum(k for _, k in verdicts[0]) == 10


def test_dropping_keeps_rows_whole(odd):
    left = rules.keep_good(odd)
    assert unchanged(left, odd) and {r["doc_id"] for r in left.collect()} <= {i for i, t in ODD if not brute(t)[-1]}


def test_only_dataframe_functions(odd):
    plan = rules.cascade(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_empty(empty):
    assert rules.cascade(empty).count() == 0
