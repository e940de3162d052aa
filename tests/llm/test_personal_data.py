"""Personal data against the plain base patterns, and contexts against a plain walk over the same graph."""

import re
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import personal_data
from tallyloom.llm.personal_data import KINDS, find_base, is_card, listed, mentions, plausible, value_of

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(text):
    digits = [int(c) for c in text if c in "0123456789"]
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return 14 <= len(digits) <= 19 and total % 10 == 0


def brute_base(text):
    digits = lambda t: sum(c in "0123456789" for c in t)
    holds = (lambda t: True, lambda t: all(int(p) <= 255 for p in t.split(".")), luhn, lambda t: 10 <= digits(t) <= 15)
    found = [(m.start(), m.end(), k) for k, p in enumerate(PLAIN) for m in re.finditer(p, text or "") if holds[k](m[0])]
    return sorted(found, key=lambda s: (s[0], s[2]))


def brute(docs, least):
    """spans of every text, by turns over a graph in dictionaries."""
    base = [brute_base(t) for t in docs]
    said = [mentions(t or "", b) for t, b in zip(docs, base)]
    values, seeds, may = defaultdict(set), defaultdict(set), defaultdict(int)
    for doc in said:
        for _, _, value, kinds, could, contexts in doc:
            seeds[value] |= {k for k in range(4) if kinds >> k & 1}
            for c in contexts:
                values[c].add(value)
                may[c, value] |= could
    patterns = {c: v for c, v in values.items() if len(v) * 1000 >= round(least * 1000) * (len(v) + 2)}
    scores = {(v, k): 1000 for v, kinds in seeds.items() for k in kinds if any(v in p for p in patterns.values())}
    found, before = {}, None
    while found != before:
        before, known = found, scores | found
        sure = {(c, k): sum(known.get((v, k), 0) for v in vs) // (len(vs) + 2) for c, vs in patterns.items() for k in range(4)}
        found = {}
        for (c, k), score in sure.items():
            for v in patterns[c] if score >= round(least * 1000) else ():
                if may[c, v] >> k & 1 and (v, k) not in scores:
                    found[v, k] = max(score, found.get((v, k), 0))
    best = {}
    for (v, k), score in sorted(found.items()):
        if v not in best or score > best[v][0]:
            best[v] = score, k
    out = []
    for spans, doc in zip(base, said):
        new = [(a, b, best[v][1]) for a, b, v, kinds, _, _ in doc if not kinds and v in best]
        out.append((spans, sorted(spans + new, key=lambda s: (s[0], s[2]))))
    return out


def text_of(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def check(df, docs, least=0.75):
    rows = personal_data.personal_data(df, least=least).select("doc_id", listed("base").alias("base"), listed("spans").alias("spans")).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    expected = [(i, text_of(b), text_of(s)) for (i, _), (b, s) in zip(docs, brute([t for _, t in docs], least))]
    assert sorted((tuple(r) for r in rows), key=key) == sorted(expected, key=key)
    return rows


BASE = [
    "a.b+c@mail.example.com, x@y", "a@b.c@d.e f@@g.h .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.003.0004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (415) 555-2671 +1 +12((((( +123456789012345678", "+4111111111111111", "٣@٤.٥ 1٣.2.3.4", "x" * 3000 + "@" + "y" * 3000, "1" * 5000, "." * 3000 + "@" * 3000, "日本 a@b.jp 🙂 +44 20 7946 0958", "",
]


@pytest.mark.parametrize("text", BASE)
def test_base(text):
    assert find_base(text) == brute_base(text)


@settings(max_examples=400, deadline=None)
@given(st.text("aZ0159.@+-_%() é\n", max_size=60))
def test_base_of_any_text(text):
    assert find_base(text) == brute_base(text)
    mentions(text, find_base(text))


@given(st.text("0123456789 -", max_size=24))
def test_luhn(text):
    assert is_card(text) == luhn(text)


def test_forms():
    assert value_of("(415) 555-2671") == "4155552671" and value_of("Bob@Host") == "bob@host"
    kinds = lambda text: [KINDS[k] for k in range(4) if plausible(text) >> k & 1]
    assert kinds("bob@host") == ["email"] and kinds("(415) 555-2671") == ["phone"] and kinds("300.1.1.1") == ["ip"]
    assert kinds("2024") == [] and kinds("fe80::1ff:fe23") == ["ip"] and kinds("4111 1111 1111 1112") == ["card"]


def test_contexts():
    text = "Please, call me: (415) 555-2671 now. tel:+14155552671; end"
    found = mentions(text, find_base(text))
    assert [(text[a:b], base, contexts) for a, b, _, base, _, contexts in found] == [
        ("(415) 555-2671", 0, ["call me _", "me _ now"]), ("+14155552671", 8, ["now tel _", "tel _ end"])]


def seeded(n=9):
    """Contexts that name a kind, one that does not, identifiers of other forms in each, and a chain of two turns."""
    docs = [(i, f"Reach us: call our desk +1 415 555 {2000 + i} today") for i in range(n)]
    docs += [(100 + i, f"odd number {i}1{i}5550{i} +1 415 666 {3000 + i} appears") for i in range(n)]
    docs += [(200, "Reach us: call our desk 415-777-1234 today"), (201, "fax 415-777-1234 too"), (202, "call our desk 12 today")]
    docs += [(300 + i, f"for help dial up 415-888-10{i:02d} soon; call our desk 415-888-10{i:02d} today") for i in range(20)]
    docs += [(400, "for help dial up 415-999-0000 soon"), (401, "for help walk 415-999-0001 soon")]
    docs += [(1500 + i, f"write to user{i}@mail.example.com please") for i in range(n)] + [(550, "write to root@localhost please"), (551, "write to 415-000-0000 please")]
    return docs


def test_contexts_find_identifiers_of_other_forms(spark):
    docs = seeded(90)
    rows = {r.doc_id: r.spans for r in check(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), docs)}
    assert rows[200] == "phone:24:36" and rows[201] == "phone:4:16" and rows[202] == ""
    assert rows[400] == "phone:17:29" and rows[401] == "" and rows[550] == "email:9:23" and rows[551] == ""


@pytest.mark.parametrize("least", [0.3, 0.5, 0.75, 0.9])
def test_any_bar(spark, least):
    docs = seeded(9)
    check(spark.createDataFrame(docs, "doc_id long, text string"), docs, least)


def test_odd_documents(odd, spark):
    check(odd, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_odd_rows(spark):
    docs = [(None, "call our desk 5551234 today"), (7, None), (7, BASE[0]), (7, BASE[0]), (None, " ".join(BASE))] + seeded(90)
    check(spark.createDataFrame(docs, "doc_id long, text string").withColumn("_base", F.lit(1)).withColumn("spans", F.lit("x")), docs)


def test_empty_table(empty):
    assert personal_data.personal_data(empty).collect() == [] and personal_data.patterns(empty).collect() == []


def test_patterns(spark):
    rows = personal_data.patterns(spark.createDataFrame(seeded(90), "doc_id long, text string")).collect()
    sure = {r.pattern: (r.kind, r.confidence) for r in rows}
    assert sure["our desk _"][0] == "phone" and sure["write to _"][0] == "email" and "odd number _" not in sure
    assert all(c >= 0.75 for _, c in sure.values())
