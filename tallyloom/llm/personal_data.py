"""Personal data: base patterns as seeds, and contexts learnt from them that find identifiers of other forms."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scratch import materialize
from .blocks import tidy
from .common import numbered, salted_join, stored

# The kinds in their order, and the base patterns. The digits of a card and a phone are counted, parts of an ip bounded.
KINDS = ("email", "ip", "card", "phone")
# Written so that no text costs more than time in proportion; each finds what its plain form in ``find_base`` does.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidates: words with a digit or an at sign, and numbers written in several words.
SIGN = re.compile(r"[0-9@]")
WORD = re.compile(r"\S+")
NUMBER = re.compile(r"[+(]*[0-9][0-9().+-]*")
EDGE = ".,;:!?\"'`<>[]{}()*_|/\\=#$%&"
_BEFORE, _AFTER = EDGE.replace("(", ""), EDGE.replace(")", "")
#: A thousandth is the unit of scores. A pattern with n values, of which all are surely of a kind, is sure to n / (n + DOUBT).
SURE, DOUBT = 1000, 2


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base spans, leftmost and not overlapping within a kind, by start and then kind.

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of at most 255;
    card ``[0-9]([\\x20-]?[0-9])+`` of 14 to 19 digits that pass Luhn; phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` of 10 to 15 digits.
    A match that fails its condition is dropped, and the search goes on behind it.
    """
    if not SIGN.search(text):
        return []
    found = [(a, b, 0) for a, b in _emails(text)]
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(_at_most_255(p) for p in m[0].split("."))]
    found += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and is_card(m[0])]
    found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= _digits(m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run before an at sign, as far back as the last match allows."""
    behind = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > behind and not LOCAL_END.match(text, begin - 1, begin):
            begin -= 1
        if begin < at and (domain := DOMAIN.match(text, at + 1)):
            yield begin, domain.end()
            behind = domain.end()
            at = text.find("@", behind)
        else:
            at = text.find("@", at + 1)


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def is_card(text: str) -> bool:
    """14 to 19 digits whose Luhn sum ends in 0."""
    digits = [ord(c) - 48 for c in text if "0" <= c <= "9"]
    if not 14 <= len(digits) <= 19:
        return False
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def value_of(text: str) -> str:
    """An identifier without its writing: the digits of a number, else the text in lower case."""
    digits = re.sub(r"[\s().+-]", "", text)
    return digits if re.fullmatch("[0-9]+", digits) else text.lower()


def plausible(text: str) -> int:
    """The kinds that a text might be one of, as bits; no more than a bar to words that are none of them in any context."""
    digits = _digits(text)
    number = re.fullmatch(r"[0-9\s().+/-]+", text) is not None
    return (
        (re.fullmatch(r"[^@]+@[^@]+", text) is not None) << 0
        | (digits > 3 and re.fullmatch(r"[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){2,}", text) is not None) << 1
        | (number and 12 <= digits <= 19) << 2 | (number and 7 <= digits <= 15) << 3
    )


def _plain(word: str) -> str:
    """A word of a context: lower case without marks at its edges; one with digits stands for all such."""
    word = word.strip(EDGE).lower()
    return "#" if SIGN.search(word) else word


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, int, list[str]]]:
    """(start, end, value, base kinds, plausible kinds, contexts) of base spans and other candidates.

    Contexts are the two words before, and the word before with the one behind; what is left of a word that a span
    shares counts as a word, the edge of the text as an empty one.
    """
    if not SIGN.search(text):
        return []
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    starts = [a for a, _ in words]
    taken = sorted((a, b) for a, b, _ in base)
    spans: dict[tuple[int, int], int] = {}
    for a, b, kind in base:
        spans[a, b] = spans.get((a, b), 0) | 1 << kind
    covered, behind = 0, -1
    free: list[tuple[int, int]] = []
    for a, b in words:
        while covered < len(taken) and taken[covered][1] <= a:
            covered += 1
        touched = covered < len(taken) and taken[covered][0] < b
        if touched or not SIGN.search(text, a, b):
            behind = -1
            continue
        number = NUMBER.fullmatch(text[a:b].rstrip(_AFTER)) is not None
        if number and free and behind == a - 1 and text[behind] == " ":
            free[-1] = free[-1][0], b  # a number written in several words
        else:
            free.append((a, b))
        behind = b if NUMBER.fullmatch(text, a, b) else -1
    found = [(a, b, kinds, kinds) for (a, b), kinds in spans.items()]
    for a, b in free:
        whole = text[a:b]
        left, right = len(whole) - len(whole.lstrip(_BEFORE)), len(whole.rstrip(_AFTER))
        if left < right and (kinds := plausible(whole[left:right])):
            found.append((a + left, a + right, 0, kinds))
    out = []
    for a, b, kinds, may in sorted(found):
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        before = [_plain(text[words[first][0]:a])] if words[first][0] < a else []
        before = [w for w in before if w]
        before += [_plain(text[x:y]) for x, y in words[max(0, first - 2):first][::-1]]
        one, two = (before + ["", ""])[:2]
        next_word = _plain(text[b:words[last][1]])
        if not next_word and last + 1 < len(words):
            next_word = _plain(text[slice(*words[last + 1])])
        out.append((a, b, value_of(text[a:b]), kinds, may, [f"{two} {one} _", f"{one} _ {next_word}"]))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
_MENTIONS = pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("base", pa.int32()), ("may", pa.int32()), ("contexts", pa.list_(pa.string()))]))
_DDL = (
    "_row struct<file:long,at:long>, _id {}, _base array<struct<start:int,end:int,kind:int>>, "
    "_mentions array<struct<start:int,end:int,value:string,base:int,may:int,contexts:array<string>>>"
)


def _read_texts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 8):
            part = batch.slice(at, 1 << 8)
            base, said = [], []
            for text in part.column("_text"):
                text = text.as_py() or ""
                spans = find_base(text)
                base.append([dict(zip(("start", "end", "kind"), s)) for s in spans])
                said.append([dict(zip(("start", "end", "value", "base", "may", "contexts"), m)) for m in mentions(text, spans)])
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), part.column("_id"), pa.array(base, _SPANS), pa.array(said, _MENTIONS)], ["_row", "_id", "_base", "_mentions"])
    tidy()


def read_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, _id, _base (spans), _mentions of every row, written to the shared folder; the only pass over the texts."""
    rows = numbered(stored(docs)).select("_row", F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return materialize(rows.mapInArrow(_read_texts, _DDL.format(rows.schema["_id"].dataType.simpleString())))


def graph(documents: DataFrame, least: float) -> DataFrame:
    """_pattern, _value, _base, _may: every context with each value in it once, written to the shared folder.

    A context with so few values that it could never be sure to ``least`` is left out: all of n values sure make n / (n + DOUBT).
    """
    said = documents.select(F.explode("_mentions").alias("m")).select(F.explode("m.contexts").alias("_pattern"), "m.value", "m.base", "m.may")
    edges = said.groupBy("_pattern", F.col("value").alias("_value")).agg(F.bit_or("base").alias("_base"), F.bit_or("may").alias("_may"))
    edges = materialize(edges)
    sizes = edges.groupBy("_pattern").agg(F.count("*").alias("_n"))
    sizes = materialize(sizes.where(F.col("_n") * SURE >= round(least * SURE) * (F.col("_n") + DOUBT)))
    return materialize(salted_join(edges, sizes, "_pattern", "inner", "_value"))


def learn(edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(_value, _kind, _score) of discovered values and (_pattern, _kind, _score) of the patterns that found them.

    Base values are sure of their kinds. In turns, a pattern is as sure of a kind as the scores of its values together over their number and
    ``DOUBT``; a value is as sure as the surest pattern around it that reaches ``least``, for kinds that its form allows. Scores are whole thousandths and
    never fall, so the turns end, when one changes nothing. All of it is joins and grouped aggregates over the edges, written every turn.
    """
    has = lambda mask: F.filter(F.array(*[F.lit(i) for i in range(len(KINDS))]), lambda k: F.getbit(mask, k) == 1)
    by_kind = F.map_from_entries(F.array_sort(F.collect_list(F.struct("_kind", "_score")))).alias("_scores")
    values = edges.groupBy("_value").agg(F.bit_or("_base").alias("_base"), F.bit_or("_may").alias("_may"))
    values = materialize(values)
    seeds = values.select("_value", F.explode(has("_base")).alias("_kind"), F.lit(SURE).cast("long").alias("_score"))
    open_kinds = edges.select("_pattern", "_value", "_may")
    found = seeds.where("false")
    patterns, mark = None, None
    while True:
        scores = seeds.union(found).groupBy("_value").agg(by_kind)
        scored = salted_join(edges.select("_pattern", "_value", "_n"), scores, "_value", "inner", "_pattern")
        of_pattern = scored.select("_pattern", "_n", F.explode("_scores").alias("_kind", "_score")).groupBy("_pattern", "_kind").agg(
            F.expr(f"sum(_score) div (min(_n) + {DOUBT})").alias("_score"))
        patterns = materialize(of_pattern.where(F.col("_score") >= round(least * SURE)))
        by_pattern = patterns.groupBy("_pattern").agg(by_kind)
        reached = salted_join(open_kinds, by_pattern, "_pattern", "inner", "_value").select(
            "_value", "_may", F.explode("_scores").alias("_kind", "_score"))
        reached = reached.where(F.array_contains(has("_may"), F.col("_kind"))).groupBy("_value", "_kind").agg(F.max("_score").alias("_score"))
        found = materialize(reached.join(seeds.select("_value", "_kind"), ["_value", "_kind"], "left_anti"))
        now = tuple(found.agg(F.count("*"), F.sum("_score")).first())
        if now == mark or not now[0]:
            return found, patterns
        mark = now


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75) -> DataFrame:
    """id, base, spans for every row: arrays of (start, end, kind) in code points, by start and then kind; ``spans`` holds ``base``.

    Beside the base spans (``find_base``) stand other words with digits or an at sign whose value the corpus shows to be personal data: it occurs, here or elsewhere, in a
    context that base values of one kind share (``learn``). Such a word gets the kind of the highest score, of equal ones the first; every mention of the value counts. Null
    texts are empty and have no spans; repeated rows and null ids are rows of their own, while their values count once; other columns are left out.
    Texts are read once. What is shuffled are mentions; contexts and values of any frequency are combined first and their joins split.
    """
    documents = read_documents(docs, id_col, text_col)
    found, _ = learn(graph(documents, least), least)
    best = found.groupBy("_value").agg(F.max(F.struct("_score", (-F.col("_kind")).alias("_first"))).alias("_best"))
    best = materialize(best.select("_value", (-F.col("_best._first")).alias("_kind")))
    free = documents.select("_row", F.explode(F.filter("_mentions", lambda m: m["base"] == 0)).alias("m")).select("_row", "m.value", "m.start", "m.end")
    new = salted_join(free.withColumnRenamed("value", "_value"), best, "_value", "inner")
    more = new.groupBy("_row").agg(F.collect_list(F.struct("start", "end", F.col("_kind").alias("kind"))).alias("_more"))
    spans = F.sort_array(F.transform(F.concat("_base", F.coalesce("_more", F.array())), lambda s: F.struct(s["start"], s["kind"], s["end"])))
    named = lambda array: F.transform(array, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind_name(s["kind"]).alias("kind")))
    return documents.join(more, "_row", "left").select(F.col("_id").alias(id_col), named(F.col("_base")).alias("base"), named(spans).alias("spans"))


def kind_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), number + 1)


def listed(spans: Column | str) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75) -> DataFrame:
    """pattern, kind, confidence: the contexts that are sure of a kind; an underscore stands for the identifier."""
    _, known = learn(graph(read_documents(docs, id_col, text_col), least), least)
    return known.select(F.col("_pattern").alias("pattern"), kind_name(F.col("_kind")).alias("kind"), (F.col("_score") / SURE).alias("confidence"))
