"""Quality rules as a short-circuit cascade, in DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD_GAP

# What is no symbol, and the limits of the base rules.
OTHER_THAN_SYMBOLS = r"[^#*$%&|<>]+"
SHORTEST, REPEATED_PERCENT, WINDOW = 50, 50, 3
#: Rows whose whole texts are taken to measure the rules. The sample sets the order alone, no verdict.
SAMPLE_ROWS = 500


@dataclass(frozen=True)
class Rule:
    """A reason to reject; ``fails`` may use the text and the counts of ``measured``, and is never null.

    ``work`` says what a row costs the rule: the characters and array elements its expression goes over, in passes over characters. None: the text once.
    """
    name: str
    fails: Column
    work: Column | None = None


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def default_rules() -> list[Rule]:
    """Thresholds that leave plain prose of any language alone."""
    text, words = F.col("_text"), F.col("n_words")
    once, counted = F.char_length("_text"), F.lit(1)  # a rule over counts that are there costs next to nothing
    without = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))  # noqa: E731  in runs, as most texts have few
    return [
        Rule("symbols", _share(F.col("n_symbols"), F.col("word_chars")) > 0.03, counted),
        Rule("duplicate_lines", _share(F.col("n_dup_lines"), F.col("_lines")) > 0.5, counted),
        Rule("word_length", ~_share(F.col("word_chars"), words).between(2.0, 15.0), counted),
        Rule("capitals", _share(without(r"[^\p{Lu}]+"), without(r"[^\p{L}]+")) > 0.6, 2 * once),
        Rule("exclamations", _share(without("[^!]+"), words) > 0.3, once),
        Rule("letters", _share(without(r"[^\p{L}]+"), F.col("word_chars")) < 0.3, once),
        Rule("same_words", _share(F.size(F.array_distinct("_words")), words) < 0.05, once + 8 * words),  # hashes the words and puts each into a set
    ]


def _neighbours(values: str, width: int) -> Column:
    """Every ``width`` neighbouring elements of an array column as a struct."""
    size = F.greatest(F.size(values) - (width - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(values, F.lit(i + 1), size).alias(f"e{i}") for i in range(width)])


def _covered(hashes: str) -> Column:
    """Words in windows whose hash stands twice or more in the array of a text's window hashes."""
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    equal = lambda w: F.filter(
        F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("a"), F.slice(w, F.lit(2), F.size(w) - 1).alias("b")),
        lambda p: p["a"]["h"] == p["b"]["h"])
    places = F.transform(F.array(marked), lambda w: F.sort_array(F.array_distinct(F.flatten(F.transform(
        equal(w), lambda p: F.array(p["a"]["i"], p["b"]["i"]))))))
    # Each window adds the words up to the next repeated window, three at most; the last adds three.
    total = F.transform(places, lambda s: F.aggregate(
        F.arrays_zip(F.slice(s, F.lit(1), F.size(s) - 1).alias("a"), F.slice(s, F.lit(2), F.size(s) - 1).alias("b")),
        F.lit(WINDOW), lambda sum_, p: sum_ + F.least(p["b"] - p["a"], F.lit(WINDOW))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(total[0])


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as a struct _doc, with _text, _words, _lines and the base counts of its whole text.

    n_words, word_chars (code points), n_symbols, n_dup_lines, n_repeat_words, base_failed. Null counts as
    empty. Repeated windows are told by their 64-bit hashes within a text; a text whose hashes all
    differ, as most do, is not sorted.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_doc"), text.alias("_text")).withColumns({
        "_words": F.filter(F.split("_text", WORD_GAP), lambda w: w != ""), "_full": lines,
    })
    rows = rows.withColumn("_hashes", F.transform(_neighbours("_words", WINDOW), lambda w: F.xxhash64(w["e0"], w["e1"], w["e2"])))
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace("_text", OTHER_THAN_SYMBOLS, "")).cast("long"),
        "_lines": F.size("_full"),
        "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        "n_repeat_words": _covered("_hashes").cast("long"),
    })
    failed = (F.col("n_words") < SHORTEST) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def ordered(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules with their cost (mean work) and rejection rate on a sample, best rejection per cost first, of equals by name.

    The sample is the first ``sample_rows`` rows of the table as it is read, judged in one job; an empty table leaves the given order. Costs are
    counted, not timed: the seconds of so few rows would be those of starting a job, and differ between runs.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).take(sample_rows)
    if not texts or not rules:
        return [(r, 0.0, 0.0) for r in rules]
    sample = measured(docs.sparkSession.createDataFrame([(t[0],) for t in texts], "text string").coalesce(1))
    work = [F.char_length("_text") if r.work is None else r.work for r in rules]
    found = sample.select(*[F.avg(w.cast("double")).alias(f"w{i}") for i, w in enumerate(work)], *[
        F.avg(r.fails.cast("double")).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    judged = [(r, found[f"w{i}"], found[f"r{i}"]) for i, r in enumerate(rules)]
    return sorted(judged, key=lambda x: (-x[2] / max(x[1], 1.0), x[0].name))


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``measured`` rows with failed_rule (null: none) and kept.

    A row that fails the base is not tried further; the others meet the rules in the order of
    ``ordered`` and stop at the first that rejects them, so a rule costs only what reaches it. The
    order changes failed_rule of rows that several rules reject, never ``kept``.
    """
    rows = measured(docs, text_col)
    failed = F.when(F.col("base_failed"), "base")
    for rule, _, _ in ordered(docs, default_rules() if rules is None else rules, text_col):
        failed = failed.when(rule.fails, rule.name)
    return rows.withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull())


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows that pass, with their own columns."""
    return cascade(docs, rules, text_col).where("kept").select("_doc.*")
