"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scratch import materialize
from .common import numbered, salted_join, stored, without

#: Labelled rows the document classifier is fitted on; those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Sites whose posteriors may be broadcast instead of joined by sorting.
BROADCAST = 200_000
RIDGE, STEPS = 1e-2, 60
#: Weights of a site's prior, in documents: the bounds, and what stands in where sites do not differ.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6

_GAPS, _MARKS, _CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>{}[]\\^~=_+@", bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123)) + bytes(range(128, 256))
FEATURES = ("marks", "capitals", "letters", "digits", "ends", "shouts", "word_length", "new_words", "new_pairs", "new_lines", "same_next", "size")


def features(text: str | None) -> list[float]:
    """Shares and means over the whole text, each roughly within 0 and 1; zeros if it has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    size = len(raw)
    chars = len(raw.translate(None, _GAPS))
    count = lambda some: size - len(raw.translate(None, some))
    letters = max(1, count(_LETTERS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(words) - 1
    return [
        count(_MARKS) / chars, count(_CAPITALS) / letters, letters / chars, count(b"0123456789") / chars,
        min(1.0, count(b".?:;,") / len(words)), min(1.0, count(b"!") / len(words)), min(1.0, chars / len(words) / 12),
        len(set(words)) / len(words), len(set(zip(words, words[1:]))) / pairs if pairs else 1.0, len(set(lines)) / len(lines),
        sum(a == b for a, b in zip(words, words[1:])) / max(1, pairs), min(1.0, float(np.log1p(len(words))) / 12),
    ]


def _featured(batches):
    for batch in batches:
        rows = np.array([features(t) for t in batch.column("_text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
        kept = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], [*kept, *FEATURES])


@dataclass(frozen=True)
class Model:
    """Logistic regression on ``FEATURES``; ``log_odds`` are those of its training labels."""
    weights: tuple[float, ...]
    bias: float
    log_odds: float

    def evidence(self) -> Column:
        """The log of the Bayes factor for good: the classifier's log odds less those it was trained at."""
        total = F.lit(self.bias - self.log_odds)
        for name, weight in zip(FEATURES, self.weights):
            total = total + F.col(name) * F.lit(weight)
        return total


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Newton steps with a ridge; labels of one kind alone, or none, give a model without evidence."""
    good = float(y.sum())
    if not 0 < good < len(y):
        return Model((0.0,) * len(FEATURES), 0.0, 0.0)
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    design = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    ridge = np.diag([RIDGE * len(x)] * x.shape[1] + [0.0]) + 1e-9 * np.eye(design.shape[1])
    beta = np.zeros(design.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[:-1] / spread
    return Model(tuple(map(float, weights)), float(beta[-1] - weights @ centre), float(np.log(good / (len(y) - good))))


def _train(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample_rows: int) -> Model:
    """Fit on the sampled labelled rows; an id with several labels counts once, at its largest label."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    known = known.orderBy(F.xxhash64(F.lit(6), "_id"), "_id").limit(sample_rows)
    # The sample is bounded, so it may be broadcast; rows that repeat an id are trained on once.
    picked = rows.join(F.broadcast(known), "_id").groupBy("_id").agg(F.min(F.struct(*FEATURES)).alias("f"), F.first("_label").alias("_label"))
    found = picked.orderBy("_id").select("f.*", F.col("_label").cast("double").alias("_label")).toPandas()
    return fit(found[list(FEATURES)].to_numpy(np.float64), (found["_label"].to_numpy() > 0).astype(np.float64))


def _weight(groups: DataFrame, mean: str) -> float:
    """How many documents a group's prior is worth: moments of a beta-binomial over the groups.

    ``groups`` has n and good (the expected number of good ones) and the prior mean of each. Groups
    that differ no more than chance would have it get the largest weight.
    """
    prior = F.least(F.greatest(F.col(mean), F.lit(1e-6)), F.lit(1 - 1e-6))
    squares = F.col("n") * F.pow(F.col("good") / F.col("n") - prior, 2) / (prior * (1 - prior))
    row = groups.agg(F.sum(squares).alias("s"), F.count("*").alias("g"), F.sum("n").alias("n")).first()
    if not row.g or row.n <= row.g:
        return MOST_WEIGHT
    share = (row.s - row.g) / (row.n - row.g)
    return float(min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / share - 1))) if share > 0 else MOST_WEIGHT


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def classified(
    docs: DataFrame, labels: DataFrame, host: Column | str = "source", path: Column | str = "lang", id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Every row's verdict: _row, id, evidence, host_mean, path_mean, score, kept.

    ``host`` and ``path`` within it name the site of a document; null is a site of its own. The
    classifier's evidence at the global prior gives each document a chance of being good. Hosts are shrunk
    toward the global mean and paths toward their host, by sums that leave the document itself out;
    the path's mean is the prior at which the document's evidence is judged again. Weights of both
    priors follow from how much sites differ. Null and empty texts have features of zero; rows without
    label take part like all others; without any usable label every row scores the prior of one half.
    Sums per site are combined before the shuffle and hold one row a site.
    """
    docs = stored(docs)
    place = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    rows = numbered(docs).select("_row", F.col(id_col).alias("_id"), F.coalesce(place(host), F.lit("")).alias("_host"),
                                 F.coalesce(place(path), F.lit("")).alias("_path"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_row struct<file:long,at:long>, _id {kind}, _host string, _path string, " + ", ".join(f"{n} double" for n in FEATURES)
    rows = materialize(rows.mapInArrow(_featured, schema))
    model = _train(rows, labels, id_col, label_col, sample_rows)
    judged = rows.select("_row", "_id", "_host", "_path", model.evidence().alias("evidence"))
    judged = judged.withColumn("p", _chance(F.col("evidence") + F.lit(model.log_odds)))

    paths = materialize(judged.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = total.good / total.n if total.n else 0.5
    host_weight = _weight(hosts.withColumn("prior", F.lit(mean)), "prior")
    hosts = hosts.withColumn("prior", (F.col("good") + F.lit(host_weight * mean)) / (F.col("n") + F.lit(host_weight)))
    sites = paths.join(hosts.select("_host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), "prior"), "_host")
    sites = materialize(sites)
    path_weight = _weight(sites, "prior")

    found = salted_join(judged, sites, ["_host", "_path"], "inner", most=BROADCAST)
    without = lambda good, n, prior, weight: (
        (F.greatest(F.col(good) - F.col("p"), F.lit(0.0)) + weight * prior) / (F.col(n) - 1 + weight))
    host_mean = without("host_good", "host_n", F.lit(mean), F.lit(host_weight))
    found = found.withColumn("host_mean", host_mean)
    found = found.withColumn("path_mean", without("good", "n", F.col("host_mean"), F.lit(path_weight)))
    prior = F.least(F.greatest(F.col("path_mean"), F.lit(1e-6)), F.lit(1 - 1e-6))
    score = _chance(F.col("evidence") + _logit(prior))
    return found.select("_row", F.col("_id").alias(id_col), "evidence", "host_mean", "path_mean",
                        score.alias("score"), (score >= threshold).alias("kept"))


def drop_rejected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    docs = stored(docs)
    gone = materialize(classified(docs, labels, **options).where("not kept").select("_row"))
    return without(docs, gone)
