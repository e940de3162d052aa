"""Linear attributions: what each feature adds to a customer's score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, settled, to_rows


def _means(table: DataFrame, features: list[str]) -> Column:
    return table.agg(F.struct(*[F.avg(col(f).cast("double")).alias(f) for f in features])).scalar()


def _contributions(table: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Adds _c0, _c1, ...: coefficient * (value - mean) per feature.

    The means are a one-row subquery.
    """
    means = _means(table, list(coefficients))
    return table.withColumns({
        f"_c{i}": F.lit(w) * (col(f).cast("double") - means[f]) for i, (f, w) in enumerate(coefficients.items())
    })


def _entries(features: list[str]) -> list[Column]:
    return [
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(f).alias("feature"), settled(f"_c{i}", 4).alias("contribution"),
            F.when(F.col(f"_c{i}") > 0, "increases churn").otherwise("decreases churn").alias("direction"),
            settled(col(f).cast("double"), 2).alias("feature_value"),
        )
        for i, f in enumerate(features)
    ]


def linear_attribution(table: DataFrame, key: str, coefficients: dict[str, float]) -> DataFrame:
    """(key, feature, contribution, direction, feature_value) in long form, no shuffle."""
    entries = to_rows(_entries(list(coefficients)))
    return _contributions(table, coefficients).select(col(key).alias(key), entries).drop("ordinal")


def base_value(table: DataFrame, coefficients: dict[str, float], intercept: float) -> DataFrame:
    """Score of the average row."""
    value = F.lit(intercept)
    for f, w in coefficients.items():
        value = value + F.lit(w) * F.avg(col(f).cast("double"))
    return table.agg(settled(value, 4).alias("base_value"))


def global_importance(table: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """(feature, importance): mean absolute contribution, largest first.

    Averaged as columns of one aggregate row; the data is not exploded.
    """
    measured = _contributions(table, coefficients).agg(*[
        F.avg(F.abs(f"_c{i}")).alias(f"m{i}") for i in range(len(coefficients))
    ])
    rows = to_rows([
        F.struct(F.lit(i).alias("ordinal"), F.lit(f).alias("feature"), settled(f"m{i}", 4).alias("importance"))
        for i, f in enumerate(coefficients)
    ])
    return measured.select(rows).orderBy(F.desc("importance"), "ordinal").drop("ordinal")


def ranked_attribution(table: DataFrame, key: str, coefficients: dict[str, float]) -> DataFrame:
    """(key, factors): all features ordered by absolute rounded contribution.

    The few features of one customer are sorted inside its row, which needs no shuffle.
    """
    # The leading field sorts by size, the ordinal keeps the feature order on a tie.
    sortable = F.array(*[
        F.struct((-F.abs(e["contribution"])).alias("size"), e["ordinal"].alias("ordinal"), e.alias("entry"))
        for e in _entries(list(coefficients))
    ])
    factors = F.transform(F.array_sort(sortable), lambda s: s["entry"])
    return _contributions(table, coefficients).select(col(key).alias(key), factors.alias("factors"))


def top_factors(table: DataFrame, key: str, coefficients: dict[str, float], k: int = 5) -> DataFrame:
    """(key, rank, feature, contribution, direction, feature_value): the k main factors."""
    ranked = ranked_attribution(table, key, coefficients).select(key, F.slice("factors", 1, k).alias("factors"))
    return ranked.select(key, F.posexplode("factors").alias("_at", "_f")).select(
        key, (F.col("_at") + 1).alias("rank"), "_f.feature", "_f.contribution", "_f.direction", "_f.feature_value"
    )


def explain_customers(
    table: DataFrame, scores: DataFrame, key: str, coefficients: dict[str, float], k: int = 5
) -> DataFrame:
    """(key, churn_probability, churned_predicted, top_factors, summary) for all customers."""
    line = lambda f: F.format_string(
        "- %s = %s %s: %+.4f", f["feature"], f["feature_value"].cast("string"),
        f["direction"], f["contribution"],
    )
    explained = (
        ranked_attribution(table, key, coefficients)
        .select(key, F.slice("factors", 1, k).alias("top_factors"))
        .join(scores, key)
    )
    percent = F.format_string("%.1f%%", settled(F.col("churn_probability") * 100, 1))
    return explained.select(
        key, "churn_probability", "churned_predicted", "top_factors",
        F.concat(
            F.lit("Customer "), col(key).cast("string"), F.lit(" leaves with probability "), percent,
            F.lit(".\n\nWhat weighs most:\n"), F.array_join(F.transform("top_factors", line), "\n"),
        ).alias("summary"),
    )


def explain_customer(explained: DataFrame, key: str, value) -> DataFrame:
    """One customer's explanation; an unknown customer raises ``LookupError``."""
    found = explained.where(col(key) == F.lit(value))
    if found.isEmpty():
        raise LookupError(f"there is no prediction for {value}")
    return found
