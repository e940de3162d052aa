"""Tests and regression from group moments: the data is reduced once, map-side first.

Every test reports its statistic, degrees of freedom and p-value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_double, col, settled
from ..functions.distributions import chi_square_p_value, f_p_value, t_p_value
from ..functions.moments import pair_moments

#: Digits of a p-value.
_P = 6


def ttest(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """Welch's two-sample t between two groups: means, statistic, degrees of freedom, p-value of both tails."""
    number = as_double(df, value)
    a, b = F.when(col(group) == F.lit(first), number), F.when(col(group) == F.lit(second), number)
    m = df.where(col(group).isin(first, second)).agg(
        F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"),
        F.count(b).alias("n2"), F.avg(b).alias("m2"), F.var_samp(b).alias("v2"),
    )
    e1, e2 = F.try_divide("v1", "n1"), F.try_divide("v2", "n2")
    freedom = F.try_divide(
        (e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, F.col("n1") - 1) + F.try_divide(e2 * e2, F.col("n2") - 1)
    )
    tested = m.select("m1", "m2", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(e1 + e2)).alias("t"), freedom.alias("freedom"))
    return tested.select(
        settled("m1", 4).alias("mean_first"), settled("m2", 4).alias("mean_second"), settled("t", 4).alias("t_statistic"),
        settled("freedom", 2).alias("degrees_of_freedom"), settled(t_p_value(F.col("t"), F.col("freedom")), _P).alias("p_value"),
    )


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: F statistic, both degrees of freedom, p-value."""
    number = as_double(df, value)
    groups = df.where(col(group).isNotNull() & number.isNotNull()).groupBy(col(group)).agg(
        F.count("*").alias("n"), F.avg(number).alias("m"), F.var_pop(number).alias("v")
    )
    # The groups' means around one of them first: their grand mean then keeps its digits at any offset.
    origin = groups.agg(F.min("m")).scalar()
    shifted = groups.withColumn("d", F.col("m") - origin)
    grand = shifted.agg(F.sum(F.col("n") * F.col("d")) / F.sum("n")).scalar()
    total = shifted.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("d") - grand, 2)).alias("between"),
    )
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    tested = total.select(
        F.try_divide(F.try_divide("between", df1), F.try_divide("within", df2)).alias("f"), df1.alias("df_between"), df2.alias("df_within"))
    return tested.select(
        settled("f", 4).alias("f_statistic"), "df_between", "df_within",
        settled(f_p_value(F.col("f"), F.col("df_between"), F.col("df_within")), _P).alias("p_value"))


def chi_square(df: DataFrame, left: str, right: str) -> DataFrame:
    """Chi-squared of independence of two categorical columns, with its p-value.

    Only the cells that occur are read: each that does not adds what was expected of it, so together
    they add the rows that the others were not expected to have.
    """
    cells = df.where(col(left).isNotNull() & col(right).isNotNull()).groupBy(
        col(left).alias("_l"), col(right).alias("_r")
    ).agg(F.count("*").alias("_o"))
    rows = cells.groupBy("_l").agg(F.sum("_o").alias("_rows"))
    columns = cells.groupBy("_r").agg(F.sum("_o").alias("_cols"))
    n = cells.agg(F.sum("_o").cast("double")).scalar()
    expected = F.col("_rows") / n * F.col("_cols")
    joined = cells.join(rows, "_l").join(columns, "_r").withColumn("_e", expected).agg(
        F.sum(F.pow(F.col("_o") - F.col("_e"), 2) / F.col("_e")).alias("there"), F.sum("_e").alias("e"), F.sum("_o").alias("n"),
        F.count_distinct("_l").alias("r"), F.count_distinct("_r").alias("c"), F.count("*").alias("cells"),
    )
    absent = F.when(F.col("cells") < F.col("r") * F.col("c"), F.greatest(F.col("n") - F.col("e"), F.lit(0.0))).otherwise(0.0)
    tested = joined.select((F.col("there") + absent).alias("x"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("degrees_of_freedom"))
    return tested.select(
        settled("x", 4).alias("chi_square"), "degrees_of_freedom", settled(chi_square_p_value(F.col("x"), F.col("degrees_of_freedom")), _P).alias("p_value"))


def regression_univariate(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x with R squared and residual deviation."""
    a, b = as_double(df, x), as_double(df, y)
    m = df.agg(
        F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
        F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.regr_sxy(b, a).alias("sxy"),
    )
    explained = F.try_divide(F.col("sxy") * F.col("sxy"), "sxx")
    rest = F.greatest(F.lit(0.0), F.col("syy") - explained)
    return m.select(
        "n", settled("slope", 4).alias("slope"), settled("intercept", 4).alias("intercept"),
        settled(F.try_divide(explained, "syy"), 6).alias("r_squared"),
        settled(F.sqrt(F.try_divide(rest, "n")), 4).alias("rmse"),
    )


def regression_multivariate(df: DataFrame, xs: list[str], y: str, tolerance: float = 1e-9) -> DataFrame:
    """Least squares of y on several columns: term, coefficient, std_error, t_statistic, p_value, and of the whole n, rank, r_squared, rmse.

    One scan gives the moments of the rows in which all are present, about their means (``pair_moments``). Of these p + 1 by p + 1 numbers the correlations of
    the regressors are factored by Cholesky's method, a column at a time, so neither scale nor offset matters. A column of which the ones before it explain all but
    ``tolerance`` adds nothing: its coefficient is null, rank is lower, and the other coefficients are those without it. A constant column is such a one. No complete row gives coefficients of null.
    """
    if y in xs or len(set(xs)) < len(xs) or not xs:
        raise ValueError("regressors must be different columns, at least one, and not the one explained")
    columns = [*xs, y]
    found = pair_moments(df, [as_double(df, c) for c in columns], complete=True).collect()  # one row a pair of columns
    size, n = len(xs), int(found[0]["n"]) if found else 0
    gram, mean = np.zeros((size + 1, size + 1)), np.zeros(size + 1)
    for r in found:
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["sxy"]
        mean[r["i"]], mean[r["j"]] = r["mx"], r["my"]
    scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
    unit = gram / np.outer(np.where(scale > 0, scale, 1), np.where(scale > 0, scale, 1))
    factor, kept = np.zeros((size, size)), []
    for k in range(size):
        for j in kept:
            factor[k, j] = (unit[k, j] - factor[k, :j] @ factor[j, :j]) / factor[j, j]
        pivot = unit[k, k] - factor[k, :k] @ factor[k, :k]
        if scale[k] > 0 and pivot > tolerance:
            factor[k, k] = np.sqrt(pivot)
            kept.append(k)
    slopes, errors = np.full(size, np.nan), np.full(size + 1, np.nan)
    rest = gram[size, size]
    freedom = n - len(kept) - 1
    if kept:
        low = factor[np.ix_(kept, kept)]
        inverse = np.linalg.inv(low)
        weights = inverse.T @ (inverse @ unit[kept, size])
        slopes[kept] = weights * scale[size] / scale[kept]
        rest = max(0.0, rest * (1 - float(unit[kept, size] @ weights)))
    if freedom > 0:
        variance = rest / freedom
        spread = np.zeros((0, 0))
        if kept:
            spread = (inverse.T @ inverse) / np.outer(scale[kept], scale[kept])
            errors[1:][kept] = np.sqrt(variance * np.diag(spread))
        errors[0] = np.sqrt(variance * (1 / n + (mean[kept] @ spread @ mean[kept] if kept else 0.0)))
    intercept = mean[size] - float(np.nansum(slopes * mean[:size])) if n else np.nan
    explained = 1 - rest / gram[size, size] if gram[size, size] > 0 else None
    number = lambda v: None if np.isnan(v) else float(v)
    rows = [(k, term, number(b), number(e), max(freedom, 0)) for k, (term, b, e) in enumerate(zip(["intercept", *xs], [intercept, *slopes], errors))]
    terms = df.sparkSession.createDataFrame(rows, "ordinal int, term string, b double, e double, freedom long")
    t = F.try_divide("b", F.nullif(F.col("e"), F.lit(0.0)))
    return terms.select(
        "ordinal", "term", settled("b", 4).alias("coefficient"), settled("e", 4).alias("std_error"), settled(t, 3).alias("t_statistic"),
        settled(t_p_value(t, F.col("freedom")), _P).alias("p_value"), F.lit(n).cast("long").alias("n"), F.lit(len(kept)).alias("rank"),
        settled(F.lit(explained).cast("double"), 6).alias("r_squared"), settled(F.lit(np.sqrt(rest / n) if n else None).cast("double"), 4).alias("rmse"))
