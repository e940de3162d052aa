"""Counts, means and sums of products of every pair of columns in one scan, however wide the table is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Groups of tasks whose parts are merged first.
GROUPS = 512
_PARTS = "i int, j int, n double, mx double, my double, sxx double, syy double, sxy double"
_NAMES = [c.split()[0] for c in _PARTS.split(", ")]


def _block(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """n, mx, my, sxx, syy, sxy of some rows, as matrices over pairs of columns; not-a-numbers are absent.

    Values are taken from the first of their column and then from the mean of the rows, so that offsets cost no digits and a column that
    does not vary has sums of exactly 0.
    """
    here = ~np.isnan(values)
    moved = np.where(here, values - first, 0.0)
    level = moved.sum(axis=0) / np.maximum(here.sum(axis=0), 1)
    moved = np.where(here, moved - level, 0.0)
    mask = here.astype(float)
    n, sums, squares = mask.T @ mask, moved.T @ mask, (moved * moved).T @ mask
    held = np.maximum(n, 1)
    mean = sums / held
    spread = np.maximum(squares - sums * mean, 0.0)
    both = moved.T @ moved - sums * sums.T / held
    base = (level + first)[:, None]
    return [n, mean + base, (mean + base).T, spread, spread.T, both]


def merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The moments of two sets of rows together."""
    n = a[0] + b[0]
    share = np.where(n > 0, b[0] / np.maximum(n, 1), 0.0)
    # A side without rows has no mean that could count.
    dx, dy = (np.where((a[0] > 0) & (b[0] > 0), b[k] - a[k], 0.0) for k in (1, 2))
    weight = a[0] * share
    return [n, *(np.where(a[0] > 0, a[k] + d * share, b[k]) for k, d in ((1, dx), (2, dy))),
            a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight]


def _reduce(complete: bool):
    def run(batches):
        total = first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            if complete:
                values = values[~np.isnan(values).any(axis=1)]
                if not len(values):
                    continue
            if first is None:
                first = np.zeros(values.shape[1])
                unset = np.ones(values.shape[1], bool)
            for k in np.flatnonzero(unset):
                there = values[~np.isnan(values[:, k]), k]
                if len(there):
                    first[k], unset[k] = there[0], False
            part = _block(values, first)
            total = part if total is None else merged(total, part)
        if total is not None:
            i, j = np.triu_indices(len(total[0]))
            columns = [pa.array(x.astype(np.int32)) for x in (i, j)] + [pa.array(m[i, j]) for m in total]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)
    return run


def _merge(parts: DataFrame, *keys: str) -> DataFrame:
    """One row a key: parts merged around their common mean, which is reached from the mean of one of them."""
    held = parts.groupBy(*keys).agg(F.collect_list(F.struct(*_NAMES[2:])).alias("parts"), F.sum("n").alias("n"))
    over = lambda f: F.aggregate("parts", F.lit(0.0), f)
    mean = lambda m: F.col("parts")[0][m] + over(lambda s, p: s + p["n"] * (p[m] - F.col("parts")[0][m])) / F.col("n")
    around = lambda s, a, b: over(lambda t, p: t + p[s] + p["n"] * (p[a] - F.col(a)) * (p[b] - F.col(b)))
    centered = held.select(*keys, "parts", "n", mean("mx").alias("mx"), mean("my").alias("my"))
    return centered.select(
        *keys, "n", "mx", "my", around("sxx", "mx", "mx").alias("sxx"), around("syy", "my", "my").alias("syy"), around("sxy", "mx", "my").alias("sxy"))


def pair_moments(df: DataFrame, values: list[Column], complete: bool = False) -> DataFrame:
    """i, j (i <= j), n, mx, my, sxx, syy, sxy: over the rows that have both values (all values, if ``complete``).

    A task reduces its rows, some thousand at a time, by products of matrices, and gives one row a pair; these are merged in two steps, some at a time, around
    the common mean. A plan of aggregates would need six expressions a pair. Null and not-a-number are absent; pairs without rows have no row.
    """
    rows = df.select(*[v.cast("double").alias(f"c{k}") for k, v in enumerate(values)])
    parts = rows.mapInArrow(_reduce(complete), _PARTS).where("n > 0")
    some = _merge(parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS))), "i", "j", "g")
    return _merge(some, "i", "j").withColumn("n", F.col("n").cast("long"))
