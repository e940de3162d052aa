"""Exact interpolated quantiles in bounded memory and a fixed number of scans.

Spark's ``percentile`` keeps every distinct value of a column in one aggregation buffer,
which no executor can hold for a large continuous column. Here a first scan brackets each
quantile by fixed-size sketches. A second one counts the rows between the brackets' ends and writes
the distinct values inside them, well under a thousandth of the rows per quantile. All that follows reads
that small table alone. The result is exact: ranks are found by counts, and a rank that a bracket
misses widens it and repeats the second scan.

All columns share each scan as (column number, value) pairs that are aggregated map-side,
so a pass shuffles a few small buffers per column and task.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .columns import as_double, to_rows
from .joins import join_small
from .scratch import materialize, release

ACCURACY = 10_000
#: Cells a range of values is divided into in each round that looks for a rank.
_CELLS = 1000
#: Partial sketches of a column are merged by this many reducers; more groups a scan would make Spark sort the rows.
_SALTS, _GROUPS = 4, 100


@dataclass
class ColumnSummary:
    """What the passes found for one column; all None where it has no values."""

    count: int = 0
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    std: float | None = None
    quantiles: list[float | None] = field(default_factory=list)


@dataclass
class _Search:
    """The value at ``rank`` among those of a column from ``low`` to ``high``, the ends included or not."""

    column: int
    rank: int
    low: float
    high: float
    open: bool = True
    value: float | None = None


def column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ordinal, v): the non-null values of all columns in long form."""
    numbers = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    pairs = [F.struct(F.lit(i).alias("ordinal"), F.col(f"v{i}").alias("v")) for i in range(len(columns))]
    return numbers.select(to_rows(pairs)).where("v is not null")


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, ColumnSummary]:
    """Count, extremes, mean, sample deviation and quantiles per column: two scans for each 25 columns.

    What reaches the driver is a bounded number of rows per column and probability.
    """
    found: dict[str, ColumnSummary] = {}
    width = max(1, _GROUPS // _SALTS)
    for start in range(0, len(columns), width):
        found |= _exact_quantiles(df, columns[start: start + width], probabilities)
    return found


def _around(probability: float, slack: float) -> tuple[float, float]:
    return max(0.0, probability - slack), min(1.0, probability + slack)


def _exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, ColumnSummary]:
    found = {c: ColumnSummary(quantiles=[None] * len(probabilities)) for c in columns}
    value = F.col("v")
    points = [F.lit(x) for p in probabilities for x in _around(p, 2.0 / ACCURACY)]
    sketch = [F.percentile_approx(value, F.array(*points), ACCURACY).alias("q")] if points else []
    salted = column_values(df, columns).groupBy("ordinal", F.floor(F.rand(7) * _SALTS).alias("salt")).agg(
        F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"),
        F.var_pop(value).alias("var"), *sketch)
    parts: dict[int, list] = {}
    for row in salted.collect():
        parts.setdefault(row["ordinal"], []).append(row)
    ends: dict[int, list[float]] = {}
    for i, rows in parts.items():
        _merge(found[columns[i]], sorted(rows, key=lambda r: r["salt"]))
        if points:
            lows, highs = range(0, len(points), 2), range(1, len(points), 2)
            ends[i] = sorted({min(r["q"][k] for r in rows) for k in lows} | {max(r["q"][k] for r in rows) for k in highs})

    wanted = {
        (i, rank): None for i in ends for p in probabilities
        for rank in (math.floor((found[columns[i]].count - 1) * p), math.ceil((found[columns[i]].count - 1) * p))
    }
    brackets = {i: [_bracket(parts[i], k) for k in range(len(probabilities))] for i in ends}
    while any(v is None for v in wanted.values()):
        missing = {i for (i, _), v in wanted.items() if v is None}
        missed = _search(df, columns, {i: ends[i] for i in missing}, {i: brackets[i] for i in missing}, wanted)
        for i, low, high in missed:
            ends[i] = sorted({*ends[i], low, high})
            brackets[i].append((low, high))
    for i in ends:
        summary = found[columns[i]]
        for k, p in enumerate(probabilities):
            position = (summary.count - 1) * p
            low, high = wanted[i, math.floor(position)], wanted[i, math.ceil(position)]
            summary.quantiles[k] = low + (high - low) * (position - math.floor(position))
    return found


def _bracket(rows: list, k: int) -> tuple[float, float]:
    """The quantile of all rows lies between the smallest and the largest of the salted ones."""
    return min(r["q"][2 * k] for r in rows), max(r["q"][2 * k + 1] for r in rows)


def _merge(summary: ColumnSummary, rows: list) -> None:
    """Moments of the salts put together, as parallel variances are."""
    summary.min, summary.max = min(r["lo"] for r in rows), max(r["hi"] for r in rows)
    mean, squares = 0.0, 0.0
    for r in rows:
        total, apart = summary.count + r["n"], r["mean"] - mean
        squares += r["var"] * r["n"] + apart * apart * summary.count * r["n"] / total
        mean += apart * r["n"] / total
        summary.count = total
    summary.mean = mean
    summary.std = math.sqrt(squares / (summary.count - 1)) if summary.count > 1 else None


def _search(df, columns, ends, brackets, wanted) -> list[tuple[int, float, float]]:
    """Fill in the wanted ranks that the brackets hold; (column, lowest, highest) of zones that need one.

    Zone 2i lies below the i-th end (and above the one before), zone 2i + 1 is the end itself.
    """
    names, width = sorted(ends), max(len(e) for e in ends.values())
    rows = []
    for at, i in enumerate(names):
        inside = [(2 * ends[i].index(lo) + 1, 2 * ends[i].index(hi) + 1) for lo, hi in brackets[i]]
        listed = [any(lo < z < hi for lo, hi in inside) for z in range(2 * width + 1)]
        rows.append((at, *ends[i], *[math.inf] * (width - len(ends[i])), listed))
    # Declared not null, which keeps the generated code small enough to be compiled.
    limits = df.sparkSession.createDataFrame(rows, T.StructType(
        [T.StructField("ordinal", T.IntegerType(), False)]
        + [T.StructField(f"e{n}", T.DoubleType(), False) for n in range(width)]
        + [T.StructField("lists", T.ArrayType(T.BooleanType(), False), False)]
    ))
    zone = F.lit(0)
    for n in range(width):
        zone = zone + (F.col("v") >= F.col(f"e{n}")).cast("int") + (F.col("v") > F.col(f"e{n}")).cast("int")
    # At most one row per column of this pass, so the broadcast is bounded by _GROUPS rows.
    placed = column_values(df, [columns[i] for i in names]).join(F.broadcast(limits), "ordinal")
    placed = placed.select("ordinal", "v", "lists", zone.alias("zone"))
    table = materialize(placed.groupBy("ordinal", "zone", F.when(F.get("lists", F.col("zone")), F.col("v")).alias("v")).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))

    zones: dict[int, list] = {i: [] for i in names}
    totals = table.groupBy("ordinal", "zone").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or(F.col("v").isNotNull()).alias("listed"))
    for row in totals.collect():
        zones[names[row["ordinal"]]].append(row)
    searches, missed = {}, []
    for i, rank in [k for k, v in wanted.items() if v is None and k[0] in zones]:
        before = 0
        for row in sorted(zones[i], key=lambda r: r["zone"]):
            if rank < before + row["n"]:
                break
            before += row["n"]
        if rank == before or rank == before + row["n"] - 1:
            wanted[i, rank] = row["lo"] if rank == before else row["hi"]
        elif row["lo"] == row["hi"]:
            wanted[i, rank] = row["lo"]
        elif row["listed"]:
            searches[i, rank] = _Search(names.index(i), rank - before, row["lo"], row["hi"])
        else:
            missed.append((i, row["lo"], row["hi"]))
    _find(table, list(searches.values()))
    for key, search in searches.items():
        wanted[key] = search.value
    release(table)
    return missed


def _find(table: DataFrame, searches: list[_Search]) -> None:
    """Values at ranks of the listed ones: each round counts a thousand cells and goes on in the right one."""
    largest = sys.float_info.max
    while open_ := [s for s in searches if s.value is None]:
        rows = [(k, s.column, s.low, s.high, max(s.low, -largest), min(s.high, largest)) for k, s in enumerate(open_)]
        ranges = table.sparkSession.createDataFrame(rows, "k int, ordinal int, a double, z double, fa double, fz double")
        # Halves, as the width of a range may exceed the largest double.
        share = (F.col("v") / 2 - F.col("fa") / 2) / (F.col("fz") / 2 - F.col("fa") / 2)
        cell = F.when(F.col("v") < F.col("fa"), -1).when(F.col("v") > F.col("fz"), _CELLS).otherwise(F.floor(share * (_CELLS - 1))).cast("int")
        inside = table.where("v is not null").join(F.broadcast(ranges), "ordinal").where("v >= a and v <= z")
        cells: dict[int, list] = {}
        for row in inside.groupBy("k", cell.alias("cell")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            cells.setdefault(row["k"], []).append(row)
        for k, s in enumerate(open_):
            for row in sorted(cells[k], key=lambda r: r["cell"]):
                if s.rank < row["n"]:
                    break
                s.rank -= row["n"]
            s.low, s.high = row["lo"], row["hi"]
            if s.rank == 0 or s.low == s.high:
                s.value = s.low
            elif s.rank == row["n"] - 1:
                s.value = s.high


def approximate_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Quantiles whose rank is off by at most a share of 1 / accuracy: one scan."""
    found: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    points = F.array(*[F.lit(p) for p in probabilities])
    for row in column_values(df, columns).groupBy("ordinal").agg(F.percentile_approx("v", points, accuracy).alias("q")).collect():
        found[columns[row["ordinal"]]] = list(row["q"])
    return found


def grouped_quantile(
    df: DataFrame, keys: list[str], value: str, probability: float, output: str,
    also: list[Column] = (), accuracy: int = 100_000,
) -> DataFrame:
    """Exact interpolated quantile per group, safe for a group that holds most rows: two scans.

    The first takes a sketch per group, which brackets the quantile, and ``also``, further aggregates of
    the columns of ``df``. The second joins the rows to the brackets, which are written first so that their
    true size is known, and folds them: what lies beside a bracket becomes one count with its
    nearest value, and only the narrow band inside (about 6 rows in 100,000 of the group, equal values
    counted once) is ordered. Ranks are checked against the counts; a group whose bracket misses them is done
    again with all of its values.
    """
    slack = 2.0 / accuracy
    data = df.withColumn("_v", as_double(df, value))
    sketch = materialize(data.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", list(_around(probability, slack)), accuracy).alias("_b"), *also,
    ))
    bounds = sketch.where("_n > 0").select(
        *keys, F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"), ((F.col("_n") - 1) * probability).alias("_pos"))
    picked = materialize(_ranked(data, bounds, keys))
    missed = picked.where("_a is null or _z is null").select(*keys)
    if missed.head(1):
        whole = sketch.where("_n > 0").join(missed, keys).select(*keys, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), ((F.col("_n") - 1) * probability).alias("_pos"))
        picked = picked.where("_a is not null and _z is not null").unionByName(_ranked(data, materialize(whole), keys))
    share = F.col("_pos") - F.floor("_pos")
    picked = picked.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * share).alias(output))
    return sketch.drop("_n", "_min", "_max", "_b").join(picked, keys, "left")


def _ranked(data: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., _pos, _a, _z): the values at the ranks around ``_pos``, null where the bracket misses them."""
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    listed = F.when(side == 0, F.col("_v"))
    # "_pos" is one value per group: grouping by it adds nothing but carries it along.
    band = join_small(data.select(*keys, "_v").where("_v is not null"), bounds, keys).groupBy(
        *keys, "_pos", side.alias("_side"), listed.alias("_listed")
    ).agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    upto = Window.partitionBy(*keys).orderBy("_side", "_low")
    ends = band.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))

    def at(rank: Column) -> Column:
        # Of what lies beside the bracket, only the values next to it are known by rank.
        here = (F.col("_start") <= rank) & (rank < F.col("_end"))
        value = F.when(F.col("_side") == 0, F.col("_low")).when(rank == F.col("_start"), F.col("_low")).when(rank == F.col("_end") - 1, F.col("_high"))
        return F.min(F.when(here, value))

    return ends.groupBy(*keys, "_pos").agg(at(F.floor("_pos")).alias("_a"), at(F.ceil("_pos")).alias("_z"))
