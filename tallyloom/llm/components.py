"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

import numpy as np
import pyarrow as pa

from ..functions.scratch import materialize
from .common import salted_join


def _contract(batches):
    """Per task: links replaced by one from every node to the smallest that the task's links reach."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (up := above.get(root, root)) != root:
            root = up
        while x != root:
            above[x], x = root, above.get(x, x)
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    table = np.array([(x, top(x)) for x in list(above)], np.int64).reshape(-1, 2)
    for at in range(0, len(table), 1 << 16):
        part = table[at:at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the links (a long, b long).

    Each round joins every node's neighbours to the smallest one around: first those above the node,
    then those below it. Rounds grow with the logarithm of the longest path; each is written to
    the shared folder. The links of a node of high degree are dealt to several tasks. No links: no rows.
    """
    stars = materialize(links.where("a <> b").mapInArrow(_contract, "a long, b long").distinct())
    mark = _mark(stars)
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("_n"))
        large = salted_join(both.where("b > a"), least.drop("_n"), "a", "inner", "b", sizes=least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        small = salted_join(down, least.drop("_n"), "a", "inner", "b", sizes=least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        if (after := _mark(stars)) == mark:
            break
        mark = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
