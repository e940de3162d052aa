"""Whole records of text files that are read in byte ranges by many tasks, where a record may span lines and ranges.

Spark deals a file to tasks in ranges and cuts each into pieces at a separator: lines of a CSV, or what lies between the closing
braces of a JSON array. Whether a piece ends a record depends on all that comes before it in the file: whether a quote is open, and how many braces. Both add
up over ranges, so a first scan reduces every range to its sums, running totals over the ranges of a file (few rows) give the state each one
begins in, and in the next scans every task cuts its own ranges. Records that cross the end of a range are put together from their fragments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scratch import materialize

#: Ranges whose states may be broadcast, of 32 bytes each, by a count of them. More are joined by sorting.
MOST_RANGES = 200_000
_STATES = "_file long, _start long, flips long, outside long, inside long"


class Csv:
    """Lines; one ends a record when no quote is open after it. Doubled quotes inside a cell leave that as it is."""
    separator = "\n"

    def __init__(self, quoted: int = 0, depth: int = 0):
        self.quoted = quoted

    def ends(self, pieces: pa.Array) -> np.ndarray:
        quoted = (np.cumsum(pc.count_substring(pieces, '"').to_numpy(zero_copy_only=False)) + self.quoted) & 1
        self.quoted = int(quoted[-1])
        return quoted == 0

    @staticmethod
    def sums(pieces: pa.Array, flips: int) -> tuple[int, int, int]:
        return flips + (pc.sum(pc.count_substring(pieces, '"')).as_py() or 0), 0, 0


class JsonArray:
    """What lies before closing braces; one ends a record when its brace stands outside strings and closes the last one open."""
    separator = "}"

    def __init__(self, quoted: int = 0, depth: int = 0):
        self.quoted, self.depth = quoted, depth

    @staticmethod
    def _braces(piece: bytes, quoted: int) -> tuple[list[int], int]:
        """Opening less closing braces outside and inside strings, and whether a string is open at the end.

        A piece begins behind a brace, where no escape is open; a backslash stands in strings alone.
        """
        parts = piece.replace(b"\\\\", b"").replace(b'\\"', b"").split(b'"')
        found = [0, 0]
        for i, part in enumerate(parts):
            found[quoted + i & 1] += part.count(b"{")
        quoted = quoted + len(parts) - 1 & 1
        found[quoted] -= 1
        return found, quoted

    def ends(self, pieces: pa.Array) -> np.ndarray:
        out = np.zeros(len(pieces), bool)
        for i, piece in enumerate(pieces.cast(pa.binary())):
            found, self.quoted = self._braces(piece.as_py(), self.quoted)
            self.depth += found[0]
            out[i] = not self.quoted and self.depth <= 0
            self.depth = max(self.depth, 0)  # what follows the last record closes nothing
        return out

    @classmethod
    def sums(cls, pieces: pa.Array, flips: int) -> tuple[int, int, int]:
        total = [0, 0]
        for piece in pieces.cast(pa.binary()):
            found, quoted = cls._braces(piece.as_py(), flips & 1)
            total = [total[0] + found[0], total[1] + found[1]]
            flips += quoted ^ flips & 1
        return flips, *total


def _runs(batches) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Slices of batches that lie in one range each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(n).to_numpy() for n in ("_file", "_start")])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            yield (int(keys[a, 0]), int(keys[a, 1])), batch.slice(a, b - a)


def _scan(form):
    def run(batches):
        key, sums = None, (0, 0, 0)
        for new, part in _runs(batches):
            if key not in (None, new):
                yield _row(key, sums)
                sums = (0, 0, 0)
            key = new
            flips, outside, inside = form.sums(part.column("value"), sums[0])
            sums = flips, sums[1] + outside, sums[2] + inside
        if key is not None:
            yield _row(key, sums)

    def _row(key, sums):
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*key, *sums)], ["_file", "_start", "flips", "outside", "inside"])
    return run


def _records(pieces: pa.Array, ends: np.ndarray, separator: str) -> tuple[pa.Array, pa.Array]:
    """Whole records of joined pieces, and the pieces of the one left open."""
    closed = np.flatnonzero(ends) + 1
    whole = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], closed)), pa.int32()), pieces)
    return pc.binary_join(whole, separator), pieces.slice(closed[-1] if len(closed) else 0)


# What a fragment is, in the order of the fragments of a range: the rest of a record, the beginning of one.
_REST, _BEGIN = 0, 1


def _cut(form, header: bool, fragments: bool):
    """Whole records that begin and end in their range, or instead the fragments of the others; without the headers of files."""
    def run(batches):
        key, state, held, rest, first = None, None, [], False, False

        def left():
            # Pieces of a record that goes on in the next range, or ends with the file.
            if held and fragments:
                yield fragment(held, _REST if rest else _BEGIN, first)

        def fragment(pieces, kind, is_header):
            text = form.separator.join(p for part in pieces for p in part.to_pylist())
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([kind], pa.int32()), pa.array([is_header]), pa.array([text])],
                ["_file", "_start", "kind", "is_header", "record"])

        for new, part in _runs(batches):
            if new != key:
                if key is not None:
                    yield from left()
                quoted, depth = part.column("quoted")[0].as_py(), part.column("depth")[0].as_py()
                key, state, held = new, form(quoted, depth), []
                rest, first = bool(quoted or depth), header and new[1] == 0
            pieces = part.column("value")
            ends = state.ends(pieces)
            if not ends.any():
                held.append(pieces)
                continue
            if held:
                pieces = pa.concat_arrays([*held, pieces])
                ends = np.concatenate((np.zeros(len(pieces) - len(ends), bool), ends))
            records, tail = _records(pieces, ends, form.separator)
            if rest:
                if fragments:
                    yield fragment([pieces.slice(0, int(np.argmax(ends)) + 1)], _REST, first)
                records = records.slice(1)
            elif first:
                records = records.slice(1)
            rest = first = False
            held = [tail] if len(tail) else []
            if not fragments and len(records):
                yield pa.RecordBatch.from_arrays([records], ["record"])
        if key is not None:
            yield from left()
    return run


def whole_records(spark: SparkSession, path: str, form: type[Csv] | type[JsonArray], header: bool = False) -> DataFrame:
    """record: the text of every record of the files at ``path``, in no order; with ``header`` without the first of each file.

    Three scans, each split as finely as Spark splits the files: sums of ranges, fragments, records. A record of any length is whole; one
    left open at the end of a file is a record. Of a JSON array the separators around a record belong to it.
    """
    source = spark.read.option("lineSep", form.separator).text(path)
    place = source.metadataColumn("_metadata")
    pieces = source.select(
        "value", F.xxhash64(place["file_path"]).alias("_file"), place["file_block_start"].alias("_start"), F.monotonically_increasing_id().alias("_at"))
    sums = materialize(pieces.mapInArrow(_scan(form), _STATES))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    states = sums.withColumn("quoted", F.pmod(F.coalesce(F.sum("flips").over(before), F.lit(0)), F.lit(2)).cast("int"))
    added = F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside"))
    states = states.withColumn("added", added).withColumn("depth", F.greatest(F.coalesce(F.sum("added").over(before), F.lit(0)), F.lit(0)).cast("int"))
    states = materialize(states.select("_file", "_start", "quoted", "depth"))
    if states.count() <= MOST_RANGES:
        stated = pieces.join(F.broadcast(states), ["_file", "_start"])  # keeps the order of the pieces
    else:
        stated = pieces.join(states, ["_file", "_start"]).repartition("_file", "_start").sortWithinPartitions("_file", "_start", "_at")
    stated = stated.select("_file", "_start", "value", "quoted", "depth")
    parts = stated.mapInArrow(_cut(form, header, True), "_file long, _start long, kind int, is_header boolean, record string")
    order = Window.partitionBy("_file").orderBy("_start", "kind")
    begun = F.max(F.when(F.col("kind") == _BEGIN, F.col("_start"))).over(order)
    joined = parts.withColumn("begun", begun).groupBy("_file", "begun").agg(
        F.array_sort(F.collect_list(F.struct("_start", "kind", "record"))).alias("parts"), F.bool_or("is_header").alias("is_header"))
    crossing = joined.where("not is_header").select(F.array_join(F.transform("parts", lambda p: p["record"]), form.separator).alias("record"))
    return stated.mapInArrow(_cut(form, header, False), "record string").union(crossing)
