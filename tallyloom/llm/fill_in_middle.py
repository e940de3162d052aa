"""Fill-in-the-middle: cut each text at two code points, found by bit arithmetic on eight bytes of UTF-8 at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The marks of prefix, suffix and middle. None can overlap another or itself.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text whose words are marked at once; a longer text is marked alone.
CHUNK = 1 << 23
_LOW = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_SHIFTS = {n: np.uint64(n) for n in (1, 6, 7, 8, 56)}


def unit_ends(octets: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """One word for every eight bytes, with bit 0 of a byte set where a code point ends.

    A byte ends one when the byte after it is no continuation (10xxxxxx), and so does the last of every text
    (``lasts``); bytes that pad the last word end nothing.
    """
    words = np.zeros(len(octets) // 8 + 1, np.uint64)
    words.view(np.uint8)[:len(octets)] = octets
    begins = ~(words >> _SHIFTS[7] & ~(words >> _SHIFTS[6])) & _LOW
    ends = begins >> _SHIFTS[8]
    ends[:-1] |= begins[1:] << _SHIFTS[56]
    ends.view(np.uint8)[len(octets):] = 0
    ends.view(np.uint8)[lasts] = 1
    return ends


class Marks:
    """Ranks and positions of the code point ends in some bytes."""

    def __init__(self, octets: np.ndarray, lasts: np.ndarray):
        self.ends = unit_ends(octets, lasts)
        self.upto = np.concatenate(([0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ends in the first ``at`` bytes."""
        word, rest = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << rest * np.uint64(8)) - np.uint64(1)  # at most 56 bits: rest is below 8
        return self.upto[word] + np.bitwise_count(self.ends[word] & below)

    def after(self, count: np.ndarray) -> np.ndarray:
        """The byte after end number ``count`` (from 1).

        The word is found in the cumulative counts. In it a multiplication gives every byte the ends up to it;
        as these are at most eight, one subtraction compares all eight with the wanted one, and the bytes
        that fall short are counted.
        """
        word = np.searchsorted(self.upto, count) - 1
        wanted = (count - self.upto[word]).astype(np.uint64)
        reached = (self.ends[word] * _LOW | _HIGH) - wanted * _LOW & _HIGH
        return word * 8 + 8 - np.bitwise_count(reached) + 1


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``CHUNK`` bytes together, or one longer text."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, to
        at = to


def cut(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
    """Per text the code points, those before the first and second cut, and the bytes before each.

    ``first`` and ``second`` are any numbers from 0; cuts are their remainders by one more than the code points, the smaller first.
    """
    offsets, octets = _bytes(texts)
    names = ("n", "prefix", "upto", "prefix_bytes", "upto_bytes")
    found = {name: np.zeros(len(texts), np.int64) for name in names}
    for at, to in _chunks(offsets):
        begin, end = offsets[at:to] - offsets[at], offsets[at + 1:to + 1] - offsets[at]
        marks = Marks(octets[offsets[at]:offsets[to]], end[end > begin] - 1)
        before = marks.rank(begin)
        units = marks.rank(end) - before
        cuts = np.sort(np.stack((first[at:to] % (units + 1), second[at:to] % (units + 1))), axis=0)
        found["n"][at:to], found["prefix"][at:to], found["upto"][at:to] = units, *cuts
        for name, count in zip(names[3:], cuts):
            some = count > 0
            found[name][at:to][some] = marks.after((before + count)[some]) - begin[some]
    return found


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return offsets, np.frombuffer(data or b"", np.uint8)


_CUTS = "struct<n:bigint,prefix:bigint,upto:bigint,prefix_bytes:bigint,upto_bytes:bigint>"


def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = cut(texts, first.to_numpy(), second.to_numpy())
    return pa.StructArray.from_arrays([pa.array(x) for x in found.values()], list(found))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_percent: int = 10, suffix_first_percent: int = 20,
) -> DataFrame:
    """id, n (code points), form, prefix_chars, middle_chars, output for every row; other columns are left out.

    The first four 8-digit groups of sha256 of ``seed``:id (a null id counts as empty) decide: two cuts, whether a text stays
    plain, and whether the suffix comes first (spm) or the prefix (psm). A null text counts as empty; empty texts and texts
    that hold a mark stay plain, without counts of parts. Repeated rows with one id are cut alike. One pass, no shuffle, and
    Python sees bytes alone: it returns where to cut.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    part = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    form = F.when(
        (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (part(2) % 100 >= 100 - plain_percent), "plain",
    ).when(part(3) % 100 < suffix_first_percent, "spm").otherwise("psm")
    cuts = F.arrow_udf(_cuts, _CUTS)
    cut_up = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), form.alias("form"), cuts(text, part(0), part(1)).alias("at"))
    octets, first, upto = F.col("text").cast("binary"), F.col("at.prefix_bytes").cast("int"), F.col("at.upto_bytes").cast("int")
    prefix = octets.substr(F.lit(1), first)
    middle = octets.substr(first + 1, upto - first)
    suffix = octets.substr(upto + 1, F.octet_length("text"))
    mark = {m: F.lit(m).cast("binary") for m in (PREFIX, SUFFIX, MIDDLE)}
    output = F.when(F.col("form") == "psm", F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)).when(
        F.col("form") == "spm", F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)).otherwise(octets)
    is_cut = F.col("form") != "plain"
    return cut_up.select(
        F.col("id").alias(id_col), F.col("at.n").alias("n"), "form",
        F.when(is_cut, F.col("at.prefix")).alias("prefix_chars"), F.when(is_cut, F.col("at.upto") - F.col("at.prefix")).alias("middle_chars"),
        output.cast("string").alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from. Marks stand in no text that was cut, so they are where the parts meet."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
