"""Packing token pieces into fixed windows by non-negative least squares on the length histogram."""

from __future__ import annotations

import json
import re
import struct
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scratch import materialize
from .blocks import beside, store, tidy

#: Triples take their shortest length from this grid; pairs take any. Sweeps of the solver.
GRID, SWEEPS = 64, 20
#: Words that a task encodes at once and remembers; a mark that stands between them.
_BATCH, _VOCABULARY, _MARK = 1 << 7, 1 << 19, b"\x01"
#: Parts of words that it remembers.
_PARTS = 1 << 17
_STEP = 256
#: Signs that may stand behind the letters of a plain word.
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
# The steps before the merges under which plain words may go straight to them.
_NORMALISER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


class WordIds(dict):
    """White-space word -> its ids as bytes of ``kind``.

    For vocabularies that drop white space, so that the ids of a text are those of its words put
    together. Plain words, which are letters with punctuation behind, go straight to the vocabulary's merges if its
    normaliser and splitter are the known ones; all others are encoded many at once with a mark between them. A plain word is
    learned when it is first looked up, any other is put aside for ``learn``.
    """

    def __init__(self, file: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.mark = self._encoded(_MARK)
        with open(file, encoding="utf-8") as text:
            steps = json.load(text)
        known = (steps.get("normalizer"), (steps.get("pre_tokenizer") or {}).get("pretokenizers")) == (_NORMALISER, _SPLITTER)
        self.plain = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([^A-Za-z0-9'\x00-\x20\x7f-\U0010ffff]*)").fullmatch if known else None
        self.parts: dict[str, bytes] = {}
        self.odd: set[bytes] = set()
        self.unread = False

    def _encoded(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.kind)

    def _part(self, part: str) -> bytes:
        """Ids of one run of letters in lower case, or of punctuation."""
        ids = self.parts.get(part)
        if ids is None:
            spelled = part if part.isascii() else "".join(map(_SPELLING.__getitem__, part.encode()))
            found = [t.id for t in self.tokenizer.model.tokenize(spelled)]
            ids = self.parts[part] = struct.pack(f"<{len(found)}{'H' if self.kind == '<u2' else 'I'}", *found)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        """Ids of a plain word; none for an odd one, which is put aside."""
        if self.plain:
            stem, signs = word.rstrip(_SIGNS), ""
            if stem.isalpha():  # A-Z and a-z alone
                letters = stem.lower().decode()
                if len(stem) < len(word):
                    signs = word[len(stem):].decode()
            elif found := self.plain(word.decode()):
                letters, signs = found.groups()
                letters = letters.lower()
            else:
                letters = ""
            if letters:
                ids = self.parts.get(letters) or self._part(letters)
                if signs:
                    ids += self.parts.get(signs) or self._part(signs)
                self[word] = ids
                return ids
        self.odd.add(word)
        self.unread = True
        return b""

    def forget(self) -> None:
        self.clear()
        self.parts.clear()

    def joined(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of every text, given as its words."""
        self._make_room()
        find, ids, again = self.__getitem__, [], []
        for i, words in enumerate(texts):
            self.unread = False
            ids.append(b"".join(map(find, words)))
            if self.unread:
                again.append(i)
        self._learn_odd()
        for i in again:
            ids[i] = b"".join(map(find, texts[i]))
        return ids

    def learn(self, words: set[bytes]) -> None:
        self._make_room()
        for word in words:
            self[word]  # noqa: B018
        self._learn_odd()

    def _make_room(self) -> None:
        if len(self) > _VOCABULARY:
            self.forget()
        if len(self.parts) > _PARTS:  # most stand in no other word
            self.parts.clear()

    def _learn_odd(self) -> None:
        odd = [*self.odd]
        self.odd.clear()
        plain = [w for w in odd if _MARK not in w]
        for at in range(0, len(plain), _BATCH):
            part = plain[at:at + _BATCH]
            ids = self._encoded((b" " + _MARK + b" ").join(part) + b" " + _MARK)
            ends = np.flatnonzero(ids == self.mark[0]).tolist() if len(self.mark) == 1 else []
            if len(ends) != len(part):  # the mark is no id of its own in this vocabulary
                continue
            start = 0
            for word, end in zip(part, ends):
                self[word], start = ids[start:end].tobytes(), end + 1
        for word in odd:
            if word not in self:
                self[word] = self._encoded(word).tobytes()


def _spelling() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_SPELLING = _spelling()


@lru_cache(maxsize=1)
def word_ids(file: str) -> WordIds:
    """One a worker process, as the vocabulary takes long to read."""
    return WordIds(file)


def _encode(file: str, end_id: int, window: int):
    """Ids of every document, and its number among the task's documents of equal rest."""
    def run(batches):
        known, part, seen, whole = word_ids(file), TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        width, end = np.dtype(known.kind).itemsize, np.array([end_id], known.kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                rows = batch.slice(at, _STEP)
                texts = [(t or "").encode().split() for t in rows.column("_text").to_pylist()]
                ids = [x + end for x in known.joined(texts)]
                tokens = [len(x) // width for x in ids]
                local, first = [], []
                for n in tokens:
                    local.append(int(seen[n % window]))
                    first.append(whole)
                    seen[n % window] += 1
                    whole += n // window
                yield pa.RecordBatch.from_pydict({
                    "_id": rows.column("_id"), "_tokens": pa.array(tokens, pa.int64()), "_ids": pa.array(ids, pa.binary()),
                    "_part": pa.repeat(pa.scalar(part, pa.int64()), len(ids)), "_rest": pa.array([n % window for n in tokens], pa.int32()),
                    "_local": pa.array(local, pa.int64()), "_whole": pa.array(first, pa.int64()),
                })
        known.forget()
        tidy()
    return run


def combinations(window: int, grid: int = GRID) -> list[tuple[int, ...]]:
    """Pairs of any lengths and triples with one length on the grid that fill a window exactly."""
    pairs = [(a, window - a) for a in range(1, (window + 1) // 2)]
    return pairs + [(a, b, window - a - b) for a in range(grid, window, grid) for b in range(1, (window - a + 1) // 2)
                    if b != a and window - a - b != a]


def solve(histogram: list[int], columns: list[tuple[int, ...]], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative least squares by coordinate descent: how often to use each column of different lengths."""
    rest = [float(x) for x in histogram]
    times = [0.0] * len(columns)
    for _ in range(sweeps):
        for j, column in enumerate(columns):
            step = 0.0
            for length in column:
                step += rest[length]
            step /= len(column)
            if step < -times[j]:
                step = -times[j]
            if step:
                times[j] += step
                for length in column:
                    rest[length] -= step
    return times


class Plan:
    """Which pieces go where: rows (rest, from rank, to rank, start, length, sequence of the first, offset).

    Pieces of equal rest are numbered; a row places a run of them, one in each of as many sequences. A
    piece that is cut stands in several rows. The plan depends on the histogram alone, and its size on
    the window, not on how many documents there are.
    """

    def __init__(self, histogram: list[int], window: int):
        self.window, self.sequences, self.rows = window, 0, []
        self.count = list(histogram)
        self.pool = [[[n, 0, c, 0]] if n and c else [] for n, c in enumerate(histogram)]
        columns = combinations(window)
        times = solve(self.count, columns)
        for j in sorted(range(len(columns)), key=lambda j: (-times[j], j)):
            repeat = min(int(times[j]), *(self.count[n] for n in columns[j]))
            if repeat:
                self._use([(n, n) for n in columns[j]], repeat)
        self._greedy()

    def _use(self, parts: list[tuple[int, int]], repeat: int) -> None:
        """Fill ``repeat`` sequences with the same parts: (length of the piece, how much of it)."""
        offset, left_over = 0, []
        for length, used in parts:
            self.count[length] -= repeat
            missing, at = repeat, self.sequences
            while missing:
                run = self.pool[length][-1]
                rest, low, high, start = run
                took = min(missing, high - low)
                self.rows.append((rest, low, low + took, start, used, at, offset))
                if used < length:
                    left_over.append((length - used, [rest, low, low + took, start + used]))
                run[1] += took
                if run[1] == run[2]:
                    self.pool[length].pop()
                missing, at = missing - took, at + took
            offset += used
        self.sequences += repeat
        for length, run in left_over:
            self.pool[length].append(run)
            self.count[length] += run[2] - run[1]

    def _greedy(self) -> None:
        """What is left, longest first: the longest piece that fits, else the longest one cut to fit."""
        there = [n for n, c in enumerate(self.count) if n and c]
        while there:
            parts, used, gap = [], {}, self.window
            while gap:
                i = bisect_right(there, gap) - 1
                while i >= 0 and self.count[there[i]] == used.get(there[i], 0):
                    i -= 1
                if i < 0:
                    i = next((k for k in range(len(there) - 1, -1, -1) if self.count[there[k]] > used.get(there[k], 0)), -1)
                if i < 0:
                    break
                n = there[i]
                used[n] = used.get(n, 0) + 1
                parts.append((n, min(n, gap)))
                gap -= parts[-1][1]
            if gap:
                self._last([n for n, _ in parts])
                return
            self._use(parts, min(self.count[n] // k for n, k in used.items()))
            for n in {*used, *(n - u for n, u in parts if u < n)}:
                k = bisect_left(there, n)
                if (k < len(there) and there[k] == n) != bool(self.count[n]):
                    insort(there, n) if self.count[n] else there.pop(k)

    def _last(self, lengths: list[int]) -> None:
        """Less than a window: sequences of a power of two each, so that none needs padding."""
        total = sum(lengths)
        for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
            parts, gap = [], size
            while gap:
                n = lengths.pop()
                parts.append((n, min(n, gap)))
                if n > gap:
                    lengths.append(n - gap)
                gap -= parts[-1][1]
            # One sequence at a time: a remainder is back in the pool before it is asked for.
            self._use(parts, 1)

    def places(self) -> dict[int, tuple[list[int], list[list[tuple[int, int, int, int]]]]]:
        """rest -> ranks at which placement changes, and the pieces from there: start, length, sequence less rank, offset."""
        by_rest: dict[int, list] = {}
        for rest, *row in self.rows:
            by_rest.setdefault(rest, []).append(row)
        found = {}
        for rest, rows in by_rest.items():
            cuts = sorted({r[0] for r in rows} | {r[1] for r in rows})
            pieces: list[list] = [[] for _ in cuts]
            for low, high, start, length, sequence, offset in rows:
                for k in range(bisect_left(cuts, low), bisect_left(cuts, high)):
                    pieces[k].append((start, length, sequence - low, offset))
            found[rest] = cuts, [sorted(p) for p in pieces]
        return found


_OFFSETS = pa.schema([("rest", pa.int32()), ("before", pa.int64()), ("whole_before", pa.int64())])
_COLUMNS = ("_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def _place(plan: Plan, folder: str, kind: str):
    places, window, packed = plan.places(), plan.window, plan.sequences
    width = np.dtype(kind).itemsize

    def run(batches):
        load, current, before, whole_before = beside(folder, _OFFSETS), None, {}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                rows, out = batch.slice(at, _STEP), []
                for doc, tokens, ids, part, rest, local, whole in zip(*(rows.column(i).to_pylist() for i in range(7))):
                    if part != current:
                        table, current = load((part, 0)), part
                        before = dict(zip(table.column("rest").to_pylist(), table.column("before").to_pylist()))
                        whole_before = table.column("whole_before")[0].as_py()
                    pieces = [(k * window, window, packed + whole_before + whole + k, 0) for k in range(tokens // window)]
                    if rest:
                        rank = before[rest] + local
                        cuts, found = places[rest]
                        pieces += [(tokens - rest + s, n, q + rank, o) for s, n, q, o in found[bisect_right(cuts, rank) - 1]]
                    for start, length, sequence, offset in pieces:
                        blob = np.frombuffer(ids, kind, length, start * width).astype("<u4").tobytes()
                        out.append((doc, start, length, blob, tokens, sequence, offset))
                columns = list(zip(*out)) or [()] * 7
                kinds = (rows.schema.field("_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(_COLUMNS))
    return run


def packed(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1,
) -> DataFrame:
    """Per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids with ``end_id`` behind; null counts as empty, so every row has a token. Whole
    windows are cut off first and stand alone; the rest of each document is packed by the histogram of
    rests: repeat counts of short combinations that fill a window are solved by non-negative least
    squares, rounded down, and what they leave is packed greedily, with a cut where nothing fits. All
    sequences are full, but those of the last tokens, which have lengths of powers of two.

    ``vocabulary`` is a file of the tokenizers library whose vocabulary drops white space; every machine
    has it at the same path. Ids are stored once; a document is numbered within its task and rest when
    encoded, and the counts of tasks and rests alone are shuffled.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    encoded = materialize(rows.mapInArrow(
        _encode(vocabulary, end_id, window),
        f"_id {kind}, _tokens long, _ids binary, _part long, _rest int, _local long, _whole long"))
    counts = materialize(encoded.groupBy("_part", "_rest").agg(
        F.count("*").alias("n"), F.sum(F.expr(f"_tokens div {window}")).cast("long").alias("whole")))
    histogram = [0] * window
    for row in counts.groupBy("_rest").agg(F.sum("n").alias("n")).where("_rest > 0").collect():  # a row a length at most
        histogram[row._rest] = row.n
    plan = Plan(histogram, window)
    # Windows over tasks: a row a task here, and a row a task and length there.
    parts = counts.groupBy("_part").agg(F.sum("whole").alias("whole"))
    parts = parts.select("_part", F.coalesce(F.sum("whole").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("whole_before"))
    by_rest = Window.partitionBy("_rest").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.col("_rest").alias("rest"), F.coalesce(F.sum("n").over(by_rest), F.lit(0)).alias("before"))
    folder = store(before.join(parts, "_part").select(F.col("_part").alias("_file"), F.lit(0).alias("_block"), "rest", "before", "whole_before"))
    out = encoded.mapInArrow(
        _place(plan, folder, word_ids(vocabulary).kind),
        f"_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)
