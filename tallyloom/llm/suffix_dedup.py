"""Suffix-array dedup on bytes: strings that repeat anywhere in the corpus are cut out."""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .blocks import beside, blocks, runs, store

#: Bytes that a task looks at in one step; a power of two, as places take ``_PLACE`` bits of a key.
CHUNK, _PLACE = 1 << 20, 20
#: Length of the grams that anchor strings, as a power of two.
GRAM_BITS = 6
#: Occurrences of an anchor above which its strings are spread by their own hashes, and bytes sorted at once.
HOT, BATCH = 20_000, 1 << 20
_STEP_ROWS = 256
_RANDOM = np.random.default_rng(3)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << _PLACE) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of every gram of 2 ** GRAM_BITS bytes, by doubling."""
    hashes = _BYTES[data]
    for i in range(GRAM_BITS):
        hashes = hashes[:-(1 << i)] * _FACTORS[i] + hashes[1 << i:]
    return hashes * _FACTORS[-1]


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbouring keys, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        keys = np.minimum(keys[:-step], keys[step:])
        done += step
    return keys


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Where strings of ``length`` bytes start that share an anchor: (first start, starts, anchor's hash).

    ``data`` holds texts with the given ends; no string crosses one. The anchor of a string is its
    smallest gram, the first of equals, so equal strings have equal anchors at equal distances, and
    consecutive strings with one anchor form a segment.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) < length:
        return none
    grams = _grams(data)
    places = np.arange(len(grams), dtype=np.uint64)
    anchors = (_smallest(grams & ~_LOW | places, length - (1 << GRAM_BITS) + 1) & _LOW).astype(np.int64)
    ending = np.zeros(len(data) + 1, bool)
    ending[ends] = True
    crossed = np.cumsum(ending)  # ends up to a place: a string crosses none within it
    starts = np.flatnonzero(crossed[length - 1:len(data)] == crossed[:len(anchors)])
    if not len(starts):
        return none
    anchors = anchors[starts]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(anchors) != 0))))
    return starts[first], np.diff(np.concatenate((first, [len(starts)]))), grams[anchors[first]]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("_text").to_pylist()]


def _chunks(texts: list[bytes], length: int):
    """(data, ends, [(text, offset in it, place in data)]) of at most ``CHUNK`` bytes.

    A long text is taken in pieces that overlap, so that each of its strings starts in exactly one.
    """
    parts, places, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK - length + 1):
            piece = text[at:at + CHUNK]
            if len(piece) < length:
                continue
            if size + len(piece) > CHUNK:
                yield b"".join(parts), np.cumsum([len(p) for p in parts]), places
                parts, places, size = [], [], 0
            parts.append(piece)
            places.append((i, at, size))
            size += len(piece)
    if parts:
        yield b"".join(parts), np.cumsum([len(p) for p in parts]), places


def _key(string: bytes, anchor: int) -> tuple[int, int]:
    """128 bits for a segment: equal strings around equal anchors."""
    value = xxhash.xxh3_128_intdigest(string, anchor)
    return (value & (1 << 64) - 1) - (1 << 63), (value >> 64) - (1 << 63)


def _record(columns: dict[str, list], kinds: dict[str, pa.DataType], block: tuple[int, int]) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    full = {"_file": pa.repeat(pa.scalar(block[0], pa.int64()), size), "_block": pa.repeat(pa.scalar(block[1], pa.int32()), size)}
    return pa.RecordBatch.from_pydict(full | {k: pa.array(v, kinds[k]) for k, v in columns.items()})


def _count(length: int):
    """Anchors: one row per block and hash, with its occurrences there."""
    kinds = {"hash": pa.int64(), "n": pa.int64()}

    def merged(held, block):
        hashes, first = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        times = np.bincount(first, np.concatenate([n for _, n in held])).astype(np.int64)
        return _record({"hash": hashes.view(np.int64), "n": times}, kinds, block)

    def run(batches):
        held, size, current = [], 0, None
        for block, batch in runs(batches, _STEP_ROWS):
            if held and (block != current or size > 1 << 21):
                yield merged(held, current)
                held, size = [], 0
            current = block
            for data, ends, _ in _chunks(_texts(batch), length):
                found = np.unique(segments(np.frombuffer(data, np.uint8), ends, length)[2], return_counts=True)
                held.append(found)
                size += len(found[0])
        if held:
            yield merged(held, current)
    return run


_ANCHORS = pa.schema([("hash", pa.int64()), ("hot", pa.bool_())])


class _Anchors:
    """The repeated anchors of the block at hand."""

    def __init__(self, folder: str):
        self.load, self.block, self.hashes, self.hot = beside(folder, _ANCHORS), None, None, None

    def of(self, block: tuple[int, int], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` repeat, and which of them are hot."""
        if block != self.block:
            table = self.load(block)
            known = table.column("hash").to_numpy().view(np.uint64)
            order = np.argsort(known)
            self.block, self.hashes, self.hot = block, known[order], table.column("hot").to_numpy(zero_copy_only=False)[order]
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        there = self.hashes[at] == hashes
        return there, there & self.hot[at]


_SEGMENT = {"hash": pa.int64(), "low": pa.int64(), "high": pa.int64(), "starts": pa.int32(), "n": pa.int64(), "string": pa.binary()}


def _gather(length: int, folder: str):
    """Distinct segments of a block with repeated anchors, and single strings (hash null) of hot ones."""
    def rows(held, block):
        columns = list(zip(*[(*k, *v) for k, v in held.items()]))
        return _record(dict(zip(_SEGMENT, columns)), _SEGMENT, block)

    def run(batches):
        anchors, held, size, current = _Anchors(folder), {}, 0, None
        for block, batch in runs(batches, _STEP_ROWS):
            if held and (block != current or size > 1 << 25):
                yield rows(held, current)
                held, size = {}, 0
            current = block
            for data, ends, _ in _chunks(_texts(batch), length):
                first, count, hashes = segments(np.frombuffer(data, np.uint8), ends, length)
                there, hot = anchors.of(block, hashes)
                signed = hashes.view(np.int64)
                for i in np.flatnonzero(there).tolist():
                    at, n, anchor = int(first[i]), int(count[i]), int(signed[i])
                    parts = ((None, at + j, 1) for j in range(n)) if hot[i] else ((anchor, at, n),)
                    for group, a, starts in parts:
                        string = data[a:a + starts + length - 1]
                        key = (group, *_key(string, int(hashes[i])))
                        if key in held:
                            held[key][1] += 1
                        else:
                            held[key] = [starts, 1, None if group is None else string]
                            size += len(string) if group is not None else 64
        if held:
            yield rows(held, current)
    return run


def two_stage_order(data: bytes, ends: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """The starts first[i] .. first[i] + count[i] - 1 of each string in the order of their next ``length`` bytes.

    ``data`` holds strings with the given ends, ``first`` is where each begins; an end is smaller than any byte.
    Only suffixes smaller than their successors are sorted directly. The others follow from a scan of the buckets
    by first byte in order: each suffix met puts its predecessor, if larger, next in that one's bucket.
    """
    size = len(data)
    text = np.frombuffer(data, np.uint8).astype(np.int16)
    end_of = np.repeat(ends, np.diff(np.concatenate(([0], ends)))).astype(np.int64)
    after = np.append(text[1:], -1)
    after[ends - 1] = -1
    differs = np.flatnonzero(text != after)  # the last place of each string is one
    decides = differs[np.searchsorted(differs, np.arange(size))]
    smaller = text[decides] < after[decides]
    ups = np.append(np.flatnonzero(smaller), size)
    last = first + count - 1
    chain = np.minimum(ups[np.searchsorted(ups, last)], end_of[last] - 1)  # what the last start follows from
    needed = np.zeros(size + 1, np.int32)
    np.add.at(needed, first, 1)
    np.add.at(needed, chain + 1, -1)
    needed = np.cumsum(needed)[:-1] > 0

    direct = np.flatnonzero(needed & smaller)
    direct = _sorted(data, direct, np.minimum(direct + length, end_of[direct]))
    larger = needed & ~smaller
    byte_of = text[direct]
    bounds = np.searchsorted(byte_of, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def follow(met: np.ndarray, byte: int) -> np.ndarray:
        """Deal the larger predecessors of ``met`` to their buckets; those of this very bucket come back."""
        before = met - 1
        before = before[(before >= 0) & larger[before]]
        before = before[end_of[before] > before + 1] if byte >= 0 else before
        if not len(before):
            return before
        bytes_ = text[before]
        again = before[bytes_ == byte]
        rest, bytes_ = before[bytes_ != byte], bytes_[bytes_ != byte]
        if len(rest):
            by = np.argsort(bytes_, kind="stable")
            rest, bytes_ = rest[by], bytes_[by]
            cuts = np.flatnonzero(np.diff(bytes_)) + 1
            for part, b in zip(np.split(rest, cuts), bytes_[np.concatenate(([0], cuts))].tolist()):
                waiting[b].append(part)
        return again

    follow(ends.astype(np.int64), -1)  # each string's end comes before all suffixes
    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        while len(wave):
            order.append(wave)
            wave = follow(wave, byte)
        own = direct[bounds[byte]:bounds[byte + 1]]
        if len(own):
            order.append(own)
            follow(own, byte)
    found = np.concatenate(order) if order else np.empty(0, np.int64)
    started = np.zeros(size + 1, np.int32)
    np.add.at(started, first, 1)
    np.add.at(started, first + count, -1)
    return found[np.cumsum(started)[found] > 0]


def _sorted(data: bytes, places: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``places`` in the order of data[place:to], by their first eight bytes and then in full where these are equal."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    keys = np.zeros(len(places), np.uint64)
    for i in range(8):
        keys = keys << np.uint64(8) | np.where(places + i < to, padded[places + i], 0).astype(np.uint64)
    by = np.argsort(keys, kind="stable")
    places, to, keys = places[by], to[by], keys[by]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
    size = np.diff(cuts)
    for a, b in zip(cuts[:-1][size > 1].tolist(), cuts[1:][size > 1].tolist()):
        some = sorted(zip(places[a:b].tolist(), to[a:b].tolist()), key=lambda x: data[x[0]:x[1]])
        places[a:b] = [x[0] for x in some]
    return places


def repeated_starts(strings: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """For each string which of its first starts begin ``length`` bytes that another start also begins."""
    data = b"".join(strings)
    ends = np.cumsum([len(s) for s in strings])
    first = ends - [len(s) for s in strings]
    order = two_stage_order(data, ends, first, np.array(starts), length).tolist()
    found = np.zeros(len(data), bool)
    for a, b in zip(order, order[1:]):
        if data[a:a + length] == data[b:b + length]:  # the common prefix of neighbours
            found[a] = found[b] = True
    return [found[f:f + n] for f, n in zip(first.tolist(), starts)]


_SPANS = {"low": pa.int64(), "high": pa.int64(), "spans": pa.list_(pa.int32())}


def _spans(mask: np.ndarray) -> list[int]:
    """Runs of true values as first, end, first, end, ..."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist()


def _compare(length: int):
    """Sorted segments in, and for every block's segment the runs of its starts that repeat."""
    def done(groups):
        # A segment: its key, starts, string, whether it repeats as a whole, and the blocks that have it.
        found = repeated_starts([s[2] for s in groups], [s[1] for s in groups], length)
        out = []
        for (key, starts, _, whole, places), mask in zip(groups, found):
            if spans := [0, starts] if whole else _spans(mask):
                out += [(*place, *key, spans) for place in places]
        kinds = {"_file": pa.int64(), "_block": pa.int32(), **_SPANS}
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds.values())], list(kinds))

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(8)))

    def run(batches):
        held, size = [], 0
        for _, group in groupby(rows(batches), key=lambda r: r[2]):
            for key, same in groupby(group, key=lambda r: (r[3], r[4])):
                same = list(same)
                held.append((key, same[0][5], same[0][7], sum(r[6] for r in same) > 1, [(r[0], r[1]) for r in same]))
                size += len(same[0][7])
            if size >= BATCH:
                yield done(held)
                held, size = [], 0
        if held:
            yield done(held)
    return run


def _cut(length: int, anchors_at: str, spans_at: str, finish):
    """For every text which bytes go; ``finish`` makes the rows of a run of documents."""
    def run(batches):
        anchors, load, current, known = _Anchors(anchors_at), beside(spans_at, pa.schema(list(_SPANS.items()))), None, {}
        for block, batch in runs(batches, _STEP_ROWS):
            if block != current:
                table, current = load(block), block
                known = dict(zip(zip(table.column("low").to_pylist(), table.column("high").to_pylist()), table.column("spans").to_pylist()))
            texts = _texts(batch)
            gone = [np.zeros(len(t) + 1, np.int32) if len(t) >= length and known else None for t in texts]
            for data, ends, places in _chunks(texts, length) if known else ():
                first, count, hashes = segments(np.frombuffer(data, np.uint8), ends, length)
                there, hot = anchors.of(block, hashes)
                piece_at = np.array([p[2] for p in places])
                for i in np.flatnonzero(there).tolist():
                    at, n = int(first[i]), int(count[i])
                    for a, starts in [(at + j, 1) for j in range(n)] if hot[i] else [(at, n)]:
                        if spans := known.get(_key(data[a:a + starts + length - 1], int(hashes[i]))):
                            text, offset, place = places[np.searchsorted(piece_at, a, side="right") - 1]
                            for low, high in zip(spans[::2], spans[1::2]):
                                gone[text][a - place + offset + low] += 1
                                gone[text][a - place + offset + high + length - 1] -= 1
            yield finish(batch, texts, [g if g is None else np.cumsum(g)[:-1] > 0 for g in gone])
    return run


def _kept(text: bytes, gone: np.ndarray | None) -> bytes:
    return text if gone is None else np.frombuffer(text, np.uint8)[~gone].tobytes()


def _digest(batch, texts, gone):
    return pa.RecordBatch.from_pydict({
        "_id": batch.column("_id"),
        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
        "n_removed": pa.array([0 if g is None else int(g.sum()) for g in gone], pa.int64()),
        "n_spans": pa.array([0 if g is None else len(_spans(g)) // 2 for g in gone], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(_kept(t, g)).hexdigest() for t, g in zip(texts, gone)]),
    })


def _full(batch, texts, gone):
    return pa.RecordBatch.from_pydict({
        "_id": batch.column("_id"), "kept": pa.array([_kept(t, g) for t, g in zip(texts, gone)], pa.binary()),
        "spans": pa.array([[] if g is None else _spans(g) for g in gone], pa.list_(pa.int64())),
    })


def _repeats(docs: DataFrame, id_col: str, text_col: str, length: int, hot: int) -> tuple[DataFrame, str, str]:
    if not 1 << GRAM_BITS <= length <= CHUNK // 2:
        raise ValueError(f"strings have {1 << GRAM_BITS} to {CHUNK // 2} bytes")
    rows = blocks(docs, {"_id": F.col(id_col), "_text": F.col(text_col).cast("string")})
    place = "_file long, _block int"
    counted = rows.mapInArrow(_count(length), f"{place}, hash long, n long")
    times = F.sum("n").over(Window.partitionBy("hash"))
    anchors = counted.withColumn("times", times).where("times > 1").groupBy("_file", "_block", "hash").agg((F.max("times") > hot).alias("hot"))
    anchors_at = store(anchors)
    gathered = rows.mapInArrow(_gather(length, anchors_at), f"{place}, hash long, low long, high long, starts int, n long, string binary")
    # Hot anchors have single strings, told apart by their keys; the others whole segments, compared anchor by anchor.
    spread = F.coalesce("hash", "low")
    gathered = gathered.repartition(spread).sortWithinPartitions(spread, "low", "high")
    found = gathered.mapInArrow(_route(length), f"{place}, low long, high long, spans array<int>")
    return rows, anchors_at, store(found)


def _route(length: int):
    """Single strings repeat if their key does; segments go to ``_compare``."""
    compare = _compare(length)
    kinds = {"_file": pa.int64(), "_block": pa.int32(), **_SPANS}

    def run(batches):
        key, times, places, out = None, 0, [], []

        def close():
            if times > 1:
                out.extend((*p, *key, [0, 1]) for p in places)

        def segments_only():
            nonlocal key, times, places
            for batch in batches:
                single = pc.is_null(batch.column("hash"))
                for file, block, low, high, n in zip(*(batch.column(c).filter(single).to_pylist() for c in ("_file", "_block", "low", "high", "n"))):
                    if (low, high) != key:
                        close()
                        key, times, places = (low, high), 0, []
                    times += n
                    places.append((file, block))
                yield batch.filter(pc.invert(single))

        def ready():
            found = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds.values())], list(kinds))
            out.clear()
            return found

        for found in compare(segments_only()):
            yield found
            if out:
                yield ready()
        close()
        if out:
            yield ready()
    return run


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = HOT) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 of its UTF-8 text without repeated strings.

    A byte goes if a string of ``length`` bytes over it also starts elsewhere, in any document or its own;
    strings are judged on the whole input. Null and empty texts have no bytes, rows with equal ids are
    documents of their own. The documents are never shuffled.

    Strings can only repeat where their anchors do, so the segments around repeated anchors alone are
    compared: equal ones are merged per block and again per anchor, and the rest is put in suffix order
    by two-stage sorting, a bounded batch of whole anchors at a time, where neighbours with a common
    prefix of ``length`` bytes repeat. Anchors with more than ``hot`` occurrences would not fit a batch: their strings
    are spread by 128-bit hashes of each string instead, merged per block, and counted.
    """
    rows, anchors_at, spans_at = _repeats(docs, id_col, text_col, length, hot)
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(_cut(length, anchors_at, spans_at, _digest), f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("_id", id_col)


def without_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = HOT) -> DataFrame:
    """Per document: id, kept (the bytes left, joined) and spans (removed runs as first, end, first, end, ...)."""
    rows, anchors_at, spans_at = _repeats(docs, id_col, text_col, length, hot)
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(_cut(length, anchors_at, spans_at, _full), f"_id {kind}, kept binary, spans array<long>")
    return out.withColumnRenamed("_id", id_col)
