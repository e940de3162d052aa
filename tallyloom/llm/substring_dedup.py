"""Substring dedup on words: repeated windows found by level-wise doubling."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .blocks import beside, blocks, runs, store
from .common import stored

#: Words that one step of a task hashes at once, and documents it takes for that.
STEP_WORDS, STEP_ROWS = 1 << 17, 256
_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NO_ID = np.iinfo(np.int64).max


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The low and the high 64 bits of every word's hash. Hashing a word costs less than finding it in a large dictionary."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2).astype(np.uint64)
    return np.ascontiguousarray(halves[:, 1]), np.ascontiguousarray(halves[:, 0])


def _windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive words, document ends ignored."""
    count = max(0, len(hashes) - length + 1)
    out = np.zeros(count, np.uint64)
    for i in range(length):
        out += hashes[i:i + count] * _FACTORS[i]
    return out


def _whole(ends: np.ndarray, count: int, length: int) -> np.ndarray:
    """Which window starts 0..count have ``length`` words left in their document."""
    starts = np.concatenate(([0], ends[:-1]))
    left = np.repeat(ends, ends - starts)[:count] - np.arange(count)
    return left >= length


def _anchors(short: np.ndarray, windows: int, wide: int) -> np.ndarray:
    """For every long window, the place of the smallest of its ``wide`` short ones, the first of equals.

    Equal windows pick the same one, so a long window can repeat only where its anchor does.
    """
    best, place = short[:windows].copy(), np.arange(windows)
    for i in range(1, wide):
        other = short[i:i + windows]
        less = other < best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + i
    return place


def _texts(batch: pa.RecordBatch):
    """(first document, their words, ends of their words) for documents of about ``STEP_WORDS`` words."""
    words, ends, first = [], [], 0
    for i, text in enumerate(batch.column("_text").to_pylist()):
        words += (text or "").encode("utf-8", "surrogatepass").split()
        ends.append(len(words))
        if len(words) >= STEP_WORDS:
            yield first, words, np.array(ends)
            words, ends, first = [], [], i + 1
    if ends:
        yield first, words, np.array(ends)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _record(columns: dict, block: tuple[int, int]) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    full = {"_file": pa.repeat(pa.scalar(block[0], pa.int64()), size), "_block": pa.repeat(pa.scalar(block[1], pa.int32()), size)}
    return pa.RecordBatch.from_pydict(full | {k: pa.array(v) for k, v in columns.items()})


def _by_block(batches, collect, merge, most):
    """Collect from every run of rows, merge and yield when the block changes or has ``most`` windows."""
    held, size, current = [], 0, None
    for block, rows in runs(batches, STEP_ROWS):
        if held and (block != current or size > most):
            yield _record(merge(held), current)
            held, size = [], 0
        current = block
        for found in collect(block, rows):
            held.append(found)
            size += len(found[0])
    if held:
        yield _record(merge(held), current)


def _first_level(length: int, window: int):
    """Sampled short windows: one row per block and hash, and whether the block's documents repeat it."""
    def collect(_, batch):
        for _first, tokens, ends in _texts(batch):
            low, _high = _hashes(tokens)
            short = _windows(low, length)
            count = max(0, len(low) - window + 1)
            anchors = _anchors(short, count, window - length + 1)[_whole(ends, count, window)]
            anchors = np.unique(anchors)
            owner = np.searchsorted(ends, anchors, side="right")
            order = np.argsort(short[anchors], kind="stable")  # owners ascend already
            hashes, owner = short[anchors][order], owner[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            yield (hashes[new],)

    def merge(held):
        hashes, times = np.unique(np.concatenate([x[0] for x in held]), return_counts=True)
        return {"hash": hashes.view(np.int64), "many": times > 1}

    return lambda batches: _by_block(batches, collect, merge, 1 << 19)


def _second_level(length: int, window: int, folder: str):
    """Whole windows whose anchor repeats: one row per block and hash, with the ids' range."""
    load = beside(folder, pa.schema([("hash", pa.int64())]))
    last: list = [None, None]

    def collect(block, batch):
        if last[0] != block:
            last[:] = block, np.sort(load(block).column("hash").to_numpy().view(np.uint64))
        known = last[1]
        if not len(known):
            return
        ids = _ids(batch)
        for first, tokens, ends in _texts(batch):
            low, high = _hashes(tokens)
            short = _windows(low, length)
            count = max(0, len(low) - window + 1)
            starts = np.flatnonzero(_whole(ends, count, window))
            anchors = short[_anchors(short, count, window - length + 1)[starts]]
            at = np.searchsorted(known, anchors)
            starts = starts[known[np.minimum(at, len(known) - 1)] == anchors]
            owner = ids[first + np.searchsorted(ends, starts, side="right")]
            yield _windows(low, window)[starts], _windows(high, window)[starts], owner, owner

    def merge(held):
        low, high, least, most = (np.concatenate([x[i] for x in held]) for i in range(4))
        order = np.lexsort((high, low))
        low, high, least, most = low[order], high[order], least[order], most[order]
        if not len(low):
            return {"low": low.view(np.int64), "high": high.view(np.int64), "least": least, "most": most}
        new = np.concatenate(([0], np.flatnonzero((low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1))
        return {"low": low[new].view(np.int64), "high": high[new].view(np.int64),
                "least": np.minimum.reduceat(least, new), "most": np.maximum.reduceat(most, new)}

    return lambda batches: _by_block(batches, collect, merge, 1 << 18)


_OWNERS = pa.schema([("low", pa.int64()), ("high", pa.int64()), ("least", pa.int64())])


def _removed(window: int, folder: str, finish):
    """For every document which words go; ``finish`` makes the rows of a run of documents."""
    load = beside(folder, _OWNERS)

    def run(batches):
        seen, known = None, None
        for block, batch in runs(batches, STEP_ROWS):
            if block != seen:
                table = load(block)
                low, high = (table.column(c).to_numpy().view(np.uint64) for c in ("low", "high"))
                order = np.lexsort((high, low))
                known, seen = (low[order], high[order], table.column("least").to_numpy()[order]), block
            ids, found = _ids(batch), []
            for first, tokens, ends in _texts(batch):
                gone = np.zeros(len(tokens) + 1, np.int64)
                if len(known[0]) and len(tokens) >= window:
                    low, high = (_windows(x, window) for x in _hashes(tokens))
                    starts = np.flatnonzero(_whole(ends, len(low), window))
                    low, high, owner = low[starts], high[starts], ids[first + np.searchsorted(ends, starts, side="right")]
                    at = np.searchsorted(known[0], low)
                    while True:  # equal first halves of the hash: step to the right second half
                        here = np.minimum(at, len(known[0]) - 1)
                        behind = (known[0][here] == low) & (known[1][here] < high) & (at < len(known[0]))
                        if not behind.any():
                            break
                        at = at + behind
                    hit = (known[0][here] == low) & (known[1][here] == high) & (known[2][here] < owner)
                    np.add.at(gone, starts[hit], 1)
                    np.add.at(gone, starts[hit] + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()):
                    found.append((tokens[a:b], gone[a:b]))
            yield finish(batch, found)
    return run


def _digest(batch, found):
    kept = [b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else b" ".join(words) for words, gone in found]
    return pa.RecordBatch.from_pydict({
        "_id": batch.column("_id"),
        "n_words": pa.array([len(w) for w, _ in found], pa.int64()),
        "n_removed": pa.array([int(g.sum()) for _, g in found], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    })


def _owners(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, str]:
    """The documents by block, and the folder with each block's repeated windows and their first owner."""
    if window < 2:
        raise ValueError("a window has at least two words")
    length = window // 2 + 1
    rows = blocks(docs, {"_id": F.col(id_col).cast("long"), "_text": F.col(text_col).cast("string")})
    place = "_file long, _block int"
    short = rows.mapInArrow(_first_level(length, window), f"{place}, hash long, many boolean")
    times = F.sum(F.when(F.col("many"), 2).otherwise(1)).over(Window.partitionBy("hash"))
    repeated = store(short.withColumn("times", times).where("times > 1").select("_file", "_block", "hash").distinct())
    whole = rows.mapInArrow(_second_level(length, window, repeated), f"{place}, low long, high long, least long, most long")
    owner = F.min("least").over(Window.partitionBy("low", "high"))
    owned = whole.withColumn("owner", owner).where("most > owner")
    owned = owned.select("_file", "_block", "low", "high", F.col("owner").alias("least")).distinct()
    return rows, store(owned)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller id.
    Ids are integers; a null id counts as the largest, and rows with equal ids never remove from one
    another. Null and empty texts have no words. Words are split at ASCII white space alone.

    Level-wise doubling: windows of half the length are sampled so that every whole window holds
    one (``_anchors``), and counted; only where one repeats is it extended to the whole window.
    Window hashes have 128 bits. Each level reduces to one row per block and hash before its shuffle.
    """
    rows, folder = _owners(docs, id_col, text_col, window)
    found = rows.mapInArrow(_removed(window, folder, _digest), "_id long, n_words long, n_removed long, kept_sha256 string")
    return found.withColumnRenamed("_id", id_col)


def drop_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``docs`` with the repeated words taken out of its text; documents that lose none stay as they are.

    Kept words of a changed text are joined by one space; a text that loses all becomes empty. Rows,
    ids and the other columns stay.
    """
    docs = stored(docs)
    _, folder = _owners(docs, id_col, text_col, window)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = docs.columns.index(text_col)
    rows = blocks(docs, {
        "_id": F.col(id_col).cast("long"), "_text": F.col(text_col).cast("string"),
        **{n: F.col(f"`{c}`") for i, (n, c) in enumerate(zip(names, docs.columns)) if i != text},
    })

    def changed(batch, found):
        before = batch.column("_text").to_pylist()
        after = [t if not g.any() else b" ".join([w for w, x in zip(words, g.tolist()) if not x]).decode("utf-8", "surrogatepass")
                 for t, (words, g) in zip(before, found)]
        columns = [pa.array(after, pa.string()) if i == text else batch.column(n) for i, n in enumerate(names)]
        return pa.RecordBatch.from_arrays(columns, names)

    kinds = [(n, f.dataType.simpleString()) for n, f in zip(names, docs.schema.fields)]
    kinds[text] = (names[text], "string")
    out = rows.mapInArrow(_removed(window, folder, changed), ", ".join(f"{n} {k}" for n, k in kinds))
    return out.toDF(*docs.columns)
