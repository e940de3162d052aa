"""Byte-level BPE: distinct words are merged by higher-order functions, texts are put together from them."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from .blocks import beside, blocks, runs, store

#: Bytes above which a word is merged by itself instead of folded.
LONG = 256
#: Words that a task holds before it passes them on.
_HELD, _STEP = 1 << 20, 256
NONE = 1 << 16


def read_ranks(file: str) -> dict[bytes, int]:
    """Token -> rank, which is its id, from a rank file: a base64 token and a number a line."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """left id << 16 | right id -> rank of the two put together, for all pairs of tokens that are a token."""
    if max(ranks.values()) >= NONE:
        raise ValueError("ids have 16 bits at most")
    found = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                found[left << 16 | right] = rank
    return found


def rank_map(pairs: dict[int, int]) -> np.ndarray:
    """``pairs`` as an array in which Spark finds a key at one of two places, told by its xxhash64.

    Each entry is key << 16 | rank, -1 where there is none. The size follows from the vocabulary.
    """
    size = 1 << max(4, (len(pairs) * 5 // 2).bit_length())
    table = [-1] * size
    for key, rank in pairs.items():
        entry, at = key << 16 | rank, None
        for _ in range(500):
            one, two = _places(entry >> 16, size)
            at = one if at is None else two if at == one else one
            if table[one] < 0 or table[two] < 0:
                at = one if table[one] < 0 else two
            table[at], entry = entry, table[at]
            if entry < 0:
                break
        else:
            raise ValueError("the pairs cannot be placed")
    return np.array(table, np.int64)


def _places(key: int, size: int) -> tuple[int, int]:
    value = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    return value & (size - 1), value >> 32 & (size - 1)


def fold(words: str, table: str, size: int) -> F.Column:
    """Merge every word of an array column, each an array of ids: the pair of the least rank first, the first of equals.

    A fold over the word's length. Each id is held as rank << 32 | place << 16 | id, with the rank of it and its
    successor, so the least number is the pair to join next and tells where it stands, and only the two ranks beside a
    joined pair are looked up again. Once no pair has a rank, -1 behind the word tells the steps that follow to leave it as
    it is. ``aggregate`` over one value gives it a name: an item of an array would have its type found again at every step.
    """
    at = [f"get({table}, cast(xxhash64(key) & {size - 1} as int))", f"get({table}, cast(shiftrightunsigned(xxhash64(key), 32) & {size - 1} as int))"]
    rank = "case " + " ".join(f"when shiftright({x}, 16) = key then {x} & 65535" for x in at) + " else r end"

    def ranked(left: str, right: str, behind: str) -> str:
        return f"shiftleft(aggregate(array(shiftleft({left}, 16) | {right}), {NONE}L, (r, key) -> {rank}), 32) | {behind}"

    start = ranked("cast(a as bigint)", "get(v, i + 1)", "(cast(i as bigint) * 65536 + a)")
    joined = ranked("shiftright(m, 32)", "(get(w, k + 2) & 65535)", "(m & 4294901760) | shiftright(m, 32)")
    before = ranked("(x & 65535)", "shiftright(m, 32)", "(x & 4294967295)")
    merged = ("transform(filter(w, (x, i) -> i != k + 1), (x, i) -> "
              f"case when i > k then x - 65536 when i < k - 1 then x when i = k then {joined} else {before} end)")
    step = (f"aggregate(array(array_min(w)), w, (u, m) -> if(m >= {NONE << 32}, concat(w, array(-1L)), "
            f"aggregate(array(cast(shiftright(m, 16) & 65535 as int)), w, (u, k) -> {merged})))")
    ended = "get(w, size(w) - 1) < 0"
    ids = f"transform(if({ended}, slice(w, 1, size(w) - 1), w), x -> cast(x & 65535 as int))"
    return F.expr(f"transform({words}, v -> if(size(v) < 2, v, aggregate(sequence(2, size(v)), transform(v, (a, i) -> {start}), "
                  f"(w, i) -> if({ended}, w, {step}), w -> {ids})))")


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, in time n log n: a heap of pairs over a linked list."""
    size = len(word)
    after, before, end = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))
    alive = [True] * size

    def pair(i: int):
        j = after[i]
        rank = ranks.get(word[i:end[j]]) if j < size else None
        return None if rank is None else (rank, i, end[i], end[j])

    heap = [p for p in map(pair, range(size)) if p]
    heapq.heapify(heap)
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or end[i] != middle or j >= size or end[j] != last:
            continue
        alive[j], end[i], after[i] = False, last, after[j]
        if after[i] < size:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    out, i = [], 0
    while i < size:
        out.append(ranks[word[i:end[i]]])
        i = after[i]
    return out


def ascii_form(pattern: str) -> re.Pattern | None:
    """The pattern for texts of ASCII alone, where letters and numbers are short classes; None if it has others."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        kind = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}.get(pattern[at:at + 5])
        if kind:
            out.append(kind if inside else f"[{kind}]")
            at += 5
        elif pattern[at] == "\\":
            if pattern[at + 1:at + 2] in "pPX":
                return None
            out.append(pattern[at:at + 2])
            at += 2
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
    try:
        return re.compile("".join(out), re.ASCII)
    except re.error:
        return None


@lru_cache(maxsize=4)
def wide_form(pattern: str) -> re.Pattern | None:
    """The pattern for texts without characters above U+FFFF, with its classes written out as ``regex`` has them; None if it has others."""
    if re.search(r"\(\?[a-zA-Z]", pattern):  # flags
        return None
    out, inside, at = [], False, 0
    while at < len(pattern):
        kind = pattern[at:at + 5] if pattern[at:at + 5] in (r"\p{L}", r"\p{N}") else pattern[at:at + 2] if pattern[at:at + 2] in (r"\s", r"\S") else ""
        if kind:
            if inside and kind == r"\S":
                return None
            chars = _ranges(kind.lower() if kind == r"\S" else kind)
            out.append(chars if inside else f"[^{chars}]" if kind == r"\S" else f"[{chars}]")
            at += len(kind)
        elif pattern[at] == "\\":
            if pattern[at + 1:at + 2].isalnum() and pattern[at + 1] not in "nrtfv":
                return None
            out.append(pattern[at:at + 2])
            at += 2
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
    try:
        return re.compile("".join(out))
    except re.error:
        return None


def _ranges(kind: str) -> str:
    """The characters up to U+FFFF of a class, as the inside of a bracket."""
    found: list[list[int]] = []
    for c in map(ord, regex.findall(kind, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])))):
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{z:04x}" for a, z in found)


def splitter(pattern: str):
    """Text -> its words. The standard library is quicker than ``regex`` where it can stand in for it."""
    full, plain, wide = regex.compile(pattern).findall, ascii_form(pattern), wide_form(pattern)

    def find(text: str) -> list[str]:
        if plain and text.isascii():
            return plain.findall(text)
        if wide and len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return wide.findall(text)
        return full(text)
    return find


def _distinct(pattern: str):
    """The distinct words of each block."""
    def rows(words, block):
        words = pa.array(words, pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(block[0], pa.int64()), len(words)), pa.repeat(pa.scalar(block[1], pa.int32()), len(words)), words], ["_file", "_block", "word"])

    def run(batches):
        find, held, current = splitter(pattern), set(), None
        for block, batch in runs(batches, _STEP):
            if held and (block != current or len(held) > _HELD):
                yield rows(held, current)
                held = set()
            current = block
            for text in batch.column("_text").to_pylist():
                held.update(find(text or ""))
        if held:
            yield rows(held, current)
    return run


@lru_cache(maxsize=1)
def _vocabulary(file: str) -> tuple[dict[bytes, int], pa.Array, np.ndarray, np.ndarray]:
    """Ranks; the tokens and their ranks as arrays; the rank of every byte."""
    ranks = read_ranks(file)
    return ranks, pa.array(list(ranks), pa.binary()), np.array(list(ranks.values()), np.int32), np.array([ranks[bytes([i])] for i in range(256)], np.int32)


def _one(values: pa.Array) -> pa.ListArray:
    """An array as the only list of a column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _rows_of_words(file: str):
    """Sorted words in, one row for the distinct words of each batch out: word, ids to merge, files and blocks that have it.

    A word that is a token comes with its id, one too long to fold with all its ids; there is nothing to
    merge then. A word that goes on in the next batch is folded there again.
    """
    def run(batches):
        ranks, tokens, token_ranks, single = _vocabulary(file)
        for batch in batches:
            words, files, blocks_ = batch.column("word"), batch.column("_file").to_numpy(), batch.column("_block").to_numpy()
            runs_ = pc.run_end_encode(words)
            ends = np.asarray(runs_.run_ends)
            # A block read by two tasks has told of a word twice.
            new = np.ones(len(files), bool)
            new[1:] = (files[1:] != files[:-1]) | (blocks_[1:] != blocks_[:-1])
            new[np.concatenate(([0], ends[:-1]))] = True
            places = np.concatenate(([0], np.cumsum(new)[ends - 1])).astype(np.int32)
            raw = runs_.values.cast(pa.binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
            letters, size = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], np.diff(offsets)
            token = pc.index_in(raw, tokens)
            known = pc.is_valid(token).to_numpy(zero_copy_only=False)
            long = ~known & (size > LONG)
            folded = ~known & ~long
            parts = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.where(folded, size, 0)))).astype(np.int32),
                                             pa.array(single[letters[np.repeat(folded, size)]]))
            done = pa.array([merge_long(raw[i].as_py(), ranks) if x else None for i, x in enumerate(long.tolist())] if long.any() else [None] * len(raw), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([
                _one(runs_.values), _one(parts), _one(pa.array(np.where(known, token_ranks[token.fill_null(0).to_numpy()], -1).astype(np.int32))), _one(done),
                _one(pa.ListArray.from_arrays(pa.array(places), pa.array(files[new]))), _one(pa.ListArray.from_arrays(pa.array(places), pa.array(blocks_[new]))),
            ], ["word", "parts", "token", "done", "files", "blocks"])
    return run


def _by_place(batches):
    """Rows of folded words in, one row per block and word out; ids as unsigned 16-bit integers."""
    for batch in batches:
        words, folded, token, done, files, blocks_ = (batch.column(i).flatten() for i in range(6))
        token, size = token.to_numpy(), pc.list_value_length(folded).to_numpy()
        known = token >= 0
        size = np.where(known, 1, size)
        ids = np.empty(size.sum(), "<u2")
        of_token = np.repeat(known, size)
        ids[of_token], ids[~of_token] = token[known], folded.flatten().to_numpy()
        offsets = np.concatenate(([0], np.cumsum(2 * size))).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
        if done.null_count < len(done):
            packed = pa.array([np.array(d, "<u2").tobytes() if d is not None else x for x, d in zip(packed.to_pylist(), done.to_pylist())], pa.binary())
        at = np.repeat(np.arange(len(words)), pc.list_value_length(files).to_numpy())
        yield pa.RecordBatch.from_arrays(
            [files.flatten(), blocks_.flatten(), pc.take(words, at), pc.take(packed, at)], ["_file", "_block", "word", "ids"])


_WORDS = pa.schema([("word", pa.string()), ("ids", pa.binary())])


def _texts(folder: str, pattern: str, finish):
    """The ids of every text, put together from the words of its block; ``finish`` makes the rows."""
    def run(batches):
        load, find, current, known = beside(folder, _WORDS), splitter(pattern), None, {}
        for block, batch in runs(batches, _STEP):
            if block != current:
                table, current = load(block), block
                known = dict(zip(table.column("word").to_pylist(), table.column("ids").to_pylist()))
            word = known.__getitem__
            ids = [np.frombuffer(b"".join(map(word, find(t or ""))), "<u2").astype("<u4") for t in batch.column("_text").to_pylist()]
            yield finish(batch, ids)
    return run


class Decoder:
    """Ids back to bytes: the binary pieces of the vocabulary, one after the other."""

    def __init__(self, file: str):
        ranks = read_ranks(file)
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        self.pieces = pa.array(pieces, pa.large_binary())

    def __call__(self, texts: list[np.ndarray]) -> list[bytes]:
        taken = self.pieces.take(pa.array(np.concatenate([np.empty(0, np.uint32), *texts])))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[:len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        data = memoryview(taken.buffers()[2] or b"")
        ends = offsets[np.cumsum([0, *map(len, texts)])].tolist()
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]


def _words(docs: DataFrame, file: str, pattern: str, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The documents by block, and the folder with each block's words and their ids."""
    spark = docs.sparkSession
    rows = blocks(docs, {"_id": F.col(id_col), "_text": F.col(text_col).cast("string")})
    words = rows.mapInArrow(_distinct(pattern), "_file long, _block int, word string")
    words = words.repartition("word").sortWithinPartitions("word", "_file", "_block")
    many = words.mapInArrow(_rows_of_words(file), "word array<string>, parts array<array<int>>, token array<int>, done array<array<int>>, "
                            "files array<array<long>>, blocks array<array<int>>")
    ranks = rank_map(pair_ranks(read_ranks(file)))
    # One row of the vocabulary's own size; as a subquery it is a literal to each task.
    offsets = pa.array([0, len(ranks)], pa.int32())
    literal = spark.createDataFrame(pa.table({"ranks": pa.ListArray.from_arrays(offsets, pa.array(ranks))}))
    many = many.withColumn("ranks", literal.scalar())
    folded = many.select("word", fold("parts", "ranks", len(ranks)).alias("folded"), "token", "done", "files", "blocks")
    return rows, store(folded.mapInArrow(_by_place, "_file long, _block int, word string, ids binary"))


def encoded(docs: DataFrame, file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ids (little-endian unsigned 32-bit) of its whole text by a rank file, without special tokens.

    ``pattern`` splits a text into words; each is merged by itself. Null and empty texts have no ids.
    Every distinct word of the corpus is folded once (see ``fold``), and a block then reads the ids of its
    own words; documents are never shuffled, a word of any frequency has one row a block. The rank file stands at
    the same path on every machine.
    """
    def finish(batch, ids):
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([x.tobytes() for x in ids], pa.binary())], ["_id", "ids"])

    rows, folder = _words(docs, file, pattern, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_texts(folder, pattern, finish), f"_id {kind}, ids binary").withColumnRenamed("_id", id_col)


def decoded(tokens: DataFrame, file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, bytes of its ids put together; null ids have none."""
    def run(batches):
        decode = Decoder(file)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                texts = decode([np.frombuffer(x or b"", "<u4") for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(texts, pa.binary())], ["_id", "bytes"])

    rows = tokens.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, bytes binary").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256, where the ids are decoded again in the task that made them."""
    decoder: list[Decoder] = []

    def finish(batch, ids):
        if not decoder:
            decoder.append(Decoder(file))
        return pa.RecordBatch.from_arrays([
            batch.column("_id"), pa.array(map(len, ids), pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoder[0](ids)], pa.string()),
        ], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows, folder = _words(docs, file, pattern, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(_texts(folder, pattern, finish), f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)
