"""Ranked lexical search: shards of compressed posting lists, searched by Block-Max MaxScore."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scratch import materialize
from .blocks import beside, store, tidy
from .common import ascii_lower, numbered, stored

# What separates terms, and the constants of a score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BLANK = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
FLAT, SLOPE, SCALE = 25, 75, 8
UNIT, FACTOR = 1_000_000_000, 1_000
#: A shard closes at so many bytes of text, documents or distinct terms, whichever comes first.
SHARD_BYTES, SHARD_DOCS, SHARD_TERMS = 1 << 25, 1 << 17, 1 << 19
#: Bytes of text whose terms are counted at once, postings a block, documents a window, items read at once, items whose best scores a task remembers.
PIECE, BLOCK, WINDOW, ITEMS, HELD = 1 << 21, 128, 1 << 12, 1 << 12, 1 << 16
_LISTS = [
    ("_term", pa.binary()), ("_df", pa.int32()), ("_total", pa.int64()), ("_postings", pa.binary()), ("_last", pa.list_(pa.int32())),
    ("_ends", pa.list_(pa.int32())), ("_pairs", pa.list_(pa.int32())), ("_tf", pa.list_(pa.int32())), ("_n", pa.list_(pa.int32())),
]
_DDL = "_shard long, _term binary, _df int, _total long, _postings binary, _last array<int>, _ends array<int>, _pairs array<int>, _tf array<int>, _n array<int>"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, the lowest first and all but the last with the high bit set; and where each one ends."""
    size = 1 + sum((values >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    ends = np.cumsum(size)
    octets = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for i in range(int(size.max(initial=0))):
        has = size > i
        octets[(ends - size)[has] + i] = values[has] >> 7 * i & 127 | (size[has] > i + 1) << 7
    return octets, ends


def unpack(octets: np.ndarray) -> np.ndarray:
    is_last = octets < 128
    if is_last.all():
        return octets.astype(np.int64)
    starts = np.concatenate(([0], np.flatnonzero(is_last)[:-1] + 1))
    sizes = np.diff(starts, append=len(octets))
    place = np.arange(len(octets)) - np.repeat(starts, sizes)
    return np.add.reduceat((octets & 127).astype(np.int64) << 7 * place, starts)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text = text.lower().translate(_BLANK)
    at = 0
    while at < len(text):
        to = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


@dataclass
class _Shard:
    """Documents on their way into a shard. Counts wait as (document << 32 | term) until ``PIECE`` bytes are in."""
    place: bytes = b""
    ids: list = field(default_factory=list)
    terms: dict = field(default_factory=dict)
    lengths: list = field(default_factory=list)
    waiting: list = field(default_factory=list)
    counted: list = field(default_factory=list)
    size: int = 0
    since: int = 0

    def __post_init__(self):
        self.terms = defaultdict()
        self.terms.default_factory = self.terms.__len__

    def add(self, place: dict, doc_id: object, text: bytes | None) -> None:
        if not self.ids:
            self.place = b"%d %d" % (place["file"], place["at"])
        doc, n, number = len(self.lengths), 0, self.terms.__getitem__
        self.ids.append(doc_id)
        for words in _pieces(text or b""):
            self.waiting.append(np.fromiter(map(number, words), np.int64, len(words)) | doc << 32)
            n += len(words)
            self.since += 6 * len(words)
            if self.since >= PIECE:
                self.count()
        self.lengths.append(n)
        self.size += len(text or b"") + 16

    def count(self) -> None:
        if self.waiting:
            self.counted.append(np.unique(np.concatenate(self.waiting), return_counts=True))
        self.waiting, self.since = [], 0

    def full(self) -> bool:
        return self.size >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS or len(self.terms) >= SHARD_TERMS

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The shard's index rows: first its documents in order of their ids, then a list for every term."""
        self.count()
        ids = pa.array(self.ids, kind)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        position = np.empty(len(order), np.int64)
        position[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)[order]
        number = xxhash.xxh3_64_intdigest(self.place)
        number -= (number >> 63) << 64
        schema = pa.schema([("_shard", pa.int64()), *_LISTS, ("_ids", pa.list_(kind))])
        nothing = pa.nulls(1)
        head = {
            "_shard": [number], "_df": [int((lengths > 0).sum())], "_total": [int(lengths.sum())], "_n": [lengths.astype(np.int32)],
            "_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))),
        }
        yield pa.RecordBatch.from_arrays([_column(head.get(f.name, nothing), f.type) for f in schema], schema=schema)
        if not self.counted:
            return
        keys = np.concatenate([k for k, _ in self.counted])
        counts = np.concatenate([c for _, c in self.counted])
        keys = (keys & 0xFFFFFFFF) << 32 | position[keys >> 32]
        by_term = np.argsort(keys, kind="stable")
        keys, counts = keys[by_term], counts[by_term]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))  # a long text is counted in pieces
        keys, counts = keys[first], np.add.reduceat(counts, first)
        lists = postings(keys >> 32, keys & 0xFFFFFFFF, counts, lengths)
        names = pa.array(list(self.terms), pa.binary())
        table = {"_shard": pa.array(np.full(len(names), number)), "_term": names, **lists}
        whole = pa.RecordBatch.from_arrays([table[f.name] if f.name in table else pa.nulls(len(names), f.type) for f in schema], schema=schema)
        for at in range(0, len(names), 1 << 14):
            yield whole.slice(at, 1 << 14)


def _column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def postings(terms: np.ndarray, docs: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> dict[str, pa.Array]:
    """Compressed lists of terms 0, 1, ... from sorted (term, document, count).

    A block is ``BLOCK`` postings: gaps of documents and counts. It keeps its last document, where its bytes end, and the
    pairs (count, document length) that no other pair of the block beats in both: the largest impact is among them whatever
    the average length of all documents turns out to be.
    """
    start = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
    df = np.diff(start, append=len(terms))
    gaps = np.diff(docs, prepend=-1)
    gaps[start] = docs[start] + 1
    octets, ends = pack(np.column_stack((gaps, counts)).ravel())
    ends = ends[1::2]
    inside = np.arange(len(terms)) - np.repeat(start, df)
    opens = np.flatnonzero(inside % BLOCK == 0)
    closes = np.concatenate((opens[1:], [len(terms)])) - 1
    per_list = (df + BLOCK - 1) // BLOCK
    list_bytes = np.concatenate(([0], ends[start[1:] - 1], ends[-1:]))
    block = np.repeat(np.arange(len(opens)), closes - opens + 1)
    n = lengths[docs]
    best = np.lexsort((n, -counts, block))
    # The running minimum of the length starts anew in each block, as later blocks are lower by more than any length.
    fall = n[best] - block[best] * (int(lengths.max()) + 1)
    lower = np.minimum.accumulate(fall)
    keep = np.concatenate(([True], fall[1:] < lower[:-1]))
    best = best[keep]
    pairs = np.bincount(block[best], minlength=len(opens))
    whole = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    ints = lambda values: pa.array(values.astype(np.int32))
    per_block = lambda values: pa.ListArray.from_arrays(whole(per_list), ints(values))
    list_of = np.repeat(np.arange(len(start)), per_list)
    per_pair = whole(np.bincount(list_of, weights=pairs, minlength=len(start)).astype(np.int64))
    return {
        "_df": ints(df), "_last": per_block(docs[closes]), "_ends": per_block(ends[closes] - list_bytes[list_of]), "_pairs": per_block(pairs),
        "_postings": pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(list_bytes.astype(np.int32)), pa.py_buffer(octets)]),
        "_tf": pa.ListArray.from_arrays(per_pair, ints(counts[best])), "_n": pa.ListArray.from_arrays(per_pair, ints(n[best])),
    }


def _index(batches):
    shard, kind = _Shard(), pa.int64()
    for batch in batches:
        kind = batch.column("_id").type
        places, ids, texts = (batch.column(n) for n in ("_row", "_id", "_text"))
        for i in range(batch.num_rows):
            shard.add(places[i].as_py(), ids[i].as_py(), texts[i].as_py())
            if shard.full():
                yield from shard.rows(kind)
                shard = _Shard()
    if shard.ids:
        yield from shard.rows(kind)
    tidy()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all terms of all whole texts, written to the shared folder: one row per shard and term, and one per shard.

    A shard is some tens of MB of neighbouring rows. Documents in it stand in the order of their ids (null ids last, equal ids as
    stored), so a smaller position wins a tie. A null text has no terms. Any extra columns are left out.
    """
    rows = numbered(stored(docs)).select("_row", F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(_index, f"{_DDL}, _ids array<{kind}>"))


class Lists:
    """The lists of one shard that some item needs, and what has been decompressed of them."""

    def __init__(self, ids: pa.Array, lengths: np.ndarray, parts: list[pa.RecordBatch], documents: int, total: int):
        self.ids, self.spread = ids, (documents, total)
        self.m = FLAT + SLOPE * lengths * documents // max(total, 1)
        table = pa.Table.from_batches(parts).combine_chunks() if parts else pa.table({n: pa.array([], t) for n, t in _LISTS})
        flat, cuts = {}, {}
        for name in ("_last", "_ends", "_pairs", "_tf", "_n"):
            column = table.column(name).combine_chunks()
            cuts[name] = column.offsets.to_numpy().astype(np.int64)
            cuts[name] -= cuts[name][:1].sum()  # a slice of a batch counts from where the batch begins
            flat[name] = column.flatten().to_numpy().astype(np.int64)
        self.number = {t: i for i, t in enumerate(table.column("_term").to_pylist())}
        self.data = table.column("_postings").to_pylist()
        self.at, self.last, self.ends = cuts["_last"], flat["_last"], flat["_ends"]
        opens = np.concatenate(([0], np.cumsum(flat["_pairs"])[:-1])) if len(flat["_pairs"]) else np.empty(0, np.int64)
        impacts = impact(flat["_tf"], FLAT + SLOPE * flat["_n"] * documents // max(total, 1))
        #: The largest impact of every block, and of every list.
        self.most = np.maximum.reduceat(impacts, opens) if len(opens) else impacts
        self.bound = np.maximum.reduceat(self.most, self.at[:-1]) if len(self.data) else impacts
        self.open: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.opened = 0

    def blocks(self, which: int) -> slice:
        return slice(self.at[which], self.at[which + 1])

    def block(self, which: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block, decompressed on first use."""
        key = which, block
        if key not in self.open:
            base = self.at[which] + block
            begin, before = (self.ends[base - 1], self.last[base - 1]) if block else (0, -1)
            values = unpack(np.frombuffer(self.data[which], np.uint8, self.ends[base] - begin, begin))
            docs = before + np.cumsum(values[::2])
            self.open[key] = docs, impact(values[1::2], self.m[docs])
            self.opened += 1
        return self.open[key]


def impact(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * counts // (FACTOR * counts + SCALE * m)


def best(lists: Lists, wanted: list[tuple[bytes, int]], k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Scores and positions of the ``k`` best documents of a shard among those that reach ``floor``; ties by position.

    ``wanted`` are terms with weights. Lists are ordered by their bounds. While the bounds of the first ones together stay below the
    score to reach, no document can get in by these alone: they are not essential. Windows of documents are taken one by one:
    candidates come from the essential lists; in the other lists, from the highest bound down, a candidate goes as soon as its score with the
    block maximum and the lists that are left falls short, and only blocks that hold a remaining candidate are decompressed.
    """
    found = sorted((int(lists.bound[i]) * w, i, w) for t, w in wanted if (i := lists.number.get(t)) is not None and w > 0)
    reach = np.cumsum([0] + [b for b, _, _ in found])  # reach[i]: the bounds of the first i lists
    scores, places = np.empty(0, np.int64), np.empty(0, np.int64)
    bar = max(floor, 1)
    last = [lists.last[lists.blocks(i)] for _, i, _ in found]
    most = [lists.most[lists.blocks(i)] * w for _, i, w in found]
    for low in range(0, len(lists.m), WINDOW):
        if reach[-1] < bar:
            break
        high = min(low + WINDOW, len(lists.m))
        spans = [(int(np.searchsorted(x, low)), min(int(np.searchsorted(x, high - 1)) + 1, len(x))) for x in last]
        if sum(int(m[a:b].max()) for m, (a, b) in zip(most, spans) if a < b) < bar:
            continue
        essential = int(np.searchsorted(reach[1:], bar))
        sums = np.zeros(high - low, np.int64)
        for (_, which, weight), (a, b) in zip(found[essential:], spans[essential:]):
            for block in range(a, b):
                docs, impacts = lists.block(which, block)
                x, y = np.searchsorted(docs, (low, high))
                sums[docs[x:y] - low] += weight * impacts[x:y]
        here = np.flatnonzero(sums)
        docs, sums = here + low, sums[here]
        for i in range(essential - 1, -1, -1):
            if not len(docs):
                break
            which, weight = found[i][1:]
            block = np.searchsorted(last[i], docs)
            top = np.concatenate((most[i], [0]))[block]
            keep = sums + top + reach[i] >= bar
            docs, sums, block = docs[keep], sums[keep], block[keep]
            for b in np.unique(block[block < len(last[i])]).tolist():
                x, y = np.searchsorted(block, (b, b + 1))
                there, impacts = lists.block(which, b)
                at = np.minimum(np.searchsorted(there, docs[x:y]), len(there) - 1)
                sums[x:y] += np.where(there[at] == docs[x:y], weight * impacts[at], 0)
        keep = sums >= bar
        scores, places = np.concatenate((scores, sums[keep])), np.concatenate((places, docs[keep]))
        order = np.lexsort((places, -scores))[:k]
        scores, places = scores[order], places[order]
        if len(scores) == k:
            bar = max(bar, int(scores[-1]))
    return scores, places


_QUERY = pa.schema([("_item_file", pa.int64()), ("_item_at", pa.int64()), ("_term", pa.binary()), ("_weight", pa.int64())])


def _search(folder: str, slices: int, documents: int, total: int, k: int):
    def run(batches):
        load = beside(folder, _QUERY)
        items: list = [None, None]
        remembered: dict[tuple[int, int], np.ndarray] = {}

        def of_slice(number: int):
            """The slice's items with their terms and weights; the last slice asked for is held."""
            if items[0] != number:
                held: dict[tuple[int, int], list] = {}
                table = load((0, number))
                for file, at, term, weight in zip(*(table.column(n).to_pylist() for n in _QUERY.names)):
                    held.setdefault((file, at), []).append((term, weight))
                items[:] = number, held
            return items[1]

        def searched(lists: Lists):
            rows, ids = [], []
            for number in range(slices):
                for item, wanted in of_slice(number).items():
                    before = remembered.get(item, np.empty(0, np.int64))
                    floor = int(before[-1]) if len(before) == k else 1
                    scores, places = best(lists, wanted, k, floor)
                    if not len(scores):
                        continue
                    if len(remembered) >= HELD and item not in remembered:
                        remembered.clear()  # what is forgotten is found again: only the floor is lower
                    remembered[item] = -np.sort(-np.concatenate((before, scores)))[:k]
                    rows += [(*item, int(s)) for s in scores]
                    ids.append(places)
                    if len(rows) >= 1 << 14:
                        yield _found(rows, ids, lists)
                        rows, ids = [], []
            if rows:
                yield _found(rows, ids, lists)

        for shard, lists in _shards(batches, documents, total):
            yield from searched(lists)
        tidy()
    return run


def _found(rows, ids, lists: Lists) -> pa.RecordBatch:
    table, places = np.array(rows, np.int64), np.concatenate(ids)
    columns = [pa.array(table[:, i]) for i in range(3)]
    return pa.RecordBatch.from_arrays([*columns, lists.ids.take(pa.array(places)), pa.array(places)], ["_file", "_at", "score", "_id", "_place"])


def _shards(batches, documents: int, total: int) -> Iterator[tuple[int, Lists]]:
    """Each shard with its lists; rows come sorted by shard, its documents first."""
    number, head, parts = None, None, []
    for batch in batches:
        shard = batch.column("_shard").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            if number != shard[a]:
                if head is not None:
                    yield number, Lists(*head, parts, documents, total)
                number, parts = shard[a], []
                first = batch.slice(a, 1)
                lengths = first.column("_n").flatten().to_numpy().astype(np.int64)
                head = first.column("_ids").flatten(), lengths
                a += 1
            if a < b:
                parts.append(batch.slice(a, b - a).select([n for n, _ in _LISTS]))
    if head is not None:
        yield number, Lists(*head, parts, documents, total)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, as ``search_index`` finds them in a new index."""
    found = search_index(build_index(docs, id_col, text_col), items, k, item_id, item_text)
    return found.withColumnRenamed("_id", id_col)


def search_index(index: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), _id, score of the ``k`` best documents of every item with a score above 0.

    A term's weight falls with the documents that hold it, its impact grows with its count and falls with the document's length; terms an
    item repeats count as often. Equal scores are ranked by ascending id, null ids last, repeated rows one by one. Rows of ``items`` with equal or null ids are
    items of their own; items without a known term have no rows.
    Only lists of terms that items hold are shuffled, to their shards; items are read in slices of about ``ITEMS`` beside them, and every task keeps the
    best scores it has seen of each item, so later shards start from a high bar. Shards give at most ``k`` rows an item, of which the best ``k`` are merged.
    """
    rows = numbered(stored(items)).select("_row", F.col(item_id).alias("_item"), ascii_lower(F.col(item_text).cast("string")).alias("_words"))
    words = F.transform(F.regexp_extract_all("_words", F.lit(TERM), F.lit(0)), lambda w: w.cast("binary"))
    counted = rows.select("_row", F.explode(words).alias("_term")).groupBy("_row", "_term").agg(F.count("*").alias("_q"))
    counted = materialize(counted)
    terms = counted.select("_term").distinct()
    heads = index.where("_term is null")
    said = heads.agg(F.sum("_df").alias("documents"), F.sum("_total").alias("total")).first()
    documents, total = said["documents"] or 0, said["total"] or 0
    lists = index.where("_term is not null").join(terms, "_term", "left_semi")
    df = lists.groupBy("_term").agg(F.sum("_df").alias("_df"))
    weight = F.floor(FACTOR * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("_df") + 1))).cast("long") * F.col("_q")
    slices = max(1, -(-items.count() // ITEMS))
    place = F.col("_row")
    queries = counted.join(df, "_term").select(
        place["file"].alias("_item_file"), place["at"].alias("_item_at"), "_term", weight.alias("_weight"),
        F.lit(0).alias("_file"), F.pmod(F.xxhash64("_row"), F.lit(slices)).cast("int").alias("_block"))
    folder = store(queries)
    kind = index.schema["_ids"].dataType.elementType.simpleString()
    columns = index.columns
    needed = lists.select(*columns).union(heads.select(*columns)).repartition("_shard").sortWithinPartitions("_shard", F.col("_term").asc_nulls_first())
    shards = needed.mapInArrow(
        _search(folder, slices, documents, total, k), f"_file long, _at long, score long, _id {kind}, _place long")
    order = Window.partitionBy("_file", "_at").orderBy(F.desc("score"), F.col("_id").asc_nulls_last(), "_place")
    ranked = shards.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = rows.select(place["file"].alias("_file"), place["at"].alias("_at"), F.col("_item").alias(item_id))
    return ranked.join(named, ["_file", "_at"]).select(item_id, "rank", "_id", "score")
