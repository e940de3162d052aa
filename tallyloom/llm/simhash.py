"""SimHash near-dedup with multi-index hashing, and near-dedup by the Jaccard similarity of word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scratch import materialize
from .blocks import beside, block_of, blocks, runs, store, tidy
from .common import numbered, salted_join, stored, without
from .components import components

BLOCK = 1 << 16
#: Bands of a signature and minima a band: of pairs with Jaccard 0.8, 3 in a million share no band.
BANDS, MINIMA = 32, 5
_FACTORS, _ADDENDS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * MINIMA), np.uint64, endpoint=False) | np.uint64(1)
_CHUNK = 1 << 10
#: Sets of a family, and their shingles together, that one task compares; a larger family is dealt to several, each with its most central sets.
FAMILY, FAMILY_SHINGLES, CENTERS = 2048, 1 << 22, 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the shingles of the whole text, in blocks of shingles; unsigned.

    A-Z is lowered, words are split at ASCII white space, shingles repeat as often as they occur. A
    text with fewer words is one shingle; without words the fingerprint is 0.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line, width = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = len(tokens) - width + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, BLOCK):
        to = min(count, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1:to + width - 1].tolist())
        ones += _ones(np.array([digest(line[a:b], seed) for a, b in spans], np.uint64))
    return _majority(ones, count)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(octets) < 256:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])


def _majority(ones: np.ndarray, count: int) -> int:
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int, seed: int):
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_id"), pa.array(prints.view(np.int64))], ["_row", "_id", "_print"]
            )
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """_row, _id, _print: the SimHash of every row as a signed long."""
    rows = numbered(stored(docs)).select("_row", F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints(words, seed), f"_row struct<file:long,at:long>, _id {kind}, _print long")


def _balls(bits: int) -> F.Column:
    """The buckets of a fingerprint: for each half, the half itself and all values one bit from it.

    Halves that differ in at most two bits share a value, and of two fingerprints that differ in
    at most five bits, one pair of halves does. Bit 32 of a bucket tells the halves apart.
    """
    low, high = F.col("_print").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("_print", 32)
    flips = [0] + [1 << i for i in range(32)] if bits >= 2 else [0]
    return F.explode(F.array(
        *[low.bitwiseXOR(F.lit(f).cast("long")) for f in flips],
        *[high.bitwiseXOR(F.lit(f | 1 << 32).cast("long")) for f in flips],
    ))


def forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what links of at most ``bits`` bits connect, without a circle.

    Every fingerprint is compared with those that no link has reached yet, so that a dense bucket of
    n costs about n comparisons and never more than n links.
    """
    left, links = prints, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                found = left[near]
                links.extend((int(at), int(x)) for x in found)
                front.extend(found)
                left = left[~near]
    return links


def _link(bits: int):
    def linked(keys, prints):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        size = ends - starts
        two = starts[size == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= bits]
        links = list(zip(prints[two].tolist(), prints[two + 1].tolist()))
        for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            links += forest(prints[a:b], bits)
        return links

    def run(batches):
        held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)  # bits are counted unsigned
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate((held_keys, batch.column("_bucket").to_numpy()))
            prints = np.concatenate((held, batch.column("_print").to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(keys, keys[-1]))  # sorted: the last bucket may go on in the next batch
            links = set(linked(keys[:cut], prints[:cut])) if cut else ()
            held_keys, held = keys[cut:], prints[cut:]
            yield _links(links)
        if len(held):
            yield _links(set(linked(held_keys, held)))
    return run


def _links(links) -> pa.RecordBatch:
    table = np.array(list(links), np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, bits: int = 4,
) -> DataFrame:
    """Every row's class of near copies: _row, id, _print (signed), component_id.

    Fingerprints link when they differ in at most ``bits`` (0 to 5) of 64 bits; a class is what
    links connect, and its id the smallest document id in it (null only if all are null). Null
    and word-less texts have fingerprint 0. Equal fingerprints are one node, so a group of copies of
    any size is one row of the search. Multi-index hashing: every node stands in the 66 buckets of
    ``_balls``; nodes that meet in a bucket are compared in full. Links and classes stay distributed.
    """
    if not 0 <= bits <= 5:
        raise ValueError("the balls of radius 1 around halves find links of at most 5 bits")
    rows = materialize(fingerprints(docs, id_col, text_col, words, seed))
    nodes = materialize(rows.groupBy("_print").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")))
    found = salted_join(rows, _class_ids(nodes, components(_near(nodes, bits))), "_print", "left", sizes=nodes)
    return found.select("_row", F.col("_id").alias(id_col), "_print", F.coalesce("_class", "_id").alias("component_id"))


def _near(prints: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``_print`` as those of at most ``bits`` bits do."""
    buckets = prints.select("_print", _balls(bits).alias("_bucket"))
    met = buckets.repartition("_bucket").sortWithinPartitions("_bucket")
    return met.mapInArrow(_link(bits), "a long, b long").distinct()


def _class_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """_print, _class of the fingerprints that stand for several rows."""
    known = nodes.join(roots.withColumnRenamed("node", "_print"), "_print", "left")
    known = materialize(known.withColumn("root", F.coalesce("root", "_print")))
    classes = known.groupBy("root").agg(F.min("_first").alias("_class"), F.sum("_n").alias("_all")).where("_all > 1")
    return salted_join(known, classes, "root", "inner", "_print").select("_print", "_class")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id, of equal ids the first stored."""
    docs = stored(docs)
    return _first_of_each(docs, near_duplicates(docs, id_col, text_col, **options), id_col)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of ``similar``, chosen as by ``drop_near_duplicates``."""
    docs = stored(docs)
    return _first_of_each(docs, similar(docs, id_col, text_col, **options), id_col)


def _first_of_each(docs: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    found = materialize(classes)
    place = F.struct(F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("_id"), "_row")
    # Rows without id have no class id of their own to group by; their fingerprint stands in.
    key = F.struct(F.col("component_id").alias("_class"), F.when(F.col("component_id").isNull(), F.col("_print")).alias("_print"))
    kept = found.groupBy(key.alias("_key")).agg(F.min(place).alias("_first")).select(F.col("_first._row").alias("_row"))
    gone = materialize(found.select("_row").join(kept, "_row", "left_anti"))
    return without(docs, gone)


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the whole text, which is read as ``fingerprint`` reads it."""
    return np.unique(_shingles(text, words, seed))


def _shingles(text: str | None, words: int, seed: int) -> np.ndarray:
    """Hashes of all shingles of the whole text, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    width, digest = min(words, len(tokens)), xxhash.xxh64_intdigest
    shingles = (b" ".join(tokens[i:i + width]) for i in range(len(tokens) - width + 1))
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(tokens) - width + 1)


def _set_and_print(text: str | None, words: int, seed: int) -> tuple[np.ndarray, int]:
    """``shingle_set`` and ``fingerprint`` of a text whose shingles are hashed once."""
    hashes = _shingles(text, words, seed)
    return np.unique(hashes), _majority(_ones(hashes), len(hashes))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash signature; none without shingles."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        least = np.minimum(least, (shingles[at:at + _CHUNK, None] * _FACTORS + _ADDENDS).min(axis=0))
    rows = least.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64)


def _signatures(words: int, seed: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 8):
                part = batch.slice(at, 1 << 8)
                sets = (_set_and_print(t.as_py(), words, seed) for t in part.column("text"))
                found = [(xxhash.xxh3_64_intdigest(x.tobytes()), s, len(x), bands(x)) for x, s in sets]
                prints, simhashes = (pa.array(np.array([x[i] for x in found], np.uint64).view(np.int64)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("_id"), prints, simhashes, pa.array([n for _, _, n, _ in found], pa.int64()),
                     pa.array([b for *_, b in found], pa.list_(pa.int64()))],
                    ["_row", "_id", "_print", "_simhash", "_size", "_bands"])
        tidy()
    return run


def _shared(batches):
    """Members of buckets with several: _print, _lead (the smallest member), _many (the other members).

    Rows come sorted by bucket and member. Of a bucket its first row is all that is held.
    """
    key = lead = None
    begun = False  # whether the bucket's first row has been given out
    parts: list[tuple] = []
    for batch in batches:
        for bucket, print_ in zip(batch.column("_bucket").to_pylist(), batch.column("_print").to_pylist()):
            if bucket != key:
                key, lead, begun = bucket, print_, False
                continue
            if not begun:
                parts.append((lead, lead))
                begun = True
            parts.append((print_, lead))
        if parts:
            table = np.array(parts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["_print", "_lead"])
            parts = []
    tidy()


def _simhash_meetings(nodes: DataFrame, bits: int) -> DataFrame:
    """``_shared``'s columns for nodes (_print, _simhash) whose SimHash prints are equal or link by at most ``bits`` bits.

    Nodes of one print meet in the smallest of them, and prints that link meet in theirs.
    """
    prints = materialize(nodes.groupBy("_simhash").agg(F.min("_print").alias("_lead"), F.count("*").alias("_n")))
    same = salted_join(nodes.select("_print", "_simhash"), prints.select("_simhash", "_lead"), "_simhash", "inner", "_print", sizes=prints)
    ends = [prints.select(F.col("_simhash").alias(end), F.col("_lead").alias(lead)) for end, lead in (("a", "_lead"), ("b", "_print"))]
    linked = _near(prints.select(F.col("_simhash").alias("_print")), bits).join(ends[0], "a").join(ends[1], "b")
    found = same.where("_print <> _lead").select("_print", "_lead").unionByName(linked.select("_print", "_lead"))
    return found.select(F.explode(F.array("_print", "_lead")).alias("_print"), "_lead")


_WANTED = pa.schema([("at", pa.int64()), ("_print", pa.int64()), ("_family", pa.int64()), ("_parts", pa.list_(pa.int32())), ("_class", pa.int64())])
_SETS = "_family long, _part int, _print long, _class long, _set array<long>"


def _sets(folder: str, words: int, seed: int):
    """The shingle sets of the rows asked for, once for every part that needs them."""
    def run(batches):
        load, here, asked = beside(folder, _WANTED), None, {}
        for block, part in runs(batches, 1 << 8):
            if block != here:
                wanted, here = load(block), block
                asked = dict(zip(wanted.column("at").to_pylist(), zip(*(wanted.column(n).to_pylist() for n in _WANTED.names[1:]))))
            rows = [(asked[at], text) for at, text in zip(part.column("_at").to_pylist(), part.column("_text")) if at in asked]
            out = []
            for (print_, family, parts, class_), text in rows:
                found = shingle_set(text.as_py(), words, seed).view(np.int64)
                out += [(family, k, print_, class_, found) for k in parts]
                if len(out) >= 1 << 6:
                    yield _set_rows(out)
                    out = []
            if out:
                yield _set_rows(out)
    return run


def _set_rows(rows: list) -> pa.RecordBatch:
    family, part, print_, class_, sets = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(family, pa.int64()), pa.array(part, pa.int32()), pa.array(print_, pa.int64()), pa.array(class_, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
        ["_family", "_part", "_print", "_class", "_set"])


def alike(sets: list[np.ndarray], classes: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (places of two sets) that join what pairs with a Jaccard similarity of ``least`` join, beyond the given classes, without a circle.

    As in ``forest``, each set is compared with those of classes that no link has reached yet, by counting what it shares with all of them in
    an index of their shingles, which is made anew when half of them are reached. So a family that links costs little more than its sets, and no pair is written.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owners = np.repeat(np.arange(len(sets)), sizes)
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.empty(0, np.int64)
    own = np.split(numbers, np.cumsum(sizes)[:-1])
    members: dict[int, list[int]] = {}
    for i, c in enumerate(classes.tolist()):
        members.setdefault(c, []).append(i)
    left = np.ones(len(sets), bool)
    order = np.argsort(numbers, kind="stable")
    index, starts = owners[order], np.searchsorted(numbers[order], np.arange(numbers.max(initial=-1) + 2))
    held, links, wanted = len(sets), [], round(least * 1000)
    for mine in members.values():
        if not left[mine[0]]:
            continue
        left[mine] = False
        front = list(mine)
        while front:
            remaining = int(left.sum())
            if not remaining:
                return links
            if 2 * remaining <= held:  # reached sets are compared no more
                keep = left[index]
                starts = np.concatenate(([0], np.cumsum(keep)))[starts]
                index, held = index[keep], remaining
            at = front.pop()
            places = [index[starts[n]:starts[n + 1]] for n in own[at]]
            both = np.bincount(np.concatenate(places), minlength=len(sets)) if places else np.zeros(len(sets), np.int64)
            near = left & (both * 1000 >= (sizes + sizes[at] - both) * wanted) & (both > 0)
            for hit in np.flatnonzero(near).tolist():
                if left[hit]:
                    links.append((at, hit))
                    left[members[int(classes[hit])]] = False
                    front.extend(members[int(classes[hit])])
    return links


def _link_sets(least: float):
    """Links within every part of a family; rows come sorted by family and part."""
    def linked(prints, classes, sets):
        links = [(prints[a], prints[b]) for a, b in alike(sets, np.array(classes, np.int64), least)] if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches):
        key, prints, classes, sets = None, [], [], []
        for batch in batches:
            flat = batch.column("_set").flatten().to_numpy().view(np.uint64)
            cuts = batch.column("_set").offsets.to_numpy()
            cuts = cuts - cuts[:1]
            names = zip(*(batch.column(n).to_pylist() for n in ("_family", "_part", "_print", "_class")))
            for i, (family, part, print_, class_) in enumerate(names):
                if (family, part) != key:
                    if len(sets) > 1:
                        yield linked(prints, classes, sets)
                    key, prints, classes, sets = (family, part), [], [], []
                prints.append(print_)
                classes.append(class_)
                sets.append(flat[cuts[i]:cuts[i + 1]].copy())
        if len(sets) > 1:
            yield linked(prints, classes, sets)
        tidy()
    return run


def _compared(docs: DataFrame, text_col: str, wanted: DataFrame, words: int, seed: int, least: float) -> DataFrame:
    """Links (a, b) among the ``wanted`` (_row, _print, _family, _parts, _class), each part of a family in one task."""
    place = F.col("_row")
    folder = store(wanted.select(
        place["file"].alias("_file"), block_of(place), place["at"].alias("at"), "_print", "_family", F.col("_parts").cast("array<int>").alias("_parts"), "_class"))
    sets = blocks(docs, {"_text": F.col(text_col).cast("string")}).mapInArrow(_sets(folder, words, seed), _SETS)
    together = sets.repartition("_family", "_part").sortWithinPartitions("_family", "_part")
    return materialize(together.mapInArrow(_link_sets(least), "a long, b long"))


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, seed: int = 42, least: float = 0.8, bits: int = 4,
) -> DataFrame:
    """Every row's class of similar texts, with the columns of ``near_duplicates``; _print is a hash of the shingle set.

    Texts link when the Jaccard similarity of their shingle sets is ``least`` or more. Texts with equal sets are
    one node. Nodes whose SimHash prints differ in at most ``bits`` bits (see ``near_duplicates``) or that meet in a band of a MinHash
    signature are of one family, and so is all that meetings connect. Every node's set goes to its family once, and
    ``alike`` finds what it links to. Sets and numbers of a bucket are never multiplied: no pair is written but links, at most one for each node of a part.

    A family of more than ``FAMILY`` sets is dealt to several tasks by hash, each of which also gets its ``CENTERS`` nodes with most meetings: the text that others
    were copied from meets more of them than they meet one another. If that leaves the family in several classes, every two parts are compared in one task
    each, classes found so far being one node; this alone moves a set more often, as often as its family has parts.

    The prints alone do not find all links: those of texts of similarity 0.8 differ by 9.7 bits on average, one
    pair in 37 by more than 15, and of any two texts one pair in 82,000 differs by 15 or less. The bands find the rest.
    """
    if not 0 <= bits <= 5:
        raise ValueError("the balls of radius 1 around halves find links of at most 5 bits")
    docs = stored(docs)
    rows = numbered(docs).select("_row", F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    signed = materialize(rows.mapInArrow(
        _signatures(words, seed), f"_row struct<file:long,at:long>, _id {kind}, _print long, _simhash long, _size long, _bands array<long>"))
    nodes = materialize(signed.groupBy("_print").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_n"), F.min("_row").alias("_row"),
        F.min_by("_simhash", "_row").alias("_simhash"), F.max("_size").alias("_size")))
    members = signed.join(nodes.select("_row"), "_row", "left_semi").select(F.explode("_bands").alias("_bucket"), "_print")
    met = members.repartition("_bucket").sortWithinPartitions("_bucket", "_print").mapInArrow(_shared, "_print long, _lead long")
    met = met.unionByName(_simhash_meetings(nodes.where("_size > 0"), bits))
    met = materialize(met.groupBy("_print", "_lead").agg(F.count("*").alias("_meetings")))
    families = components(met.where("_lead <> _print").select(F.col("_lead").alias("a"), F.col("_print").alias("b")))
    degrees = met.groupBy("_print").agg(F.sum("_meetings").alias("_own")).join(
        met.groupBy(F.col("_lead").alias("_print")).agg(F.sum("_meetings").alias("_led")), "_print", "left")
    family = nodes.join(families.select(F.col("node").alias("_print"), F.col("root").alias("_family")), "_print").join(
        degrees.select("_print", (F.col("_own") + F.coalesce("_led", F.lit(0))).alias("_degree")), "_print")
    family = materialize(family.select("_print", "_row", "_size", "_family", "_degree"))
    parts = F.ceil(F.greatest(F.count("*") / FAMILY, F.sum("_size") / FAMILY_SHINGLES)).cast("int")
    sizes = materialize(family.groupBy("_family").agg(F.count("*").alias("_n"), parts.alias("_of")))
    dealt = salted_join(family, sizes.select("_family", "_of"), "_family", "inner", "_print", sizes=sizes)
    dealt = materialize(dealt.withColumn("_part", F.pmod(F.xxhash64(F.lit(5), "_print"), F.col("_of")).cast("int")))
    large = dealt.where("_of > 1")
    rank = F.row_number().over(Window.partitionBy("_family").orderBy(F.desc("_degree"), "_print"))
    centers = large.withColumn("_rank", rank).where(F.col("_rank") <= CENTERS).select("_print", F.lit(True).alias("_center"))
    own = F.array("_part")
    wanted = dealt.where("_of = 1").withColumn("_parts", own).unionByName(large.join(centers, "_print", "left").withColumn(
        "_parts", F.when(F.col("_center"), F.sequence(F.lit(0), F.col("_of") - 1)).otherwise(own)).drop("_center"))
    links = _compared(docs, text_col, wanted.withColumn("_class", F.col("_print")), words, seed, least)
    labels = components(links)
    classed = large.join(labels.withColumnsRenamed({"node": "_print", "root": "_class"}), "_print", "left")
    classed = materialize(classed.withColumn("_class", F.coalesce("_class", "_print")))
    open_ = materialize(classed.groupBy("_family").agg(F.count("*").alias("_n"), F.min("_class").alias("a"), F.max("_class").alias("b")).where("a <> b"))
    if open_.head(1):
        # Two parts meet in the task numbered from both.
        with_all = F.transform(F.filter(F.sequence(F.lit(0), F.col("_of") - 1), lambda k: k != F.col("_part")),
                               lambda k: F.least(k, F.col("_part")) * F.col("_of") + F.greatest(k, F.col("_part")))
        again = salted_join(classed, open_.select("_family"), "_family", "left_semi", "_print", sizes=open_).withColumn("_parts", with_all)
        links = links.union(_compared(docs, text_col, again, words, seed, least))
        labels = components(links)
    found = salted_join(signed.drop("_bands", "_size", "_simhash"), _class_ids(nodes, labels), "_print", "left", sizes=nodes)
    return found.select("_row", F.col("_id").alias(id_col), "_print", F.coalesce("_class", "_id").alias("component_id"))
