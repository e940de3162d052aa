"""WARC archives: written as one gzip stream a file, normalised to one member a record, read by index."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scratch import materialize, scratch_folder
from .blocks import beside, block_of, blocks, filesystem, store
from .common import numbered, salted_join, stored

#: Bytes of records after which a task begins another archive, and bytes it inflates or copies at once.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 20
MONOLITHIC_LEVEL, MEMBER_LEVEL = 1, 6
# Parts of the WARC 1.1 format.
DATE, VERSION, END = "2025-01-01T00:00:00Z", b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields of our own: the page's id, that of the page it repeats, the length of the full payload.
PAGE, REFERS, LENGTH = "Page-Id", "Refers-To-Page-Id", "Payload-Length"
_NAMES = uuid.UUID("6f1c1e0e-2f3b-5d0a-9c57-0d2b1f5f9f10")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(file: int, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{file}/{at}')}>"


def record(name: str, page: int | None, url: str | None, payload: bytes, first: dict | None) -> bytes:
    """A response with the payload in an HTTP message, or, given the first record with the payload, a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http if first else http + payload
    fields = {
        "WARC-Type": "revisit" if first else "response", "WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Target-URI": _clean(url),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Profile": PROFILE if first else None,
        "WARC-Refers-To": first and first["name"], PAGE: page, REFERS: first and first["page"], LENGTH: len(payload),
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + END


def _clean(url: str | None) -> str | None:
    """White space and control characters would end the field."""
    return url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def head(raw: bytes) -> tuple[dict[str, str], int]:
    """The fields of the record that ``raw`` begins with, and where its block starts."""
    end = raw.index(END)
    version, *lines = raw[:end].decode().split("\r\n")
    if version.encode() != VERSION:
        raise ValueError(f"no WARC record: {version[:40]!r}")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines), end + len(END)


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Split a stream of records; holds one record and one chunk at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(END, at)) >= 0:
            size = int(re.search(rb"\r\nContent-Length: (\d+)", held[at:end + 2])[1])
            to = end + len(END) + size + len(END)
            if to > len(held):
                break
            yield bytes(held[at:to])
            at = to
        del held[:at]
    if held:
        raise ValueError("the archive ends within a record")


def inflate(stream) -> Iterator[bytes]:
    """Bytes of a gzip stream of one member or several, a bounded piece at a time."""
    inflater = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            if out := inflater.decompress(raw, CHUNK):
                yield out
            raw = inflater.unconsumed_tail
            if inflater.eof:
                raw, inflater = inflater.unused_data, zlib.decompressobj(31)


class _Out:
    """A file under a name of the attempt's own until it is whole, so that a lost task leaves no half file."""

    def __init__(self, folder: str, name: str):
        self.system, root = filesystem(folder)
        self.system.create_dir(root, recursive=True)
        self.path, self.own = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.stream, self.size = self.system.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.own, self.path)


_FIRST = pa.schema([("at", pa.int64()), ("first_file", pa.int64()), ("first_at", pa.int64()), ("refers_to", pa.int64())])


def _write(folder: str, repeats: str, archive_bytes: int):
    def run(batches):
        load, part, current, firsts = beside(repeats, _FIRST), TaskContext.get().partitionId(), None, {}
        out, number, size, count = None, 0, 0, 0

        def closed():
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([count], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                block = row["_file"], row["_block"]
                if block != current:
                    current, firsts = block, {x["at"]: x for x in load(block).to_pylist()}
                first = firsts.get(row["_at"])
                first = first and {"name": record_id(first["first_file"], first["first_at"]), "page": first["refers_to"]}
                if out is None:
                    name = f"part-{part:06d}-{number:04d}.warc.gz"
                    out, packer, size, count = _Out(folder, name), zlib.compressobj(MONOLITHIC_LEVEL, wbits=31), 0, 0
                raw = record(record_id(row["_file"], row["_at"]), row["_id"], row["_url"], (row["_html"] or "").encode(), first)
                out.write(packer.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= archive_bytes:
                    yield closed()
                    out, number = None, number + 1
        if out is not None:
            yield closed()
    return run


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per page below ``folder``, each archive one gzip stream; rows archive, records.

    Of pages with equal payloads (UTF-8, null as empty) of at least ``min_bytes``, that with the smallest id
    is the response, a null id last, of equal ids the first stored; the others are revisits of it. Payloads
    are compared by SHA-256. The pages are not shuffled: what each repeats is found by digest and read
    beside the page's block. A task's archives have names of its own and appear when they are whole.
    """
    pages = stored(pages)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = materialize(numbered(pages).select(
        "_row", F.col(id_col).cast("long").alias("_id"), F.sha2(payload, 256).alias("_key"), F.octet_length(payload).alias("_bytes")))
    large = rows.where(F.col("_bytes") >= min_bytes)
    groups = large.groupBy("_key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first"))
    repeats = salted_join(large, groups.where("n > 1"), "_key", "inner", sizes=groups.withColumnRenamed("n", "_n")).where("first._row <> _row")
    place = F.col("_row")
    folder_of = store(repeats.select(
        place["file"].alias("_file"), block_of(place), place["at"].alias("at"),
        F.col("first._row.file").alias("first_file"), F.col("first._row.at").alias("first_at"), F.col("first._id").alias("refers_to")))
    source = blocks(pages, {"_id": F.col(id_col).cast("long"), "_url": F.col(url_col).cast("string"), "_html": F.col(html_col).cast("string")})
    return materialize(source.mapInArrow(_write(folder, folder_of, archive_bytes), "archive string, records long"))


def _normalise(source: str, target: str):
    def run(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                system, root = filesystem(source)
                out, index, count = _Out(target, name), _Out(target, f"{name}.idx"), 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in records(inflate(stream)):
                        packer = zlib.compressobj(MEMBER_LEVEL, wbits=31)
                        member = packer.compress(raw) + packer.flush()
                        fields, _ = head(raw)
                        line = {"offset": out.size, "length": len(member), "id": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "uri": fields.get("WARC-Target-URI")}
                        index.write(json.dumps(line, ensure_ascii=False).encode() + b"\n")
                        out.write(member)
                        count += 1
                out.close()
                index.close()
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([count], pa.int64())})
    return run


def _spread(archives: DataFrame) -> DataFrame:
    """One archive a task; the list has one short row each."""
    return archives.select("archive").repartition(max(1, archives.count()))


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite the named archives of ``source`` to ``target``: each record a gzip member of its own.

    Each file is inflated once, as a stream, whatever members it has. Beside it stands ``<name>.idx`` with
    a JSON line a record: offset, length, id, type, uri. Rows: archive, records.
    """
    return materialize(_spread(archives).mapInArrow(_normalise(source, target), "archive string, records long"))


def _read(folder: str, payloads: bool):
    def run(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                system, root = filesystem(folder)
                with system.open_input_stream(f"{root}/{name}.idx", compression=None) as stream:
                    index = [json.loads(x) for x in stream.read().splitlines()]
                with system.open_input_file(f"{root}/{name}") as file:
                    for at in range(0, len(index), 256):
                        yield _rows([_one(file, name, x, payloads) for x in index[at:at + 256]], payloads)
    return run


def _one(file, name: str, entry: dict, payloads: bool) -> dict:
    raw = zlib.decompress(file.read_at(entry["length"], entry["offset"]), 31)
    fields, start = head(raw)
    block = raw[start:start + int(fields["Content-Length"])]
    payload = block[block.index(END) + len(END):] if fields["WARC-Type"] == "response" else None
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and (digest(payload) != told or len(payload) != int(fields[LENGTH])):
        raise ValueError(f"{name}, {entry['offset']}: the payload does not match its digest")
    number = lambda key: int(fields[key]) if key in fields else None
    return {"page_id": number(PAGE), "url": fields.get("WARC-Target-URI"), "payload_bytes": number(LENGTH), "payload_digest": told,
            "record_type": fields["WARC-Type"], "refers_to": number(REFERS), "archive": name, "offset": entry["offset"], "payload": payload if payloads else None}


def _rows(found: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
             "refers_to": pa.int64(), "archive": pa.string(), "offset": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in kinds.items()], list(kinds))


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the named archives, each read by its entry in the index and checked by its digest.

    page_id, url, payload_bytes, payload_digest (bare base32 SHA-1), record_type, refers_to (page id; null for
    responses), archive, offset and, on request, the payload of responses. Length and digest are those of the full payload,
    which a revisit has in its fields alone.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
    return _spread(archives).mapInArrow(_read(folder, payloads), schema + (", payload binary" if payloads else ""))


def round_trip(spark: SparkSession, pages: DataFrame, payloads: bool = False, **options) -> DataFrame:
    """Write ``pages``, normalise the archives, and read the normalised ones; no pages, no rows."""
    folder = scratch_folder(spark)
    written = write_archives(pages, f"{folder}/monolithic", **options)
    normal = normalise(written, f"{folder}/monolithic", f"{folder}/members")
    return read_archives(normal, f"{folder}/members", payloads)
