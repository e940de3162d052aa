import base64
import gzip
import hashlib
import io
import os

import pytest

from tallyloom.llm import warc

BIG = "<p>" + "long text " * 40_000 + "</p>"
PAGES = [
    (5, "http://a.example/x", "<p>same</p>"), (3, "http://b.example/\r\nEvil: 1", "<p>same</p>"), (3, None, "<p>same</p>"), (None, "u", "<p>same</p>"),
    (7, "", None), (8, None, ""), (9, "http://c.example/ü", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (10, "x", BIG), (11, "y", BIG), (12, "z", "one"),
]


def want(min_bytes=0):
    groups = {}
    for i, _, html in PAGES:
        groups.setdefault(html or "", []).append(i)
    out = []
    for html, ids in groups.items():
        raw = html.encode()
        first = min(ids, key=lambda i: (i is None, i or 0))
        alone = len(raw) < min_bytes
        rest = list(ids)
        rest.remove(first)
        facts = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        out += [(first, *facts, "response", None)] + [(i, *facts, "response" if alone else "revisit", None if alone else first) for i in rest]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "pages.parquet")
    df = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, _row string, archive string")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("options", [{}, {"min_bytes": 6}, {"archive_bytes": 100}])
def test_round_trip(spark, pages, options):
    rows = warc.round_trip(spark, pages, payloads=True, **options).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == want(options.get("min_bytes", 0))
    for r in rows:
        if r["record_type"] == "response":
            assert len(r["payload"]) == r["payload_bytes"] and warc.digest(bytes(r["payload"])) == r["payload_digest"]
        else:
            assert r["payload"] is None


def test_members_and_index_agree_with_the_monolithic_file(spark, pages, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    written = warc.write_archives(pages, one)
    normal = warc.normalise(written, one, many)
    assert sum(r["records"] for r in normal.collect()) == len(PAGES)
    for row in written.collect():
        with gzip.open(f"{one}/{row['archive']}") as stream:
            whole = stream.read()
        with open(f"{many}/{row['archive']}", "rb") as file:
            raw = file.read()
        assert gzip.decompress(raw) == whole and raw.count(b"\x1f\x8b\x08") >= row["records"]
    assert not [n for n in os.listdir(one) + os.listdir(many) if n.startswith(".") and not n.endswith(".crc")]
    again = warc.normalise(normal, many, str(tmp_path / "again"))
    assert sum(r["records"] for r in again.collect()) == len(PAGES)


def test_streams_in_any_pieces(monkeypatch):
    raw = [warc.record(f"<urn:uuid:{i}>", i, f"u{i}", b"x" * i * 50, None) for i in range(8)]
    for step in (1, 3, 97, 10_000):
        data = b"".join(raw)
        assert list(warc.records(data[a:a + step] for a in range(0, len(data), step))) == raw
    monkeypatch.setattr(warc, "CHUNK", 31)
    packed = gzip.compress(b"".join(raw[:4])) + gzip.compress(b"") + gzip.compress(b"".join(raw[4:]))
    assert b"".join(warc.inflate(io.BytesIO(packed))) == b"".join(raw)
    with pytest.raises(ValueError):
        list(warc.records([raw[0], raw[1][:-5]]))


def test_a_damaged_payload_is_noticed(spark, pages, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    normal = warc.normalise(warc.write_archives(pages, one), one, many)
    name = next(r["archive"] for r in normal.collect() if r["records"])
    with open(f"{many}/{name}.idx") as index:
        entry = __import__("json").loads(index.readline())
    member = gzip.decompress(open(f"{many}/{name}", "rb").read()[entry["offset"]:entry["offset"] + entry["length"]])
    fields, start = warc.head(member)
    block = member[start:start + int(fields["Content-Length"])]
    wrong = dict(entry) | {"offset": 0}
    class File:
        def read_at(self, size, offset):
            return gzip.compress(member[:start] + block[:-1] + b"?" + warc.END)
    if fields["WARC-Type"] == "response" and int(fields["Payload-Length"]):
        with pytest.raises(ValueError):
            warc._one(File(), name, wrong, True)


def test_empty(spark, pages, tmp_path):
    pages.where("false").coalesce(1).write.parquet(str(tmp_path / "none.parquet"))
    assert warc.round_trip(spark, spark.read.schema(pages.schema).parquet(str(tmp_path / "none.parquet"))).count() == 0
