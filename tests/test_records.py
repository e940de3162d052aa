"""Records of text files cut by many tasks, against readers that see a file whole."""

import csv
import io
import json

import pytest


from tallyloom.sources import readers
from tallyloom.sources.records import Csv, JsonArray, whole_records

CELLS = ["plain", "", 'He said ""hi""'.replace('""', '"'), "two\nlines", "a,b", "\n\n", '"', '","', "é日本🙂", "x" * 400, "\r\nx\ry", 'end"\n', "{}}{", " spaced "]


@pytest.fixture(params=["131072", "150"])
def ranges(spark, request):
    """Ranges of a file, in bytes: one, and many so short that a record spans several."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield int(request.param)
    for name, value in before.items():
        spark.conf.set(name, value)


def written(folder, name, rows, end="\r\n"):
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator=end).writerows(rows)
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text.getvalue(), encoding="utf-8", newline="")
    return text.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_span_lines_and_ranges(spark, tmp_path, ranges, end):
    folder = tmp_path / "t.csv"
    rows = {}
    for k, name in enumerate(["a.csv", "b.csv"]):
        rows[name] = [[str(20 * k + i), CELLS[(i + k) % len(CELLS)], CELLS[(3 * i + k) % len(CELLS)]] for i in range(18)]
        written(folder, name, [["id", "one", 'two "2"\nlines'], *rows[name]], end)
    found = readers.read_csv(spark, str(folder), schema="id long, one string, two string", missing=("",))
    expected = [(int(i), a or None, b or None) for name in rows for i, a, b in rows[name]]
    key = lambda r: r[0]
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected, key=key)
    if ranges < 200:
        assert whole_records(spark, str(folder), Csv, True).rdd.getNumPartitions() > 4


def test_csv_without_a_schema_with_blank_lines_and_an_open_quote(spark, tmp_path, ranges):
    path = tmp_path / "odd.csv"
    path.write_text('n,said\n1,"a\n\nb"\n\n2,c\r\n\r\n3,"never closed\n4,d\n', newline="")
    rows = {r["n"]: r["said"] for r in readers.read_csv(spark, str(path)).collect()}
    assert rows[1] == "a\n\nb" and rows[2] == "c" and rows[3].startswith("never closed\n4,d") and len(rows) == 3


@pytest.mark.parametrize("text", ["", "a,b\n", "a,b", 'a,"b\nb"\n'])
def test_csv_with_a_header_alone(spark, tmp_path, text):
    path = tmp_path / "head.csv"
    path.write_text(text)
    assert readers.read_csv(spark, str(path), schema="a string, b string").collect() == []


OBJECTS = [{"id": i, "text": t, "in": {"deep": [{"x": i}, {"y": "}"}], "s": '\\"{' * (i % 3)}} for i, t in enumerate(CELLS + ["\\", '\\"', "\\\\", '{"a": 1}, {', "]}, ["])]


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_json_arrays_are_cut_into_their_objects(spark, tmp_path, ranges, style):
    folder = tmp_path / "t.json"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(OBJECTS, **style) + "\n")
    (folder / "b.json").write_text(json.dumps(OBJECTS[:3], **style))
    schema = "id long, text string, `in` struct<deep:array<struct<x:long,y:string>>,s:string>"
    found = readers.load_dataset(spark, str(folder), schema=schema, json_document=True)
    rows = sorted((r.id, r.text, r["in"].s) for r in found.collect())
    assert rows == sorted((o["id"], o["text"], o["in"]["s"]) for o in OBJECTS + OBJECTS[:3])
    if ranges < 200:
        assert found.rdd.getNumPartitions() > 4


def test_json_arrays_without_a_schema(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps(OBJECTS))
    found = readers.read_json_arrays(spark, str(path))
    assert dict(found.dtypes)["id"] == "bigint" and found.count() == len(OBJECTS)
    for text in ("[]", "", "[1, 2]"):
        path.write_text(text)
        assert readers.read_json_arrays(spark, str(path), "id long").collect() == []
    path.write_text('[{"id": 1}, {"id": "broken}]')
    assert [r.id for r in readers.read_json_arrays(spark, str(path), "id long").collect()] == [1, None]


@pytest.mark.parametrize("ranges", ["150"], indirect=True)
def test_many_ranges_are_joined_by_sorting(spark, tmp_path, monkeypatch, ranges):
    monkeypatch.setattr("tallyloom.sources.records.MOST_RANGES", 0)
    rows = [[str(i), CELLS[i % len(CELLS)]] for i in range(30)]
    written(tmp_path / "t.csv", "a.csv", [["id", "one"], *rows])
    found = readers.read_csv(spark, str(tmp_path / "t.csv"), schema="id long, one string", missing=("",))
    assert sorted((r.id, r.one or "") for r in found.collect()) == [(int(i), t) for i, t in sorted(rows, key=lambda r: int(r[0]))]
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()


def test_two_forms_give_the_same_sums_from_any_state():
    import pyarrow as pa

    pieces = pa.array(json.dumps(OBJECTS).split("}"))
    whole = JsonArray.sums(pieces, 0)
    flips, outside, inside = JsonArray.sums(pieces.slice(0, 9), 0)
    state = JsonArray(flips & 1, outside)
    assert JsonArray.sums(pieces.slice(9), flips)[0] == whole[0]
    all_ends = JsonArray().ends(pieces)
    assert state.ends(pieces.slice(9)).tolist() == all_ends[9:].tolist() and all_ends.sum() == len(OBJECTS) + 1
