import os
import subprocess
import sys

import corpus_pipeline
import pytest

import __spark_entry__ as entry_file
from odd_documents import unchanged

GIVEN = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's documents over the smallest tables, written and read again."""
    folder, docs, found = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{GIVEN}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found.append((name, docs))
        stage(spark, docs, GIVEN).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
    return [*found, ("result", docs)]


def test_stages_in_order(stages):
    assert [n for n, _ in stages] == ["quality_classifier", "exact_dedup", "simhash_dedup", "substring_dedup", "packing", "result"]
    columns = stages[0][1].columns
    assert all(df.columns == columns for _, df in stages[:-1])


def test_filters_keep_rows_as_they_were(stages):
    for (_, before), (_, after) in zip(stages[:3], stages[1:4]):
        assert unchanged(after, before)


def test_low_quality_goes_and_high_quality_stays(spark, stages):
    labels = spark.read.parquet(f"{GIVEN}/labels.parquet")
    kept = {r["doc_id"] for r in stages[1][1].select("doc_id").collect()}
    judged = [(r["quality"], r["doc_id"] in kept) for r in labels.collect()]
    for quality in (0, 1):
        same = [k for q, k in judged if q == quality]
        assert sum(k == bool(quality) for k in same) / len(same) > 0.95


def test_copies_go(stages):
    texts = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "") for r in stages[2][1].collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "") for r in stages[1][1].collect()}


def test_passages_stay_once(stages):
    owners = {}
    for r in stages[4][1].collect():
        words = (r["text"] or "").split()
        assert r["n_chars"] == len(r["text"] or "")
        for i in range(len(words) - 49):
            owners.setdefault(tuple(words[i:i + 50]), set()).add(r["doc_id"])
    assert all(len(o) == 1 for o in owners.values())


def test_every_token_is_packed_once(stages):
    ids = {r["doc_id"] for r in stages[4][1].collect()}
    pieces = {}
    for r in stages[5][1].collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(pieces) == ids
    for parts in pieces.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total


def test_odd_documents_pass_through(spark, odd, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_no_documents_pass_through(spark, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, empty, str(tmp_path))
        assert found.count() == 0


def test_run_is_registered():
    assert entry_file.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry_file.oracle_sql()
    assert {n for n in entry_file.queries() if n.startswith("op")} == {
        "op1_simhash_dedup", "op2_byte_bpe", "op3_suffix_dedup", "op4_packing", "op5_quality_rules", "op6_quality_classifier",
        "op7_exact_dedup", "op8_warc", "op9_substring_dedup", "op10_html_text", "op11_lexical_search", "op12_personal_data", "op13_fill_in_middle"}


def test_the_rest_imports_without_the_subpackage(tmp_path):
    top = os.path.dirname(os.path.abspath(entry_file.__file__))
    for name in ("__spark_entry__.py", "tallyloom"):
        os.symlink(f"{top}/{name}", tmp_path / name) if name != "tallyloom" else os.mkdir(tmp_path / name)
    for name in os.listdir(f"{top}/tallyloom"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{top}/tallyloom/{name}", tmp_path / "tallyloom" / name)
    code = (tmp_path / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(code)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"],
                          cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
    assert said.stdout.split()[-1] == "False", said.stderr
