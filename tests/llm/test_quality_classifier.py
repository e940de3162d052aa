import numpy as np
import pytest

from odd_documents import ODD, stored_again, unchanged
from tallyloom.llm import quality_classifier as qc

GIVEN = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{GIVEN}/documents.parquet"), spark.read.parquet(f"{GIVEN}/labels.parquet")
    trained, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = qc.classified(docs, trained).join(held, "doc_id").select("kept", "quality").collect()
    right = sum(r["kept"] == bool(r["quality"]) for r in found)
    assert len(found) > 100 and right / len(found) > 0.97
    good = [r for r in found if r["quality"]]
    assert sum(r["kept"] for r in good) / len(good) > 0.98


def test_odd_documents(odd, labels):
    rows = qc.classified(odd, labels).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, _ in ODD), key=str)
    assert all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in rows)
    assert unchanged(qc.drop_rejected(odd, labels), odd)


def test_without_usable_labels_all_score_one_half(odd, labels):
    for some in (labels.where("false"), labels.where("doc_id = 99"), labels.where("quality = 1")):
        assert {round(r["score"], 9) for r in qc.classified(odd, some).collect()} == {0.5}


def test_sparse_sites_shrink_toward_their_priors(spark, tmp_path):
    """Two large hosts of opposite quality pull their undecided documents apart; a site of one document stays near the mean."""
    good = "the river runs quiet beside the old stone garden every early morning"
    bad = "BUY!!! ### NOW!!! %%% WIN!!! &&& $$$ CLICK!!! *** FREE!!!"
    rows = [(i, (good if i % 2 == 0 else bad) + f" {i}", "a" if i % 2 == 0 else "b", "en") for i in range(400)]
    rows += [(1000, "hm", "a", "en"), (1001, "hm", "b", "en"), (1002, "hm", "c", "en"), (1003, "hm", "a", "de"), (1004, "hm", None, None)]
    docs = stored_again(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(0, 400, 3)] , "doc_id long, quality int")
    found = {r["doc_id"]: r for r in qc.classified(docs, labels).collect()}
    assert found[1000]["path_mean"] > 0.9 > 0.6 > found[1002]["path_mean"] > 0.4 > 0.1 > found[1001]["path_mean"]
    assert found[1000]["score"] > found[1002]["score"] > found[1001]["score"]
    assert abs(found[1003]["path_mean"] - found[1003]["host_mean"]) < 0.2 and 0.4 < found[1004]["path_mean"] < 0.6


def test_newton_finds_the_ridge_optimum():
    rng = np.random.default_rng(1)
    x = rng.random((300, len(qc.FEATURES)))
    y = (x[:, 0] + 0.2 * rng.normal(size=300) > 0.5).astype(float)
    model = qc.fit(x, y)
    p = 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.bias)))
    scaled = (x - x.mean(0)) / x.std(0)
    gradient = scaled.T @ (p - y) + qc.RIDGE * len(x) * np.array(model.weights) * x.std(0)
    assert abs((p - y).sum()) < 1e-5 and np.abs(gradient).max() < 1e-5


def test_sites_joined_by_sorting_give_the_same(odd, labels, monkeypatch):
    want = sorted((tuple(r) for r in qc.classified(odd, labels).select("_row", "score").collect()), key=str)
    monkeypatch.setattr(qc, "BROADCAST", 0)
    found = sorted((tuple(r) for r in qc.classified(odd, labels).select("_row", "score").collect()), key=str)
    assert [r[0] for r in found] == [r[0] for r in want] and [r[1] for r in found] == pytest.approx([r[1] for r in want])


def test_empty(empty, labels):
    assert qc.classified(empty, labels).count() == 0 and qc.drop_rejected(empty, labels).columns == empty.columns
