import pytest
from pyspark.sql import functions as F

from tallyloom.operators import evidence, experience, questions, runs


def test_question_tags(spark):
    asked = [
        "Forecast sales for next 90 days", "Which customers are at risk of churning?", "Analyze", "  ", "hello",
        "What was the average order value of the top 12 products in 2024?",
    ]
    df = spark.createDataFrame([(q,) for q in asked], "question string")
    tagged = {r["question"]: r for r in questions.tag_questions(df).collect()}
    assert tagged[asked[0]]["task_type"] == "forecasting" and "sales" in tagged[asked[0]]["metrics"]
    assert tagged[asked[1]]["task_type"] == "predictive" and tagged[asked[1]]["entities"] == ["customer"]
    assert tagged["Analyze"]["is_ambiguous"] and tagged["Analyze"]["entities"] == ["dataset"]
    assert tagged["  "]["task_type"] == "general_chat" and tagged["  "]["is_ambiguous"] and tagged["  "]["metrics"] == []
    assert tagged["hello"]["task_type"] == "general_chat" and not tagged["hello"]["is_ambiguous"]
    assert tagged[asked[5]]["constraints"] == ["year = 2024", "limit = 12"]
    assert tagged[asked[5]]["metrics"] == ["average_order_value"]


def test_customer_ids(spark):
    df = spark.createDataFrame([("Why is customer cust_0042 at risk?",), ("why?",)], "question string")
    assert [r["customer_id"] for r in questions.extract_customer_id(df).collect()] == ["CUST_0042", None]


SCHEMA = "run int, success boolean, error_message string, stderr string, return_value map<string,string>, extracted_metrics map<string,string>"


@pytest.mark.parametrize("record,outcome", [
    ((False, "IndexError: list index out of range", "", None, {}), "CODE_ERROR"),
    ((False, "KeyError: 'revenue_target' not in index", "", None, {}), "DATA_ERROR"),
    ((False, None, "No such Column", None, {}), "DATA_ERROR"),
    ((False, None, None, None, None), "CODE_ERROR"),
    ((True, None, "", None, {}), "INSUFFICIENT_EVIDENCE"),
    ((True, None, "", None, {"a": "1"}), "SUCCESS"),
    ((True, None, "", {"error": "x"}, {}), "ANALYSIS_ERROR"),
    ((True, None, "", {"total_customers": "3"}, {}), "STATISTICAL_WARNING"),
    ((True, None, "", {"total_customers": "0"}, {}), "SUCCESS"),
    ((True, None, "", {"sample_size": "0"}, {}), "STATISTICAL_WARNING"),
    ((True, None, "", {"accuracy": "0.4"}, {}), "ANALYSIS_ERROR"),
    ((True, None, "", {"accuracy": "0.0"}, {}), "SUCCESS"),
    ((True, None, "", {"total_customers": "50", "total_revenue": "1300.0"}, {"total_revenue": "1300.0"}), "SUCCESS"),
])
def test_triage(spark, record, outcome):
    df = spark.createDataFrame([(1, *record)], SCHEMA)
    assert runs.triage_runs(df).head()["outcome"] == outcome


CLAIMS = "run_id int, claim string, metric_name string, metric_value double, test_name string, confidence_score double"


def test_audit_rules(spark):
    rows = [
        (1, "Revenue rose", "revenue", 1.0, None, 0.60), (1, "x", "m", None, None, 0.9),
        (1, "Discounts cause customer churn directly", "churn", 0.5, None, 0.9),
        (1, "It fell because of rain", "m", 1.0, "RCT", 0.9), (1, "y", "m", 1.0, None, 0.59),
    ]
    issues = {r["claim"]: r["issue"] for r in evidence.audit_claims(spark.createDataFrame(rows, CLAIMS)).collect()}
    assert list(issues.values()) == [None, "null_value", "causal_overreach", None, "low_confidence"]


def test_grounding(spark):
    claims = spark.createDataFrame([
        (1, "Projected revenue trend", "forecasted_daily_revenue_avg", 1.0, None, 0.9),
        (2, "Discounts cause churn", "churn", 0.5, None, 0.9), (2, "Revenue is 5", "revenue", 5.0, None, 0.9),
        (3, "Margin is low", "margin", 0.1, None, 0.9),
        (4, "a", "m", 1.0, None, 0.1), (4, "b", "m", 1.0, None, 0.9),
    ], CLAIMS)
    wanted = spark.createDataFrame([(1, "Revenue"), (1, "records"), (3, "gross_sales"), (5, "x")], "run_id int, metric string")
    every = spark.createDataFrame([(i,) for i in range(1, 6)], "run_id int")
    status = {r["run_id"]: r["status"] for r in evidence.grounding_status(every, claims, wanted).collect()}
    assert status == {1: "VALID", 2: "OVERREACH", 3: "INSUFFICIENT", 4: "CONTRADICTORY", 5: "INSUFFICIENT"}
    gaps = {(r["run_id"], r["metric"]) for r in evidence.uncovered_metrics(wanted, claims).collect()}
    assert gaps == {(3, "gross_sales"), (5, "x")}


RESULTS = (
    "run_id int, step_id int, success boolean, code string, return_value map<string,string>, "
    "extracted_metrics map<string,string>, "
    "breakdown array<struct<dimension:string,segment:string,sum:double,mean:double,count:bigint>>, "
    "importance array<struct<feature:string,importance:double>>"
)


def test_evidence_rows(spark):
    results = spark.createDataFrame([
        (1, 1, True, "forecast(df)", {"forecast_avg": "120000.0", "historical_avg": "100000.0", "trend": "increasing", "points_count": "90"},
         {"forecast_avg": "120000.0", "word": "x"}, None, None),
        (1, 2, True, "churn(df)", {"accuracy": "0.9", "total_customers": "50", "predicted_churned": "10"}, {}, None,
         [("recency", 3.0), ("monetary", 2.0), ("frequency", 1.0), ("other", 0.1)]),
        (1, 3, True, " by\nregion ", {"points_count": "7"}, {}, [("region", "A", 5.0, 1.0, 5), ("region", "B", 1234.5, 2.0, 2)], None),
        (1, 4, False, "broken", {"lost": "1"}, {}, None, None),
    ], RESULTS)
    rows = evidence.evidence_rows(results).collect()
    by_metric = {r["metric_name"]: r for r in rows}
    assert len(by_metric) == len(rows) and "lost" not in by_metric and "word" not in by_metric
    first = by_metric["forecasted_daily_revenue_avg"]
    assert first["metric_value"] == "120000.00" and first["confidence_score"] >= 0.8 and "120,000.00" in first["claim"] and first["artifact_id"] == "forecast_series"
    assert by_metric["points_count"]["step_id"] == 1 and by_metric["points_count"]["metric_value"] == "90"
    assert "10 of 50 customers (20.0%)" in by_metric["predicted_churn_rate"]["claim"]
    assert by_metric["shap_feature_importance"]["metric_value"] == "recency, monetary, frequency"
    assert by_metric["region_top_segment_contribution"]["claim"] == "By region, B comes first with 1,234.5 in all and 2.0 a row."
    assert by_metric["region_top_segment_contribution"]["code_reference"] == "by region"
    table = {r["metric"]: r for r in evidence.evidence_table(evidence.evidence_rows(results)).collect()}
    assert table["accuracy"]["confidence"] == "95%"


def test_experiences(spark):
    log = spark.createDataFrame([
        (1, "forecasting", ["s1", "s2"], ["f1"]), (2, "predictive", ["s3"], []), (3, "forecasting", ["s4", "s5", "s6"], []),
        (4, "forecasting", ["s7"], []),
    ], "seq int, task_type string, successful_steps array<string>, failures array<string>")
    asked = spark.createDataFrame([("forecasting",), ("diagnostic",), ("predictive",)], "task_type string")
    found = {r["task_type"]: (r["experiences"], r["heuristics"]) for r in experience.experience_topk(asked, log).collect()}
    assert found["forecasting"] == ([1, 3], ["s1", "s2", "Caution: f1", "s4", "s5"])
    assert found["predictive"] == ([2], ["s3"])
    assert found["diagnostic"] == ([1, 2], ["s1", "s2", "Caution: f1", "s3"])


def _brute_steps(rows, gap):
    out = []
    for owner in {r[0] for r in rows if r[0] is not None and r[1] is not None}:
        last, start, place, failed = None, None, 0, False
        for _, at, step_id, _, step, ok, message, insight in sorted((r for r in rows if r[0] == owner and r[1] is not None), key=lambda r: (r[1], r[2])):
            if last is None or at - last >= gap:
                start, place, failed = at, 0, False
            place += 1
            out.append((owner, start, place, step_id, step, "failed" if not ok else "recovered" if failed else "done", insight if ok else message))
            last, failed = at, not ok
    return sorted(out)


def test_runs_end_at_pauses(spark):
    from datetime import datetime, timedelta
    import random

    noise = random.Random(3)
    first = datetime(2024, 2, 28, 12)
    rows = [("busy", first + timedelta(minutes=29 * i), i, "forecasting", f"s{i}", i % 3 > 0, f"m{i}", f"i{i}") for i in range(300)]  # one run of six days
    rows += [("even", first + timedelta(minutes=30 * i), i, "predictive", "s", i % 2 > 0, "m", None) for i in range(100)]  # every pause just long enough
    rows += [("odd", first + timedelta(seconds=noise.randrange(9 * 86400)), i, "descriptive", "s", noise.random() < 0.6, "m", "i") for i in range(800)]
    rows += [("odd", first, 900 + i, "descriptive", "same time", i % 2 > 0, "m", "i") for i in range(4)] + [(None, first, 1, "x", "s", True, None, None), ("none", None, 1, "x", "s", True, None, None)]
    steps = spark.createDataFrame(rows, "owner string, at timestamp, step_id int, task_type string, step string, success boolean, message string, insight string").repartition(5)
    found = experience.experience_steps(steps)
    mine = sorted((r.owner, r.run_start, r.position, r.step_id, r.step, r.outcome, r.note) for r in found.collect())
    expected = _brute_steps(rows, timedelta(minutes=30))
    assert mine == expected
    runs = {(r.owner, r.run_start): r for r in experience.experiences(steps, "abc").collect()}
    assert len(runs) == len({(o, s) for o, s, *_ in expected}) and len([o for o, _ in runs if o == "busy"]) == 1 and len([o for o, _ in runs if o == "even"]) == 100
    for key, run in runs.items():
        own = [r for r in expected if r[:2] == key]
        assert (run.steps, run.failures, run.recoveries) == (len(own), sum(r[5] == "failed" for r in own), sum(r[5] == "recovered" for r in own))
        assert run.dataset_signature == "abc"
    assert runs["busy", first].task_type == "forecasting" and runs["busy", first].insights == 300
    with pytest.raises(ValueError):
        experience.experiences(steps, "abc", 0)


def test_a_signature_is_that_of_the_catalog(spark, five):
    from tallyloom.sources import tables

    five.createOrReplaceTempView("signed")
    assert experience.dataset_signature(five) == tables.schema_fingerprint(spark, ["signed"]).head()["fingerprint"]
