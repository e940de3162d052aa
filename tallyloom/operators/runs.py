"""Classify the records of a run log.

A record has ``success``, ``error_message``, ``stderr`` and two string maps,
``return_value`` (null if the run returned nothing) and ``extracted_metrics``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import contains_any

# Error words that point to the data, and the limits of the checks.
DATA_ERROR_WORDS = ["keyerror", "not in index", "column", "empty dataframe", "nodata"]
MIN_SAMPLE = 5
MIN_ACCURACY = 0.5
# Outcome, error type and suggested action of each rule.
OUTCOMES = {
    "data": ("DATA_ERROR", "DataMismatch", "REPLAN"),
    "code": ("CODE_ERROR", "RuntimeSyntaxError", "REPAIR_CODE"),
    "empty": ("INSUFFICIENT_EVIDENCE", "EmptyOutput", "SUPPLEMENT_EVIDENCE"),
    "error": ("ANALYSIS_ERROR", "AnalyticalFailure", "REPLAN"),
    "sample": ("STATISTICAL_WARNING", "LowSampleSize", "SUPPLEMENT_EVIDENCE"),
    "accuracy": ("ANALYSIS_ERROR", "SubstandardModelPerformance", "REPLAN"),
    "fine": ("SUCCESS", None, "PROCEED"),
}


def _first_number(*names: str) -> Column:
    """The first listed result that is a nonzero number; the last one counts even if zero."""
    values = [F.col("return_value")[n].try_cast("double") for n in names]
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values[:-1]], values[-1])


def _text(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def triage_runs(runs: DataFrame) -> DataFrame:
    """Adds outcome, error_type, suggested_action, details and target_step_id; the first rule that applies decides.

    ``target_step_id`` is the record's ``step_id`` if it has one, else null.
    """
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    message = F.lower(F.coalesce(_text(F.col("error_message")), _text(F.col("stderr")), F.lit("Unknown error")))
    returned = F.col("return_value").isNotNull()
    measured = F.coalesce(F.size(F.map_keys("extracted_metrics")), F.lit(0)) > 0
    rule = (
        F.when(failed & contains_any(message, DATA_ERROR_WORDS), "data")
        .when(failed, "code")
        .when(~returned & ~measured, "empty")
        .when(returned & F.map_contains_key("return_value", "error"), "error")
        .when(_first_number("total_customers", "points_count", "sample_size") < MIN_SAMPLE, "sample")
        .when(_first_number("accuracy", "model_accuracy") < MIN_ACCURACY, "accuracy")
        .otherwise("fine")
    )

    def named(position: int) -> Column:
        choice = F.lit(None).cast("string")
        for key, values in OUTCOMES.items():
            choice = F.when(F.col("_rule") == key, F.lit(values[position])).otherwise(choice)
        return choice

    said = F.coalesce(_text(F.col("error_message")), _text(F.col("stderr")), F.lit("no message"))
    number = lambda *names: F.round(_first_number(*names), 4).cast("string")
    details = (
        F.when(F.col("_rule") == "data", F.concat(F.lit("the data lacks what the run asked for: "), said))
        .when(F.col("_rule") == "code", F.concat(F.lit("the run broke off: "), said))
        .when(F.col("_rule") == "empty", F.lit("the run ended well but left neither a result nor a metric"))
        .when(F.col("_rule") == "error", F.concat(F.lit("the result itself is an error: "), F.col("return_value")["error"]))
        .when(F.col("_rule") == "sample", F.concat(F.lit("the result rests on few rows: "), number("total_customers", "points_count", "sample_size")))
        .when(F.col("_rule") == "accuracy", F.concat(F.lit("the model is right too seldom: "), number("accuracy", "model_accuracy")))
        .otherwise(F.lit("results and metrics are there"))
    )
    step = F.col("step_id") if "step_id" in runs.columns else F.lit(None).cast("int")
    ruled = runs.withColumn("_rule", rule)
    return ruled.select(
        "*", named(0).alias("outcome"), named(1).alias("error_type"), named(2).alias("suggested_action"),
        details.alias("details"), step.alias("target_step_id"),
    ).drop("_rule")


def triage_summary(runs: DataFrame) -> DataFrame:
    """(outcome, error_type, suggested_action, runs)."""
    return triage_runs(runs).groupBy("outcome", "error_type", "suggested_action").agg(F.count("*").alias("runs"))
