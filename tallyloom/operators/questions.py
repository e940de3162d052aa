"""Tag a table of free-text questions by keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, contains_any, word_count

# Task type, words that select it (substring match, first rule wins) and
# the analysis categories it needs.
TASK_RULES = [
    ("forecasting", ["forecast", "predict revenue", "future", "next month", "trend", "arima", "sales projection"],
     ["time_series", "eda"]),
    ("predictive", ["churn", "retention", "leave", "attrition", "risk", "predict customer"],
     ["ml", "explainability"]),
    ("diagnostic", ["why", "cause", "driver", "shap", "factor", "reason", "explain"],
     ["explainability", "statistical_test"]),
    ("comparative", ["compare", "difference", "vs", "versus", "higher than", "by region", "by category"],
     ["eda", "sql_query"]),
    ("recommendation", ["recommend", "action", "strategy", "improve", "optimize"],
     ["eda", "ml"]),
    ("statistical", ["correlat", "p-value", "significant", "hypothesis", "distribution", "variance"],
     ["statistical_test", "eda"]),
    ("general_chat", ["hello", "hi", "who are you", "what can you do", "help"],
     []),
]
DEFAULT_TASK = ("descriptive", ["eda"])
# The entities and metrics that questions may name.
ENTITIES = ["customer", "order", "product", "region", "payment_method", "revenue", "category", "date"]
METRICS = ["revenue", "sales", "churn", "count", "average_order_value", "quantity", "discount", "profit", "cost"]


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _found(values: list[str], text: Column, default: str) -> Column:
    """The listed words that occur in the text, with ``_`` also matching a space."""
    hits = F.filter(
        _words(values), lambda w: F.contains(text, w) | F.contains(text, F.replace(w, F.lit("_"), F.lit(" ")))
    )
    return F.when(F.size(hits) > 0, hits).otherwise(_words([default]))


def tag_questions(df: DataFrame, text: str = "question") -> DataFrame:
    """Adds task_type, categories, entities, metrics, constraints and is_ambiguous.

    Everything is a projection over the whole text; a blank question is ambiguous chat.
    """
    # Projected once: the rules below refer to them dozens of times.
    prepared = df.withColumns({
        "_lower": F.lower(col(text)), "_words": F.coalesce(word_count(col(text)), F.lit(0)),
    })
    question, lower, words = col(text), F.col("_lower"), F.col("_words")
    blank = words == 0
    task, categories = F.when(blank, "general_chat"), F.when(blank, _words([]))
    for name, keywords, needs in TASK_RULES:
        hit = contains_any(lower, keywords)
        task, categories = task.when(hit, name), categories.when(hit, _words(needs))
    year = F.nullif(F.regexp_extract(question, r"\b(20\d\d)\b", 1), F.lit(""))
    top = F.nullif(F.regexp_extract(lower, r"\btop\s*(\d+)\b", 1), F.lit(""))
    constraints = F.array_compact(F.array(
        F.concat(F.lit("year = "), year), F.concat(F.lit("limit = "), top)
    ))
    none = _words([])
    # Entities match as written; only metric names may also be spelled with a space.
    entities = F.filter(_words(ENTITIES), lambda w: F.contains(lower, w))
    entities = F.when(F.size(entities) > 0, entities).otherwise(_words(["dataset"]))
    tagged = prepared.withColumn("task_type", task.otherwise(DEFAULT_TASK[0])).withColumn(
        "categories", categories.otherwise(_words(DEFAULT_TASK[1]))
    )
    return tagged.select(
        "*",
        F.when(blank, none).otherwise(entities).alias("entities"),
        F.when(blank, none).otherwise(_found(METRICS, lower, "records")).alias("metrics"),
        F.when(blank, none).otherwise(constraints).alias("constraints"),
        (blank | ((words < 2) & (F.col("task_type") != "general_chat"))).alias("is_ambiguous"),
    ).drop("_lower", "_words")


def extract_customer_id(df: DataFrame, text: str = "question") -> DataFrame:
    """Adds ``customer_id``: the first ``CUST_<digits>`` of the text, upper-cased, or null."""
    found = F.regexp_extract(col(text), r"(?i)CUST_\d+", 0)
    return df.withColumn("customer_id", F.nullif(F.upper(found), F.lit("")))
