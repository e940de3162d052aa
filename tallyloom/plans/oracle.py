"""The same results in SQL for DuckDB, name by name.

Queries that SQL cannot express have no entry here: the fitted churn scores and the
least-squares autoregressive forecast. Word lists, thresholds and patterns below are fixed values: they repeat those
marked so in the operators, which results must equal.
"""

from __future__ import annotations

from ..sources.readers import MISSING
from .queries import COEFFICIENTS, GIVEN, INTERCEPT, PAUSE, RISK_DAYS, SAMPLED, SQL_TEXTS
from .tables import CLAIMS_SQL, COLUMNS, DIRTY_SQL, QUESTIONS_SQL, RUNS_SQL, TRANSACTIONS_SQL

# Spark type and pandas-style kind of each transactions column, in order.
_TYPES = {
    "order_id": "bigint", "line_no": "int", "customer_id": "bigint", "order_date": "date", "product_id": "bigint",
    "product_category": "string", "quantity": "double", "unit_price": "double", "discount": "double",
    "revenue": "double", "cost": "double", "payment_method": "string", "region": "string",
}
_NUMERIC = [c for c, t in _TYPES.items() if t in ("bigint", "int", "double")]
_MEASURES = ["quantity", "unit_price", "discount", "revenue", "cost"]
_ENCODED = ["product_category", "payment_method", "region"]


def _t(body: str) -> str:
    return f"WITH {TRANSACTIONS_SQL} {body}"


def _dirty(body: str, more: str = "") -> str:
    return f"WITH {DIRTY_SQL}{more} {body}"


def _r(value: str, digits: int) -> str:
    """Round half up in decimal, as the library does once summation noise is gone."""
    return f"CAST(round(CAST({value} AS DECIMAL(30, {digits + 7})), {digits}) AS DOUBLE)"


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _each(columns: list[str], template: str) -> str:
    """One SELECT per column: {c} is the column, {i} its position in the table."""
    return _union([template.format(c=c, i=COLUMNS.index(c), t=_TYPES[c]) for c in columns])


def _quantile(c: str, p: float) -> str:
    return f"quantile_cont(CAST({c} AS DOUBLE), {p})"


# --- cleaning pieces ------------------------------------------------------------------------

_FILLED = """,
common AS (SELECT region AS mode FROM dirty WHERE region IS NOT NULL GROUP BY region ORDER BY count(*) DESC, region LIMIT 1),
medians AS (SELECT quantile_cont(quantity, 0.5) AS mq, quantile_cont(unit_price, 0.5) AS mu,
  quantile_cont(discount, 0.5) AS md FROM dirty),
filled AS (
  SELECT order_id, line_no, customer_id, order_date, product_id, product_category,
    coalesce(quantity, mq) AS quantity, coalesce(unit_price, mu) AS unit_price, coalesce(discount, md) AS discount,
    revenue, cost, payment_method, coalesce(region, mode) AS region
  FROM dirty, medians, common)"""


def _fences(source: str, columns: list[str]) -> str:
    return "fences AS (" + _union([
        f"""SELECT '{c}' AS "column", q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
        (SELECT {_quantile(c, 0.25)} AS q1, {_quantile(c, 0.75)} AS q3 FROM {source})""" for c in columns
    ]) + ")"


def _bound(c: str, side: str) -> str:
    return f"""(SELECT {side} FROM fences WHERE "column" = '{c}')"""


def _outliers(source: str, columns: list[str]) -> str:
    return "outliers AS (" + _union([
        f"""SELECT f."column", count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outlier_count,
        count(*) FILTER (WHERE {c} < lo) AS capped_lower, count(*) FILTER (WHERE {c} > hi) AS capped_upper,
        round(lo, 2) AS lower_bound, round(hi, 2) AS upper_bound
        FROM {source}, fences f WHERE f."column" = '{c}' GROUP BY f."column", lo, hi""" for c in columns
    ]) + ")"


def _capped(c: str) -> str:
    lo, hi = _bound(c, "lo"), _bound(c, "hi")
    return f"""round(CASE WHEN {c} IS NOT NULL THEN CAST(greatest({lo}, least({hi}, {c})) AS DOUBLE) END, 4) AS {c}"""


_KEEP = [c for c in COLUMNS if c not in _MEASURES]
_CLEAN = _FILLED + ", uniq AS (SELECT DISTINCT * FROM filled), " + _fences("uniq", _NUMERIC) + ", " + _outliers("uniq", _NUMERIC)

# --- statistics pieces ------------------------------------------------------------------------

_STATS = """SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
  CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25,
  quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75,
  CAST(max({c}) AS DOUBLE) AS max FROM dirty"""
_STAT_TABLE = f", stats AS ({_each(_NUMERIC, _STATS)})"


def _correlations(source: str, digits: int) -> str:
    parts = [
        f"""SELECT '{a}' AS "column", '{b}' AS other,
        round(regr_sxy({b}, {a}) / nullif(sqrt(regr_sxx({b}, {a}) * regr_syy({b}, {a})), 0), {digits}) AS r FROM {source}"""
        for a in _NUMERIC for b in _NUMERIC
    ]
    return _union(parts)


_FACTS = """SELECT {i} AS ordinal, '{c}' AS "column", '{t}' AS dtype, count(*) AS row_count,
  count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_percentage,
  count(DISTINCT {c}) AS unique_count, count(DISTINCT {c}) = count(*) AS is_unique FROM dirty"""
_KIND = {c: "numeric" for c in _NUMERIC} | {"order_date": "datetime"} | {c: "categorical" for c in _ENCODED}
_SEMANTIC = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in _KIND.items()) + " END"


def _top(columns: list[str], k: int) -> str:
    counted = _each(columns, """SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM dirty
        WHERE {c} IS NOT NULL GROUP BY {c}""")
    return f"""(SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS position, value, n
        FROM ({counted}) QUALIFY position <= {k})"""


_SAMPLES = f"""(SELECT "column", string_agg(value || ' (' || n || ')', '; ' ORDER BY position) AS sample_summary
    FROM {_top(_ENCODED, 5)} GROUP BY "column")"""


def _profile(mode: str, samples: str) -> str:
    return _dirty(
        f"""SELECT f.ordinal, f."column", f.dtype, {_SEMANTIC.replace('"column"', 'f."column"')} AS semantic_type,
        f.null_count, f.null_percentage, f.unique_count, {samples} AS sample_summary,
        CAST(round(CAST(min AS DECIMAL(30, 9)), 2) AS DOUBLE) AS min, CAST(round(CAST(max AS DECIMAL(30, 9)), 2) AS DOUBLE) AS max, CAST(round(CAST(mean AS DECIMAL(30, 9)), 2) AS DOUBLE) AS mean, CAST(round(CAST(median AS DECIMAL(30, 9)), 2) AS DOUBLE) AS median,
        CAST(round(CAST(std AS DECIMAL(30, 9)), 2) AS DOUBLE) AS std, CAST(round(CAST(q25 AS DECIMAL(30, 9)), 2) AS DOUBLE) AS q25, CAST(round(CAST(q75 AS DECIMAL(30, 9)), 2) AS DOUBLE) AS q75, CAST(round(CAST(q75 - q25 AS DECIMAL(30, 9)), 2) AS DOUBLE) AS iqr,
        '{mode}' AS privacy_mode
        FROM facts f LEFT JOIN stats s ON f."column" = s."column" LEFT JOIN {_SAMPLES} p ON f."column" = p."column" """,
        f"{_STAT_TABLE}, facts AS ({_each(COLUMNS, _FACTS)})",
    )


# --- metrics pieces -----------------------------------------------------------------------------

_REV = "round(CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE), 2)"
_MONTHLY = f"""monthly AS (SELECT strftime(order_date, '%Y-%m') AS month, {_REV} AS revenue FROM transactions GROUP BY 1)"""
_TREND = """trend AS (SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS previous FROM monthly)"""
_DIRECTION = "CASE WHEN previous IS NOT NULL THEN CASE WHEN revenue > previous THEN 'growing' ELSE 'declining' END END"

# Dates go through text with the month first and are read back.
_TEXT_DATES = f"""WITH {TRANSACTIONS_SQL.replace("transactions AS (", "typed AS (", 1)},
texts AS (SELECT * REPLACE (strftime(order_date, '%m/%d/%Y') AS order_date) FROM typed),
transactions AS (SELECT * REPLACE (CAST(strptime(order_date, '%m/%d/%Y') AS DATE) AS order_date) FROM texts)"""

_FEATURES = """features AS (
  SELECT customer_id, CAST(date_diff('day', max(order_date), (SELECT max(order_date) FROM transactions)) AS INTEGER) AS recency,
    count(DISTINCT order_id) AS frequency, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS monetary,
    CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) / count(revenue) AS avg_order_value,
    avg(quantity) AS avg_quantity, avg(discount) AS avg_discount, count(DISTINCT product_category) AS distinct_categories
  FROM transactions GROUP BY customer_id),
labeled AS (SELECT *, CAST(recency > 60 AS INTEGER) AS churned FROM features)"""


def _features(body: str, more: str = "") -> str:
    return _t(f", {_FEATURES}{more} {body}")


_LOGIT = f"{INTERCEPT}::DOUBLE" + "".join(f" + {f} * ({w!r}::DOUBLE)" for f, w in COEFFICIENTS.items())
_SCORES = f""", scored AS (SELECT customer_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({_LOGIT}))) AS p FROM features),
scores AS (SELECT customer_id, round(p, 4) AS churn_probability, p >= 0.5 AS churned_predicted FROM scored)"""
_MEANS = ", means AS (SELECT " + ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in COEFFICIENTS) + " FROM features)"
_LONG = _MEANS + ", long AS (" + _union([
    f"""SELECT customer_id, {i} AS ordinal, '{f}' AS feature, ({w!r}::DOUBLE) * ({f} - m_{f}) AS raw,
    {_r(f, 2)} AS feature_value FROM features, means"""
    for i, (f, w) in enumerate(COEFFICIENTS.items())
]) + """), parts AS (SELECT customer_id, ordinal, feature, """ + _r("raw", 4) + """ AS contribution, raw,
  CASE WHEN raw > 0 THEN 'increases churn' ELSE 'decreases churn' END AS direction, feature_value FROM long),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, ordinal) AS rank FROM parts)"""


def _report() -> str:
    def row(c: int) -> str:
        tp = f"count(*) FILTER (WHERE churned = {c} AND predicted = {c})"
        return f"""SELECT {c} AS k, coalesce({tp} / nullif(count(*) FILTER (WHERE predicted = {c}), 0), 0) AS p,
        coalesce({tp} / nullif(count(*) FILTER (WHERE churned = {c}), 0), 0) AS r,
        count(*) FILTER (WHERE churned = {c}) AS s FROM judged"""
    return f""", judged AS (SELECT churned, CAST(recency > {RISK_DAYS} AS INTEGER) AS predicted FROM labeled),
    per AS ({row(0)} UNION ALL {row(1)}),
    scored AS (SELECT k, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f, s FROM per)
    SELECT CAST(k AS VARCHAR) AS label, round(p, 2) AS precision, round(r, 2) AS recall, round(f, 2) AS f1, s AS support FROM scored
    UNION ALL SELECT 'macro avg', round(avg(p), 2), round(avg(r), 2), round(avg(f), 2), CAST(sum(s) AS BIGINT) FROM scored
    UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 2), round(sum(r * s) / sum(s), 2),
      round(sum(f * s) / sum(s), 2), CAST(sum(s) AS BIGINT) FROM scored
    UNION ALL SELECT 'accuracy', NULL, NULL, round(avg(CASE WHEN churned = predicted THEN 1.0::DOUBLE ELSE 0 END), 4), count(*) FROM judged"""


# --- series pieces ----------------------------------------------------------------------------------

def _series(*by: str) -> str:
    """daily: sums per day; filled: gap-filled with a day index x; fit: the line per series."""
    keys = "".join(f"{b}, " for b in by)
    same = " AND ".join(["d.ds = c.ds"] + [f"d.{b} = c.{b}" for b in by])
    group = f"GROUP BY {', '.join(by)}" if by else ""
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    ckeys = "".join(f"c.{b}, " for b in by)
    return f""", daily AS (SELECT {keys}order_date AS ds, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS value
      FROM transactions GROUP BY {keys}order_date),
    calendar AS (SELECT {keys}CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM daily {group}),
    filled AS (SELECT {ckeys}c.ds, coalesce(value, 0) AS value,
      row_number() OVER ({part.replace('BY ', 'BY c.') if by else ''} ORDER BY c.ds) - 1 AS x FROM calendar c LEFT JOIN daily d ON {same}),
    line AS (SELECT {keys}max(ds) AS last_day, count(*) AS n, regr_slope(value, x) AS slope,
      regr_intercept(value, x) AS intercept FROM filled {group}),
    """


def _linear(*by: str) -> str:
    keys = "".join(f"{b}, " for b in by)
    join = " AND ".join(f"f.{b} = l.{b}" for b in by) or "true"
    lkeys = "".join(f"l.{b}, " for b in by)
    return _series(*by) + f"""fit AS (SELECT {lkeys}last_day, n, slope, intercept,
      stddev_pop(value - (slope * x + intercept)) AS sd FROM filled f JOIN line l ON {join} GROUP BY {lkeys}last_day, n, slope, intercept),
    steps AS (SELECT {keys}CAST(last_day + CAST(s AS INTEGER) AS DATE) AS ds, greatest(0, slope * (n + s - 1) + intercept) AS p, sd
      FROM fit, generate_series(1, 90) g(s) WHERE n >= 30),
    forecast AS (SELECT {keys}ds, {_r("p", 2)} AS value, {_r("greatest(0, p - 1.96 * sd)", 2)} AS lower,
      {_r("greatest(0, p + 1.96 * sd)", 2)} AS upper FROM steps)"""


def _summary(*by: str) -> str:
    keys = "".join(f"{b}, " for b in by)
    join = " AND ".join(f"r.{b} = a.{b}" for b in by) or "true"
    fjoin = " AND ".join(f"f.{b} = l.{b}" for b in by) or "true"
    rkeys = "".join(f"r.{b}, " for b in by)
    fkeys = "".join(f"f.{b}, " for b in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    fgroup = f"GROUP BY {', '.join('f.' + b for b in by)}" if by else ""
    return _linear(*by) + f""", recent AS (SELECT {fkeys}sum(value) / 30.0::DOUBLE AS last FROM filled f JOIN line l ON {fjoin}
      WHERE ds > last_day - 30 {fgroup}),
    ahead AS (SELECT {keys}avg(value) AS mean FROM forecast {group}),
    summary AS (SELECT {rkeys}{_r("last", 2)} AS last_30_days_avg, {_r("mean", 2)} AS forecast_avg,
      CASE WHEN mean > last THEN 'increasing' WHEN mean < last THEN 'decreasing' ELSE 'stable' END AS trend,
      90 AS forecast_periods,
      round(CASE WHEN {_r("last", 2)} > 0 THEN ({_r("mean", 2)} - {_r("last", 2)}) / {_r("last", 2)} * 100 ELSE 0 END, 2) AS percentage_change
      FROM recent r JOIN ahead a ON {join})"""


# --- text pieces ----------------------------------------------------------------------------------------

# The personal-data patterns, as in functions/masking.py.
_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
_PHONE = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
_CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"
_MASK1 = f"regexp_replace(text, '{_EMAIL}', '[REDACTED_EMAIL]', 'g')"
_MASK2 = f"regexp_replace({_MASK1}, '{_PHONE}', '[REDACTED_PHONE]', 'g')"
_MASK3 = f"regexp_replace({_MASK2}, '{_CARD}', '[REDACTED_CARD]', 'g')"


def _pii() -> str:
    kinds = [("email", "text", _EMAIL), ("phone", _MASK1, _PHONE), ("card", _MASK2, _CARD)]
    return _union([
        f"""SELECT source, '{k}' AS kind, CAST(sum(h) AS BIGINT) AS hits, count(*) FILTER (WHERE h > 0) AS texts FROM
        (SELECT source, len(regexp_extract_all({text}, '{pattern}')) AS h FROM documents) GROUP BY source"""
        for k, text, pattern in kinds
    ])


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


_RULES = [
    ("forecasting", "time_series; eda", ["forecast", "predict revenue", "future", "next month", "trend", "arima", "sales projection"]),
    ("predictive", "ml; explainability", ["churn", "retention", "leave", "attrition", "risk", "predict customer"]),
    ("diagnostic", "explainability; statistical_test", ["why", "cause", "driver", "shap", "factor", "reason", "explain"]),
    ("comparative", "eda; sql_query", ["compare", "difference", "vs", "versus", "higher than", "by region", "by category"]),
    ("recommendation", "eda; ml", ["recommend", "action", "strategy", "improve", "optimize"]),
    ("statistical", "statistical_test; eda", ["correlat", "p-value", "significant", "hypothesis", "distribution", "variance"]),
    ("general_chat", "", ["hello", "hi", "who are you", "what can you do", "help"]),
]
_TASK = "CASE " + " ".join(f"WHEN {_any(w)} THEN '{t}'" for t, _, w in _RULES) + " ELSE 'descriptive' END"
_CATEGORIES = "CASE " + " ".join(f"WHEN {_any(w)} THEN '{c}'" for _, c, w in _RULES) + " ELSE 'eda' END"


def _listed(words: list[str], default: str, spaces: bool) -> str:
    test = "contains(q, w)" + (" OR contains(q, replace(w, '_', ' '))" if spaces else "")
    return f"coalesce(nullif(array_to_string(list_filter({words!r}, lambda w: {test}), '; '), ''), '{default}')"


_ENTITIES = _listed(["customer", "order", "product", "region", "payment_method", "revenue", "category", "date"], "dataset", False)
_METRICS = _listed(
    ["revenue", "sales", "churn", "count", "average_order_value", "quantity", "discount", "profit", "cost"], "records", True
)
_TAGGED = rf"""tagged AS (
  SELECT question_id, CASE WHEN words = 0 THEN 'general_chat' ELSE {_TASK} END AS task_type,
    CASE WHEN words = 0 THEN '' ELSE {_CATEGORIES} END AS categories,
    CASE WHEN words = 0 THEN '' ELSE {_ENTITIES} END AS entities, CASE WHEN words = 0 THEN '' ELSE {_METRICS} END AS metrics,
    CASE WHEN words = 0 THEN '' ELSE concat_ws('; ', 'year = ' || nullif(regexp_extract(question, '\b(20\d\d)\b', 1), ''),
      'limit = ' || nullif(regexp_extract(q, '\btop\s*(\d+)\b', 1), '')) END AS constraints, words
  FROM (SELECT question_id, question, lower(question) AS q, len(regexp_extract_all(question, '\S+')) AS words FROM question_log))"""

_TRIAGE = """triaged AS (SELECT run_id,
  CASE WHEN event_type = 'error' THEN CASE WHEN k % 4 IN (0, 2) THEN 'data' ELSE 'code' END
    WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 'fine' ELSE 'empty' END
    WHEN event_type = 'purchase' AND k % 5 = 0 THEN 'error'
    WHEN event_type = 'purchase' THEN CASE WHEN k < 5 AND k <> 0 THEN 'sample' WHEN k / 50.0 < 0.5 THEN 'accuracy' ELSE 'fine' END
    WHEN event_type = 'signup' THEN CASE WHEN k % 7 BETWEEN 1 AND 4 THEN 'sample' WHEN k > 0 AND k / 100.0 < 0.5 THEN 'accuracy' ELSE 'fine' END
    WHEN k % 10 < 5 THEN 'sample' ELSE 'fine' END AS rule, event_type, k FROM run_log),
named AS (SELECT run_id,
  CASE rule WHEN 'data' THEN 'DATA_ERROR' WHEN 'code' THEN 'CODE_ERROR' WHEN 'empty' THEN 'INSUFFICIENT_EVIDENCE'
    WHEN 'sample' THEN 'STATISTICAL_WARNING' WHEN 'fine' THEN 'SUCCESS' ELSE 'ANALYSIS_ERROR' END AS outcome,
  CASE rule WHEN 'data' THEN 'DataMismatch' WHEN 'code' THEN 'RuntimeSyntaxError' WHEN 'empty' THEN 'EmptyOutput'
    WHEN 'error' THEN 'AnalyticalFailure' WHEN 'sample' THEN 'LowSampleSize' WHEN 'accuracy' THEN 'SubstandardModelPerformance' END AS error_type,
  CASE rule WHEN 'code' THEN 'REPAIR_CODE' WHEN 'fine' THEN 'PROCEED' WHEN 'empty' THEN 'SUPPLEMENT_EVIDENCE'
    WHEN 'sample' THEN 'SUPPLEMENT_EVIDENCE' ELSE 'REPLAN' END AS suggested_action,
  CASE rule WHEN 'data' THEN 'the data lacks what the run asked for: ' || CASE k % 4 WHEN 0 THEN 'KeyError: ''revenue_target''' ELSE 'Column revenue_target is missing' END
    WHEN 'code' THEN 'the run broke off: ' || CASE k % 4 WHEN 1 THEN 'IndexError: list index out of range' ELSE 'no message' END
    WHEN 'empty' THEN 'the run ended well but left neither a result nor a metric' WHEN 'error' THEN 'the result itself is an error: no convergence'
    WHEN 'sample' THEN 'the result rests on few rows: ' || CAST(CAST(CASE event_type WHEN 'purchase' THEN k WHEN 'signup' THEN k % 7 ELSE k % 10 END AS DOUBLE) AS VARCHAR)
    WHEN 'accuracy' THEN 'the model is right too seldom: ' || CAST(round(CASE event_type WHEN 'purchase' THEN k / 50.0::DOUBLE ELSE k / 100.0::DOUBLE END, 4) AS VARCHAR)
    ELSE 'results and metrics are there' END AS details, 1 AS target_step_id
  FROM triaged)"""

_PLAIN = "regexp_replace(format('{{:,.2f}}', {0}), '0$', '')"
_EVIDENCE = _summary("region") + f""", {_FEATURES}{_SCORES}{_LONG},
  judged AS (SELECT region, count(*) AS n, count(*) FILTER (WHERE churned_predicted) AS p, round(avg(CAST(CAST(churned_predicted AS INTEGER) = churned AS INTEGER)), 4) AS a
    FROM labeled JOIN scores USING (customer_id) JOIN (SELECT DISTINCT customer_id, region FROM transactions) USING (customer_id) GROUP BY region),
  weights AS (SELECT feature, round(avg(abs(raw)), 4) AS w FROM parts GROUP BY feature),
  top AS (SELECT string_agg(feature, ', ' ORDER BY w DESC, feature) AS names FROM (SELECT * FROM weights ORDER BY w DESC, feature LIMIT 3)),
  sums AS (SELECT region, product_category, round(sum(revenue), 2) AS s, round(avg(revenue), 2) AS m
    FROM transactions GROUP BY region, product_category),
  lead AS (SELECT region, product_category, s, m, count(*) OVER (PARTITION BY region) AS k, sum(s) OVER (PARTITION BY region) AS total
    FROM sums QUALIFY row_number() OVER (PARTITION BY region ORDER BY s DESC, product_category) = 1),
  texts AS (SELECT region, printf('%.2f', total) AS total FROM lead),
  fc AS (SELECT region, trend, forecast_avg AS f, last_30_days_avg AS h FROM summary),
  scalars AS (SELECT region, 1 AS step, 'total_revenue' AS k, total AS v FROM texts
    UNION ALL SELECT region, 2, 'trend', trend FROM fc UNION ALL SELECT region, 2, 'forecast_avg', printf('%.2f', f) FROM fc
    UNION ALL SELECT region, 2, 'historical_avg', printf('%.2f', h) FROM fc UNION ALL SELECT region, 2, 'points_count', '90' FROM fc
    UNION ALL SELECT region, 3, 'total_customers', CAST(n AS VARCHAR) FROM judged UNION ALL SELECT region, 3, 'predicted_churned', CAST(p AS VARCHAR) FROM judged
    UNION ALL SELECT region, 3, 'accuracy', CAST(a AS VARCHAR) FROM judged),
  evidence AS (
    SELECT region AS run_id, 1 AS step_id, 'By product_category, ' || product_category || ' comes first with '
      || {_PLAIN.format('s')} || ' in all and ' || {_PLAIN.format('m')} || ' a row.' AS claim,
      'product_category_top_segment_contribution' AS metric_name, s AS number, CAST(NULL AS VARCHAR) AS word,
      'Segment Aggregation' AS test_name, CAST(NULL AS DOUBLE) AS statistic_value, k AS sample_size,
      0.95::DOUBLE AS confidence_score, 'segment_breakdown' AS artifact_id, 'revenue_by_category(df) show()' AS code_reference FROM lead
    UNION ALL SELECT region, 2, 'A day is expected to bring ' || format('{{:,.2f}}', f) || ', after ' || format('{{:,.2f}}', h) || ' a day so far: ' || trend || '.',
      'forecasted_daily_revenue_avg', f, NULL, 'ARIMA / Autoregressive Trend Projection', NULL, 90, 0.9::DOUBLE, 'forecast_series', 'forecast_linear(daily)' FROM fc
    UNION ALL SELECT region, 3, p || ' of ' || n || ' customers (' || printf('%.1f', round(p * 100.0::DOUBLE / n, 1)) || '%) look set to leave, says a model that is right about '
      || printf('%.1f', a * 100) || '% of them.', 'predicted_churn_rate', NULL, printf('%.1f', round(p * 100.0::DOUBLE / n, 1)), 'Logistic Regression Classification', a, n,
      CASE WHEN a <> 0 THEN round(a, 2) ELSE 0.85 END, 'churn_model_predictions', 'score_customers(features)' FROM judged
    UNION ALL SELECT region, 4, 'What moves the prediction most: ' || names || '.', 'shap_feature_importance', NULL, names, 'SHAP LinearExplainer Attribution', NULL, NULL,
      0.92::DOUBLE, 'feature_importance', 'global_importance(features)' FROM judged, top
    UNION ALL SELECT region, step, 'The run returned ' || v || ' as ' || k || '.', k, NULL, v, NULL, NULL, NULL, 0.95::DOUBLE, NULL,
      CASE step WHEN 1 THEN 'revenue_by_category(df) show()' WHEN 2 THEN 'forecast_linear(daily)' ELSE 'score_customers(features)' END FROM scalars)"""



def _tail(density: str, low: str, width: str, steps: int = 20000) -> str:
    """A tail probability by Simpson's rule over the density in u; what lies beyond the width is far below the digits shown."""
    return f"""(SELECT round(sum((CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density})) * ({width}) / {steps * 3}, 6)
        FROM (SELECT i, {low} + ({width}) * i / {steps} AS u FROM generate_series(0, {steps}) g(i)))"""


def _t_tails(t: str, v: str) -> str:
    density = f"2 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * (1 + u * u / {v}) ** (-({v} + 1) / 2)"
    return _tail(density, f"abs({t})", "40")


_F_TAIL = _tail(
    "exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + d1 / 2 * ln(d1 / d2) + (d1 / 2 - 1) * ln(u) - (d1 + d2) / 2 * ln(1 + d1 * u / d2))",
    "f", "(60 + 12 * sqrt(d1)) / d1")
_CHI_TAIL = _tail("exp((k / 2 - 1) * ln(u) - u / 2 - k / 2 * ln(2) - lgamma(k / 2))", "x", "60 + 12 * sqrt(k)")

_ANOVA = """, g AS (SELECT product_category, avg(revenue) AS m, count(*) AS n FROM transactions GROUP BY 1),
        s AS (SELECT sum((t.revenue - g.m) * (t.revenue - g.m)) AS w FROM transactions t JOIN g USING (product_category)),
        b AS (SELECT sum(n * (m - (SELECT avg(revenue) FROM transactions)) ** 2) AS b, count(*) AS k, sum(n) AS n FROM g),
        f AS (SELECT (b / (k - 1)) / (w / (n - k)) AS f, CAST(k - 1 AS DOUBLE) AS d1, CAST(n - k AS DOUBLE) AS d2 FROM b, s)
        SELECT round(f, {digits}) AS f_statistic, CAST(d1 AS BIGINT) AS df_between, CAST(d2 AS BIGINT) AS df_within, {tail} AS p_value FROM f"""
_MISSING = ", ".join("'" + m + "'" for m in MISSING)

#: Runs as islands between gaps: a flag where a pause ends, summed up.
_RUNS_BY_PAUSE = f"""flagged AS (SELECT user_id AS owner, ts, event_id AS step_id, event_type AS step, props,
    coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL {PAUSE} MINUTE, true) AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  numbered AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY owner ORDER BY ts, step_id) AS run FROM flagged),
  placed AS (SELECT *, min(ts) OVER (PARTITION BY owner, run) AS run_start, row_number() OVER (PARTITION BY owner, run ORDER BY ts, step_id) AS position,
    CASE step WHEN 'purchase' THEN 'forecasting' WHEN 'signup' THEN 'predictive' ELSE 'descriptive' END AS task_type,
    CASE WHEN step = 'error' THEN 'failed' WHEN lag(step) OVER (PARTITION BY owner, run ORDER BY ts, step_id) = 'error' THEN 'recovered' ELSE 'done' END AS outcome,
    CASE WHEN step IN ('error', 'purchase') THEN props END AS note FROM numbered)"""

#: Orders 0 to 5 of the daily steps of a region, each from the one before.
_LEVINSON = """steps AS (SELECT region, ds, value, value - lag(value) OVER (PARTITION BY region ORDER BY ds) AS d FROM filled),
        centered AS (SELECT *, d - avg(d) OVER (PARTITION BY region) AS c FROM steps WHERE d IS NOT NULL),
        lagged AS (SELECT *, """ + ", ".join(f"lag(c, {k}) OVER (PARTITION BY region ORDER BY ds) AS l{k}" for k in range(1, 6)) + """ FROM centered),
        g AS (SELECT region, count(*) AS n, avg(d) AS mu, max(ds) AS last_day, arg_max(value, ds) AS level, arg_max([c, l1, l2, l3, l4], ds) AS recent,
          [sum(c * c) / count(*), """ + ", ".join(f"sum(c * l{k}) / count(*)" for k in range(1, 6)) + """] AS g FROM lagged GROUP BY region),
        lev AS (SELECT region, 0 AS m, CAST([] AS DOUBLE[]) AS a, g[1] AS e FROM g
          UNION ALL SELECT region, m + 1, list_append(list_transform(a, lambda x, i: x - k * a[m + 1 - i]), k), e * (1 - k * k)
          FROM (SELECT lev.*, (g.g[m + 2] - coalesce(list_sum(list_transform(a, lambda x, i: x * g.g[m + 2 - i])), 0)) / e AS k FROM lev JOIN g USING (region) WHERE m < 5)),
        fits AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY aic, m) AS place FROM (SELECT lev.*, n * ln(e) + 2 * (m + 1) AS aic FROM lev JOIN g USING (region)))"""


def _catalog(columns, samples: str = "") -> str:
    """Columns of tables as the catalog has them; with ``samples`` of {t} and {c} the columns are given by table."""
    def one(t: str, where: str, more: str = "") -> str:
        return f"""SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name AS "column",
        CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
          WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'timestamp_ntz' END AS type,
        is_nullable = 'YES' AS nullable, (SELECT count(*) FROM {t}) AS row_count{more}
        FROM information_schema.columns WHERE table_name = '{t}'{where}"""
    if not samples:
        return _union([one(t, "") for t in columns])
    return _union([one(t, f" AND column_name = '{c}'", f", {samples.format(t=t, c=c)} AS samples") for t, names in columns.items() for c in names])


ORACLE: dict[str, str] = {
    # sources, catalog, SQL
    "scan_transactions": _t("SELECT * FROM transactions"),
    "scan_csv": f"SELECT * REPLACE (CASE WHEN text NOT IN ({_MISSING}) THEN text END AS text) FROM documents",
    "scan_json": "SELECT * FROM customer",
    "scan_json_array": "SELECT * FROM documents",
    "write_table_summary": _t(f"""SELECT 'stored_transactions' AS table_name, count(*) AS rows_loaded, 13 AS column_count,
        '{','.join(COLUMNS)}' AS columns, 'success' AS status FROM transactions"""),
    "table_catalog": _catalog(GIVEN),
    "schema_with_samples": _catalog(SAMPLED, """(SELECT string_agg(CAST(v AS VARCHAR), ' | ' ORDER BY v) FROM (SELECT DISTINCT "{c}" AS v FROM {t} WHERE "{c}" IS NOT NULL ORDER BY v LIMIT 3))"""),
    "schema_without_samples": _catalog(SAMPLED, "CAST(NULL AS VARCHAR)"),
    "table_names": _union([f"SELECT DISTINCT table_name FROM information_schema.columns WHERE table_name = '{t}'" for t in GIVEN]),
    "detect_schema": _dirty(_each(COLUMNS, """SELECT {i} AS ordinal, '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null,
        count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
        (SELECT string_agg(CAST(v AS VARCHAR), '; ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM dirty WHERE {c} IS NOT NULL
          ORDER BY v LIMIT 3)) AS sample_values FROM dirty""")),
    "detect_schema_approximately": _dirty(_each(COLUMNS, """SELECT {i} AS ordinal, '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null,
        count(*) - count({c}) AS null_count, (SELECT string_agg(CAST(v AS VARCHAR), '; ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM dirty WHERE {c} IS NOT NULL
          ORDER BY v LIMIT 3)) AS sample_values FROM dirty""")),
    "dataset_info": _t(f"""SELECT count(*) AS num_rows, 13 AS num_columns, '{','.join(COLUMNS)}' AS column_names,
        'order_date' AS date_column, strftime(min(order_date), '%Y-%m-%d %H:%M:%S') AS date_min,
        strftime(max(order_date), '%Y-%m-%d %H:%M:%S') AS date_max FROM transactions"""),
    "schema_fingerprint": f"""SELECT table_name, CAST(count(*) AS INTEGER) AS column_count,
        substr(md5(string_agg(column_name, '_' ORDER BY column_name)), 1, 12) AS fingerprint
        FROM information_schema.columns WHERE table_name IN {GIVEN} GROUP BY table_name""",
    # cleaning
    "missing_values": _dirty(f"""SELECT * FROM ({_each(COLUMNS, '''SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percentage FROM dirty''')}) WHERE missing_count > 0"""),
    "impute_median": _dirty("SELECT order_id, line_no, quantity, unit_price, discount, revenue, cost FROM filled", _FILLED),
    "impute_mode": _dirty("SELECT order_id, line_no, payment_method, region FROM filled", _FILLED),
    "impute_report": _dirty(_union([
        f"""SELECT '{c}' AS "column", (SELECT count(*) - count({c}) FROM dirty) AS filled, 'median' AS method,
        CAST({m} AS VARCHAR) AS fill_value FROM medians""" for c, m in (("quantity", "mq"), ("unit_price", "mu"), ("discount", "md"))
    ] + ["""SELECT 'region', (SELECT count(*) - count(region) FROM dirty), 'mode', mode FROM common"""]), _FILLED),
    "duplicate_count": _dirty(f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM dirty GROUP BY ALL, {', '.join(COLUMNS)})".replace("GROUP BY ALL, ", "GROUP BY ")),
    "deduplicate": _dirty("SELECT DISTINCT * FROM dirty"),
    "outliers_iqr": _dirty("SELECT * FROM outliers WHERE outlier_count > 0", f", {_fences('dirty', _MEASURES)}, {_outliers('dirty', _MEASURES)}"),
    "cap_outliers": _dirty(f"SELECT order_id, line_no, {', '.join(_capped(c) for c in _MEASURES)} FROM dirty", f", {_fences('dirty', _MEASURES)}"),
    "clean_transactions": _dirty(f"SELECT {', '.join(_KEEP)}, {', '.join(_capped(c) for c in _MEASURES)} FROM uniq", _CLEAN),
    "clean_report": _dirty("""SELECT 'summary' AS section, NULL AS "column", 'initial_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM dirty
        UNION ALL SELECT 'summary', NULL, 'initial_columns', 13
        UNION ALL SELECT 'summary', NULL, 'total_missing', 4 * count(*) - count(quantity) - count(unit_price) - count(discount) - count(region) FROM dirty
        UNION ALL SELECT 'summary', NULL, 'duplicates_removed', (SELECT count(*) FROM dirty) - count(*) FROM uniq
        UNION ALL SELECT 'summary', NULL, 'final_rows', count(*) FROM uniq
        UNION ALL SELECT 'summary', NULL, 'final_columns', 13
        UNION ALL SELECT 'missing', 'quantity', 'filled', count(*) - count(quantity) FROM dirty
        UNION ALL SELECT 'missing', 'unit_price', 'filled', count(*) - count(unit_price) FROM dirty
        UNION ALL SELECT 'missing', 'discount', 'filled', count(*) - count(discount) FROM dirty
        UNION ALL SELECT 'missing', 'region', 'filled', count(*) - count(region) FROM dirty
        UNION ALL SELECT 'outliers', "column", 'capped_lower', capped_lower FROM outliers WHERE outlier_count > 0
        UNION ALL SELECT 'outliers', "column", 'capped_upper', capped_upper FROM outliers WHERE outlier_count > 0
        UNION ALL SELECT 'outliers', "column", 'lower_bound', lower_bound FROM outliers WHERE outlier_count > 0
        UNION ALL SELECT 'outliers', "column", 'upper_bound', upper_bound FROM outliers WHERE outlier_count > 0""", _CLEAN),
    # encoding
    "encode_labels": _dirty("SELECT order_id, line_no, revenue, " + ", ".join(
        f"(SELECT code FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce({c}, 'nan') AS v FROM dirty)) m "
        f"WHERE m.v = coalesce(dirty.{c}, 'nan')) AS {c}" for c in _ENCODED) + " FROM dirty"),
    "encoding_map": _dirty(_each(_ENCODED, """SELECT '{c}' AS "column", v AS label, row_number() OVER (ORDER BY v) - 1 AS code
        FROM (SELECT DISTINCT coalesce({c}, 'nan') AS v FROM dirty)""")),
    "scale_zscore": _t("SELECT order_id, line_no, " + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM transactions)) / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM transactions), 6) AS {c}"
        for c in _MEASURES) + " FROM transactions"),
    "scaler_info": _t(", coded AS (SELECT " + ", ".join(_MEASURES) + ", " + ", ".join(
        f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in _ENCODED) + " FROM transactions) " + _union([
        f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(coalesce(nullif(stddev_pop({c}), 0), 1), 4) AS std FROM coded"""
        for c in _MEASURES + _ENCODED])),
    # statistics and profile
    "column_statistics": _dirty("""SELECT "column", CAST(round(CAST(mean AS DECIMAL(30, 9)), 2) AS DOUBLE) AS mean, CAST(round(CAST(median AS DECIMAL(30, 9)), 2) AS DOUBLE) AS median, CAST(round(CAST(std AS DECIMAL(30, 9)), 2) AS DOUBLE) AS std,
        CAST(round(CAST(min AS DECIMAL(30, 9)), 2) AS DOUBLE) AS min, CAST(round(CAST(max AS DECIMAL(30, 9)), 2) AS DOUBLE) AS max, CAST(round(CAST(q25 AS DECIMAL(30, 9)), 2) AS DOUBLE) AS q25, CAST(round(CAST(q75 AS DECIMAL(30, 9)), 2) AS DOUBLE) AS q75 FROM stats""", _STAT_TABLE),
    "describe_table": _dirty("""SELECT "column", count, CAST(round(CAST(mean AS DECIMAL(30, 9)), 2) AS DOUBLE) AS mean, CAST(round(CAST(std AS DECIMAL(30, 9)), 2) AS DOUBLE) AS std, CAST(round(CAST(min AS DECIMAL(30, 9)), 2) AS DOUBLE) AS min,
        CAST(round(CAST(q25 AS DECIMAL(30, 9)), 2) AS DOUBLE) AS q25, CAST(round(CAST(median AS DECIMAL(30, 9)), 2) AS DOUBLE) AS median, CAST(round(CAST(q75 AS DECIMAL(30, 9)), 2) AS DOUBLE) AS q75, CAST(round(CAST(max AS DECIMAL(30, 9)), 2) AS DOUBLE) AS max FROM stats""", _STAT_TABLE),
    "correlation_matrix": _dirty(_correlations("dirty", 3)),
    "correlation_matrix_4dp": _t(_correlations("transactions", 4)),
    "column_summaries": _dirty(_union([
        f"""SELECT '{c}' AS "column", '{'numeric' if c in _NUMERIC else 'categorical'}' AS kind, count({c}) AS non_null,
        count(DISTINCT {c}) AS unique_count FROM dirty""" for c in COLUMNS])),
    "top_values": _dirty(f"SELECT * FROM {_top(['order_date'] + _ENCODED, 10)}"),
    "profile_columns": _dirty(_each(COLUMNS, _FACTS)),
    "semantic_types": _union([f"""SELECT '{c}' AS "column", '{k}' AS semantic_type""" for c, k in _KIND.items()]),
    "profile_stats": _dirty("""SELECT "column", CAST(round(CAST(min AS DECIMAL(30, 9)), 2) AS DOUBLE) AS min, CAST(round(CAST(max AS DECIMAL(30, 9)), 2) AS DOUBLE) AS max, CAST(round(CAST(mean AS DECIMAL(30, 9)), 2) AS DOUBLE) AS mean, CAST(round(CAST(median AS DECIMAL(30, 9)), 2) AS DOUBLE) AS median,
        round(coalesce(std, 0), 2) AS std, CAST(round(CAST(q25 AS DECIMAL(30, 9)), 2) AS DOUBLE) AS q25, CAST(round(CAST(q75 AS DECIMAL(30, 9)), 2) AS DOUBLE) AS q75, CAST(round(CAST(q75 - q25 AS DECIMAL(30, 9)), 2) AS DOUBLE) AS iqr FROM stats""", _STAT_TABLE),
    "profile_top5": _dirty(f"SELECT * FROM {_SAMPLES}"),
    "strong_correlations": _dirty("""SELECT 'correlation' AS type, a AS source, b AS target, round(r, 3) AS strength,
        a || ' and ' || b || ' move together with r = ' || printf('%.2f', r) AS description FROM (""" + _union([
        f"SELECT '{a}' AS a, '{b}' AS b, regr_sxy({b}, {a}) / nullif(sqrt(regr_sxx({b}, {a}) * regr_syy({b}, {a})), 0) AS r FROM dirty"
        for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1:]]) + ") WHERE abs(r) >= 0.4"),
    "date_ranges": _dirty("""SELECT 'order_date' AS "column", strftime(min(order_date), '%Y-%m-%d %H:%M:%S') AS min,
        strftime(max(order_date), '%Y-%m-%d %H:%M:%S') AS max, date_diff('day', min(order_date), max(order_date)) AS span_days FROM dirty"""),
    "dataset_profile": _dirty(f"""SELECT 'transactions' AS dataset_name, count(*) AS row_count, {len(COLUMNS)}::BIGINT AS column_count,
        '{"; ".join(_NUMERIC)}' AS numeric_columns, '{"; ".join(_ENCODED)}' AS categorical_columns, 'order_date' AS datetime_columns, '' AS id_columns,
        'transactions: ' || count(*) || ' rows of {len(COLUMNS)} columns; told apart by none; measured in {", ".join(_NUMERIC)}; grouped by {", ".join(_ENCODED)}.' AS description,
        'STRICT' AS privacy_mode, 'only schema and aggregates are shown; sample values are withheld' AS privacy_notice FROM dirty"""),
    "shared_profile": _dirty("SELECT 'dataset' AS section, 'transactions' AS item, 'categorical_columns, column_count, dataset_name, datetime_columns, description, id_columns, numeric_columns, privacy_notice, row_count' AS facts, '-' AS samples, 'STRICT' AS privacy_mode UNION ALL "
        + _union([f"""SELECT 'column', '{c}', 'column, dtype, """ + ("iqr, max, mean, median, min, " if c in _NUMERIC else "") + "null_count, null_percentage, " + ("q25, q75, " if c in _NUMERIC else "") + "sample_summary, semantic_type, " + ("std, " if c in _NUMERIC else "") + "unique_count', '[REDACTED_UNDER_STRICT_PRIVACY]', 'STRICT'" for c in COLUMNS])
        + " UNION ALL SELECT 'relationship', a || ' - ' || b, 'description, source, strength, target, type', '-', 'STRICT' FROM (" + _union([
            f"SELECT '{a}' AS a, '{b}' AS b, regr_sxy({b}, {a}) / nullif(sqrt(regr_sxx({b}, {a}) * regr_syy({b}, {a})), 0) AS r FROM dirty"
            for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1:]]) + ") WHERE abs(r) >= 0.4 UNION ALL SELECT 'date_range', 'order_date', 'column, max, min, span_days', '-', 'STRICT'"),
    "profile_strict": _profile("STRICT", "'[REDACTED_UNDER_STRICT_PRIVACY]'"),
    "profile_standard": _profile("STANDARD", "coalesce(p.sample_summary, '')"),
    # privacy
    "mask_pii": f"SELECT doc_id, {_MASK3} AS text FROM documents",
    "pii_counts": _pii(),
    # metrics
    "kpi_totals": _t(f"""SELECT {_REV} AS total_revenue, round(CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) / count(revenue), 2) AS average_order_value,
        round(CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) / count(DISTINCT order_id), 2) AS revenue_per_order,
        count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS total_customers FROM transactions"""),
    "revenue_by_category": _t(f"SELECT product_category, {_REV} AS revenue FROM transactions GROUP BY 1"),
    "revenue_by_region": _t(f"SELECT region, {_REV} AS revenue FROM transactions GROUP BY 1"),
    "monthly_revenue_from_text": f"{_TEXT_DATES}, {_MONTHLY} SELECT * FROM monthly",
    "daily_revenue_from_text": f"""{_TEXT_DATES} SELECT region, order_date AS ds, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS value
        FROM transactions GROUP BY region, order_date""",
    "date_ranges_from_text": f"""{_TEXT_DATES} SELECT 'order_date' AS "column", strftime(min(order_date), '%Y-%m-%d %H:%M:%S') AS min,
        strftime(max(order_date), '%Y-%m-%d %H:%M:%S') AS max, date_diff('day', min(order_date), max(order_date)) AS span_days FROM transactions""",
    "dataset_info_from_text": f"""{_TEXT_DATES} SELECT count(*) AS num_rows, 3 AS num_columns, 'order_date,revenue,region' AS column_names,
        'order_date' AS date_column, strftime(min(order_date), '%Y-%m-%d %H:%M:%S') AS date_min,
        strftime(max(order_date), '%Y-%m-%d %H:%M:%S') AS date_max FROM transactions""",
    "discount_given_by_category": _t(f"SELECT product_category, {_r('sum(quantity * unit_price * discount / 7)', 2)} AS revenue FROM transactions GROUP BY 1"),
    "monthly_revenue": _t(f", {_MONTHLY} SELECT * FROM monthly"),
    "top_customers": _t(f"SELECT customer_id, {_REV} AS revenue FROM transactions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "orders_by_payment": _t("SELECT payment_method, count(*) AS orders FROM transactions GROUP BY 1"),
    "segment_breakdown": _dirty("""SELECT region AS segment, round(sum(revenue), 2) AS sum, round(avg(revenue), 2) AS mean,
        count(revenue) AS count, false AS is_total FROM dirty WHERE region IS NOT NULL GROUP BY region
        UNION ALL SELECT NULL, round(sum(revenue), 2), round(avg(revenue), 2), count(revenue), true FROM dirty"""),
    "segment_share_rank": _t("""SELECT segment, sum, round(sum * 100.0::DOUBLE / (sum(sum) OVER ()), 2) AS share, rank() OVER (ORDER BY sum DESC) AS rank
        FROM (SELECT CAST(customer_id AS VARCHAR) AS segment, round(sum(revenue), 2) AS sum FROM transactions GROUP BY 1)"""),
    "monthly_trend": _t(f", {_MONTHLY}, {_TREND} SELECT month, revenue, previous, {_DIRECTION} AS direction FROM trend"),
    "filter_date_range": _t("""SELECT order_id, line_no, order_date, quantity, revenue FROM transactions
        WHERE quantity > 40 AND order_date >= DATE '1997-01-01' AND order_date < DATE '1998-07-01'"""),
    "aggregate_by": _dirty("""SELECT product_category, round(sum(revenue), 2) AS sum, round(avg(revenue), 2) AS mean,
        round(quantile_cont(revenue, 0.5), 2) AS median, count(revenue) AS count FROM dirty GROUP BY product_category"""),
    # churn and attribution
    "churn_features": _features("""SELECT customer_id, recency, frequency, round(monetary, 2) AS monetary, round(avg_order_value, 8) AS avg_order_value,
        round(avg_quantity, 8) AS avg_quantity, round(avg_discount, 8) AS avg_discount, distinct_categories FROM features"""),
    "churn_labels": _features("SELECT customer_id, recency, churned FROM labeled"),
    "stratified_split": _features("""SELECT customer_id, churned, row_number() OVER (PARTITION BY churned ORDER BY md5(customer_id || '42'), customer_id)
        <= ceil(0.2 * count(*) OVER (PARTITION BY churned)) AS is_test FROM labeled"""),
    "classification_report": _features(_report()),
    "churn_summary": _features("""SELECT count(*) AS total_customers, count(*) FILTER (WHERE churned_predicted) AS predicted_churned,
        count(*) FILTER (WHERE NOT churned_predicted) AS predicted_retained FROM scores""", _SCORES),
    "churn_top_risk": _features("SELECT * FROM scores ORDER BY churn_probability DESC, customer_id LIMIT 10", _SCORES),
    "churn_fit_residuals": """SELECT unnest(['intercept', 'frequency', 'monetary', 'avg_order_value', 'avg_quantity', 'avg_discount', 'distinct_categories']) AS term,
        0.0::DOUBLE AS residual""",
    "linear_attribution": _features("SELECT customer_id, feature, contribution, direction, feature_value FROM parts", _LONG),
    "attribution_base_value": _features("SELECT round(" + f"{INTERCEPT}::DOUBLE" + "".join(
        f" + ({w!r}::DOUBLE) * m_{f}" for f, w in COEFFICIENTS.items()) + ", 4) AS base_value FROM means", _MEANS),
    "global_importance": _features("SELECT feature, round(avg(abs(raw)), 4) AS importance FROM parts GROUP BY feature", _LONG),
    "top_factors": _features("SELECT customer_id, rank, feature, contribution, direction, feature_value FROM ranked WHERE rank <= 5", _LONG),
    # series
    "daily_revenue": _t(_series() + "done AS (SELECT 1) SELECT ds, value FROM daily"),
    "daily_gapfilled": _t(_series() + "done AS (SELECT 1) SELECT ds, value FROM filled"),
    "daily_gapfilled_by_category": _t(_series("product_category") + "done AS (SELECT 1) SELECT product_category, ds, value FROM filled"),
    "history_tail": _t(_series() + "done AS (SELECT 1) SELECT ds, round(value, 2) AS value FROM filled ORDER BY ds DESC LIMIT 90"),
    "forecast_linear": _t(_linear() + " SELECT * FROM forecast"),
    "forecast_width_offset": _t(_linear() + " SELECT ds, round(2 * 1.96 * sd, 0) AS width FROM steps"),
    "forecast_linear_by_region": _t(_linear("region") + " SELECT * FROM forecast"),
    "forecast_summary": _t(_summary() + " SELECT * FROM summary"),
    "forecast_summary_by_customer": _t(_summary("customer_id") + " SELECT * FROM summary"),
    "forecast_change": _t(_summary() + f""", {_MONTHLY}, {_TREND} SELECT trend, percentage_change, last_30_days_avg, forecast_avg,
        (SELECT {_DIRECTION} FROM trend ORDER BY month DESC LIMIT 1) AS recent_monthly_trend,
        'Over the next 90 days the daily mean is seen ' || trend || ' (' || CASE WHEN percentage_change >= 0 THEN '+' ELSE '' END
        || printf('%.1f', percentage_change) || '%).' AS forecast_summary,
        'From ' || format('{{:,.2f}}', last_30_days_avg) || ' a day in the last 30 days to ' || format('{{:,.2f}}', forecast_avg) || ' a day ahead.' AS trend_detail FROM summary"""),
    "forecast_evidence": _t(_summary() + f""", {_MONTHLY}, {_TREND} SELECT unnest([0, 1, 2, 3]) AS position,
        unnest(['last_30_days_avg', 'forecast_avg', 'percentage_change', 'recent_monthly_trend']) AS metric,
        unnest([format('{{:,.2f}}', last_30_days_avg), format('{{:,.2f}}', forecast_avg), CASE WHEN percentage_change >= 0 THEN '+' ELSE '' END || printf('%.1f', percentage_change) || '%',
          (SELECT {_DIRECTION} FROM trend ORDER BY month DESC LIMIT 1)]) AS value FROM summary"""),
    "forecast_ar_first_order": _t(_series("region") + f"""moves AS (SELECT region, ds, value, value - lag(value) OVER (PARTITION BY region ORDER BY ds) AS d FROM filled),
        pairs AS (SELECT *, lag(d) OVER (PARTITION BY region ORDER BY ds) AS before FROM moves),
        fitted AS (SELECT region, regr_slope(d, before) AS b, regr_intercept(d, before) AS a, max(ds) AS last_day, max_by(value, ds) AS v, max_by(d, ds) AS dl,
          sqrt((regr_syy(d, before) - regr_slope(d, before) * regr_sxy(d, before)) / regr_count(d, before)) AS sd FROM pairs GROUP BY region),
        steps AS (SELECT *, a * (1 - b ** s) / (1 - b) + b ** s * dl AS move, (1 - b ** s) / (1 - b) AS effect FROM fitted, generate_series(1, 90) g(s)),
        ahead AS (SELECT region, CAST(last_day + CAST(s AS INTEGER) AS DATE) AS ds, v + sum(move) OVER (PARTITION BY region ORDER BY s) AS p,
          1.96 * sd * sqrt(sum(effect * effect) OVER (PARTITION BY region ORDER BY s)) AS e FROM steps)
        SELECT region, ds, {_r("greatest(0, p)", 2)} AS value, {_r("greatest(0, p - e)", 2)} AS lower, {_r("greatest(0, p + e)", 2)} AS upper FROM ahead"""),
    "ar_orders": _t(_series("region") + f"""{_LEVINSON} SELECT region, m AS "order", {_r("sqrt(e)", 2)} AS deviation, {_r("aic", 4)} AS aic, place = 1 AS chosen FROM fits""").replace("WITH", "WITH RECURSIVE", 1),
    "forecast_ar_aic": _t(_series("region") + f"""{_LEVINSON}, ahead AS (
          SELECT region, 0 AS h, a, recent[1:len(a)] AS r, CAST(level AS DOUBLE) AS level, mu, CAST([] AS DOUBLE[]) AS shocks, 0.0::DOUBLE AS response, 0.0::DOUBLE AS square, m, sqrt(e) AS sd, last_day
          FROM fits JOIN g USING (region) WHERE place = 1
          UNION ALL SELECT region, h + 1, a, list_prepend(move, r)[1:len(a)], level + mu + move, mu, list_prepend(shock, shocks)[1:len(a)], response + shock, square + (response + shock) ** 2, m, sd, last_day
          FROM (SELECT *, coalesce(list_sum(list_transform(a, lambda x, i: x * r[i])), 0) AS move,
            CASE h WHEN 0 THEN 1.0::DOUBLE ELSE coalesce(list_sum(list_transform(a, lambda x, i: x * coalesce(shocks[i], 0))), 0) END AS shock FROM ahead WHERE h < 90))
        SELECT region, CAST(last_day + CAST(h AS INTEGER) AS DATE) AS ds, m AS "order", {_r("greatest(0, level)", 2)} AS value, {_r("greatest(0, level - 1.96 * sd * sqrt(square))", 2)} AS lower,
          {_r("greatest(0, level + 1.96 * sd * sqrt(square))", 2)} AS upper FROM ahead WHERE h > 0""").replace("WITH", "WITH RECURSIVE", 1),
    # questions, runs, evidence, experience
    "tag_questions": f"WITH {QUESTIONS_SQL}, {_TAGGED} SELECT * EXCLUDE (words), words = 0 OR (words < 2 AND task_type <> 'general_chat') AS is_ambiguous FROM tagged",
    "extract_customer_id": rf"WITH {QUESTIONS_SQL} SELECT question_id, nullif(upper(regexp_extract(question, '(?i)CUST_\d+', 0)), '') AS customer_id FROM question_log",
    "triage_runs": f"WITH {RUNS_SQL}, {_TRIAGE} SELECT * FROM named",
    "triage_summary": f"WITH {RUNS_SQL}, {_TRIAGE} SELECT outcome, error_type, suggested_action, count(*) AS runs FROM named GROUP BY ALL",
    "evidence_rows": _t(_EVIDENCE + """ SELECT run_id, step_id, claim, metric_name,
        coalesce(word, printf('%.2f', number)) AS metric_value,
        test_name, statistic_value, sample_size, confidence_score, artifact_id, code_reference FROM evidence"""),
    "evidence_table": _t(_EVIDENCE + """ SELECT run_id, metric_name AS metric, coalesce(word, printf('%.2f', number)) AS value,
        printf('%.0f%%', confidence_score * 100) AS confidence, step_id, code_reference AS code_ref FROM evidence"""),
    "audit_claims": f"WITH {CLAIMS_SQL} SELECT claim_id, run_id, claim, CASE WHEN issue IS NULL THEN 'supported' ELSE 'unsupported' END AS verdict, issue FROM audited",
    "grounding_issues": f"""WITH {CLAIMS_SQL} SELECT run_id, issue AS kind, claim AS subject, CAST(NULL AS VARCHAR) AS remedy FROM audited WHERE issue IS NOT NULL
        UNION ALL SELECT run_id, 'missing_metric', metric, 'compute ' || metric FROM uncovered""",
    "uncovered_metrics": f"WITH {CLAIMS_SQL} SELECT run_id, metric FROM uncovered",
    "grounding_status": f"""WITH {CLAIMS_SQL},
        counted AS (SELECT run_id, count(*) AS claims, count(*) FILTER (WHERE issue IS NULL) AS supported,
          count(*) FILTER (WHERE issue IS NOT NULL) AS unsupported, count(*) FILTER (WHERE issue = 'causal_overreach') AS o FROM audited GROUP BY run_id),
        gaps AS (SELECT run_id, count(*) AS missing_metrics FROM uncovered GROUP BY run_id),
        every AS (SELECT c_custkey AS run_id, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, coalesce(unsupported, 0) AS unsupported,
          coalesce(o, 0) AS o, coalesce(missing_metrics, 0) AS missing_metrics FROM customer c LEFT JOIN counted ON counted.run_id = c_custkey
          LEFT JOIN gaps ON gaps.run_id = c_custkey)
        SELECT run_id, claims, supported, unsupported, missing_metrics, CASE WHEN claims = 0 OR missing_metrics > 0 OR unsupported > supported THEN 'INSUFFICIENT'
          WHEN o > 0 THEN 'OVERREACH' WHEN unsupported > 0 THEN 'CONTRADICTORY' ELSE 'VALID' END AS status,
          claims > 0 AND missing_metrics = 0 AND unsupported = 0 AS is_grounded FROM every""",
    "experience_topk": f"""WITH {QUESTIONS_SQL}, {_TAGGED},
        log AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'descriptive' WHEN 'purchase' THEN 'forecasting' WHEN 'signup' THEN 'predictive'
          ELSE 'statistical' END AS task_type, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events),
        lines AS (SELECT seq, task_type, 'read ' || event_type || '; used k = ' || k || CASE WHEN event_type = 'error' THEN '; Caution: error with k = ' || k ELSE '' END AS text FROM log),
        asked AS (SELECT DISTINCT task_type FROM tagged),
        own AS (SELECT a.task_type, l.seq, l.text FROM asked a JOIN lines l USING (task_type) QUALIFY row_number() OVER (PARTITION BY a.task_type ORDER BY seq) <= 2),
        anyone AS (SELECT seq, text FROM lines ORDER BY seq LIMIT 2),
        found AS (SELECT * FROM own UNION ALL SELECT a.task_type, seq, text FROM asked a, anyone WHERE a.task_type NOT IN (SELECT task_type FROM own))
        SELECT task_type, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS experiences,
          array_to_string(list_slice(string_split(string_agg(text, '; ' ORDER BY seq), '; '), 1, 5), '; ') AS heuristics FROM found GROUP BY task_type""",
    "experiences": f"""WITH {_RUNS_BY_PAUSE}
        SELECT owner, run_start, max(ts) AS run_end, arg_min(task_type, position) AS task_type,
        (SELECT substr(md5(string_agg(column_name, '_' ORDER BY column_name)), 1, 12) FROM information_schema.columns WHERE table_name = 'events') AS dataset_signature,
        count(*) AS steps, count(*) FILTER (WHERE outcome = 'failed') AS failures, count(*) FILTER (WHERE outcome = 'recovered') AS recoveries,
        count(*) FILTER (WHERE step = 'purchase') AS insights FROM placed GROUP BY owner, run_start""",
    "experience_steps": f"""WITH {_RUNS_BY_PAUSE}
        SELECT owner, run_start, position, step_id, ts AS at, step, outcome, note FROM placed""",
    # tests and regression
    "ttest": _t(""", m AS (SELECT avg(revenue) FILTER (WHERE region = 'ASIA') AS m1, avg(revenue) FILTER (WHERE region = 'EUROPE') AS m2,
        var_samp(revenue) FILTER (WHERE region = 'ASIA') / count(*) FILTER (WHERE region = 'ASIA') AS e1, count(*) FILTER (WHERE region = 'ASIA') AS n1,
        var_samp(revenue) FILTER (WHERE region = 'EUROPE') / count(*) FILTER (WHERE region = 'EUROPE') AS e2, count(*) FILTER (WHERE region = 'EUROPE') AS n2
        FROM transactions), w AS (SELECT m1, m2, (m1 - m2) / sqrt(e1 + e2) AS t, (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) AS v FROM m)
        SELECT round(m1, 4) AS mean_first, round(m2, 4) AS mean_second, round(t, 4) AS t_statistic, round(v, 2) AS degrees_of_freedom, """ + _t_tails("t", "v") + " AS p_value FROM w"),
    "anova": _t(_ANOVA.format(digits=4, tail=_F_TAIL)),
    "anova_offset": _t(_ANOVA.format(digits=3, tail=_F_TAIL)),
    "chi_square": _t(""", o AS (SELECT product_category AS l, payment_method AS r, count(*) AS o FROM transactions GROUP BY ALL),
        e AS (SELECT l, r, CAST(o AS DOUBLE) AS o, CAST(sum(o) OVER (PARTITION BY l) AS DOUBLE) * CAST(sum(o) OVER (PARTITION BY r) AS DOUBLE) / CAST(sum(o) OVER () AS DOUBLE) AS e FROM o),
        c AS (SELECT sum((o - e) * (o - e) / e) AS x, CAST((count(DISTINCT l) - 1) * (count(DISTINCT r) - 1) AS DOUBLE) AS k FROM e)
        SELECT round(x, 4) AS chi_square, CAST(k AS BIGINT) AS degrees_of_freedom, """ + _CHI_TAIL + " AS p_value FROM c"),
    "regression_multivariate": _t(""", d AS (SELECT revenue AS y, quantity AS x1, unit_price AS x2, discount AS x3 FROM transactions),
        m AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, regr_sxx(y, x1) AS s11, regr_sxx(y, x2) AS s22, regr_sxx(y, x3) AS s33,
          regr_sxy(x1, x2) AS s12, regr_sxy(x1, x3) AS s13, regr_sxy(x2, x3) AS s23, regr_sxy(y, x1) AS s1y, regr_sxy(y, x2) AS s2y, regr_sxy(y, x3) AS s3y, regr_syy(y, x1) AS syy FROM d),
        c AS (SELECT *, s22 * s33 - s23 * s23 AS c11, s13 * s23 - s12 * s33 AS c12, s12 * s23 - s13 * s22 AS c13, s11 * s33 - s13 * s13 AS c22, s12 * s13 - s11 * s23 AS c23,
          s11 * s22 - s12 * s12 AS c33, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s13 * s23) + s13 * (s12 * s23 - s13 * s22) AS det FROM m),
        b AS (SELECT *, (c11 * s1y + c12 * s2y + c13 * s3y) / det AS b1, (c12 * s1y + c22 * s2y + c23 * s3y) / det AS b2, (c13 * s1y + c23 * s2y + c33 * s3y) / det AS b3,
          (m1 * (c11 * m1 + c12 * m2 + c13 * m3) + m2 * (c12 * m1 + c22 * m2 + c23 * m3) + m3 * (c13 * m1 + c23 * m2 + c33 * m3)) / det AS lever FROM c),
        e AS (SELECT *, syy - b1 * s1y - b2 * s2y - b3 * s3y AS rest, CAST(n - 4 AS DOUBLE) AS v FROM b),
        r AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS ordinal FROM e),
        q AS (SELECT ordinal, ['intercept', 'quantity', 'unit_price', 'discount', 'double_quantity'][ordinal + 1] AS term, n, rest, syy, v,
          CASE ordinal WHEN 0 THEN my - b1 * m1 - b2 * m2 - b3 * m3 WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN b3 END AS b,
          CASE ordinal WHEN 0 THEN sqrt(rest / v * (1.0 / n + lever)) WHEN 1 THEN sqrt(rest / v * c11 / det) WHEN 2 THEN sqrt(rest / v * c22 / det) WHEN 3 THEN sqrt(rest / v * c33 / det) END AS se FROM r),
        t AS (SELECT *, b / se AS t FROM q)
        SELECT CAST(ordinal AS INTEGER) AS ordinal, term, round(b, 4) AS coefficient, round(se, 4) AS std_error, round(t, 3) AS t_statistic, CASE WHEN t IS NOT NULL THEN """ + _t_tails("t", "v") + """ END AS p_value,
          n, 3::INTEGER AS rank, round(1 - rest / syy, 6) AS r_squared, round(sqrt(rest / n), 4) AS rmse FROM t"""),
    "regression_univariate": _t("""SELECT CAST(regr_count(cost, quantity) AS BIGINT) AS n, round(regr_slope(cost, quantity), 4) AS slope, round(regr_intercept(cost, quantity), 4) AS intercept,
        round(regr_r2(cost, quantity), 6) AS r_squared,
        round(sqrt(regr_syy(cost, quantity) * (1 - regr_r2(cost, quantity)) / regr_count(cost, quantity)), 4) AS rmse FROM transactions"""),
}
_PRINTED = """SELECT customer_id, churn_probability, churned_predicted, 'Customer ' || customer_id || ' leaves with probability '
    || printf('%.1f%%', CAST(round(CAST(churn_probability * 100 AS DECIMAL(30, 8)), 1) AS DOUBLE)) || '.' || chr(10) || chr(10) || 'What weighs most:' || chr(10)
    || string_agg('- ' || feature || ' = ' || {value} || ' ' || direction || ': ' || printf('%+.4f', contribution), chr(10) ORDER BY rank) AS summary
    FROM ranked JOIN scores USING (customer_id) WHERE rank <= 5 GROUP BY customer_id, churn_probability, churned_predicted"""
ORACLE["explain_customers"] = _features(_PRINTED.format(value="CAST(feature_value AS VARCHAR)"), _SCORES + _LONG)
for _name, _statement in SQL_TEXTS.items():
    ORACLE[_name] = _t(_statement.rstrip(";").strip())
