"""Validation, reporting and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.anomalies import summary_sql
from catalog.profiling import rows_of
from catalog.registry import query
from catalog.sqlgen import COLUMNS, facts_sql, LINE_KEY
from catalog.views import spread_table, table, view, view_sql
from siftframe.operators import rules as R
from siftframe.operators.anomaly import EMAIL_PATTERN
from siftframe.operators.clean import clean
from siftframe.operators.profile import profile
from siftframe.operators.rowid import with_row_index
from siftframe.plans.profiling import profile_reports
from siftframe.plans.reporting import comparison_frame, quality_report
from siftframe.sources.writers import write_report
from siftframe.streaming.monitor import (
    freeze_bounds,
    latest_updates,
    stream_anomalies,
    stream_failures,
    stream_repeats,
    window_metrics,
    write_available,
    write_updates,
)
from siftframe.work import new_table_path

ORDERS = view_sql("dirty_orders")
CONTACTS = view_sql("dirty_contacts")


def _failure(source: str, column: str, row: str, rule: str, fails: str, message: str, no: int | None = None) -> str:
    head = f"CAST({no} AS INTEGER) AS rule_no, " if no is not None else ""
    return f"""SELECT {head}'{column}' AS "column", {row} AS row_index, coalesce(CAST({column} AS VARCHAR), 'nan') AS value,
    '{rule}' AS rule, {message} AS message FROM ({source}) WHERE {fails}"""


def _single(name: str, view_name: str, row: str, definition: dict, sql: str) -> None:
    @query(name, sql)
    def _(spark, folder):
        return R.validate(view(spark, folder, view_name), [definition], row)


_NON_NULL = _failure(ORDERS, "price", "o_orderkey", "non_null", "price IS NULL",
                     "'Value is missing (null/empty) in row ' || o_orderkey || '.'")
_NON_EMPTY = _failure(CONTACTS, "contact_email", "c_custkey", "non_null", "contact_email = ''",
                      "'Value is missing (null/empty) in row ' || c_custkey || '.'")
_single("rule_non_null", "dirty_orders", "o_orderkey", {"column": "price", "type": "non_null"}, _NON_NULL)
_single("rule_non_null_empty_text", "dirty_contacts", "c_custkey", {"column": "contact_email", "type": "non_null"}, _NON_EMPTY)


def _unique_sql(source: str, column: str, row: str, no: int | None = None) -> str:
    return _failure(
        source, column, row, "unique",
        f"{column} IN (SELECT {column} FROM ({source}) WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
        f"'Duplicate value ''' || {column} || ''' in row ' || {row} || '.'", no,
    )


_single("rule_unique", "orders", "o_orderkey", {"column": "o_custkey", "type": "unique"}, _unique_sql("FROM orders", "o_custkey", "o_orderkey"))
_single("rule_unique_hot_value", "dirty_orders", "o_orderkey", {"column": "status", "type": "unique"}, _unique_sql(ORDERS, "status", "o_orderkey"))
_single("rule_unique_text", "documents", "doc_id", {"column": "text", "type": "unique"}, _unique_sql("FROM documents", "text", "doc_id"))

_X = "TRY_CAST(price_txt AS DOUBLE)"
_RANGE = _failure(
    ORDERS, "price_txt", "o_orderkey", "range", f"{_X} IS NULL OR {_X} < 50000 OR {_X} > 400000.5",
    f"""CASE WHEN {_X} IS NULL THEN 'Value ''' || price_txt || ''' is not numeric in row ' || o_orderkey || '.'
    WHEN {_X} < 50000 THEN 'Value ' || price_txt || ' is below minimum allowed (50000) in row ' || o_orderkey || '.'
    ELSE 'Value ' || price_txt || ' is above maximum allowed (400000.5) in row ' || o_orderkey || '.' END""",
)
_single("rule_range", "dirty_orders", "o_orderkey",
        {"column": "price_txt", "type": "range", "params": {"min": 50000, "max": 400000.5}}, _RANGE)

_REGEX = _failure(
    CONTACTS, "contact_email", "c_custkey", "regex",
    f"contact_email <> '' AND NOT regexp_matches(contact_email, '{EMAIL_PATTERN}')",
    "'Value ''' || contact_email || ''' does not match pattern ''email format'' in row ' || c_custkey || '.'",
)
_single("rule_regex", "dirty_contacts", "c_custkey",
        {"column": "contact_email", "type": "regex", "params": {"pattern": EMAIL_PATTERN, "description": "email format"}}, _REGEX)
_PREFIX = _failure(
    CONTACTS, "phone", "c_custkey", "regex", "NOT regexp_matches(phone, '^(555)0+')",
    "'Value ''' || phone || ''' does not match pattern ''Regex pattern'' in row ' || c_custkey || '.'",
)
_single("rule_regex_named_group", "dirty_contacts", "c_custkey",
        {"column": "phone", "type": "regex", "params": {"pattern": r"(?P<area_code>555)0+"}}, _PREFIX)
_single("rule_regex_start_only", "dirty_contacts", "c_custkey",
        {"column": "phone", "type": "regex", "params": {"pattern": r"(?P<area>555)0+"}}, _PREFIX)

_ALLOWED = [" yes", "NO", "active"]
_IN_SET = _failure(
    ORDERS, "flag", "o_orderkey", "in_set", "lower(trim(flag)) NOT IN ('yes', 'no', 'active')",
    "'Value ''' || flag || ''' is not in the allowed set ['' yes'', ''NO'', ''active''] in row ' || o_orderkey || '.'",
)
_single("rule_in_set", "dirty_orders", "o_orderkey", {"column": "flag", "type": "in_set", "params": {"allowed": _ALLOWED}}, _IN_SET)


@query(
    "rule_in_table",
    """SELECT 'l_partkey' AS "column", row_index, CAST(l_partkey AS VARCHAR) AS value, 'in_set' AS rule,
    'Value ''' || l_partkey || ''' is not in the allowed table in row ' || row_index || '.' AS message
    FROM (SELECT l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_index
          FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)""",
)
def _(spark, folder):
    """Allowed values in a table that grows with the data."""
    lines = with_row_index(table(spark, folder, "lineitem").select(*LINE_KEY), LINE_KEY)
    return R.in_table(lines, "l_partkey", table(spark, folder, "part").where("p_size > 10").select("p_partkey"))


RULES = [
    {"column": "price", "type": "non_null"},
    {"column": "o_custkey", "type": "unique"},
    {"column": "flag", "type": "in_set", "params": {"allowed": _ALLOWED}},
    {"column": "price_txt", "type": "range", "params": {"min": 50000, "max": 400000.5}},
    {"column": "no such column", "type": "non_null"},
    {"column": "flag", "type": "no such type"},
    {"column": "flag", "type": "regex", "params": {"pattern": "("}},
    {"type": "unique"},
    {"column": "status", "type": "unique"},
]


def _numbered(sql: str, no: int) -> str:
    return sql.replace("SELECT '", f"SELECT CAST({no} AS INTEGER) AS rule_no, '", 1)


_ALL = " UNION ALL ".join(
    f"({_numbered(s, i)})"
    for i, s in enumerate(
        [_NON_NULL, _unique_sql(ORDERS, "o_custkey", "o_orderkey"), _IN_SET, _RANGE, "", _unique_sql(ORDERS, "status", "o_orderkey")]
    )
    if s
)
_FIVE = '"column", row_index, value, rule, message'


@query("validation_run", f"SELECT {_FIVE} FROM ({_ALL})")
def _(spark, folder):
    """All rules at once; faulty definitions and unknown columns are left out."""
    return R.validate(view(spark, folder, "dirty_orders"), RULES, "o_orderkey")


@query(
    "validation_numbered",
    f"SELECT row_number() OVER (ORDER BY rule_no, row_index) AS failure_id, {_FIVE} FROM ({_ALL})",
)
def _(spark, folder):
    rules, _ = R.make_rules(RULES)
    return R.numbered_failures(R.failure_log(view(spark, folder, "dirty_orders"), rules, "o_orderkey"))


@query("validation_overview", f'SELECT "column", rule, count(*) AS failures FROM ({_ALL}) GROUP BY ALL')
def _(spark, folder):
    return R.failure_overview(R.validate(view(spark, folder, "dirty_orders"), RULES, "o_orderkey"))


# --- suggestions ------------------------------------------------------------


def suggested_sql(name: str, most: int | None = None) -> str:
    parts = []
    for i, c in enumerate(COLUMNS[name]):
        email = "email" in c.lower()
        f = f"FROM facts WHERE \"column\" = '{c}'"
        null = "CAST(NULL AS DOUBLE)"
        text = "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT {i} AS o, 1 AS s, '{c}' AS \"column\", 'non_null' AS type, {null} AS \"min\", {null} AS \"max\", {text} AS pattern, {text} AS allowed {f} AND n = nn")
        parts.append(f"SELECT {i}, 2, '{c}', 'unique', NULL, NULL, NULL, NULL {f} AND u / n > 0.95 AND n > 10")
        parts.append(f"SELECT {i}, 3, '{c}', 'range', lo, hi, NULL, NULL {f} AND ty = 'numeric'")
        parts.append(
            f"""SELECT {i}, 4, '{c}', 'in_set', NULL, NULL, NULL, (SELECT string_agg(t, '|' ORDER BY k DESC, r) FROM
            (SELECT CAST("{c}" AS VARCHAR) AS t, count(*) AS k, min(_row) AS r FROM v WHERE "{c}" IS NOT NULL GROUP BY 1 ORDER BY k DESC, r {f"LIMIT {most}" if most else ""}))
            {f} AND ty = 'categorical' AND u <= 8"""
        )
        if email:
            parts.append(f"SELECT {i}, 5, '{c}', 'regex', NULL, NULL, '{EMAIL_PATTERN}', NULL {f}")
    return (
        facts_sql(name)
        + ' SELECT CAST(row_number() OVER (ORDER BY o, s) AS INTEGER) AS position, "column", type, "min", "max", pattern, allowed FROM ('
        + " UNION ALL ".join(f"({p})" for p in parts)
        + ")"
    )


def _suggested(name: str) -> None:
    @query(f"suggested_rules_{name}", suggested_sql(name))
    def _(spark, folder):
        df, row = rows_of(spark, folder, name)
        return R.suggested_rules_frame(df, R.suggest_rules(profile(df, row, list(COLUMNS[name]), quartiles=False)))


for _name in ("dirty_orders", "dirty_contacts", "events", "customer", "part"):
    _suggested(_name)


@query("suggested_rules_capped", suggested_sql("part", 5))
def _(spark, folder):
    df, row = rows_of(spark, folder, "part")
    return R.suggested_rules_frame(df, R.suggest_rules(profile(df, row, list(COLUMNS["part"]), quartiles=False), most=5))



# --- reports ----------------------------------------------------------------
def _before_after(spark, folder):
    raw = view(spark, folder, "sparse_events", spread_table).withColumn("row_index", F.col("event_id"))
    config = {
        "imputations": [{"column": "mostly_null", "method": "constant", "value": 5.0}],
        "drop_null_rows": ["event_type"],
    }
    return raw, clean(raw, config)


_AFTER_VIEW = (
    "SELECT event_id, coalesce(mostly_null, 5.0) AS mostly_null, const, nothing, event_type FROM "
    f"({view_sql('sparse_events')})"
)


def _after_sql() -> str:
    return summary_sql("sparse_events").replace(view_sql("sparse_events"), _AFTER_VIEW)


@query(
    "before_after_comparison",
    f"""WITH a AS ({summary_sql('sparse_events')}), b AS ({_after_sql()})
    SELECT a.row_count AS original_rows, b.row_count AS cleaned_rows,
    CASE WHEN b.row_count > a.row_count THEN '+' ELSE '' END || (b.row_count - a.row_count) AS rows_change,
    a.missing_cells AS original_missing_cells, a.missing_pct AS original_missing_pct,
    b.missing_cells AS cleaned_missing_cells, b.missing_pct AS cleaned_missing_pct,
    round(100 - b.missing_pct, 1) AS completeness_rate, a.quality_score AS original_score, b.quality_score AS cleaned_score,
    CASE WHEN b.quality_score > a.quality_score THEN '+' ELSE '' END || printf('%.2f', b.quality_score - a.quality_score) AS score_delta
    FROM a, b""",
)
def _(spark, folder):
    raw, cleaned = _before_after(spark, folder)
    return comparison_frame(*profile_reports(raw, cleaned))


@query("quality_report_document")
def _(spark, folder):
    """One JSON document; the failure and anomaly logs are tables that it names."""
    raw, cleaned = _before_after(spark, folder)
    rules = [{"column": "const", "type": "range", "params": {"max": 100}}, {"column": "event_type", "type": "non_null"}]
    return quality_report("events", raw, cleaned, rules, timestamp="1970-01-01T00:00:00+00:00").frame()


# --- streams ----------------------------------------------------------------
_STREAM_RULES = [
    {"column": "value", "type": "range", "params": {"min": 1, "max": 20}},
    {"column": "event_type", "type": "in_set", "params": {"allowed": ["click", "view"]}},
    {"column": "props", "type": "regex", "params": {"pattern": r'\{"k": \d\}'}},
]


def _events_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _run(stream, spark):
    path = new_table_path(spark, "stream")
    write_available(stream, path, new_table_path(spark, "stream-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


_EVENT_ROW = "event_id"


@query(
    "stream_validation",
    " UNION ALL ".join(
        [
            "("
            + _failure("FROM events", "value", _EVENT_ROW, "range", "value < 1 OR value > 20",
                       "CASE WHEN value < 1 THEN 'Value ' || value || ' is below minimum allowed (1) in row ' || event_id || '.' "
                       "ELSE 'Value ' || value || ' is above maximum allowed (20) in row ' || event_id || '.' END")
            + ")",
            "("
            + _failure("FROM events", "event_type", _EVENT_ROW, "in_set", "event_type NOT IN ('click', 'view')",
                       "'Value ''' || event_type || ''' is not in the allowed set [''click'', ''view''] in row ' || event_id || '.'")
            + ")",
            "("
            + _failure("FROM events", "props", _EVENT_ROW, "regex", "NOT regexp_matches(props, '^\\{\"k\": [0-9]\\}')",
                       "'Value ''' || props || ''' does not match pattern ''Regex pattern'' in row ' || event_id || '.'")
            + ")",
        ]
    ),
)
def _(spark, folder):
    return _run(stream_failures(_events_stream(spark, folder), _STREAM_RULES, "event_id"), spark)


@query(
    "stream_window_metrics",
    """SELECT date_trunc('day', ts) AS window_start, count(*) AS "rows", count(*) - count(value) AS missing,
    count(*) FILTER (value < 1 OR value > 20) AS failures FROM events GROUP BY 1""",
)
def _(spark, folder):
    """Windows as their last update left them, those still open at the end included."""
    stream = _events_stream(spark, folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    path = new_table_path(spark, "stream")
    metrics = window_metrics(stream, "ts", "value", _STREAM_RULES, "1 day")
    write_updates(metrics, path, new_table_path(spark, "stream-state")).awaitTermination()
    return latest_updates(spark, path, ["window_start"])


@query(
    "stream_unique",
    """SELECT 'value' AS "column", event_id AS row_index, CAST(value AS VARCHAR) AS value, 'unique' AS rule,
    'Duplicate value ''' || value || ''' in row ' || event_id || '.' AS message FROM events
    WHERE value IN (SELECT value FROM events GROUP BY value HAVING count(*) > 1)""",
)
def _(spark, folder):
    return _run(stream_repeats(_events_stream(spark, folder), "value", "event_id"), spark)


_FROZEN = "SELECT * FROM events WHERE event_type <> 'error'"


@query(
    "stream_validation_frozen",
    f"""WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ({_FROZEN}))
    SELECT 'value' AS "column", event_id AS row_index, CAST(value AS VARCHAR) AS value, 'outlier' AS type,
    'Numerical outlier detected in row ' || event_id || ': ' || value AS message FROM events, b
    WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
    UNION ALL SELECT 'event_type', event_id, event_type, 'unseen_value',
    'Value ''' || event_type || ''' was not seen before, in row ' || event_id || '.' FROM events WHERE event_type = 'error'""",
)
def _(spark, folder):
    """Bounds frozen while there were no errors yet; a later profile of all events changes nothing."""
    path = new_table_path(spark, "bounds")
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    freeze_bounds(spark, profile(events.where("event_type <> 'error'"), "event_id", ["event_type", "value"]), path, 1)
    found = stream_anomalies(_events_stream(spark, folder).select("event_id", "event_type", "value"), path, 1, "event_id")
    freeze_bounds(spark, profile(events, "event_id", ["event_type", "value"]), path, 2)
    return _run(found, spark)


@query(
    "rules_edited",
    """SELECT 'event_type' AS "column", 'in_set' AS rule, count(*) AS failures FROM events WHERE event_type NOT IN ('click', 'view')
    UNION ALL SELECT 'value', 'range', count(*) FROM events WHERE value < 5""",
)
def _(spark, folder):
    """Rules added to a list and removed from it, the allowed values from a comma list."""
    rules = R.add_rule([], "props", "regex", {"pattern": "never"})
    rules = R.add_rule(rules, "event_type", "in_set", {"allowed": R.allowed_from_text(" click, view ,")})
    rules = R.remove_rule(R.add_rule(rules, "value", "range", {"min": 5}), 1)
    return R.failure_overview(R.validate(table(spark, folder, "events"), rules, "event_id"))


_REPORT_FIELDS = {
    "raw_records": "$.metadata.raw_records",
    "cleaned_records": "$.metadata.cleaned_records",
    "missing_cells_raw": "$.metadata.missing_cells_raw",
    "missing_cells_cleaned": "$.metadata.missing_cells_cleaned",
    "failures": "$.validation_checks.failures_count",
}


@query(
    "report_file",
    f"""WITH a AS ({summary_sql('sparse_events')}), b AS ({_after_sql()})
    SELECT a.row_count AS raw_records, b.row_count AS cleaned_records, a.missing_cells AS missing_cells_raw, b.missing_cells AS missing_cells_cleaned,
    (SELECT count(*) FROM ({_AFTER_VIEW}) WHERE const < 100 OR event_type IS NULL OR event_type = '') AS failures, 'sparse events' AS original_filename,
    a.quality_score || '%' AS original_quality_score FROM a, b""",
)
def _(spark, folder):
    """The report document as a file, read back."""
    raw, cleaned = _before_after(spark, folder)
    rules = [{"column": "const", "type": "range", "params": {"min": 100}}, {"column": "event_type", "type": "non_null"}]
    path = new_table_path(spark, "report")
    write_report(quality_report("sparse events", raw, cleaned, rules).frame(), path)
    text = spark.read.text(path, wholetext=True).where("value <> ''")
    number = lambda p: F.get_json_object("value", p).cast("long")
    return text.select(
        *[number(p).alias(c) for c, p in _REPORT_FIELDS.items()],
        F.get_json_object("value", "$.original_filename").alias("original_filename"),
        F.get_json_object("value", "$.scores.original_quality_score").alias("original_quality_score"),
    )
