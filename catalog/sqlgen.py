"""SQL text for per-column results: one SELECT per column, joined by UNION ALL."""

from __future__ import annotations

from catalog.views import view_sql
from siftframe.functions.dates import DATE_HINTS
from siftframe.functions.values import BOOLEAN_WORDS, NUMBER_PATTERN

# the fixed values of the library: number and date patterns, words
NUMBER = NUMBER_PATTERN
DATE_HINT = "|".join(DATE_HINTS)
BOOLEAN = ",".join(f"'{w}'" for w in BOOLEAN_WORDS)

# column kinds by view: int, float, text, time
COLUMNS = {
    "dirty_orders": {"o_orderkey": "int", "o_custkey": "int", "price": "float", "price_txt": "text",
                     "priority": "text", "status": "text", "flag": "text"},
    "dirty_dates": {"o_orderkey": "int", "d_iso": "text", "d_mixed": "text", "d_bad": "text", "d_native": "time"},
    "dirty_contacts": {"c_custkey": "int", "contact_email": "text", "phone": "text", "c_acctbal": "float"},
    "dirty_parts": {"p_partkey": "int", "p_name": "text", "name_var": "text"},
    "sparse_events": {"event_id": "int", "mostly_null": "float", "const": "float", "nothing": "text", "event_type": "text"},
    "materials": {"p_partkey": "int", "material": "text", "p_brand": "text"},
    "cryptic_customers": {"Cust ID": "int", "Cust Name": "text", "Eml": "text", "Ctn Wgt": "text", "Txn-Amt": "float",
                          "Nation  Key (%)": "text", "mkt_Segment_": "text", "???": "text"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "float",
               "o_orderdate": "time", "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int",
                 "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
                 "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"},
    "events": {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "text", "value": "float", "props": "text"},
    "documents": {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int"},
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
    "customer": {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "text"},
    "part": {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "float"},
    "supplier": {"s_suppkey": "int", "s_name": "text", "s_nationkey": "int", "s_acctbal": "float"},
    "pages": {"page_id": "int", "url": "text", "html": "text"},
    "conversations": {"conv_id": "int", "turn": "int", "role": "text", "text": "text"},
}
# unique row key of each view; lineitem is numbered first
ROW_KEY = {
    "dirty_orders": "o_orderkey", "dirty_dates": "o_orderkey", "dirty_contacts": "c_custkey", "dirty_parts": "p_partkey",
    "sparse_events": "event_id", "materials": "p_partkey", "cryptic_customers": "Cust ID", "orders": "o_orderkey",
    "events": "event_id", "documents": "doc_id", "labels": "doc_id", "customer": "c_custkey", "part": "p_partkey",
    "supplier": "s_suppkey", "pages": "page_id", "lineitem": "row_index",
}
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def rows_sql(name: str) -> str:
    """View with its row key as ``_row``."""
    if name == "lineitem":
        key = f"row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1"
    else:
        key = f'"{ROW_KEY[name]}"'
    return f"SELECT *, {key} AS _row FROM ({view_sql(name)})"


def text_sql(column: str, kind: str) -> str:
    c = f'CAST("{column}" AS VARCHAR)'
    return f"CASE WHEN contains({c}, '.') THEN rpad({c}, 26, '0') ELSE {c} END" if kind == "time" else c


def num_sql(column: str, kind: str) -> str:
    if kind in ("int", "float"):
        return f'CAST("{column}" AS DOUBLE)'
    if kind == "text":
        return f"CASE WHEN regexp_matches(\"{column}\", '{NUMBER}') THEN TRY_CAST(trim(\"{column}\") AS DOUBLE) END"
    return "CAST(NULL AS DOUBLE)"


def per_column(name: str, select: str, columns: list[str] | None = None) -> str:
    """``select`` for each column, over c(_row, t = text, x = number, d = time).

    Placeholders: {column} as a string literal body, {kind}.
    """
    parts = []
    for column, kind in COLUMNS[name].items():
        if columns is None or column in columns:
            time = f'"{column}"' if kind == "time" else "CAST(NULL AS TIMESTAMP)"
            source = (
                f"(SELECT _row, {text_sql(column, kind)} AS t, {num_sql(column, kind)} AS x, {time} AS d FROM v) AS c"
            )
            parts.append("(" + select.replace("{column}", column).replace("{kind}", kind).replace("{source}", source) + ")")
    return f"WITH v AS ({rows_sql(name)}) " + " UNION ALL ".join(parts)


# a text column's dates are read by the format of its first value, ISO in all views here
TYPE = f"""CASE
  WHEN nn = 0 THEN 'empty'
  WHEN u <= 2 AND all_boolean THEN 'boolean'
  WHEN '{{kind}}' IN ('int', 'float') THEN 'numeric'
  WHEN '{{kind}}' = 'time' THEN 'datetime'
  WHEN nx * 1.0 / nn > 0.9 THEN 'numeric'
  WHEN hinted AND n_dates * 1.0 / nn > 0.8 THEN 'datetime'
  WHEN u <= 15 OR (u < 100 AND u * 1.0 / n < 0.15) THEN 'categorical'
  ELSE 'text' END"""

FACTS = f"""(SELECT count(*) AS n, count(t) AS nn, count(DISTINCT t) AS u, count(x) AS nx,
  bool_and(lower(t) IN ({BOOLEAN})) AS all_boolean,
  count(CASE WHEN '{{kind}}' = 'text' THEN try_strptime(t, '%Y-%m-%d') END) AS n_dates,
  (SELECT coalesce(bool_or(regexp_matches(t, '{DATE_HINT}')), false) FROM
     (SELECT t FROM {{source}} WHERE t IS NOT NULL ORDER BY _row LIMIT 10)) AS hinted,
  min(x) AS lo, max(x) AS hi, avg(x) AS mean, coalesce(stddev_samp(x), CASE WHEN count(x) = 1 THEN 0.0 END) AS std,
  quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3,
  coalesce(min(d), min(CASE WHEN '{{kind}}' = 'text' THEN try_strptime(t, '%Y-%m-%d') END)) AS first_time,
  coalesce(max(d), max(CASE WHEN '{{kind}}' = 'text' THEN try_strptime(t, '%Y-%m-%d') END)) AS last_time
  FROM {{source}})"""

TOP = """(SELECT string_agg(t || '=' || n, '|' ORDER BY n DESC, r) FROM
  (SELECT t, count(*) AS n, min(_row) AS r FROM {source} WHERE t IS NOT NULL GROUP BY t ORDER BY n DESC, r LIMIT 5))"""
SAMPLES = """(SELECT string_agg(t, '|' ORDER BY _row) FROM
  (SELECT t, _row FROM {source} WHERE t IS NOT NULL ORDER BY _row LIMIT 5))"""

PROFILE = f"""SELECT '{{column}}' AS "column", ty AS inferred_type, n AS total_count, n - nn AS null_count,
  round((n - nn) * 1.0 / n, 6) AS null_pct, u AS unique_count, {SAMPLES} AS sample_values, {TOP} AS top_values,
  CASE WHEN ty = 'numeric' THEN round(lo, 4) END AS "min", CASE WHEN ty = 'numeric' THEN round(hi, 4) END AS "max",
  CASE WHEN ty = 'numeric' THEN round(mean, 4) END AS mean, CASE WHEN ty = 'numeric' THEN round(std, 4) END AS std,
  CASE WHEN ty = 'numeric' THEN round(median, 4) END AS median,
  CASE WHEN ty = 'datetime' THEN strftime(first_time, '%Y-%m-%d %H:%M:%S') END AS min_ts,
  CASE WHEN ty = 'datetime' THEN strftime(last_time, '%Y-%m-%d %H:%M:%S') END AS max_ts
  FROM (SELECT *, {TYPE} AS ty FROM {FACTS})"""


def facts_sql(name: str, columns: list[str] | None = None) -> str:
    """WITH v AS ..., facts(column, kind, ty, n, nn, u, ...): one row per column."""
    body = per_column(name, f"SELECT '{{column}}' AS \"column\", *, {TYPE} AS ty FROM {FACTS}", columns)
    head, rest = body.split(") (SELECT '", 1)
    return head + "), facts AS ((SELECT '" + rest + ")"
