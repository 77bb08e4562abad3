"""Anomaly scan and quality score queries."""

from __future__ import annotations

from catalog.profiling import rows_of
from catalog.registry import query
from catalog.sqlgen import COLUMNS, facts_sql
from catalog.views import table, view, view_sql
from siftframe.operators import anomaly as A
from siftframe.operators import profile as P
from siftframe.operators.report import summary_frame, with_band
from siftframe.plans.profiling import profile_report

EMAIL = A.EMAIL_PATTERN
PHONE = A.PHONE_PATTERN


def _bounds(column: str, source: str) -> str:
    return f"""b AS (SELECT *, q3 - q1 AS iqr FROM (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3,
      avg({column}) AS mean, stddev_samp({column}) AS std FROM {source}))"""


OUTSIDE = """CASE WHEN iqr = 0 THEN std > 0 AND abs({x} - mean) > 3 * std
  ELSE {x} < q1 - 1.5 * iqr OR {x} > q3 + 1.5 * iqr END"""


@query(
    "high_missingness",
    facts_sql("sparse_events")
    + """ SELECT "column", CAST(NULL AS BIGINT) AS row_index, printf('%.1f%%', (n - nn) / n * 100) || ' missing' AS value,
    'high_missingness' AS type,
    'Column ''' || "column" || ''' has a very high missing rate (' || printf('%.1f%%', (n - nn) / n * 100) || ').' AS message
    FROM facts WHERE (n - nn) / n > 0.5""",
)
def _(spark, folder):
    df, row = rows_of(spark, folder, "sparse_events")
    prof = P.profile(df, row, quartiles=False)
    return A.high_missingness(df, prof).drop("ordinal", "step")


@query(
    "iqr_outliers",
    f"WITH {_bounds('value', 'events')} SELECT event_id, user_id, value FROM events, b WHERE {OUTSIDE.replace('{x}', 'value')}",
)
def _(spark, folder):
    return A.iqr_outliers(table(spark, folder, "events"), "value").select("event_id", "user_id", "value")


@query(
    "three_sigma_outliers",
    f"WITH v AS ({view_sql('sparse_events')}), {_bounds('const', 'v')} SELECT event_id, const FROM v, b WHERE {OUTSIDE.replace('{x}', 'const')}",
)
def _(spark, folder):
    return A.iqr_outliers(view(spark, folder, "sparse_events"), "const").select("event_id", "const")


def _rare_sql(name: str, column: str, row: str) -> str:
    return f"""WITH v AS ({view_sql(name)}), c AS (SELECT {column} AS value, count(*) AS n FROM v WHERE {column} IS NOT NULL GROUP BY 1),
    s AS (SELECT sum(n) AS total, max(n) AS top FROM c),
    rare AS (SELECT value, n FROM c, s WHERE total >= 20 AND n / total < 0.01 AND top / total >= 0.01)"""


@query("rare_categories", _rare_sql("dirty_orders", "status", "o_orderkey") + ' SELECT value, n AS "count" FROM rare')
def _(spark, folder):
    return A.rare_categories(view(spark, folder, "dirty_orders"), "status")


def _overflow_sql(i: int, step: int, lit: str, rows: str, kind: str, short: str, long: str) -> str:
    return f"""SELECT {i}, {step}, '{lit}', CAST(NULL AS BIGINT), n || ' {short}', '{kind}',
        'Column ''{lit}'' has ' || n || ' {long} (first 20 shown above).' FROM (SELECT count(*) AS n FROM {rows}) WHERE n > 20"""


def log_sql(name: str, capped: bool = False) -> str:
    """The whole anomaly log of a view, numbered in order."""
    cap = lambda n: f"WHERE k <= {n}" if capped else ""
    parts = []
    for i, (c, kind) in enumerate(COLUMNS[name].items()):
        lit = c.replace("'", "''")
        where = f"f.\"column\" = '{lit}'"
        t = f'CAST("{c}" AS VARCHAR)'
        parts.append(
            f"""SELECT {i} AS o, 0 AS s, '{lit}' AS "column", CAST(NULL AS BIGINT) AS row_index,
            printf('%.1f%%', (n - nn) / n * 100) || ' missing' AS value, 'high_missingness' AS type,
            'Column ''{lit}'' has a very high missing rate (' || printf('%.1f%%', (n - nn) / n * 100) || ').' AS message
            FROM facts f WHERE {where} AND (n - nn) / n > 0.5"""
        )
        x = f'CAST("{c}" AS DOUBLE)' if kind in ("int", "float") else f'TRY_CAST("{c}" AS DOUBLE)'
        if kind != "time":
            out = (
                f"""(SELECT _row, {t} AS t, row_number() OVER (ORDER BY _row) AS k, count(*) OVER () AS total FROM
                (SELECT *, q3 - q1 AS iqr FROM v, facts f WHERE {where} AND ty = 'numeric')
                WHERE {OUTSIDE.replace('{x}', x)})"""
            )
            parts.append(
                f"""SELECT {i}, 1, '{lit}', _row, t, 'outlier', 'Numerical outlier detected in row ' || _row || ': ' || t
                FROM {out} {cap(50)}"""
            )
            if capped:
                parts.append(
                    f"""SELECT DISTINCT {i}, 1, '{lit}', CAST(NULL AS BIGINT), total || ' outliers', 'outlier',
                    'Column ''{lit}'' has ' || total || ' numerical outliers (first 50 shown above).' FROM {out} WHERE total > 50"""
                )
            rare = (
                f"""(SELECT _row, {t} AS t, row_number() OVER (ORDER BY _row) AS k FROM v, facts f
                WHERE {where} AND ty = 'categorical' AND nn >= 20
                AND {t} IN (SELECT {t} FROM v GROUP BY 1 HAVING count({t}) / (SELECT nn FROM facts f WHERE {where}) < 0.01)
                AND EXISTS (SELECT {t} FROM v WHERE {t} IS NOT NULL GROUP BY {t} HAVING count(*) / (SELECT nn FROM facts f WHERE {where}) >= 0.01))"""
            )
            parts.append(
                f"""SELECT {i}, 1, '{lit}', _row, t, 'rare_value',
                'Rare categorical value ''' || t || ''' (occurs < 1%) in row ' || _row || '.' FROM {rare} {cap(20)}"""
            )
            if capped:
                parts.append(_overflow_sql(i, 1, lit, rare, "rare_value", "rare values", "rare categorical values"))
        kind_of = A.format_pattern(c)
        if kind_of:
            bad = f"""(SELECT _row, {t} AS t, row_number() OVER (ORDER BY _row) AS k FROM v
                 WHERE {t} <> '' AND NOT regexp_matches(trim({t}), '{kind_of[1]}'))"""
            parts.append(
                f"""SELECT {i}, 2, '{lit}', _row, t, 'format_error',
                'Invalid {kind_of[0]} format in row ' || _row || ': ''' || t || '''' FROM {bad} {cap(20)}"""
            )
            if capped:
                parts.append(_overflow_sql(i, 2, lit, bad, "format_error", "format errors", "malformed values"))
    return facts_sql(name) + ", log AS (" + " UNION ALL ".join(f"({p})" for p in parts) + ")"


_LOG = 'SELECT "column", row_index, value, type, message FROM log'
_NUMBERED = (
    'SELECT CAST(row_number() OVER (ORDER BY o, s, row_index NULLS LAST) AS INTEGER) AS anomaly_id, "column", row_index, '
    "value, type, message FROM log"
)


def _log(name: str) -> None:
    @query(f"anomaly_log_{name}", f"{log_sql(name)} {_NUMBERED.replace('AS INTEGER', 'AS BIGINT')}")
    def _(spark, folder):
        df, row = rows_of(spark, folder, name)
        return profile_report(df, row, list(COLUMNS[name])).anomalies(numbered=True)


def _capped_log(name: str) -> None:
    @query(f"anomaly_log_{name}_capped", f"{log_sql(name, True)} {_NUMBERED}")
    def _(spark, folder):
        df, row = rows_of(spark, folder, name)
        return profile_report(df, row, list(COLUMNS[name])).anomalies(capped=True, numbered=True)


for _name in ("events", "dirty_orders", "dirty_contacts", "sparse_events", "lineitem", "documents"):
    _log(_name)
for _name in ("events", "dirty_orders", "dirty_contacts"):
    _capped_log(_name)


@query("anomaly_log_uncapped", f"{log_sql('dirty_contacts', False)} {_LOG}")
def _(spark, folder):
    df, row = rows_of(spark, folder, "dirty_contacts")
    return profile_report(df, row).anomalies(capped=False)


def _kind_log(name: str, view_name: str, kind: str, extra: str = "", spark_extra: str = "true"):
    @query(name, f"{log_sql(view_name, 'capped' in name)} {_LOG} WHERE type = '{kind}'{extra}")
    def _(spark, folder):
        df, row = rows_of(spark, folder, view_name)
        return profile_report(df, row).anomalies(capped="capped" in name).where(f"type = '{kind}' and {spark_extra}")


_kind_log("outliers_capped", "events", "outlier")
_kind_log("rare_value_log", "dirty_orders", "rare_value")
_kind_log("email_format_log", "dirty_contacts", "format_error", " AND \"column\" = 'contact_email'", "column = 'contact_email'")
_kind_log("phone_format_log", "dirty_contacts", "format_error", " AND \"column\" = 'phone'", "column = 'phone'")


def _counts_sql(name: str) -> str:
    """Uncapped counts; every checked column has a row, also with none found."""
    checked = []
    for c, kind in COLUMNS[name].items():
        if A.format_pattern(c):
            checked.append(f"SELECT '{c}' AS \"column\", 'format_error' AS type")
    checked.append("SELECT \"column\", 'outlier' FROM facts WHERE ty = 'numeric'")
    return (
        log_sql(name, False)
        + f""" SELECT k."column", k.type, count(l.type) AS "count" FROM ({' UNION ALL '.join(checked)}) k
        LEFT JOIN log l ON l."column" = k."column" AND l.type = k.type GROUP BY ALL
        UNION ALL SELECT "column", type, count(*) FROM log WHERE type = 'rare_value' GROUP BY ALL"""
    )


@query("anomaly_counts", _counts_sql("dirty_contacts"))
def _(spark, folder):
    df, row = rows_of(spark, folder, "dirty_contacts")
    return A.anomaly_counts_frame(df, P.profile(df, row))


def summary_sql(name: str, capped: bool = False) -> str:
    """One row: counts, missing share and score of a view."""
    return f"""{log_sql(name, capped)} SELECT n AS row_count, c AS column_count, n * c AS total_cells, m AS missing_cells,
      CASE WHEN n > 0 THEN round(m / (n * c) * 100, 2) ELSE 0.0 END AS missing_pct,
      greatest(0.0, least(100.0, round(100 - 40 * m / (n * c) - 30 * least(outliers / n, 1.0) - 30 * least(formats / n, 1.0), 2)))
        AS quality_score
      FROM (SELECT CAST(max(n) AS BIGINT) AS n, CAST(count(*) AS INTEGER) AS c, CAST(sum(n - nn) AS BIGINT) AS m FROM facts),
           (SELECT count(*) FILTER (type = 'outlier') AS outliers, count(*) FILTER (type = 'format_error') AS formats FROM log)"""


def _summary(name: str) -> None:
    @query(f"dataset_summary_{name}", summary_sql(name))
    def _(spark, folder):
        df, row = rows_of(spark, folder, name)
        return profile_report(df, row, list(COLUMNS[name])).summary_frame()


for _name in ("events", "dirty_contacts", "sparse_events"):
    _summary(_name)


@query("dataset_summary_capped", summary_sql("dirty_contacts", True))
def _(spark, folder):
    df, row = rows_of(spark, folder, "dirty_contacts")
    return profile_report(df, row, list(COLUMNS["dirty_contacts"]), uncapped=False).summary_frame()


@query("quality_score_uncapped", summary_sql("sparse_events", False))
def _(spark, folder):
    df, row = rows_of(spark, folder, "sparse_events")
    return profile_report(df, row, uncapped=True).summary_frame()


@query(
    "score_band",
    f"""WITH s AS ({summary_sql('dirty_contacts', False)}) SELECT *, CASE WHEN quality_score >= 85 THEN 'good'
    WHEN quality_score >= 60 THEN 'warning' ELSE 'poor' END AS band FROM s""",
)
def _(spark, folder):
    df, row = rows_of(spark, folder, "dirty_contacts")
    report = profile_report(df, row, uncapped=True)
    return with_band(summary_frame(spark, report.summary))
