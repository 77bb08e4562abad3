"""Row numbers, sources, profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqlgen import COLUMNS, FACTS, LINE_KEY, PROFILE, ROW_KEY, SAMPLES, TYPE, num_sql, per_column, text_sql
from catalog.views import spread_table, table, view, view_sql
from siftframe.operators import merged as M
from siftframe.operators import profile as P
from siftframe.operators.rowid import preview, renumber, with_row_index
from siftframe.sources.readers import read_table
from siftframe.sources.writers import write_csv, write_json, write_json_array, write_json_columns
from siftframe.work import new_table_path


def rows_of(spark, folder, name):
    """A view and its row key; lineitem gets a row number first."""
    df = view(spark, folder, name, spread_table)
    if name == "lineitem":
        df = with_row_index(df, LINE_KEY)
    return df, ROW_KEY[name]


#: Views whose dates are told by their first values.
DATES = {"dirty_dates": "first"}


# --- row numbers ------------------------------------------------------------


@query(
    "row_index_composite_key",
    f"SELECT {', '.join(LINE_KEY)}, row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1 AS row_index FROM lineitem",
)
def _(spark, folder):
    return with_row_index(table(spark, folder, "lineitem").select(*LINE_KEY), LINE_KEY)


@query(
    "row_index_input_order",
    "SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events",
)
def _(spark, folder):
    return with_row_index(table(spark, folder, "events").select("event_id", "user_id"))


@query(
    "row_index_over_files",
    "SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events",
)
def _(spark, folder):
    """Files of unequal size in one folder are numbered in the order of their names."""
    path = new_table_path(spark, "files")
    events = table(spark, folder, "events").select("event_id", "user_id")
    for name, part in (("a", "event_id < 40"), ("b", "event_id >= 40 AND event_id < 700"), ("c", "event_id >= 700")):
        events.where(part).write.parquet(f"{path}/part={name}")
    return with_row_index(spark.read.parquet(path).select("event_id", "user_id"))


@query(
    "row_index_sparse_keys",
    "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders",
)
def _(spark, folder):
    """Keys with a gap of 2**30 between any two."""
    keyed = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") * (1 << 30)).alias("k"))
    return with_row_index(keyed, "k", unique_integer=True).drop("k")


@query(
    "row_index_after_removal",
    "SELECT o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index "
    "FROM orders WHERE o_orderstatus <> 'F'",
)
def _(spark, folder):
    kept = table(spark, folder, "orders").where("o_orderstatus <> 'F'")
    return renumber(kept.select("o_orderstatus", "o_totalprice", F.col("o_orderkey").alias("row_index")))


@query("preview_first_rows", f"SELECT * FROM ({view_sql('dirty_orders')}) ORDER BY o_orderkey LIMIT 8")
def _(spark, folder):
    return preview(view(spark, folder, "dirty_orders"), 8, "o_orderkey")


# --- sources and sinks ------------------------------------------------------


@query(
    "csv_round_trip",
    "SELECT "
    + ", ".join(f'nullif({text_sql(c, k)}, \'\') AS "{c}"' for c, k in COLUMNS["dirty_contacts"].items())
    + f" FROM ({view_sql('dirty_contacts')})",
)
def _(spark, folder):
    path = new_table_path(spark, "csv")
    write_csv(view(spark, folder, "dirty_contacts"), path)
    return read_table(spark, path, ".CSV", multi_line=False)


@query("csv_text_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def _(spark, folder):
    """Whole documents with line breaks and quotes inside cells."""
    path = new_table_path(spark, "csv")
    write_csv(table(spark, folder, "documents"), path)
    return read_table(spark, path, "csv")


@query("json_round_trip", f"SELECT * FROM ({view_sql('dirty_orders')})")
def _(spark, folder):
    path = new_table_path(spark, "json")
    df = view(spark, folder, "dirty_orders")
    write_json(df, path)
    return read_table(spark, path, "json", lines=True).select(*df.columns)


@query("json_array_round_trip", f"SELECT * FROM ({view_sql('dirty_orders')})")
def _(spark, folder):
    """Files of arrays of records."""
    path = new_table_path(spark, "json-arrays")
    df = view(spark, folder, "dirty_orders")
    write_json_array(df, path)
    return read_table(spark, path, "json").select(*df.columns)


@query("json_columns", f"SELECT * FROM ({view_sql('dirty_orders')})")
def _(spark, folder):
    """Files of the form {column: {row: value}}."""
    path = new_table_path(spark, "json-columns")
    df = view(spark, folder, "dirty_orders")
    write_json_columns(df, path)
    return read_table(spark, path, "json", orient="columns").select(*df.columns)


# --- profile ----------------------------------------------------------------


@query(
    "upload_metadata",
    f"""SELECT n AS total_rows, 7 AS total_columns, m AS missing_cells, round(m / (n * 7) * 100, 1) AS missing_pct FROM
    (SELECT count(*) AS n, count(*) * 7 - {' - '.join(f'count({c})' for c in COLUMNS['dirty_orders'])} AS m
     FROM ({view_sql('dirty_orders')}))""",
)
def _(spark, folder):
    return P.upload_metadata(view(spark, folder, "dirty_orders"))


def _types(name: str) -> None:
    @query(f"semantic_types_{name}", per_column(name, f"SELECT '{{column}}' AS \"column\", {TYPE} AS inferred_type FROM {FACTS}"))
    def _(spark, folder):
        df, row = rows_of(spark, folder, name)
        prof = P.profile(df, row, list(COLUMNS[name]), quartiles=False, dates=DATES.get(name, "all"))
        return P.profile_frame(df, prof).select("column", "inferred_type")


for _name in ("dirty_orders", "dirty_dates", "dirty_contacts", "sparse_events", "labels", "documents", "part", "pages"):
    _types(_name)


@query(
    "null_shares",
    per_column(
        "sparse_events",
        "SELECT '{column}' AS \"column\", count(*) AS total_count, count(*) - count(t) AS null_count, "
        "(count(*) - count(t)) * 1.0 / count(*) AS null_pct FROM {source}",
    ).replace("* 1.0 /", "/ CAST(1 AS DOUBLE) /"),
)
def _(spark, folder):
    return P.null_counts(view(spark, folder, "sparse_events"))


def _distinct(name: str) -> None:
    @query(f"distinct_counts_{name}", per_column(name, "SELECT '{column}' AS \"column\", count(DISTINCT t) AS unique_count FROM {source}"))
    def _(spark, folder):
        return P.distinct_counts(view(spark, folder, name))


_distinct("lineitem")
_distinct("documents")


def _samples(name: str) -> None:
    @query(
        f"sample_values_{name}",
        per_column(
            name,
            "SELECT '{column}' AS \"column\", CAST(row_number() OVER (ORDER BY _row) AS INTEGER) AS position, t AS value "
            "FROM {source} WHERE t IS NOT NULL ORDER BY _row LIMIT 5",
        ),
    )
    def _(spark, folder):
        df, row = rows_of(spark, folder, name)
        return P.sample_values(df, row, list(COLUMNS[name]))


_samples("sparse_events")
_samples("dirty_dates")


def _top(name: str) -> None:
    @query(
        f"top_values_{name}",
        per_column(
            name,
            "SELECT '{column}' AS \"column\", CAST(row_number() OVER (ORDER BY n DESC, r) AS INTEGER) AS rank, t AS value, n AS \"count\" "
            "FROM (SELECT t, count(*) AS n, min(_row) AS r FROM {source} WHERE t IS NOT NULL GROUP BY t) ORDER BY n DESC, r LIMIT 5",
        ),
    )
    def _(spark, folder):
        df, row = rows_of(spark, folder, name)
        return P.top_values(df, row, list(COLUMNS[name]))


for _name in ("lineitem", "events", "documents"):
    _top(_name)

_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "numeric_stats",
    per_column(
        "lineitem",
        "SELECT '{column}' AS \"column\", min(x) AS \"min\", max(x) AS \"max\", round(avg(x), 4) AS mean, "
        "round(stddev_samp(x), 4) AS std FROM {source}",
        _NUMERIC,
    ),
)
def _(spark, folder):
    stats = P.numeric_stats(table(spark, folder, "lineitem"), _NUMERIC)
    return stats.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@query(
    "exact_quartiles",
    per_column(
        "lineitem",
        "SELECT '{column}' AS \"column\", round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median, "
        "round(quantile_cont(x, 0.75), 4) AS q3 FROM {source}",
        _NUMERIC,
    ),
)
def _(spark, folder):
    """With a small in-memory limit, so that the distributed narrowing is what runs."""
    from siftframe.operators.quantiles import exact_quantiles

    found = exact_quantiles(
        table(spark, folder, "lineitem"), {c: F.col(c).cast("double") for c in _NUMERIC}, [0.25, 0.5, 0.75], limit=5000
    )
    rows = [(c, *[round(v, 4) for v in q]) for c, q in found.items()]
    return spark.createDataFrame(rows, "column string, q1 double, median double, q3 double")


@query(
    "datetime_stats",
    per_column(
        "dirty_dates",
        f"SELECT '{{column}}' AS \"column\", strftime(first_time, '%Y-%m-%d %H:%M:%S') AS min_ts, "
        f"strftime(last_time, '%Y-%m-%d %H:%M:%S') AS max_ts FROM (SELECT *, {TYPE} AS ty FROM {FACTS}) WHERE ty = 'datetime'",
    ),
)
def _(spark, folder):
    df, row = rows_of(spark, folder, "dirty_dates")
    prof = P.profile_frame(df, P.profile(df, row, quartiles=False, dates="first"))
    return prof.where("inferred_type = 'datetime'").select("column", "min_ts", "max_ts")


def flat_profile(prof):
    """Profile with lists joined to text and rounded numbers, for comparison."""
    return prof.select(
        "column", "inferred_type", "total_count", "null_count", F.round("null_pct", 6).alias("null_pct"), "unique_count",
        F.when(F.size("sample_values") > 0, F.array_join("sample_values", "|")).alias("sample_values"),
        F.when(
            F.size("top_values") > 0,
            F.array_join(F.transform("top_values", lambda t: F.concat(t["value"], F.lit("="), t["count"].cast("string"))), "|"),
        ).alias("top_values"),
        *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std", "median")],
        "min_ts", "max_ts",
    )


def _profile(name: str) -> None:
    @query(f"schema_profile_{name}", per_column(name, PROFILE))
    def _(spark, folder):
        df, row = rows_of(spark, folder, name)
        return flat_profile(P.profile_frame(df, P.profile(df, row, list(COLUMNS[name]), dates=DATES.get(name, "all"))))


for _name in ("lineitem", "dirty_orders", "dirty_dates", "dirty_contacts", "sparse_events", "events", "documents", "customer"):
    _profile(_name)

_H = f"SELECT {num_sql('price_txt', 'text')} AS x FROM ({view_sql('dirty_orders')})"


def _histogram_sql(numbers: str) -> str:
    return f"""WITH d AS (SELECT x FROM ({numbers}) WHERE x IS NOT NULL),
    e AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
    b AS (SELECT CASE WHEN lo = hi THEN 1 ELSE least(CAST(floor(20 * (x - lo) / (hi - lo)) AS BIGINT) + 1, 20) END AS bin,
          lo, hi FROM d, e)
    SELECT CAST(bin AS BIGINT) AS bin, round(lo + (bin - 1) * (hi - lo) / 20, 4) AS low,
           round(CASE WHEN lo = hi THEN hi ELSE lo + bin * (hi - lo) / 20 END, 4) AS high, count(*) AS "count"
    FROM b GROUP BY bin, lo, hi"""


@query("histogram_text_numbers", _histogram_sql(_H))
def _(spark, folder):
    h = P.histogram(view(spark, folder, "dirty_orders"), "price_txt")
    return h.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "count")


@query("histogram_numeric", _histogram_sql("SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem"))
def _(spark, folder):
    h = P.histogram(table(spark, folder, "lineitem"), "l_extendedprice")
    return h.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "count")


@query(
    "value_distribution",
    "SELECT CAST(row_number() OVER (ORDER BY n DESC, r) AS INTEGER) AS rank, p_name AS value, n AS \"count\" FROM "
    "(SELECT p_name, count(*) AS n, min(p_partkey) AS r FROM part GROUP BY p_name) ORDER BY n DESC, r LIMIT 10",
)
def _(spark, folder):
    return P.value_distribution(table(spark, folder, "part"), "p_name", "p_partkey")


@query(
    "schema_summary_table",
    per_column(
        "dirty_orders",
        f"""SELECT '{{column}}' AS "column", upper({TYPE}) AS inferred_type, printf('%.1f%%', (n - nn) / n * 100) AS null_rate,
        printf('%.1f%%', u / n * 100) AS uniqueness, replace({SAMPLES}, '|', ', ') AS sample_values FROM {FACTS}""",
    ),
)
def _(spark, folder):
    df, row = rows_of(spark, folder, "dirty_orders")
    return P.schema_summary(P.profile_frame(df, P.profile(df, row, quartiles=False))).drop("physical_type")


_DETAIL = f"""SELECT "column", metric, value FROM (
  SELECT '{{column}}' AS "column", ty, unnest([
    {{'metric': 'Inferred Type', 'value': upper(ty), 'of': ''}},
    {{'metric': 'Null Records', 'value': printf('%d (%.1f%%)', n - nn, (n - nn) / n * 100), 'of': ''}},
    {{'metric': 'Unique Values', 'value': CAST(u AS VARCHAR), 'of': ''}},
    {{'metric': 'Minimum', 'value': printf('%.4f', lo), 'of': 'numeric'}},
    {{'metric': 'Maximum', 'value': printf('%.4f', hi), 'of': 'numeric'}},
    {{'metric': 'Mean Average', 'value': printf('%.4f', mean), 'of': 'numeric'}},
    {{'metric': 'Median (P50)', 'value': printf('%.4f', median), 'of': 'numeric'}},
    {{'metric': 'Std Dev', 'value': printf('%.4f', std), 'of': 'numeric'}},
    {{'metric': 'Earliest Date', 'value': strftime(first_time, '%Y-%m-%d %H:%M:%S'), 'of': 'datetime'}},
    {{'metric': 'Latest Date', 'value': strftime(last_time, '%Y-%m-%d %H:%M:%S'), 'of': 'datetime'}}
  ], recursive := true) FROM (SELECT *, {TYPE} AS ty FROM {FACTS})) WHERE "of" = '' OR "of" = ty"""


@query("column_details", per_column("orders", _DETAIL))
def _(spark, folder):
    df, row = rows_of(spark, folder, "orders")
    return P.column_details(P.profile_frame(df, P.profile(df, row)))


@query(
    "schema_profile_late_dates",
    f"""WITH d AS (SELECT *, coalesce(try_strptime(d_late, '%Y-%m-%d'), try_strptime(d_late, '%d/%m/%Y'), try_strptime(d_late, '%Y/%m/%d')) AS t,
      try_strptime(d_some, '%Y-%m-%d') AS s FROM ({view_sql('late_dates')})),
    f AS (SELECT 'd_late' AS "column", count(t) > 0.8 * count(*) AS dates, count(DISTINCT d_late) AS u, min(t) AS lo, max(t) AS hi FROM d
      UNION ALL SELECT 'd_some', count(s) > 0.8 * count(*), count(DISTINCT d_some), min(s), max(s) FROM d)
    SELECT "column", CASE WHEN dates THEN 'datetime' ELSE 'text' END AS inferred_type, u AS unique_count,
      CASE WHEN dates THEN strftime(lo, '%Y-%m-%d %H:%M:%S') END AS min_ts, CASE WHEN dates THEN strftime(hi, '%Y-%m-%d %H:%M:%S') END AS max_ts FROM f""",
)
def _(spark, folder):
    """Dates of several forms, each read by its own format."""
    df = view(spark, folder, "late_dates", spread_table)
    prof = P.profile_frame(df, P.profile(df, "o_orderkey", ["d_late", "d_some"], dates="mixed"))
    return prof.select("column", "inferred_type", "unique_count", "min_ts", "max_ts")


@query(
    "profile_merged",
    per_column(
        "events",
        "SELECT '{column}' AS \"column\", count(*) AS total_count, count(*) - count(t) AS null_count, count(x) AS numbers, min(x) AS \"min\", "
        "max(x) AS \"max\", round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std FROM {source}",
        ["user_id", "event_type", "value"],
    ),
)
def _(spark, folder):
    """Every kind of event is profiled on its own and appended; the whole comes from these profiles."""
    path = new_table_path(spark, "parts")
    events = table(spark, folder, "events").select("event_type", "user_id", "value")
    for r in events.select("event_type").distinct().orderBy("event_type").collect():
        M.append_part(events.where(F.col("event_type") == r["event_type"]), r["event_type"], path)
    whole = M.merged_profile(M.read_parts(events, path))
    return whole.select("column", "total_count", "null_count", "numbers", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(
    "profile_nested",
    """SELECT 'embedding' AS "column", CASE WHEN count(DISTINCT embedding) <= 15 THEN 'categorical' ELSE 'text' END AS inferred_type, count(*) AS total_count,
    count(*) - count(embedding) AS null_count, count(DISTINCT embedding) AS unique_count FROM embeddings""",
)
def _(spark, folder):
    """An array column is profiled as the JSON text of its values."""
    df = table(spark, folder, "embeddings")
    prof = P.profile_frame(df, P.profile(df, "vec_id", ["embedding"]))
    return prof.select("column", "inferred_type", "total_count", "null_count", "unique_count")


@query(
    "schema_profile_placeholder_dates",
    f"""WITH d AS (SELECT *, try_strptime(d_behind, '%Y-%m-%d') AS t FROM ({view_sql('late_dates')}))
    SELECT 'd_behind' AS "column", CASE WHEN count(t) > 0.8 * count(*) THEN 'datetime' ELSE 'text' END AS inferred_type, count(DISTINCT d_behind) AS unique_count,
      strftime(min(t), '%Y-%m-%d %H:%M:%S') AS min_ts, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS max_ts FROM d
    UNION ALL SELECT 'd_late', 'text', count(DISTINCT d_late), NULL, NULL FROM d""",
)
def _(spark, folder):
    """Dates of one form that the first values do not show; three forms at once are no format of a column."""
    df = view(spark, folder, "late_dates", spread_table)
    prof = P.profile_frame(df, P.profile(df, "o_orderkey", ["d_behind", "d_late"]))
    return prof.select("column", "inferred_type", "unique_count", "min_ts", "max_ts")
