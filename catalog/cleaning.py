"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqlgen import num_sql
from catalog.views import EMAIL, table, view, view_sql
from siftframe.operators import clean as C
from siftframe.plans.cleaning import add_conversion, add_imputation, clean_and_enrich, new_config, remove_step

ORDERS = view_sql("dirty_orders")
DUPS = view_sql("dirty_dups")

# --- headers ----------------------------------------------------------------
_OLD = ["Cust ID", "Cust Name", "Eml", "Ctn Wgt", "Txn-Amt", "Nation  Key (%)", "mkt_Segment_", "???"]
_STYLED = {
    "snake_case": ["cust_id", "cust_name", "eml", "ctn_wgt", "txnamt", "nation_key", "mkt_segment", "column"],
    "camelCase": ["custId", "custName", "eml", "ctnWgt", "txn-amt", "nationKey(%)", "mktSegment", "???"],
    "uppercase": ["CUST_ID", "CUST_NAME", "EML", "CTN_WGT", "TXNAMT", "NATION__KEY_", "MKT_SEGMENT_", "column"],
    "lowercase": ["cust_id", "cust_name", "eml", "ctn_wgt", "txnamt", "nation__key_", "mkt_segment_", "column"],
    "title_case": ["Cust Id", "Cust Name", "Eml", "Ctn Wgt", "Txn-amt", "Nation Key (%)", "Mkt Segment", "???"],
    "as they are": ["Cust ID", "Cust Name", "Eml", "Ctn Wgt", "Txn-Amt", "Nation  Key (%)", "mkt_Segment_", "???"],
}


def _headers(style: str) -> None:
    columns = ", ".join(f'"{o}" AS "{n}"' for o, n in zip(_OLD, _STYLED[style]))

    @query(f"headers_{style.replace(' ', '_')}", f"SELECT {columns} FROM ({view_sql('cryptic_customers')})")
    def _(spark, folder):
        return C.standardize_headers(view(spark, folder, "cryptic_customers"), style)


for _style in _STYLED:
    _headers(_style)


@query(
    "header_collisions",
    'SELECT c_custkey AS cust_id, c_name AS cust_id_2, c_nationkey AS nation, c_acctbal AS cust_id_3, c_mktsegment AS nation_2 FROM customer',
)
def _(spark, folder):
    df = table(spark, folder, "customer").toDF("Cust ID", "cust_id ", "Nation", "CUST__ID", " nation")
    return C.standardize_headers(df)


# --- cells ------------------------------------------------------------------


@query("trim_whitespace", f"SELECT * REPLACE (trim(priority) AS priority) FROM ({ORDERS})")
def _(spark, folder):
    return C.trim_whitespace(view(spark, folder, "dirty_orders"))


@query("drop_null_rows", f"SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM ({ORDERS}) WHERE price IS NOT NULL")
def _(spark, folder):
    df = view(spark, folder, "dirty_orders").withColumn("row_index", F.col("o_orderkey"))
    return C.clean(df, {"drop_null_rows": ["price", "no such column"]})


_NUM = "CASE WHEN price_txt = 'n/a?' THEN NULL ELSE CAST(price_txt AS DOUBLE) END"


@query("impute_mean", f"SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM ({ORDERS}))), 4) AS price FROM ({ORDERS})")
def _(spark, folder):
    df = C.handle_missing(view(spark, folder, "dirty_orders"), "price", "mean")
    return df.select("o_orderkey", F.round("price", 4).alias("price"))


@query(
    "impute_median",
    f"SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM ({ORDERS}))), 4) AS price FROM ({ORDERS})",
)
def _(spark, folder):
    df = C.handle_missing(view(spark, folder, "dirty_orders"), "price", "median")
    return df.select("o_orderkey", F.round("price", 4).alias("price"))


@query(
    "impute_mode",
    f"""WITH v AS ({view_sql('materials')}) SELECT p_partkey, coalesce(material, (SELECT material FROM v WHERE material IS NOT NULL
    GROUP BY material ORDER BY count(*) DESC, material LIMIT 1)) AS material FROM v""",
)
def _(spark, folder):
    return C.handle_missing(view(spark, folder, "materials"), "material", "mode").select("p_partkey", "material")


@query("impute_constant", f"SELECT p_partkey, coalesce(material, 'Unknown') AS material FROM ({view_sql('materials')})")
def _(spark, folder):
    return C.handle_missing(view(spark, folder, "materials"), "material", "constant", "Unknown").select("p_partkey", "material")


@query(
    "impute_several",
    f"""WITH v AS ({ORDERS}) SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM v)), 4) AS price, status, priority
    FROM v WHERE price_txt IS NOT NULL""",
)
def _(spark, folder):
    steps = [
        {"column": "price", "method": "mean"},
        {"column": "status", "method": "mode"},
        {"column": "priority", "method": "constant", "value": "none"},
        {"column": "price_txt", "method": "drop"},
    ]
    df = C.impute(view(spark, folder, "dirty_orders"), steps)
    return df.select("o_orderkey", F.round("price", 4).alias("price"), "status", "priority")


# --- types ------------------------------------------------------------------


@query("cast_int", f"SELECT o_orderkey, CAST(round_even({_NUM}, 0) AS BIGINT) AS price_txt FROM ({ORDERS})")
def _(spark, folder):
    return C.convert(view(spark, folder, "dirty_orders"), "price_txt", "int").select("o_orderkey", "price_txt")


@query("cast_float", f"SELECT o_orderkey, {_NUM} AS price_txt FROM ({ORDERS})")
def _(spark, folder):
    return C.convert(view(spark, folder, "dirty_orders"), "price_txt", "float").select("o_orderkey", "price_txt")


@query("cast_str", f"SELECT o_orderkey, coalesce(CAST(price AS VARCHAR), '') AS price FROM ({ORDERS})")
def _(spark, folder):
    return C.convert(view(spark, folder, "dirty_orders"), "price", "str").select("o_orderkey", "price")


@query("cast_category", f"SELECT o_orderkey, CAST(price AS VARCHAR) AS price, status FROM ({ORDERS})")
def _(spark, folder):
    df = C.convert(view(spark, folder, "dirty_orders"), "status", "category")
    return df.select("o_orderkey", F.col("price").cast("string").alias("price"), "status")


@query(
    "category_codes",
    "SELECT p_name AS value, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part)",
)
def _(spark, folder):
    return C.category_codes(table(spark, folder, "part"), "p_name")


@query(
    "cast_datetime_first_format",
    f"SELECT o_orderkey, try_strptime(d_mixed, '%Y-%m-%d') AS d_mixed FROM ({view_sql('dirty_dates')})",
)
def _(spark, folder):
    df = view(spark, folder, "dirty_dates").withColumn("row_index", F.col("o_orderkey"))
    return C.convert(df, "d_mixed", "datetime").select("o_orderkey", "d_mixed")


@query(
    "cast_datetime_given_format",
    f"SELECT o_orderkey, try_strptime(d_mixed, '%d/%m/%Y') AS d_mixed FROM ({view_sql('dirty_dates')})",
)
def _(spark, folder):
    return C.convert(view(spark, folder, "dirty_dates"), "d_mixed", "datetime", "%d/%m/%Y").select("o_orderkey", "d_mixed")


@query(
    "cast_boolean",
    f"""SELECT o_orderkey, CASE WHEN lower(trim(flag)) IN ('true', '1', '1.0', 'yes', 'y', 't', 'active') THEN true
    WHEN lower(trim(flag)) IN ('false', '0', '0.0', 'no', 'n', 'f', 'inactive') THEN false END AS flag FROM ({ORDERS})""",
)
def _(spark, folder):
    return C.convert(view(spark, folder, "dirty_orders"), "flag", "boolean").select("o_orderkey", "flag")


# --- rows -------------------------------------------------------------------
_DATA = "event_id, ts, user_id, event_type, value, props"


@query(
    "drop_exact_duplicates",
    f"SELECT *, row_number() OVER (ORDER BY r) - 1 AS row_index FROM (SELECT {_DATA}, min(row_index) AS r FROM ({DUPS}) GROUP BY ALL)"
    .replace("SELECT *, row", f"SELECT {_DATA}, row"),
)
def _(spark, folder):
    return C.clean(view(spark, folder, "dirty_dups"), {"remove_duplicates": True})


@query(
    "drop_duplicates_on_subset",
    f"""SELECT {_DATA}, row_number() OVER (ORDER BY row_index) - 1 AS row_index FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY row_index) AS k FROM ({DUPS})) WHERE k = 1""",
)
def _(spark, folder):
    config = {"remove_duplicates": True, "duplicate_columns": ["user_id", "event_type"]}
    return C.clean(view(spark, folder, "dirty_dups"), config)


# --- the whole sequence -----------------------------------------------------
_CONFIG = new_config(
    imputations=[
        {"column": "price", "method": "median"},
        {"column": "status", "method": "mode"},
        {"column": "PRICE", "method": "drop"},
    ],
    conversions=[
        {"column": "price_txt", "type": "float"},
        {"column": "flag", "type": "boolean"},
        {"column": "no such column", "type": "int"},
    ],
    duplicate_columns=["o_custkey", "status"],
    drop_null_rows=["price_txt"],
)


@query(
    "cleaning_sequence",
    f"""WITH v AS (SELECT o_orderkey, o_custkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM ({ORDERS}))), 4) AS price,
      {_NUM} AS price_txt, trim(priority) AS priority, status,
      CASE WHEN flag IN ('Yes', 'ACTIVE') THEN true WHEN flag IN ('no', '0') THEN false END AS flag FROM ({ORDERS})),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, status ORDER BY o_orderkey) AS k FROM v)
    SELECT * EXCLUDE (k), row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM k WHERE k = 1 AND price_txt IS NOT NULL""",
)
def _(spark, folder):
    """Imputation, conversion and duplicate steps together; steps on unknown names are skipped."""
    df = view(spark, folder, "dirty_orders").withColumn("row_index", F.col("o_orderkey"))
    return C.clean(df, _CONFIG).withColumn("price", F.round("price", 4))


_MESSY = f"""SELECT c_custkey AS "Cust ID", '  ' || c_name || ' ' AS "Cust Name", {EMAIL} AS "Eml",
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS "Txn Amt" FROM customer"""


def _messy(spark, folder):
    df = view(spark, folder, "cryptic_customers").select("Cust ID", "Cust Name", "Eml", F.col("`Txn-Amt`").alias("Txn Amt"))
    return df.select(
        "Cust ID",
        F.concat(F.lit("  "), F.col("Cust Name"), F.lit(" ")).alias("Cust Name"),
        "Eml",
        F.when(F.col("Cust ID") % 6 != 0, F.col("Txn Amt")).alias("Txn Amt"),
        F.col("Cust ID").alias("row_index"),
    )


@query(
    "cleaning_names_not_followed",
    f"""SELECT "Cust ID" AS cust_id, trim("Cust Name") AS cust_name, "Eml" AS eml, "Txn Amt" AS txn_amt, "Cust ID" AS row_index FROM ({_MESSY})""",
)
def _(spark, folder):
    """Steps name the old headers, which are gone after the header step: nothing is filled or dropped."""
    config = new_config(imputations=[{"column": "Txn Amt", "method": "mean"}], drop_null_rows=["Txn Amt"])
    return C.clean(_messy(spark, folder), config)


@query(
    "cleaning_names_followed",
    f"""SELECT "Cust ID" AS cust_id, trim("Cust Name") AS cust_name, "Eml" AS eml,
    round(coalesce("Txn Amt", (SELECT avg("Txn Amt") FROM ({_MESSY}))), 4) AS txn_amt, "Cust ID" AS row_index FROM ({_MESSY})""",
)
def _(spark, folder):
    config = new_config(imputations=[{"column": "Txn Amt", "method": "mean"}], drop_null_rows=["Txn Amt"])
    return C.clean(_messy(spark, folder), config, resolve_names=True).withColumn("txn_amt", F.round("txn_amt", 4))


# --- date forms -------------------------------------------------------------
def _date_form(name: str, spark_form: str, sql_form: str, date_format: str | None) -> None:
    """Dates of orders written in a form and read back, with a first value that may be no date."""
    first = "CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN NULL ELSE o_orderdate END" if date_format is None else "o_orderdate"

    @query(f"cast_datetime_{name}", f"SELECT o_orderkey, {first.replace('o_orderdate', sql_form)} AS d FROM orders")
    def _(spark, folder):
        df = table(spark, folder, "orders").select("o_orderkey", F.expr(spark_form).alias("d"))
        if date_format is None:
            low = df.agg(F.min("o_orderkey")).first()[0]
            df = df.withColumn("d", F.when(F.col("o_orderkey") == low, "soon").otherwise(F.col("d")))
            return C.convert(df.withColumn("row_index", F.col("o_orderkey")), "d", "datetime").drop("row_index")
        return C.convert(df, "d", "datetime", date_format)


_DAY = "CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)"
_date_form("two_digit_year", "date_format(o_orderdate - INTERVAL 20 YEARS, 'MM/dd/yy')", f"{_DAY} - INTERVAL 20 YEARS", "%m/%d/%y")
_date_form("compact_time", "concat(date_format(o_orderdate, 'yyyyMMdd'), ' 10:20:30')", f"{_DAY} + INTERVAL 37230 SECONDS", "%Y%m%d %H:%M:%S")
_date_form("zulu", "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:20:30Z')", f"{_DAY} + INTERVAL 37230 SECONDS", "%Y-%m-%dT%H:%M:%S%z")
_date_form("offset", "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:20:30+02:00')", f"{_DAY} + INTERVAL 30030 SECONDS", "%Y-%m-%dT%H:%M:%S%z")
_date_form("after_no_date", "concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 10:20:30')", f"{_DAY} + INTERVAL 37230 SECONDS", None)


@query("cast_datetime_unknown_directive", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS d FROM orders")
def _(spark, folder):
    """A format that cannot be read leaves the column alone."""
    df = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("d"))
    return C.convert(df, "d", "datetime", "%Q")


_MODE = "(SELECT {c} FROM v WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "impute_modes",
    f"""WITH v AS ({ORDERS}) SELECT o_orderkey, coalesce(status, {_MODE.format(c='status')}) AS status,
    coalesce(price_txt, {_MODE.format(c='price_txt')}) AS price_txt, round(coalesce(price, {_MODE.format(c='price')}), 4) AS price FROM v""",
)
def _(spark, folder):
    """The modes of all columns from one pass."""
    steps = [{"column": c, "method": "mode"} for c in ("status", "price_txt", "price")]
    filled = C.impute(view(spark, folder, "dirty_orders"), steps)
    return filled.select("o_orderkey", "status", "price_txt", F.round("price", 4).alias("price"))


@query(
    "config_builder",
    f"""SELECT o_orderkey, coalesce(status, 'none') AS status, {num_sql('price_txt', 'text')} AS price_txt, flag FROM ({ORDERS})""",
)
def _(spark, folder):
    """A configuration put together step by step: the last step of a column wins, and a step is taken back."""
    config = new_config(standardize_headers=None, trim_whitespace=False, remove_duplicates=False)
    config = add_imputation(add_imputation(config, "status", "mode"), "status", "constant", "none")
    config = add_conversion(add_conversion(config, "price_txt", "int"), "flag", "boolean")
    config = remove_step(add_conversion(config, "price_txt", "float"), "conversions", 0)
    return clean_and_enrich(view(spark, folder, "dirty_orders"), config).select("o_orderkey", "status", "price_txt", "flag")
