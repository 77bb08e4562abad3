"""Tables, and views over them with deliberate defects.

The supplied tables hold no missing or malformed values. Each view adds some by
plain projections, whose expressions read the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftframe.sources.readers import spread

ISO = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
EMAIL = (
    "CASE WHEN c_custkey % 29 = 0 THEN '' "
    "WHEN c_custkey % 13 = 0 THEN replace(c_name, '#', '') || 'example.com' "
    "ELSE replace(c_name, '#', '') || '@example.com' END"
)

# view -> (table, [(expression, column)])
VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "dirty_orders": (
        "orders",
        [
            ("o_orderkey", "o_orderkey"),
            ("o_custkey", "o_custkey"),
            ("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END", "price"),
            ("CASE WHEN o_orderkey % 37 = 0 THEN 'n/a?' ELSE CAST(o_totalprice AS STRING) END", "price_txt"),
            ("CASE WHEN o_orderkey % 5 = 0 THEN '  ' || o_orderpriority || ' ' ELSE o_orderpriority END", "priority"),
            ("CASE WHEN o_orderkey % 500 = 7 THEN 'X' ELSE o_orderstatus END", "status"),
            (
                "CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'ACTIVE' WHEN 3 THEN '0' "
                "ELSE 'maybe' END",
                "flag",
            ),
        ],
    ),
    "dirty_dates": (
        "orders",
        [
            ("o_orderkey", "o_orderkey"),
            (ISO, "d_iso"),
            (
                f"CASE WHEN o_orderkey % 10 = 3 THEN substr({ISO}, 9, 2) || '/' || substr({ISO}, 6, 2) || '/' || "
                f"substr({ISO}, 1, 4) ELSE {ISO} END",
                "d_mixed",
            ),
            (f"CASE WHEN o_orderkey % 3 = 1 THEN 'soon' ELSE {ISO} END", "d_bad"),
            ("o_orderdate", "d_native"),
        ],
    ),
    # dates of three forms behind two dozen placeholders, and a column of which a third are dates
    "late_dates": (
        "orders",
        [
            ("o_orderkey", "o_orderkey"),
            (
                f"CASE WHEN o_orderkey < 25 THEN 'tbd' WHEN o_orderkey % 3 = 0 THEN {ISO} "
                f"WHEN o_orderkey % 3 = 1 THEN substr({ISO}, 9, 2) || '/' || substr({ISO}, 6, 2) || '/' || substr({ISO}, 1, 4) "
                f"ELSE substr({ISO}, 1, 4) || '/' || substr({ISO}, 6, 2) || '/' || substr({ISO}, 9, 2) END",
                "d_late",
            ),
            (f"CASE WHEN o_orderkey < 25 THEN 'tbd' ELSE {ISO} END", "d_behind"),
            (f"CASE WHEN o_orderkey % 3 = 0 THEN {ISO} ELSE 'w' || CAST(o_orderkey AS STRING) END", "d_some"),
        ],
    ),
    "dirty_contacts": (
        "customer",
        [
            ("c_custkey", "c_custkey"),
            (EMAIL, "contact_email"),
            (
                "CASE WHEN c_custkey % 17 = 0 THEN lpad(CAST(c_custkey AS STRING), 6, '5') "
                "ELSE '555' || lpad(CAST(c_custkey AS STRING), 7, '0') END",
                "phone",
            ),
            ("c_acctbal", "c_acctbal"),
        ],
    ),
    "dirty_parts": (
        "part",
        [
            ("p_partkey", "p_partkey"),
            ("p_name", "p_name"),
            (
                "CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') "
                "WHEN 2 THEN substr(p_name, 1, length(p_name) - 1) ELSE p_name END",
                "name_var",
            ),
        ],
    ),
    "sparse_events": (
        "events",
        [
            ("event_id", "event_id"),
            ("CASE WHEN event_id % 4 = 0 THEN value END", "mostly_null"),
            ("CASE WHEN event_id % 1000 = 1 THEN CAST(500.0 AS DOUBLE) ELSE CAST(5.0 AS DOUBLE) END", "const"),
            ("CAST(NULL AS STRING)", "nothing"),
            ("event_type", "event_type"),
        ],
    ),
    "materials": (
        "part",
        [
            ("p_partkey", "p_partkey"),
            (
                "CASE p_partkey % 14 WHEN 0 THEN 'Org. Cotton' WHEN 1 THEN ' ctn blend ' WHEN 2 THEN 'POLY (recycled)' "
                "WHEN 3 THEN 'PES' WHEN 4 THEN 'Recycled Wool' WHEN 5 THEN 'wool' WHEN 6 THEN 'Paid' "
                "WHEN 7 THEN 'unpaid' WHEN 8 THEN ' S ' WHEN 9 THEN 'Declined' WHEN 10 THEN 'f' "
                "WHEN 11 THEN 'Waiting' WHEN 12 THEN NULL ELSE p_name || ' - ' || p_brand END",
                "material",
            ),
            ("p_brand", "p_brand"),
        ],
    ),
    "cryptic_customers": (
        "customer",
        [
            ("c_custkey", "Cust ID"),
            ("c_name", "Cust Name"),
            (EMAIL, "Eml"),
            ("CAST(c_acctbal AS STRING)", "Ctn Wgt"),
            ("c_acctbal", "Txn-Amt"),
            ("CAST(c_nationkey AS STRING)", "Nation  Key (%)"),
            ("c_mktsegment", "mkt_Segment_"),
            ("lpad(CAST(c_custkey AS STRING), 8, '0')", "???"),
        ],
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """For queries that go over every cell several times."""
    return spread(table(spark, folder, name))


def view(spark: SparkSession, folder: str, name: str, read=table) -> DataFrame:
    if name == "dirty_dups":
        return dirty_dups(spark, folder)
    if name not in VIEWS:
        return read(spark, folder, name)
    source, columns = VIEWS[name]
    return read(spark, folder, source).select(*[F.expr(e).alias(c) for e, c in columns])


def dirty_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Events with every 20th one repeated; ``row_index`` is unique and increasing, with gaps."""
    events = table(spark, folder, "events")
    copies = F.when(F.col("event_id") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return events.select("*", F.explode(copies).alias("copy")).select(
        *events.columns, (F.col("event_id") * 2 + F.col("copy")).alias("row_index")
    )


def view_sql(name: str) -> str:
    """SELECT giving a view in SQL."""
    if name == "dirty_dups":
        return (
            "SELECT *, event_id * 2 AS row_index FROM events UNION ALL "
            "SELECT *, event_id * 2 + 1 AS row_index FROM events WHERE event_id % 20 = 0"
        )
    if name not in VIEWS:
        return f"SELECT * FROM {name}"
    source, columns = VIEWS[name]
    return "SELECT " + ", ".join(f'{e} AS "{c}"' for e, c in columns) + f" FROM {source}"
