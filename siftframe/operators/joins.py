"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARE = 1000  # a key is hot above 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are
BROADCAST_ROWS = 200_000  # largest table joined by broadcast, checked by counting rows
BROADCAST_BYTES = 64 << 20  # and the bytes of their texts


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """Keys holding more than 1/HOT_SHARE of the rows, from (key, n); at most HOT_SHARE rows."""
    total = counts.agg(F.sum("n")).scalar()
    return counts.where(F.col("n") * HOT_SHARE > total).select(key)


def semi_join(rows: DataFrame, wanted: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Rows whose key is in ``wanted``.

    Rows of hot keys stay where they are (broadcast side of at most HOT_SHARE
    rows); only the others, with few rows per key, are shuffled.
    """
    wanted = wanted.select(key)
    wanted_hot = wanted.join(F.broadcast(hot), key, "left_semi")
    direct = rows.join(F.broadcast(wanted_hot), key, "left_semi")
    shuffled = rows.join(F.broadcast(hot), key, "left_anti").join(wanted, key, "left_semi")
    return direct.unionByName(shuffled)


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """At most so many rows, with at most BROADCAST_BYTES of text and other variable-length values."""
    wide = [f.name for f in table.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))]
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in wide), F.lit(0))
    found = table.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found["n"] <= rows and found["bytes"] <= BROADCAST_BYTES


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a table of unique keys: by broadcast if it is small, else hot keys apart."""
    if is_small(table):
        return rows.join(F.broadcast(table), key, "left")
    hot = hot_keys(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")), key)
    table_hot = table.join(F.broadcast(hot), key, "left_semi")
    unkeyed = rows.where(F.col(key).isNull()).join(F.broadcast(table_hot), key, "left")
    keyed = rows.where(F.col(key).isNotNull())
    direct = keyed.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(table_hot), key, "left")
    shuffled = keyed.join(F.broadcast(hot), key, "left_anti").join(table, key, "left")
    return direct.unionByName(shuffled).unionByName(unkeyed)
