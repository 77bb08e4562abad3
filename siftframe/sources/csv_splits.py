"""CSV records with line breaks in cells, read by as many tasks as a file has splits.

A line break ends a record where the number of quotes before it, from the start of the file on, is
even. So the quotes of every split are counted first; their sums over the splits before tell each split
whether it begins within a cell. With that, every task puts the lines of its splits together to
records by itself; only the pieces of records that cross a border of splits - two per split at most -
are brought together. Quotes in a cell must be doubled and the cell quoted, as usual.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORDS = "file string, block long, line long, piece string, value string"


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, block, value): the lines, with the split they lie in."""
    lines = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _quotes(lines: DataFrame) -> DataFrame:
    """(file, block, inside, odd): whether a split begins within a cell, and whether its file has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    # one row per split
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    return sums.select(
        "file", "block",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        (F.sum("n").over(whole) % 2 == 1).alias("odd"),
        F.count("*").over(whole).alias("splits"),
    )


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records, the rest of a record begun in the split before (`end`), and the beginning of one that goes on (`start`)."""
    at, held, piece, inside, first, n = None, [], "", False, 0, 0
    rows: list[tuple] = []

    def close(kind: str) -> None:
        # a piece that neither begins nor ends in its split only goes on
        if held:
            rows.append((*at, first, kind, "\n".join(held)))
            held.clear()

    for batch in batches:
        for file, block, begins_inside, value in zip(batch["file"], batch["block"], batch["inside"], batch["value"]):
            if (file, block) != at:
                close("start" if piece == "record" else "middle")
                at, n, inside = (file, block), 0, begins_inside
                piece = "end" if inside else "record"
            if not held:
                first = n
            held.append(value)
            n += 1
            if value.count('"') % 2:
                inside = not inside
            if not inside:
                close(piece)
                piece = "record"
        yield pd.DataFrame(rows, columns=["file", "block", "line", "piece", "value"])
        rows = []
    close("start" if piece == "record" else "middle")
    yield pd.DataFrame(rows, columns=["file", "block", "line", "piece", "value"])


def split_records(spark: SparkSession, path: str, encoding: str) -> DataFrame | None:
    """(file, block, line, value): the records with their place; None if no file has several splits, or a file's quotes do not pair."""
    lines = _lines(spark, path, encoding)
    quotes = _quotes(lines).cache()
    try:
        state = quotes.agg(F.max("splits").alias("most"), F.bool_or("odd").alias("odd")).first()
        # one row per split reaches the driver and every task
        known = spark.createDataFrame(quotes.select("file", "block", "inside").collect(), "file string, block long, inside boolean")
    finally:
        quotes.unpersist()
    if (state["most"] or 0) <= 1 or state["odd"]:
        return None
    found = lines.join(F.broadcast(known), ["file", "block"]).select("file", "block", "inside", "value").mapInPandas(_joined, RECORDS)
    # at most two pieces per split
    pieces = found.where("piece <> 'record'")
    order = Window.partitionBy("file").orderBy("block", "line")
    grouped = pieces.withColumn("of", F.sum(F.when(F.col("piece") == "start", 1).otherwise(0)).over(order))
    whole = grouped.groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
    crossing = whole.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["line"].alias("line"), F.array_join("parts.value", "\n").alias("value"))
    return found.where("piece = 'record'").select("file", "block", "line", "value").unionByName(crossing)
