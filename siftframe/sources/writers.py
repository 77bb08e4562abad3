"""Writing tables and reports; every sink writes one file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.functions.values import col, fresh
from siftframe.operators.rowid import data_columns


def _data(df: DataFrame) -> DataFrame:
    """Without the row number, which is not part of the data."""
    return df.select(*[col(c) for c in data_columns(df)])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 with header; quotes inside cells are doubled."""
    (
        _data(df)
        .write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "utf-8")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per line; nulls are kept."""
    _data(df).write.mode(mode).option("ignoreNullFields", False).json(path)


DOCUMENT_ROWS = 10_000


def _documents(df: DataFrame, rows: int) -> tuple[DataFrame, str, str]:
    """The data with a document - up to so many rows of a task - and the row's place in it, and their names."""
    data = _data(df)
    mid, document, place = fresh(data, "_mid", "_document", "_place")
    at = F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    cut = F.struct(F.shiftright(mid, 33).alias("task"), F.floor(at / rows).alias("part"))
    numbered = data.withColumn(mid, F.monotonically_increasing_id())
    return numbered.select(*[col(c) for c in data.columns], cut.alias(document), (at % rows).alias(place)), document, place


def write_json_array(df: DataFrame, path: str, mode: str = "errorifexists", rows: int = DOCUMENT_ROWS) -> None:
    """Files that each hold an array of up to ``rows`` records; nulls are kept."""
    numbered, document, place = _documents(df, rows)
    record = F.struct(*[col(c) for c in data_columns(df)]).alias("record")
    lists = numbered.groupBy(document).agg(F.sort_array(F.collect_list(F.struct(col(place).alias("place"), record))).alias("rows"))
    texts = lists.select(F.to_json(F.col("rows.record"), {"ignoreNullFields": "false"}).alias("value"))
    texts.write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def write_json_columns(df: DataFrame, path: str, mode: str = "errorifexists", rows: int = DOCUMENT_ROWS) -> None:
    """Files that each hold {column: {row: value}} of up to ``rows`` rows; nulls are kept."""
    numbered, document, place = _documents(df, rows)
    # one list of whole rows, from which the columns are told apart once it is complete
    rows_of = numbered.groupBy(document).agg(F.collect_list(F.struct(col(place).cast("string").alias("place"), *[col(c).alias(f"c{i}") for i, c in enumerate(data_columns(df))])).alias("rows"))
    maps = [F.map_from_arrays("rows.place", f"rows.c{i}").alias(c) for i, c in enumerate(data_columns(df))]
    whole = rows_of.select(F.struct(*maps).alias("columns"))
    texts = whole.select(F.to_json("columns", {"ignoreNullFields": "false"}).alias("value"))
    texts.write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The one-row report document as text."""
    report.select("report").write.mode(mode).text(path)


def write_log(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A failure or anomaly log as its own table."""
    log.write.mode(mode).parquet(path)
