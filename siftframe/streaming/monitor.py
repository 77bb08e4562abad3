"""Checks on a stream: row-level rules, repeated values by keyed state, bounds frozen from a profile."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftframe.functions.values import col, digested, dtype_of, is_missing, is_text, raw_text, show_cell, shown, try_num
from siftframe.operators.anomaly import outlier_bounds
from siftframe.operators.profile import ColumnProfile
from siftframe.operators.rowid import ROW_INDEX
from siftframe.operators.rules import FAILURE_COLUMNS, failure_log, make_rules


def stream_failures(stream: DataFrame, definitions: list[dict], row_id: str = ROW_INDEX) -> DataFrame:
    """Failure log of a stream; rules that look at all rows (``unique``) are refused, see :func:`stream_repeats`."""
    rules, _ = make_rules(definitions)
    if any(r.row_check is None for r in rules):
        raise ValueError("unique needs the rows before: use stream_repeats")
    return failure_log(stream, rules, row_id).select(*FAILURE_COLUMNS)


def stream_repeats(stream: DataFrame, column: str, row_id: str = ROW_INDEX, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Failure log of the ``unique`` rule on a stream: every row of a value that occurs more than once.

    The state of a value is its first row, until a second one comes and both are reported, and
    whether that has happened. With a ``time`` column, rows later than the watermark of ``delay`` are
    dropped and a value is forgotten when the watermark passes its last row by ``delay``; repeats
    farther apart are then two first rows. Without one, state grows with the number of distinct values.
    """
    dtype = dtype_of(stream, column)
    text = raw_text(col(column), dtype)
    if time:
        stream = stream.withWatermark(time, delay)
    key = digested(text) if is_text(dtype) else text
    when = [col(time).alias("time")] if time else []
    rows = stream.where(text.isNotNull()).select(key.alias("key"), text.alias("value"), col(row_id).cast("long").alias("row_index"), *when)
    hold = pd.Timedelta(delay) // pd.Timedelta(milliseconds=1)

    def repeats(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, reported, latest = state.get if state.exists else (None, False, 0)
        for batch in batches:
            found = batch[["row_index", "value"]]
            if time and len(batch):
                latest = max(latest, int(batch["time"].max().timestamp() * 1000))
            if first is None and len(found):
                first, found = int(found["row_index"].iloc[0]), found.iloc[1:]
            if len(found):
                if not reported:
                    yield pd.DataFrame({"row_index": [first], "value": [found["value"].iloc[0]]})
                    reported = True
                yield found
        state.update((first, reported, latest))
        if time:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + hold)

    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    found = rows.groupBy("key").applyInPandasWithState(
        repeats, "row_index long, value string", "first long, reported boolean, latest long", "append", timeout
    )
    value = shown(F.col("value"), dtype)
    message = F.concat(F.lit("Duplicate value '"), value, F.lit("' in row "), F.col("row_index").cast("string"), F.lit("."))
    return found.select(F.lit(column).alias("column"), "row_index", value.alias("value"), F.lit("unique").alias("rule"), message.alias("message"))


# --- bounds frozen from a profile ---------------------------------------------

BOUNDS_SCHEMA = "column string, low double, high double, allowed array<string>"


def freeze_bounds(spark: SparkSession, prof: list[ColumnProfile], path: str, version: int) -> None:
    """Write outlier bounds of numeric and the values of categorical columns as a new version of a table.

    A version is never written twice, so what a running stream has read does not change.
    """
    rows = []
    for p in prof:
        if p.inferred_type == "numeric":
            b = outlier_bounds(p.q1, p.q3, p.mean, p.std)
            low, high = (b.low, b.high) if b.center is None else (b.center - b.reach, b.center + b.reach)
            rows.append((p.column, low, high, None))
        elif p.inferred_type == "categorical" and p.values:
            rows.append((p.column, None, None, list(p.values)))
    spark.createDataFrame(rows, BOUNDS_SCHEMA).write.parquet(f"{path}/version={version}")


def stream_anomalies(stream: DataFrame, path: str, version: int, row_id: str = ROW_INDEX) -> DataFrame:
    """Outliers and values unseen before in a stream, by one version of frozen bounds (a stream-static join).

    Columns are those of the anomaly log; ``type`` is ``outlier`` or ``unseen_value``. Bounds have one row per
    column of the profiled table; columns that the stream lacks, or the bounds, are left alone.
    """
    bounds = stream.sparkSession.read.schema(BOUNDS_SCHEMA).parquet(f"{path}/version={version}")
    cells = []
    for c in (c for c in stream.columns if c != row_id):
        dtype = dtype_of(stream, c)
        cells.append(F.struct(F.lit(c).alias("column"), try_num(col(c), dtype).alias("number"), show_cell(col(c), dtype).alias("value")))
    long = stream.select(col(row_id).cast("long").alias("row_index"), F.explode(F.array(*cells)).alias("c")).select("row_index", "c.*")
    joined = long.where("value IS NOT NULL").join(F.broadcast(bounds), "column")
    outlier = (F.col("number") < F.col("low")) | (F.col("number") > F.col("high"))
    unseen = ~F.array_contains("allowed", F.col("value"))
    kind = F.when(outlier, "outlier").when(unseen, "unseen_value")
    row = F.col("row_index").cast("string")
    message = F.when(outlier, F.concat(F.lit("Numerical outlier detected in row "), row, F.lit(": "), F.col("value"))).otherwise(
        F.concat(F.lit("Value '"), F.col("value"), F.lit("' was not seen before, in row "), row, F.lit("."))
    )
    return joined.select("column", "row_index", "value", kind.alias("type"), message.alias("message")).where("type IS NOT NULL")


def window_metrics(
    stream: DataFrame, time: str, column: str, definitions: list[dict], width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """(window_start, rows, missing, failures) per tumbling window, with a watermark of ``delay``."""
    rules, _ = make_rules([d for d in definitions if d["column"] == column])
    dtype = dtype_of(stream, column)
    failing = F.lit(0)
    for r in rules:
        test = r.row_check(col(column), dtype, F.lit("")).fails
        failing = failing + F.when(test, 1).otherwise(0)
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(col(time), width).alias("w"))
        .agg(
            F.count("*").alias("rows"),
            F.count_if(is_missing(col(column), dtype)).alias("missing"),
            F.sum(failing).alias("failures"),
        )
        .select(F.col("w.start").alias("window_start"), "rows", "missing", "failures")
    )


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available now to a Parquet table, then stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what every batch changed, under the batch's number, then stop when nothing is left.

    A batch that runs again replaces what it wrote. Windows that the watermark has not closed are
    written too, so nothing is missing when a bounded input ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
    return writer.trigger(availableNow=True).start()


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row written for each key by :func:`write_updates`."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))
