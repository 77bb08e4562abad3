"""Streams over several batches: repeated values by state, bounds frozen beforehand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftframe.operators.profile import profile
from siftframe.streaming.monitor import freeze_bounds, stream_anomalies, stream_repeats, write_available


def batches(spark, folder, tables, schema):
    """A stream whose batches are the tables, one file each."""
    for k, rows in enumerate(tables):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def run(spark, stream, folder):
    write_available(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def test_repeats_over_batches(spark, tmp_path):
    tables = [[(0, "a"), (1, "b"), (2, None), (3, "x" * 100)], [(4, "a"), (5, "c"), (6, None)], [(7, "a"), (8, "b"), (9, "d"), (10, "x" * 100), (11, "")]]
    stream = stream_repeats(batches(spark, tmp_path, tables, "row_index long, v string"), "v")
    got = run(spark, stream, tmp_path)
    assert sorted((r["row_index"], r["value"]) for r in got) == [(0, "a"), (1, "b"), (3, "x" * 100), (4, "a"), (7, "a"), (8, "b"), (10, "x" * 100)]
    assert {r["message"] for r in got if r["row_index"] == 8} == {"Duplicate value 'b' in row 8."}


def test_values_are_forgotten_behind_the_watermark(spark, tmp_path):
    at = lambda hours: dt.datetime(2026, 1, 1) + dt.timedelta(hours=hours)
    tables = [[(0, 5, at(0)), (1, 6, at(0))], [(2, 5, at(0.5))], [(3, 7, at(50))], [(4, 7, at(50)), (5, 8, at(51))], [(6, 6, at(52)), (7, 5, at(53))]]
    stream = batches(spark, tmp_path, tables, "row_index long, v int, ts timestamp")
    got = run(spark, stream_repeats(stream, "v", time="ts", delay="1 hour"), tmp_path)
    assert sorted(r["row_index"] for r in got) == [0, 2, 3, 4]


def test_a_later_version_changes_nothing(spark, tmp_path):
    old = spark.createDataFrame([(i, float(i % 10), "ab"[i % 2]) for i in range(100)], "row_index long, x double, k string")
    freeze_bounds(spark, profile(old), f"{tmp_path}/bounds", 1)
    stream = batches(spark, tmp_path, [[(0, 5.0, "a"), (1, 99.0, "c")], [(2, None, None), (3, -99.0, "b")]], "row_index long, x double, k string")
    found = stream_anomalies(stream, f"{tmp_path}/bounds", 1)
    freeze_bounds(spark, profile(old.withColumn("x", F.col("x") * 1000)), f"{tmp_path}/bounds", 2)
    got = run(spark, found, tmp_path)
    assert sorted((r["row_index"], r["column"], r["type"], r["value"]) for r in got) == [(1, "k", "unseen_value", "c"), (1, "x", "outlier", "99.0"), (3, "x", "outlier", "-99.0")]
    with pytest.raises(Exception, match="(?i)exist"):
        freeze_bounds(spark, profile(old), f"{tmp_path}/bounds", 2)
