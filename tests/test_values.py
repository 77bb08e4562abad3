import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions import dates
from siftframe.functions.values import float_text, raw_text, show_cell, shown_text, slug, strip, try_num


def column(spark, values, dtype):
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", dtype)]))


def test_numbers_in_text(spark):
    cases = {
        "5": 5.0, " 7.5 ": 7.5, "1e5": 1e5, "+5": 5.0, ".5": 0.5, "5.": 5.0, "-3": -3.0, "inf": math.inf, "-Infinity": -math.inf,
        "1_000": None, "0x1A": None, "1,000": None, "$5": None, "12d": None, "12f": None, "nan": None, "": None, "abc": None, None: None,
    }
    df = column(spark, cases, T.StringType())
    got = {r["v"]: r["x"] for r in df.select("v", try_num(F.col("v"), T.StringType()).alias("x")).collect()}
    assert got == cases


def test_nan_is_missing(spark):
    df = column(spark, [1.0, float("nan"), None], T.DoubleType())
    assert [r[0] for r in df.select(try_num(F.col("v"), T.DoubleType())).collect()] == [1.0, None, None]
    assert [r[0] for r in df.select(raw_text(F.col("v"), T.DoubleType())).collect()] == ["1.0", None, None]


def test_strip_is_python_strip(spark):
    values = ["  a b ", "\t x ", " y　\n", "", " ", "z\x1f"]
    df = column(spark, values, T.StringType())
    assert [r[0] for r in df.select(strip(F.col("v"))).collect()] == [v.strip() for v in values]


def test_doubles_print_as_in_python(spark):
    values = [0.0, 1.5, -2.0, 1e7, 123456789.125, -1e15, 1e16, 1.5e17, 1e-3, 1e-4, 1.25e-4, 1e-5, 2.5e-7, 1e300, float("inf"), -1e22]
    df = column(spark, values, T.DoubleType())
    rows = df.select("v", float_text(F.col("v").cast("string")).alias("t"), F.col("v").cast("string").alias("raw")).collect()
    assert [r["t"] for r in rows] == [repr(v) for v in values]
    assert [shown_text(r["raw"], T.DoubleType()) for r in rows] == [repr(v) for v in values]


def test_cells_print_as_in_python(spark):
    df = spark.sql("select true b, timestamp'2024-01-01 00:00:07.1795' t, timestamp'2024-01-01' d, array(1,2) a")
    row = df.select(*[show_cell(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first()
    assert tuple(row) == ("True", "2024-01-01 00:00:07.179500", "2024-01-01 00:00:00", "[1,2]")


def test_slug(spark):
    df = column(spark, ["A  b-C", "__x__", "ä (1)", "%%"], T.StringType())
    assert [r[0] for r in df.select(slug(F.col("v"))).collect()] == ["a_b_c", "x", "ä_1", ""]


@pytest.mark.parametrize(
    "value,fmt",
    [
        ("2026-01-15", "%Y-%m-%d"), ("16/01/2026", "%d/%m/%Y"), ("01/02/2026", "%m/%d/%Y"), ("2026/01/17", "%Y/%m/%d"),
        ("Jan 20, 2026", "%b %d, %Y"), ("20260115", "%Y%m%d"), ("2026-01-15 10:11:12", "%Y-%m-%d %H:%M:%S"), ("soon", None),
    ],
)
def test_format_of_first_value(value, fmt):
    assert dates.guess_format(value) == fmt


def test_dates_parse_by_format(spark):
    df = column(spark, ["2026-1-5", "2026-01-05", "05/01/2026", "Jan 5, 2026", "x", None], T.StringType())
    iso = [str(r[0]) for r in df.select(dates.parse_date(F.col("v"), ["%Y-%m-%d"])).collect()]
    assert iso == ["2026-01-05 00:00:00", "2026-01-05 00:00:00", "None", "None", "None", "None"]
    free = df.select(F.count(dates.parse_like_first(F.col("v"), "soon"))).first()[0]
    assert free == 4


def test_format_translation():
    assert dates.java_format("%d.%m.%Y %H:%M") == "d.M.yyyy H:m"
    assert dates.java_format("%YT%m") == "yyyy'T'M"
    with pytest.raises(ValueError):
        dates.java_format("%Q")


def test_date_forms(spark):
    cases = [
        ("01/02/85", "%m/%d/%y", "1985-01-02 00:00:00"),
        ("01/02/68", "%m/%d/%y", "2068-01-02 00:00:00"),
        ("20260630 10:00:00", "%Y%m%d %H:%M:%S", "2026-06-30 10:00:00"),
        ("2026-06-30T10:00:00Z", "%Y-%m-%dT%H:%M:%S%z", "2026-06-30 10:00:00"),
        ("2026-06-30T10:00:00+02:00", "%Y-%m-%dT%H:%M:%S%z", "2026-06-30 08:00:00"),
        ("2026-06-30 10:00:00-0130", "%Y-%m-%d %H:%M:%S%z", "2026-06-30 11:30:00"),
    ]
    for text, fmt, want in cases:
        assert dates.guess_format(text) == fmt
        df = spark.createDataFrame([(text,)], "v string")
        assert str(df.select(dates.parse_date(F.col("v"), [fmt])).first()[0]) == want
    # a first value that is no date does not hide the time of the others
    df = spark.createDataFrame([("2026-07-01 10:00:00",)], "v string")
    assert str(df.select(dates.parse_like_first(F.col("v"), "soon")).first()[0]) == "2026-07-01 10:00:00"
    assert not dates.readable("%Q") and dates.readable("%Y")


def test_no_text_meets_more_than_three_parsers():
    assert max(map(len, dates.FORMATS_BY_SHAPE.values())) <= 3
    for fmt in (d + t for d in dates.DATE_FORMATS for t in dates.TIME_SUFFIXES):
        assert any(fmt in known for known in dates.FORMATS_BY_SHAPE.values())
    assert "Y-d-d" in dates.HINTED_SHAPES and "d @ Y" not in dates.HINTED_SHAPES


def test_shapes_lose_no_date(spark):
    """Reading by shape equals trying every format in order."""
    texts = [
        "2026-1-5", "2026/01/05", "20260105", "1/2/2026", "13/2/2026", "1-2-26", "25-12-2026", "12/25/85", "Jan 5, 2026", "January 5, 2026", "5 Jan 2026",
        "2026-01-05 10:11:12", "2026-01-05T10:11", "2026-01-05T10:11:12.123456", "2026-01-05 10:11:12.5", "2026-01-05 10:11:12Z", "2026-01-05T10:11:12.123456+02:00",
        "2026-01-05 10:11:12+0200", "2026-13-45", "tomorrow", "", "12", "123456789", "2026-01-05 and a long remark that no date would ever carry with it", "@", None,
    ]
    df = column(spark, texts, T.StringType())
    every = dates.parse_date(F.col("v"), [d + t for d in dates.DATE_FORMATS for t in dates.TIME_SUFFIXES])
    rows = df.select("v", every.alias("a"), dates.parse_by_shape(F.col("v")).alias("b"), dates.shape(F.col("v")).alias("s")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and sum(r["b"] is not None for r in rows) >= 16
    assert all(r["s"] == dates.text_shape(r["v"]) for r in rows if r["v"] is not None and len(r["v"]) <= dates.LONGEST_DATE)
