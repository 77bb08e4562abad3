import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.values import number_of_text, try_num
from siftframe.operators import anomaly as A
from siftframe.operators import profile as P
from siftframe.operators import quantiles
from siftframe.operators.quantiles import exact_quantiles
from siftframe.operators.rowid import preview, renumber, with_row_index
from siftframe.operators.rules import suggest_rules
from siftframe.plans.profiling import profile_report


def kinds(spark, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_index bigint, v {dtype}")
    return P.profile(df)[0].inferred_type


def test_messy_table(messy):
    report = profile_report(messy)
    types = {p.column: p.inferred_type for p in report.columns}
    assert types == {
        "Cust ID": "categorical", "Cust Name": "categorical", "Eml": "categorical", "Ctn Wgt": "categorical",
        "Material": "categorical", "Txn Amt": "numeric", "Dt Joined": "categorical",
    }
    amount = next(p for p in report.columns if p.column == "Txn Amt")
    assert (amount.q1, amount.median, amount.q3) == (10.625, 13.25, 14.25)
    assert report.summary == {
        "row_count": 8, "column_count": 7, "total_cells": 56, "missing_cells": 3, "missing_pct": 5.36, "quality_score": 90.36,
    }
    log = [(r["column"], r["row_index"], r["value"]) for r in report.anomalies(numbered=True).orderBy("anomaly_id").collect()]
    assert log == [("Txn Amt", 4, "9000.0"), ("Txn Amt", 7, "-40.0")]
    rules = suggest_rules(report.columns)
    assert sorted(r["type"] for r in rules) == ["in_set"] * 6 + ["non_null"] * 4 + ["range"]


@pytest.mark.parametrize(
    "values,dtype,expected",
    [
        ([None, None], "string", "empty"),
        (["Yes", "no", None], "string", "boolean"),
        ([" yes", "no"], "string", "categorical"),
        ([1, 1, 1], "bigint", "boolean"),
        ([1.0, 0.0], "double", "boolean"),
        ([True, True], "boolean", "boolean"),
        ([1, 2, 3], "bigint", "numeric"),
        ([str(i) for i in range(10)] + ["x"], "string", "numeric"),
        ([str(i) for i in range(9)] + ["x"], "string", "categorical"),
        ([f"2026-01-{i:02d}" for i in range(1, 20)], "string", "datetime"),
        ([f"2026-01-{i:02d}" for i in range(1, 9)] + ["soon"] * 2, "string", "categorical"),
        ([f"name {i}" for i in range(16)], "string", "text"),
        ([f"name {i % 16}" for i in range(200)], "string", "categorical"),
        ([f"name {i % 100}" for i in range(2000)], "string", "text"),
    ],
)
def test_semantic_types(spark, values, dtype, expected):
    assert kinds(spark, values, dtype) == expected


def test_nested_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [1, 2])], "row_index bigint, v array<int>")
    p = P.profile(df)[0]
    assert (p.inferred_type, p.unique_count, p.sample_values) == ("categorical", 1, ["[1,2]", "[1,2]"])
    empty = profile_report(df.where("false"))
    assert empty.summary["quality_score"] == 0.0 and empty.summary["total_cells"] == 0
    assert empty.anomalies().count() == 0


def test_samples_of_sparse_columns(spark):
    """Values that appear late need more than the first stretch of rows."""
    df = spark.range(5000).select(
        F.col("id").alias("row_index"),
        F.when(F.col("id") >= 3000, F.col("id")).alias("late"),
        F.when(F.col("id") == 4999, F.lit("z")).alias("once"),
        F.col("id").alias("every"),
    )
    rows = P.sample_values(df).orderBy("column", "position").collect()
    got = {}
    for r in rows:
        got.setdefault(r["column"], []).append(r["value"])
    assert got == {"every": list("01234"), "late": [str(3000 + i) for i in range(5)], "once": ["z"]}


def test_top_values_tie_by_first_seen_and_long_text(spark):
    long_a, long_b = "a" * 500, "a" * 499 + "b"
    values = ["z", long_b, long_a, long_a, "y", "y", None]
    df = spark.createDataFrame(list(enumerate(values)), "row_index bigint, v string")
    top = [(r["value"], r["count"]) for r in P.top_values(df).orderBy("rank").collect()]
    assert top == [(long_a, 2), ("y", 2), ("z", 1), (long_b, 1)]
    assert [t["value"] for t in P.profile(df)[0].top_values] == [long_a, "y", "z", long_b]


@pytest.mark.parametrize("limit", [1, 100, 100000])
def test_exact_quantiles(spark, limit):
    rng = random.Random(5)
    data = {
        "normal": [rng.gauss(0, 1) for _ in range(3000)],
        "skewed": [10.0 ** rng.randint(-300, 300) for _ in range(3000)],
        "hot": [7.0] * 2000 + [float(i) for i in range(1000)],
        "few": [float(rng.randint(0, 3)) for _ in range(3000)],
        "infinite": [float("inf")] * 800 + [float("-inf")] * 100 + [rng.random() for _ in range(2100)],
        "sparse": [None] * 2900 + [float(i) for i in range(100)],
        "none": [None] * 3000,
    }
    df = spark.createDataFrame(pd.DataFrame(data).astype(object).where(lambda d: d.notnull(), None), ", ".join(f"{c} double" for c in data))
    got = exact_quantiles(df.repartition(5), {c: F.col(c) for c in data}, [0, 0.25, 0.5, 0.75, 1], limit)
    assert "none" not in got
    for c, q in got.items():
        if c == "infinite":
            inner = np.quantile(np.clip(np.array(data[c]), -1e308, 1e308), [0.25, 0.5])
            assert np.allclose(q[1:3], inner) and q[0] == float("-inf") and q[3:] == [float("inf")] * 2
        else:
            assert np.allclose(q, pd.Series(data[c], dtype=float).quantile([0, 0.25, 0.5, 0.75, 1]), rtol=1e-12), c


def test_quantiles_take_two_scans_at_most(spark, monkeypatch):
    """One pass for extents and sketches, then one over brackets, and a second only if these hold too many values."""
    from siftframe.operators import quantiles as Q

    scans, long = [], Q._long
    monkeypatch.setattr(Q, "_long", lambda df, parts: scans.append(len(parts)) or long(df, parts))
    df = spark.range(200_000).select(
        F.exp(F.randn(3) * 8).alias("skewed"), F.floor(F.rand(4) * 5).cast("double").alias("few"),
        F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.rand(5) * 3).alias("hot"), (F.col("id") * 1.0).alias("even"),
    )
    data = df.toPandas()
    for limit, most in ((50_000, 1), (300, 2)):
        scans.clear()
        got = exact_quantiles(df, {c: F.col(c) for c in df.columns}, [0.25, 0.5, 0.75], limit)
        assert len(scans) <= most
        assert all(np.allclose(got[c], data[c].quantile([0.25, 0.5, 0.75]), rtol=1e-12) for c in df.columns)


def test_a_wrong_sketch_is_noticed(spark):
    from siftframe.operators.quantiles import Extent

    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    for marks in ((600.0, 610.0), (10.0, 20.0), (499.0, 499.0)):
        got = exact_quantiles(df, {"x": F.col("x")}, [0.5], 50, {"x": Extent(1000, 0.0, 999.0, marks)})
        assert got == {"x": [499.5]}


def test_observed_facts_give_the_same_profile(spark):
    rows = [(i, None if i % 7 == 0 else i / 3, f"{i % 50}.5" if i % 11 else "n.a.", f"2026-01-{i % 28 + 1:02d}", None) for i in range(500)]
    df = spark.createDataFrame(rows, "row_index long, x double, t string, d string, nothing double").withColumn("when", F.to_timestamp("d"))
    table, facts = P.written_with_facts(df, "facts")
    got, want = P.profile(table, facts=facts), P.profile(df)
    for a, b in zip(got, want):
        # sums depend on the order of the tasks in their last digits
        assert (a.mean, a.std) == pytest.approx((b.mean, b.std)) if b.mean is not None else (a.mean, a.std) == (None, None)
        a.mean, a.std = b.mean, b.std
    assert got == want
    empty, none = P.written_with_facts(df.limit(0), "facts")
    assert P.profile(empty, facts=none) == P.profile(df.limit(0))


def test_outlier_rules():
    assert A.outlier_bounds(1, 3, 2, 1) == A.OutlierBounds(-2.0, 6.0)
    assert A.outlier_bounds(5, 5, 5.5, 2.0) == A.OutlierBounds(center=5.5, reach=6.0)
    assert A.outlier_bounds(5, 5, 5.0, 0.0) == A.OutlierBounds()
    assert A.outlier_bounds(None, None, None, None) == A.OutlierBounds()


def test_rare_values_guards(spark):
    def rare(values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return {r["value"] for r in A.rare_categories(df, "v").collect()}

    assert rare(["a"] * 200 + ["b"]) == {"b"}
    assert rare(["a"] * 18 + ["b"]) == set()
    assert rare([f"v{i}" for i in range(150)]) == set()


def test_format_checks(spark):
    assert A.format_pattern("Contact_EMAIL")[0] == "email"
    assert A.format_pattern("hotel")[0] == "phone"
    assert A.format_pattern("Eml") is None
    good = ["+1 555-123-4567", "(555) 123 4567", "5551234567", "", None]
    bad = ["555-12-4567", "phone"]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    flagged = df.where(A.malformed(F.col("v"), df.schema["v"].dataType, A.PHONE_PATTERN))
    assert [r[0] for r in flagged.collect()] == bad


def test_capped_log_is_part_of_the_uncapped_one(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_index"), F.when(F.col("id") % 20 == 0, 1e6 + F.col("id")).otherwise(F.col("id") % 10).alias("v")
    )
    report = profile_report(df)
    every = {(r["row_index"], r["message"]) for r in report.anomalies().collect()}
    logged = report.anomalies(capped=True).collect()
    rows = {(r["row_index"], r["message"]) for r in logged if r["row_index"] is not None}
    assert len(every) == 150 and len(rows) == 50 and rows <= every
    assert [r["value"] for r in logged if r["row_index"] is None] == ["150 outliers"]
    assert report.summary["quality_score"] == round(100 - 30 * 150 / 3000, 2)
    assert profile_report(df, uncapped=False).summary["quality_score"] == round(100 - 30 * 51 / 3000, 2)
    numbered = report.anomalies(numbered=True).orderBy("anomaly_id").collect()
    assert [r["anomaly_id"] for r in numbered] == list(range(1, 151))
    assert [r["row_index"] for r in numbered] == sorted(r["row_index"] for r in numbered)


@pytest.mark.parametrize("partitions", [1, 3, 11])
def test_row_index(spark, partitions):
    df = spark.range(0, 2000, 1, partitions).select((F.col("id") * 7919 % 2000).alias("k"), (F.col("id") % 3).alias("g"))
    by_input = with_row_index(df).orderBy("row_index").collect()
    assert [r["row_index"] for r in by_input] == list(range(2000))
    assert [r["k"] for r in by_input] == [i * 7919 % 2000 for i in range(2000)]
    by_key = with_row_index(df, ["g", "k"]).orderBy("row_index").collect()
    assert [(r["g"], r["k"]) for r in by_key] == sorted((r["g"], r["k"]) for r in by_input)
    # one key value for a third of the rows: ties keep input order
    tied = with_row_index(df, "g").where("g = 0").orderBy("row_index").collect()
    assert [r["k"] for r in tied] == [r["k"] for r in by_input if r["g"] == 0]
    closed = renumber(df.select((F.col("k") * 1_000_003 - 5_000_000).alias("row_index"), "k"))
    assert sorted((r["row_index"], r["k"]) for r in closed.collect()) == [(i, i) for i in range(2000)]
    assert [r["k"] for r in preview(closed, 3).collect()] == [0, 1, 2]


def test_row_index_over_files_of_unequal_size(spark, tmp_path):
    sizes = {"a": 3, "b": 5000, "c": 40}
    for name, n in sizes.items():
        with open(tmp_path / f"{name}.csv", "w") as f:
            f.write("v\n" + "".join(f"{name}{k}\n" for k in range(n)))
    rows = with_row_index(spark.read.option("header", True).csv(str(tmp_path))).orderBy("row_index").collect()
    assert [r["v"] for r in rows] == [f"{name}{k}" for name, n in sizes.items() for k in range(n)]
    assert [r["row_index"] for r in rows] == list(range(len(rows)))


def test_row_index_of_sparse_and_repeated_keys(spark):
    df = spark.range(1000).select((F.col("id") * (1 << 30)).alias("k"))
    got = with_row_index(df, "k", unique_integer=True)
    assert [(r["k"], r["row_index"]) for r in got.orderBy("k").collect()] == [(i << 30, i) for i in range(1000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("5",), ("5",), ("x",)], "v string")
    assert [tuple(r) for r in P.histogram(df, "v").collect()] == [(1, 5.0, 5.0, 2)]


def test_values_outside_of_brackets_are_only_counted(spark, monkeypatch):
    made, plain = [], quantiles._long
    monkeypatch.setattr(quantiles, "_long", lambda df, parts: made.append((rows := plain(df, parts)).count()) or rows)
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).cast("double").alias("x"))
    got = exact_quantiles(df, {"x": F.col("x")}, [0.25, 0.5, 0.75], 1000)
    assert got == {"x": [14999.75, 29999.5, 44999.25]}
    assert sum(made) < 6000  # all rows for every bracket before


def test_columns_of_few_numbers_are_not_read_again(spark, monkeypatch):
    read, plain = [], P._number_stats
    monkeypatch.setattr(P, "_number_stats", lambda df, numbers, *a: read.append(sorted(numbers)) or plain(df, numbers, *a))
    cells = [(i, float(i % 7) - 2.5, str(i % 3) if i % 50 else "?", i * 0.5, None if i % 2 else -0.0) for i in range(1000)]
    df = spark.createDataFrame(cells, "row_index long, few double, words string, many double, zero double")
    found = {p.column: p for p in P.profile(df)}
    assert read == [["many"]]
    for c, values in (("few", [r[1] for r in cells]), ("words", [float(r[2]) for r in cells if r[2] != "?"]), ("many", [r[3] for r in cells])):
        p = found[c]
        assert p.inferred_type == "numeric"
        assert (p.min, p.max) == (min(values), max(values))
        assert (p.mean, p.std) == pytest.approx((statistics.fmean(values), statistics.stdev(values)), rel=1e-12)
        assert (p.q1, p.median, p.q3) == pytest.approx(statistics.quantiles(values, n=4, method="inclusive"), rel=1e-12)


def test_numbers_of_texts_on_the_driver(spark):
    texts = ["1", " 2.5e3 ", "-Infinity", "inf", "1_0", "abc", "", "1.\n", ".5", "+7", "12d", "1\x85", "1\u2028", "\u30001", "\xa01", "NaN", "\u0661", "1e400", "- 1", "1\r\n", "\x1c1", "\n", "1\n\x85"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", try_num(F.col("t"), T.StringType()).alias("x"))
    assert {r["t"]: r["x"] for r in df.collect()} == {t: number_of_text(t) for t in texts}


def test_log_makes_records_of_flagged_rows_only(spark):
    cells = [(i, float(i % 10) if i != 7 else 500.0, float(i) if i != 8 else 1e6, None if i % 3 else 1.0) for i in range(200)]
    df = spark.createDataFrame(cells, "row_index long, a double, b double, gaps double")
    prof = P.profile(df)
    flagged = A._flagged(df, prof, A.anomaly_checks(df, prof), "row_index")
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate"):].partition("Filter")[2]
    assert " > 14.5" in below  # the bound of column a, before records are made
    assert sorted((r["row_index"], r["ordinal"], r["raw"]) for r in flagged.collect()) == [(7, 0, "500.0"), (8, 1, "1000000.0")]
