import pytest
from pyspark.sql import functions as F

from siftframe.operators import rules as R
from siftframe.operators.joins import hot_keys, semi_join
from siftframe.plans.reporting import quality_report
from siftframe.streaming.monitor import stream_failures


def failing(spark, values, rule, dtype="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"row_index bigint, v {dtype}")
    return [(r["row_index"], r["message"]) for r in R.failure_log(df, [rule]).orderBy("row_index").collect()]


def rows(*args, **kw):
    return [i for i, _ in failing(*args, **kw)]


def test_non_null(spark):
    assert rows(spark, ["Ana", "", None, " "], R.non_null("v")) == [1, 2]
    assert rows(spark, [1.0, float("nan"), None], R.non_null("v"), "double") == [1, 2]


def test_range(spark):
    rule = R.value_range("v", 10, 20.5)
    got = failing(spark, ["15", "9.5", "21", "ten", "", None, "20.5", "10"], rule)
    assert got == [
        (1, "Value 9.5 is below minimum allowed (10) in row 1."),
        (2, "Value 21 is above maximum allowed (20.5) in row 2."),
        (3, "Value 'ten' is not numeric in row 3."),
    ]
    assert rows(spark, [1.0, float("nan"), 9.0], R.value_range("v", max_val=5), "double") == [2]
    df = spark.sql("select 0L row_index, timestamp'2024-01-01' v")
    assert R.failure_log(df, [rule]).count() == 1


def test_unique(spark):
    got = failing(spark, [9, 5, 5, 8, None, None], R.unique("v"), "bigint")
    assert got == [(1, "Duplicate value '5' in row 1."), (2, "Duplicate value '5' in row 2.")]
    assert rows(spark, ["", "", "a"], R.unique("v")) == [0, 1]


def test_unique_with_hot_and_cold_values(spark):
    values = ["hot"] * 3000 + [f"v{i // 2}" for i in range(6000)] + [f"w{i}" for i in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "row_index bigint, v string").repartition(7)
    cells = df.select(F.col("v").alias("key"))
    counts = cells.groupBy("key").agg(F.count("*").alias("n"))
    assert [r["key"] for r in hot_keys(counts, "key").collect()] == ["hot"]
    assert semi_join(cells, counts.where("n > 1"), "key", hot_keys(counts, "key")).count() == 9000
    assert sorted(r["row_index"] for r in R.failure_log(df, [R.unique("v")]).collect()) == list(range(9000))


def test_regex(spark):
    rule = R.regex("v", r"\w+@\w+\.org", "org mail")
    assert failing(spark, ["me@home.org", "me at home", "", None], rule) == [
        (1, "Value 'me at home' does not match pattern 'org mail' in row 1.")
    ]
    # only the start is anchored; groups, end marks and Unicode digits as in Python
    assert rows(spark, ["ab1", "xab", "ab"], R.regex("v", r"(?P<x>a)b")) == [1]
    assert rows(spark, ["a\n", "a", "ab"], R.regex("v", r"a\Z")) == [0, 2]
    assert rows(spark, ["a\n", "a", "ab"], R.regex("v", r"a$")) == [2]
    assert rows(spark, ["٣", "3", "x"], R.regex("v", r"\d")) == [2]


def test_in_set(spark):
    rule = R.in_set("v", ["red", " Blue"])
    assert failing(spark, ["Red", "green", " BLUE ", "", None], rule) == [
        (1, "Value 'green' is not in the allowed set ['red', ' Blue'] in row 1.")
    ]
    df = spark.createDataFrame([(0, "A "), (1, "b"), (2, None), (3, "c")], "row_index bigint, v string")
    allowed = spark.createDataFrame([("a",), ("C",)], "x string")
    assert [r["row_index"] for r in R.in_table(df, "v", allowed).collect()] == [1]


def test_three_rules(spark):
    df = spark.createDataFrame(
        [(0, 11, 7, "x@y.org"), (1, 12, 99, "y@z.org"), (2, 12, 8, "nobody")], "row_index bigint, id bigint, size bigint, mail string"
    )
    definitions = [
        {"column": "id", "type": "unique", "params": {}},
        {"column": "size", "type": "range", "params": {"max": 10}},
        {"column": "mail", "type": "regex", "params": {"pattern": r"[^@]+@[^@]+"}},
    ]
    assert R.validate(df, definitions).count() == 4
    log = R.numbered_failures(R.failure_log(df, R.make_rules(definitions)[0])).orderBy("failure_id").collect()
    assert [(r["failure_id"], r["rule"], r["row_index"]) for r in log] == [(1, "unique", 1), (2, "unique", 2), (3, "range", 1), (4, "regex", 2)]


def test_factory_and_skipped(spark):
    with pytest.raises(ValueError):
        R.make_rule({"column": "a", "type": "nope"})
    bad = [{"type": "unique"}, {"column": "a", "type": "nope"}, {"column": "a", "type": "regex", "params": {"pattern": "("}},
           {"column": "a", "type": "regex"}, {"column": "zz", "type": "non_null"}]
    df = spark.createDataFrame([(0, "x")], "row_index bigint, a string")
    assert R.validate(df, bad).count() == 0
    assert [r["position"] for r in R.skipped_rules(df, bad).orderBy("position").collect()] == [0, 1, 2, 3]


def test_custom_rule(spark):
    def check(c, dtype, row):
        return R.Check(F.length(c) > 3, F.concat(F.lit("too long in row "), row))

    rule = R.Rule("v", "short", {}, check)
    assert failing(spark, ["abc", "abcd", None], rule) == [(1, "too long in row 1")]


def test_rule_list_editing():
    rules = R.add_rule([], "a", "non_null")
    rules = R.add_rule(rules, "b", "in_set", {"allowed": R.allowed_from_text("x, y ,,z")})
    assert rules[1]["params"]["allowed"] == ["x", "y", "z"]
    assert R.remove_rule(rules, 1) == rules[1:]
    with pytest.raises(IndexError):
        R.remove_rule(rules, 3)


def test_suggested_set_holds_all_values(spark):
    from siftframe.operators.profile import profile

    df = spark.createDataFrame([(i, f"v{i % 7}") for i in range(70)], "row_index bigint, kind string")
    prof = profile(df)
    allowed = next(r for r in R.suggest_rules(prof) if r["type"] == "in_set")["params"]["allowed"]
    assert allowed == ["v0", "v1", "v2", "v3", "v4", "v5", "v6"]
    few = next(r for r in R.suggest_rules(prof, most=5) if r["type"] == "in_set")["params"]["allowed"]
    assert few == ["v0", "v1", "v2", "v3", "v4"]


def test_report(messy, spark):
    import json

    rules = [{"column": "Eml", "type": "regex", "params": {"pattern": r"\S+@\S+\.\S+", "description": "email"}}]
    report = quality_report("messy.csv", messy, messy.where("row_index <> 6"), rules, timestamp="t")
    doc = json.loads(report.frame().first()["report"])
    assert doc["metadata"]["raw_records"] == 8 and doc["metadata"]["cleaned_records"] == 7
    assert doc["scores"]["original_quality_score"] == "90.36%"
    assert doc["validation_checks"]["failures_count"] == 2 and doc["validation_checks"]["failures"][0]["failures"] == 2
    assert spark.read.parquet(doc["validation_checks"]["failures_log"]).count() == 2
    log = spark.read.parquet(doc["anomalies_log"]).orderBy("anomaly_id")
    assert [(a["anomaly_id"], a["row_index"]) for a in log.collect()] == [(1, 4), (2, 7)]
    assert sum(a["count"] for a in doc["anomalies_remaining"]) == 2


def test_stream_refuses_table_wide_rules(spark):
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("row_index"), "timestamp")
    with pytest.raises(ValueError):
        stream_failures(stream, [{"column": "row_index", "type": "unique"}])
    assert stream_failures(stream, [{"column": "row_index", "type": "non_null"}]).isStreaming


def test_group_names_and_patterns_of_the_jvm(spark):
    df = spark.createDataFrame([(0, "ab-ab"), (1, "ab-cd")], "row_index bigint, v string")
    rule = {"column": "v", "type": "regex", "params": {"pattern": r"(?P<first_part>\w+)-(?P=first_part)"}}
    assert [r["row_index"] for r in R.validate(df, [rule]).collect()] == [1]
    odd = {"column": "v", "type": "regex", "params": {"pattern": r"(a)?(?(1)b|c)"}}
    assert R.validate(df, [odd, rule]).count() == 1
    skipped = R.skipped_rules(df, [odd, rule, {"column": "v", "type": "no such"}]).collect()
    assert [r["position"] for r in skipped] == [0, 2] and "JVM" in skipped[0]["reason"]
