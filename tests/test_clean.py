import pytest
from pyspark.sql import functions as F

from siftframe.operators import clean as C
from siftframe.plans import cleaning as plan


@pytest.mark.parametrize(
    "name,style,expected",
    [
        ("Cust ID", "snake_case", "cust_id"), (" Txn-Amt (%) ", "snake_case", "txnamt"), ("__a  b__", "snake_case", "a_b"),
        ("cust_ID name", "camelCase", "custIdName"), ("", "camelCase", ""), ("a  b-c", "uppercase", "A__BC"),
        ("Cust Id!", "lowercase", "cust_id"), ("cust_ID", "title_case", "Cust Id"), (" x ", None, "x"), (" Keep Me", "other", "Keep Me"),
    ],
)
def test_header_styles(name, style, expected):
    assert C.restyled(name, style) == expected


def test_headers_of_table(messy):
    snake = C.standardize_headers(messy).columns
    assert snake == ["row_index", "cust_id", "cust_name", "eml", "ctn_wgt", "material", "txn_amt", "dt_joined"]
    assert C.without_collisions(["a", "A", "a_2", "a"]) == ["a", "A_2", "a_2_2", "a_3"]


def test_trim_and_idempotence(messy):
    once = C.trim_whitespace(messy)
    assert once.where("row_index = 1").first()["Cust Name"] == "Ben Okoro"
    config = plan.new_config()
    cleaned = C.clean(messy, config)
    assert cleaned.count() == 7
    assert [r["row_index"] for r in cleaned.orderBy("row_index").collect()] == list(range(7))
    again = C.clean(cleaned, config)
    assert sorted(map(str, again.collect())) == sorted(map(str, cleaned.collect()))


def test_duplicates(spark, messy):
    kept = C.drop_duplicates(messy, ["Material"])
    assert sorted(r["row_index"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    with pytest.raises(KeyError):
        C.drop_duplicates(messy, ["nope"])
    df = spark.createDataFrame([(0, None, 1.0), (1, None, 1.0), (2, "a", float("nan")), (3, "a", float("nan"))], "row_index bigint, a string, b double")
    assert sorted(r["row_index"] for r in C.drop_duplicates(df).collect()) == [0, 2]


def test_imputation(spark, messy):
    filled = C.handle_missing(messy, "Cust Name", "constant", "Unknown")
    assert filled.where("row_index = 3").first()["Cust Name"] == "Unknown"
    assert C.handle_missing(messy, "nope", "mean") is messy or C.handle_missing(messy, "nope", "mean").columns == messy.columns
    weights = C.handle_missing(messy, "Ctn Wgt", "mean").where("row_index = 3").first()["Ctn Wgt"]
    assert float(weights) == pytest.approx((300 + 2.5 + 640 + 910 + 1100 + 1100) / 6)
    df = spark.createDataFrame([(1, "b"), (None, "a"), (4, None), (7, "a"), (None, "b")], "n int, s string")
    got = C.impute(df, [{"column": "n", "method": "median"}, {"column": "s", "method": "mode"}])
    assert [tuple(r) for r in got.collect()] == [(1.0, "b"), (4.0, "a"), (4.0, "a"), (7.0, "a"), (4.0, "b")]
    text = C.handle_missing(df, "n", "constant", "none").select("n").collect()
    assert [r[0] for r in text] == ["1", "none", "4", "7", "none"]
    assert [r[0] for r in C.handle_missing(df, "n", "constant", 0).select("n").collect()] == [1, 0, 4, 7, 0]
    empty = df.where("false")
    assert C.handle_missing(empty, "n", "mean").count() == 0


def test_drop_changes_later_statistics(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, "x"), (None, "y")], "n double, s string")
    steps = [{"column": "s", "method": "drop"}, {"column": "n", "method": "mean"}]
    assert [r["n"] for r in C.impute(df, steps).collect()] == [3.0, 3.0]


def test_conversions(spark):
    df = spark.createDataFrame(
        [("500", "2.5", "Yes ", "2026-01-02"), ("xyz", "3.5", "0", "03/01/2026"), (None, "inf", "maybe", None)],
        "a string, b string, c string, d string",
    )
    assert [r["a"] for r in C.convert(df, "a", "int").collect()] == [500, None, None]
    assert [r["b"] for r in C.convert(df, "b", "int").collect()] == [2, 4, None]
    assert [r["b"] for r in C.convert(df, "b", "float").collect()] == [2.5, 3.5, float("inf")]
    assert [r["c"] for r in C.convert(df, "c", "boolean").collect()] == [True, False, None]
    assert [r["a"] for r in C.convert(df, "a", "str").collect()] == ["500", "xyz", ""]
    assert [str(r["d"])[:10] for r in C.convert(df, "d", "datetime").collect()] == ["2026-01-02", "None", "None"]
    assert [str(r["d"])[:10] for r in C.convert(df, "d", "datetime", "%d/%m/%Y").collect()] == ["None", "2026-01-03", "None"]
    assert C.convert(df, "nope", "int").columns == df.columns


def test_steps_name_new_headers(messy):
    config = plan.new_config(imputations=[{"column": "Cust Name", "method": "constant", "value": "?"}], remove_duplicates=False)
    skipped = C.clean(messy, config).where("cust_name is null").count()
    followed = C.clean(messy, config, resolve_names=True).where("cust_name is null").count()
    assert (skipped, followed) == (1, 0)


def test_config_building():
    config = plan.new_config()
    config = plan.add_imputation(config, "a", "mean", "ignored")
    config = plan.add_imputation(config, "b", "constant", "x")
    config = plan.add_imputation(config, "a", "mode")
    assert config["imputations"] == [
        {"column": "b", "method": "constant", "value": "x"}, {"column": "a", "method": "mode", "value": None},
    ]
    config = plan.add_conversion(config, "a", "int", "")
    config = plan.add_conversion(config, "a", "datetime", "%Y")
    assert config["conversions"] == [{"column": "a", "type": "datetime", "format": "%Y"}]
    assert plan.remove_step(config, "imputations", 0)["imputations"][0]["column"] == "a"
    assert plan.new_config()["imputations"] == []


def test_renumbering_after_drop(spark):
    df = spark.range(100).select(F.col("id").alias("row_index"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    got = C.clean(df, {"drop_null_rows": ["v"]}).orderBy("row_index").collect()
    assert [(r["row_index"], r["v"]) for r in got] == [(i, 3 * i) for i in range(34)]
