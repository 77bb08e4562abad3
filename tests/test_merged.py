"""Merged profiles against whole ones, and mapped values that are remembered."""

import random

import pandas as pd
import pytest

from siftframe.operators import merged as M
from siftframe.operators.enrich import remembered_values
from siftframe.operators.profile import profile


def test_parts_add_up(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, float("nan"), *[rng.gauss(5, 2)] * 8]), rng.choice(["a", "a", "b", None, f"v{rng.randrange(3000)}"]), rng.randrange(10**6)) for i in range(6000)]
    df = spark.createDataFrame(rows, "row_index long, x double, t string, n long")
    cuts = (0, 100, 101, 3000, 6000)
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        M.append_part(df.where(f"row_index >= {low} and row_index < {high}"), f"p{k}", str(tmp_path / "parts"))
    M.append_part(df.where("row_index < 100"), "p0", str(tmp_path / "parts"))  # written again: counts once
    M.append_part(df.limit(0), "none", str(tmp_path / "parts"))
    got = {r["column"]: r for r in M.merged_profile(M.read_parts(df, str(tmp_path / "parts"))).collect()}
    for p in profile(df):
        r = got[p.column]
        assert (r["total_count"], r["null_count"]) == (p.total_count, p.null_count)
        assert r["null_pct"] == pytest.approx(p.null_pct)
        assert r["unique_count"] == pytest.approx(p.unique_count, rel=0.05)
        if p.column != "t":
            assert (r["min"], r["max"]) == (p.min, p.max)
            assert r["mean"] == pytest.approx(p.mean, rel=1e-12) and r["std"] == pytest.approx(p.std, rel=1e-12)
            values = sorted(v for v in (row[{"x": 1, "n": 3}[p.column]] for row in rows) if v is not None and v == v)
            for q, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
                assert abs(sum(v <= r[q] for v in values) / len(values) - share) < 0.005
        else:
            assert [(t["value"], t["count"]) for t in r["top_values"][:2]] == [(t["value"], t["count"]) for t in p.top_values[:2]]


def test_only_new_values_are_mapped(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def upper(values: pd.Series) -> pd.Series:
        calls.add(len(values))
        return values.map(lambda v: None if v == "PES" else v.upper())

    memo = str(tmp_path / "memo")
    run = lambda values, context="": {r["original"]: r["standard"] for r in remembered_values(spark.createDataFrame([(v,) for v in values], "v string"), "v", upper, memo, context).collect()}
    assert run(["a", "b", "a", None, "PES"]) == {"a": "A", "b": "B", "PES": "polyester"} and calls.value == 3
    assert run(["b", "c", "PES"]) == {"b": "B", "c": "C", "PES": "polyester"} and calls.value == 4
    assert run(["b"], "other") == {"b": "B"} and calls.value == 5
    assert run([]) == {} and calls.value == 5
