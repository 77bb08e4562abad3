"""Every registered query against its SQL on the smallest tables (a part of them unless ALL_QUERIES is set)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
NAMES = sorted(QUERIES)
PART = NAMES if os.environ.get("ALL_QUERIES") else NAMES[::6]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 4) if isinstance(v, float) else v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", PART)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql_or_a_reason():
    without = set(QUERIES) - set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
    assert without == {"quality_report_document"}
