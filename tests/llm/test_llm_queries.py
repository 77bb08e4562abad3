"""The registered queries against their SQL on the smallest tables, and the pipeline against brute force."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm_dedup import brute_components, sets_of

import corpus_pipeline
from siftframe.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_all_operators_and_the_stages():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language id", "exact dedup", "minhash near-dedup", "packing"]


def test_near_groups_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    want = brute_components([r["doc_id"] for r in docs], sets_of([r["text"] for r in docs], 2))
    assert {r["doc_id"]: r["component_id"] for r in QUERIES["op5_minhash"](spark, FOLDER).collect()} == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    judged = [i for i in start if i in labels]
    assert sum((i in kept[0]) == (labels[i] == 1) for i in judged) > 0.93 * len(judged)
    assert all(any(c.isalpha() for c in t) for t in kept[1].values()) and len(kept[1]) >= 0.98 * len(kept[0])
    last = {}
    for i in sorted(kept[1]):
        last[kept[1][i]] = i
    assert set(kept[2]) == set(last.values())
    ids = sorted(kept[2])
    heads = brute_components(ids, sets_of([kept[2][i] for i in ids], 5))
    assert set(kept[3]) == {i for i in ids if heads[i] == i}
    pieces = corpus_pipeline.run(spark, FOLDER)
    found = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("of")).collect()
    assert {r["doc_id"] for r in found} == set(kept[3]) and all(r["n"] == r["of"] for r in found)


def test_stages_on_odd_tables(spark):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, and no rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(60)
    clash = [F.lit(c).alias(c) for c in ("_of", "maybe", "sha", "near_id", "score", "lang_pred", "key", "block")]
    docs = docs.select("*", *clash)
    sample = docs.first().asDict()
    odd = [{**sample, "doc_id": i, "text": t, "lang": None} for i, t in ((None, None), (None, sample["text"]), (900, ""), (900, ""), (901, None), (902, "word " * 60_000), (903, "#"))]
    table = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(5))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, FOLDER)
        rows = out.collect()
        assert stage(spark, table.limit(0), FOLDER).count() == 0, name
        if name == "packing":
            assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
            continue
        assert out.columns == docs.columns and 0 < len(rows) <= table.count(), name
        texts = [r["text"] or "" for r in rows]
        if name == "exact dedup":
            assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in table.collect()})
        elif name == "minhash near-dedup":
            assert sum(r["doc_id"] is None for r in rows) == 2 and texts.count("") >= 3
        elif name == "language id":
            assert "" not in texts and "#" not in texts
