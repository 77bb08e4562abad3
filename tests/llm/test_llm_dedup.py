"""Exact and near duplicates against brute force on small tables."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from siftframe.llm import exact, minhash
from siftframe.llm.components import components

SCHEMA = "doc_id long, text string, maybe string, block long, words string, key string, id long"


def edge_rows():
    base = [(1, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, "A b c"), (6, "a b c "), (7, "x" * 200_000), (8, "x" * 200_000), (None, "lone"), (None, "a b c"), (9, "nine"), (9, "nine")]
    return [(i, t, "m", 1, "w", "k", 0) for i, t in base]


def brute_labels(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("blocks", [exact.BROADCAST_BLOCKS, 0])
def test_labels_and_kept_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(exact, "BROADCAST_BLOCKS", blocks)
    rows = edge_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in exact.label_copies(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_labels(rows), key=repr)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in rows})


def test_no_text_shuffles(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k % 5000}") for k in range(6000)], "doc_id long, text string")

    def shuffled(df):
        """Columns that an Exchange of the plan takes in."""
        plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return {c for m in re.finditer(r"\) Exchange\nInput \[\d+\]: \[([^]]*)\]", plan) for c in re.findall(r"(\w+)#", m[1])}

    for most, slices in ((exact.BROADCAST_BLOCKS, 32), (1, 32), (1, 1)):  # one broadcast, two slices, a join
        monkeypatch.setattr(exact, "BROADCAST_BLOCKS", most)
        monkeypatch.setattr(exact, "SLICES", slices)
        labels = exact.label_copies(docs)
        assert "text" not in shuffled(labels)
        assert labels.where("group_size = 2").count() == 2000 and labels.where("kept").count() == 5000
        if slices > 1:
            assert not shuffled(exact.mark_possible_repeats(docs, "text", "flag")[0])
        assert exact.drop_copies(docs).count() == 5000


def test_rows_that_share_an_id(spark):
    t, u = " ".join(f"w{k}" for k in range(40)), " ".join(f"u{k}" for k in range(40))
    near = t.replace("w39", "other")
    schema = "doc_id long, text string, _of string, near_id long, set_key string"
    rows = [(3, t, "a", 1, None), (5, near, "b", 1, None), (5, u, "c", 1, None), (5, None, "d", 1, None), (7, u, "e", 1, None), (9, t, "f", 1, None), (None, t, "g", 1, None)]
    left = minhash.drop_near(spark.createDataFrame(rows, schema))
    assert left.columns == ["doc_id", "text", "_of", "near_id", "set_key"]
    assert sorted(r["_of"] for r in left.collect()) == ["a", "c", "d", "g"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.label_copies(docs).collect() == [] and exact.drop_copies(docs).collect() == []
    assert minhash.near_groups(docs).collect() == [] and minhash.drop_near(docs).collect() == []


def test_filter_has_no_false_negative(spark):
    rng = random.Random(1)
    texts = [f"t{rng.randrange(3000)}" for _ in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    marked, _ = exact.mark_possible_repeats(docs, "text", "flag")
    flags = {r["doc_id"]: r["flag"] for r in marked.collect()}
    repeated = [texts.count(t) > 1 for t in texts[:400]]
    assert all(flags[k] for k, again in enumerate(repeated) if again)
    assert sum(flags[k] for k, again in enumerate(repeated) if not again) <= 0.1 * len(repeated)


def sets_of(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset())
    return out


def brute_components(ids, sets, percent=80):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(ids)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(ids[a]), find(ids[b])
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def crowded_texts(seed=3):
    """A crowd of near copies of one text, which are only partly linked with each other, and others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(60)]
    texts = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(60)] = f"v{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    for _ in range(60):
        texts.append(" ".join(f"z{rng.randrange(10_000)}" for _ in range(rng.randrange(1, 40))))
    texts += [texts[0], texts[0].upper(), None, "", " \t\n", "one", "ONE", "two words", "two\x0bwords", "é É", "É é"]
    return texts


@pytest.mark.parametrize("width, block", [(2, (128, 512)), (2, (4, 8)), (5, (128, 512))])
def test_components_are_those_of_all_pairs(spark, monkeypatch, width, block):
    monkeypatch.setattr(minhash, "STRAGGLERS", block[0])
    monkeypatch.setattr(minhash, "MEMBERS", block[1])
    texts = crowded_texts()
    ids = list(range(100, 100 + len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    sets = sets_of(texts, width)
    want = brute_components(ids, sets)
    got = {r["doc_id"]: r for r in minhash.near_groups(docs, width=width).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert [got[i]["n_shingles"] for i in ids] == [len(s) for s in sets]
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    left = {r["doc_id"] for r in minhash.drop_near(docs, width=width).collect()}
    assert left == {i for i in ids if want[i] == i}


def test_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text, 1, "a"), (5, text, 2, "b"), (6, text + " more", 3, "c"), (None, None, 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, label string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_groups(docs).collect()), key=repr)
    assert got == sorted([(None, 5, False), (5, 5, True), (6, 5, False), (None, None, True)], key=repr)
    left = minhash.drop_near(docs)
    assert left.columns == docs.columns and sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 0, 5]


def test_circulant_signature_estimates_jaccard():
    a, b = np.arange(0, 900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    s = minhash.signatures([minhash._mix64(a), minhash._mix64(b)], 512)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.06


def test_components_of_paths_rings_and_stars(spark):
    name = lambda k: hashlib.md5(str(k).encode()).digest()
    links = [(k, k + 1) for k in range(0, 200)] + [(1000 + k, 1000 + (k + 1) % 50) for k in range(50)] + [(2000, 2001 + k) for k in range(50)] + [(7, 7)]
    rows = [(name(a), name(b)) for a, b in links]
    labels = {bytes(r["key"]): bytes(r["label"]) for r in components(spark.createDataFrame(rows, "a binary, b binary")).collect()}
    groups = [range(0, 201), range(1000, 1050), range(2000, 2051)]
    found = [{labels[name(k)] for k in g} for g in groups]
    assert all(len(f) == 1 for f in found) and len(set().union(*found)) == 3
