import random

import pytest
from pyspark.sql import functions as F

from siftframe.functions.similarity import common_length, ratio, ratio_at_least, similarity
from siftframe.operators import fuzzy as Z


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[j], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def slow_stars(values, threshold):
    """Values one by one from the most frequent on; the sequential definition."""
    counts, first = {}, {}
    for i, v in enumerate(values):
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
            first.setdefault(v, i)
    order = sorted(counts, key=lambda v: (-counts[v], first[v]))
    taken, out = set(), set()
    for v in order:
        if v in taken:
            continue
        taken.add(v)
        group = [o for o in order if o not in taken and ratio(v.strip().lower(), o.strip().lower()) >= threshold]
        taken |= set(group)
        if group:
            out |= {(v, m, counts[m]) for m in [v, *group]}
    return out


def random_values(rng, n, alphabet="abcd ", longest=9):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n // 3)]
    values = []
    for _ in range(n):
        v = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            if v and rng.random() < 0.5:
                v.pop(rng.randrange(len(v)))
            else:
                v.insert(rng.randint(0, len(v)), rng.choice(alphabet))
        v = "".join(v)
        values.append(None if rng.random() < 0.03 else v.upper() if rng.random() < 0.2 else v)
    return values


def table(spark, values, partitions=4):
    return spark.createDataFrame(list(enumerate(values)), "row_index bigint, v string").repartition(partitions)


def test_common_length_against_the_textbook():
    rng = random.Random(1)
    for _ in range(500):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 40)))
        assert common_length(a, b) == slow_common(a, b)


def test_similarity_values(spark):
    pairs = [("merino wool", "merino wool"), ("merino wool", "viscose"), ("  Merino WOOL\t", "merino-wool"),
             ("Merino Wool", "Mer. Wool"), ("", "a"), (" ", " "), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 100.0 and got[1] < 50.0 and got[2] > 80.0 and got[3] == 80.0 and got[4:] == [0.0, 0.0, 0.0]


def test_long_text_bound():
    a, b = "ab" * 400, "cd" * 400
    assert not ratio_at_least(a, b, 50) and ratio_at_least(a, a[:-3] + "xyz", 99)
    assert ratio_at_least(a, b, 0)


@pytest.mark.parametrize("threshold", [50, 66.7, 80, 95, 100])
def test_pairs_lose_nothing(spark, threshold):
    rng = random.Random(int(threshold))
    values = random_values(rng, 150) + random_values(rng, 60, "abcdefghijklmnopqrstuvwxyz", 30) + ["aaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaab"]
    got = {(r["value1"], r["value2"]) for r in Z.similar_pairs(table(spark, values), "v", threshold).collect()}
    seen = list(dict.fromkeys(v for v in values if v and v.strip()))
    want = {
        (a, b)
        for i, a in enumerate(seen)
        for b in seen[i + 1 :]
        if ratio(a.strip().lower(), b.strip().lower()) >= threshold
    }
    assert got == want


def test_frequent_keys_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(Z, "TILE", 7)
    values = [f"item {i:03d}" for i in range(60)]
    got = Z.similar_pairs(table(spark, values), "v", 80).count()
    want = sum(ratio(a, b) >= 80 for i, a in enumerate(values) for b in values[i + 1 :])
    assert got == want


@pytest.mark.parametrize("threshold,batch,few,one_task", [(50, None, None, True), (75, 4, 0, True), (80, None, None, False), (80, 6, 300, False)])
def test_stars_equal_the_sequential_grouping(spark, monkeypatch, threshold, batch, few, one_task):
    if batch:  # few candidate pairs allowed: many batches
        monkeypatch.setattr(Z, "BATCH", batch)
        monkeypatch.setattr(Z, "FEW_PAIRS", few)
        monkeypatch.setattr(Z, "VALUE_PAIRS", 0)
    if not one_task:
        monkeypatch.setattr(Z, "ONE_TASK", -1)
    values = random_values(random.Random(threshold + (batch or 0)), 36 if batch else 110)
    stars = Z.star_clusters(table(spark, values, 3 + (batch or 0)), "v", threshold)
    got = {(r["canonical"], r["member"], r["n"]) for r in stars.collect()}
    assert got == slow_stars(values, threshold)


def test_batches_are_few_and_a_crowd_never_forms_its_pairs(spark, monkeypatch):
    values = [f"Customer#{i:09d}" for i in range(3000)]
    monkeypatch.setattr(Z, "FEW_PAIRS", 0)
    monkeypatch.setattr(Z, "VALUE_PAIRS", 0)
    monkeypatch.setattr(Z, "BATCH", 100)
    settled, sizes = Z._settled, []

    def counted(links):
        sizes.append(links.count())
        return settled(links)

    monkeypatch.setattr(Z, "_settled", counted)
    got = {(r["canonical"], r["member"], r["n"]) for r in Z.star_clusters(table(spark, values), "v", 80).collect()}
    assert got == slow_stars(values, 80)
    assert len(sizes) <= 30 and sum(sizes) < 200_000  # all pairs are 4.5 million


def test_candidates_are_bounded(spark):
    """Rows out of the candidate join: texts of 14 random letters share rare keys at fitting places only."""
    rng = random.Random(2)
    values = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(3000)]
    values += [v[:6] + "x" + v[7:] for v in values[:500]]
    nodes = spark.createDataFrame(list(enumerate(values)), "id long, norm string")
    keyed = Z._keyed(nodes, 85, Z._common_tokens(nodes))
    found = Z._candidates(keyed, keyed, F.col("id1") < F.col("id2"), 85, False)
    pairs = {(r["id1"], r["id2"]) for r in found.collect()}
    assert pairs >= {(i, 3000 + i) for i in range(500) if values[i] != values[3000 + i]}
    assert len(pairs) < 0.08 * len(values) ** 2 / 2
    assert keyed.count() <= 10 * len(values)


def test_many_dissimilar_values_take_few_writes(spark, monkeypatch):
    rng = random.Random(9)
    values = ["item-" + "".join(rng.choice("abcdefghijklmnop") for _ in range(14)) for _ in range(3000)]
    written, tags = Z.written, []

    def counted(df, tag):
        tags.append(tag)
        return written(df, tag)

    monkeypatch.setattr(Z, "written", counted)
    assert Z.star_clusters(table(spark, values), "v", 90).isEmpty()
    assert len(tags) <= 12


def test_dense_cluster(spark):
    values = [f"Customer#{i:09d}" for i in range(300)]
    got = {(r["canonical"], r["member"], r["n"]) for r in Z.star_clusters(table(spark, values), "v", 80).collect()}
    assert got == slow_stars(values, 80)


def test_material_names(spark):
    values = ["Merino Wool", "Mer. Wool", "Viscose", "Merino-Wool", "Visc", "Viscose"]
    df = table(spark, values)
    stars = Z.star_clusters(df, "v", 75)
    groups = Z.group_records(stars).collect()
    assert [g["members"] for g in groups] == [["Merino Wool", "Mer. Wool", "Merino-Wool"]]
    assert groups[0]["frequencies"] == {"Merino Wool": 1, "Mer. Wool": 1, "Merino-Wool": 1}
    mapping = Z.replacement_map(stars, "v", keep=["Mer. Wool"])
    got = [r["v"] for r in Z.apply_mapping(df, "v", mapping).orderBy("row_index").collect()]
    assert got == ["Merino Wool", "Mer. Wool", "Viscose", "Merino Wool", "Visc", "Viscose"]
    parts = Z.group_records(stars, most=2).collect()
    whole = {g["canonical"]: sorted(g["members"]) for g in groups}
    for name, members in whole.items():
        own = sorted((p for p in parts if p["canonical"] == name), key=lambda p: p["part"])
        assert own[0]["part"] == 1 and own[0]["members"][0] == name
        assert sorted(m for p in own for m in p["members"]) == members


def test_mapping(spark, monkeypatch):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "b"), (3, "a"), (4, "c")], "row_index bigint, v string")
    assert Z.apply_mapping(df, "nope", {"a": "x"}) is df
    want = ["x", None, "b", "x", "y"]
    assert [r["v"] for r in Z.apply_mapping(df, "v", {"a": "x", "c": "y"}).orderBy("row_index").collect()] == want
    # the way taken by tables too large to broadcast
    import siftframe.operators.joins as J

    monkeypatch.setattr(J, "is_small", lambda table, rows=0: False)
    assert [r["v"] for r in Z.apply_mapping(df, "v", {"a": "x", "c": "y"}).orderBy("row_index").collect()] == want
    monkeypatch.setattr(J, "HOT_SHARE", 2)
    assert [r["v"] for r in Z.apply_mapping(df, "v", {"a": "x", "c": "y"}).orderBy("row_index").collect()] == want
