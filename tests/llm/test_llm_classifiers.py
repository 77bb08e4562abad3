"""Language and quality: held-out accuracy on the supplied tables, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftframe.llm import language, quality

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_language_held_out(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs, ~held)
    rows = language.predict(docs, model).where(held).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.identify(docs, model).columns == docs.columns


def test_language_edge_cases(spark):
    texts = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 5
    learn = spark.createDataFrame([(k, t, g, "x") for k, (t, g) in enumerate(texts)] + [(99, "no language", None, "x")], "doc_id long, text string, lang string, score string")
    model = language.fit(learn, F.lit(True))
    assert model.languages == ["de", "en", "fr"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !!"), (4, "the dog"), (4, "the dog"), (None, "und die " * 100_000)], "doc_id long, text string")
    got = {(r["doc_id"], r["text"] and r["text"][:9]): r for r in language.predict(odd, model).collect()}
    assert [got[k]["lang_pred"] for k in ((1, None), (2, ""), (3, "123 ... !"))] == ["und"] * 3
    assert got[4, "the dog"]["lang_pred"] == "en" and got[None, "und die u"]["lang_pred"] == "de"
    assert language.identify(odd, model).count() == 3
    # without training rows, with one language, and an extra column of the same name
    assert language.fit(learn.limit(0), F.lit(True)).languages == []
    assert language.predict(odd, language.fit(learn.limit(0), F.lit(True))).select("lang_pred").distinct().first()[0] == "und"
    single = language.fit(learn.where("lang = 'fr'"), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(odd, single).collect()} == {"und", "fr"}
    assert language.predict(learn, model).columns == ["doc_id", "text", "lang", "score", "lang_pred", "_score", "ambiguous"]
    assert language.predict(odd.limit(0), model).collect() == []


def test_sliced_means_equal_those_of_one_slice(monkeypatch):
    texts = ["abc déf " * n for n in (1, 5, 40)] + ["x", ""]
    weights = np.random.default_rng(0).normal(size=(language.BUCKETS, 3))
    whole, counts = language.gram_means(texts, weights), language.gram_counts(texts)
    monkeypatch.setattr(language, "SLICE", 7)
    assert np.allclose(language.gram_means(texts, weights), whole) and np.allclose(language.gram_counts(texts), counts)


@pytest.mark.parametrize("n", [2, 4, 5, 12, 60])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    distance = (code.shape[1] - code @ code.T) / 2 + 1000 * np.eye(n)
    assert distance.min() >= (1 if n == 2 else 2 if n < 6 else code.shape[1] / 5)


def test_quality_held_out(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(docs, labels, ~held)
    rows = quality.score(docs, model).join(labels, "doc_id").where(held).select("quality", "score", "predicted").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.95
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_risk_uses_no_negative_label():
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(1.5, 1, (400, 2)), rng.normal(-1.5, 1, (400, 2))
    unlabelled = np.r_[rng.normal(1.5, 1, (700, 2)), rng.normal(-1.5, 1, (300, 2))]
    model = quality.nn_pu(positive, unlabelled, 0.7)
    assert (model.score(positive) > 0.5).mean() > 0.95 and (model.score(negative) < 0.5).mean() > 0.85
    assert np.mean(model.score(positive)[:, None] > model.score(negative)) > 0.99


def test_quality_edge_cases(spark):
    rows = [(1, None, 0.0), (2, "", 0.0), (3, "word " * 100_000, 1.0), (3, "word " * 100_000, 1.0), (None, "some text", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "_score", "predicted"]
    assert all(0 <= r["_score"] <= 1 and r["predicted"] == int(r["_score"] >= 0.5) for r in got.collect()) and got.count() == 5
    without = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r["_score"] for r in quality.score(docs, without).collect()} == {0.5}
    assert quality.keep_good(docs.limit(0), model).collect() == []


def plain_buckets(data: bytes) -> list[int]:
    """Buckets of all n-grams, one by one."""
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in data]
    out = []
    for at in range(len(data) - 2):
        code = 0
        for k in range(3):
            code = (code * 257 + data[at + k]) % 2**32
            out.append(((code + k + 1) * 2654435761 % 2**32) >> (32 - 15))
    return out


def test_counts_and_decoding_by_plain_loops(docs):
    import math

    texts = [r["text"].lower() for r in docs.orderBy("doc_id").limit(40).collect()]
    joined = b"".join(b" " + t.encode() + b"  " for t in texts)
    counts = np.zeros(language.BUCKETS)
    for bucket in plain_buckets(joined):
        counts[bucket] += 1
    assert (language.gram_counts(texts) == counts).all()
    model = language.fit(docs, F.lit(True))
    names, scores, close = model.decode(texts)
    for text, name, score, ambiguous in zip(texts, names, scores, close):
        data = b" " + text.encode() + b"  "
        margins = [0.0] * model.code.shape[1]
        for bucket in plain_buckets(data):
            for bit in range(len(margins)):
                margins[bit] += 8 * model.weights[bucket, bit] / (3 * len(data))
        losses = [sum(t * math.log1p(math.exp(-c * m)) for t, c, m in zip(model.trust, row, margins)) for row in model.code]
        shares = [math.exp(min(losses) - x) for x in losses]
        shares = [s / sum(shares) for s in shares]
        ranked = sorted(shares, reverse=True)
        assert name == model.languages[shares.index(ranked[0])]
        assert abs(score - ranked[0]) < 1e-3
        assert ambiguous == (ranked[0] - ranked[1] < language.AMBIGUOUS) or abs(ranked[0] - ranked[1] - language.AMBIGUOUS) < 1e-2


def test_risk_is_least_where_training_ends():
    """The risk written out, its slope by finite differences, and scores by a plain loop."""
    import math

    rng = np.random.default_rng(3)
    positive = rng.normal(1, 1, (300, 3))
    unlabelled = np.r_[rng.normal(1, 1, (350, 3)), rng.normal(-1, 1, (350, 3))]
    model = quality.nn_pu(positive, unlabelled, 0.5, steps=4000, rate=0.01)

    def risk(w: list[float]) -> float:
        def margin(x):
            z = [min(8, max(-8, (a - m) / s)) for a, m, s in zip(x, model.mean, model.scale)]
            return sum(a * b for a, b in zip(z, w)) + w[-1]

        loss = lambda g: math.log1p(math.exp(-g))
        of_p = sum(loss(margin(x)) for x in positive) / len(positive)
        not_p = sum(loss(-margin(x)) for x in positive) / len(positive)
        not_u = sum(loss(-margin(x)) for x in unlabelled) / len(unlabelled)
        return 0.5 * of_p + max(0.0, not_u - 0.5 * not_p) + 0.5e-4 * sum(a * a for a in w[:-1])

    w = [*model.weights, model.bias]
    least = risk(w)
    for k in range(len(w)):
        up, down = (risk([a + (d if i == k else 0) for i, a in enumerate(w)]) for d in (1e-4, -1e-4))
        assert abs(up - down) / 2e-4 < 0.02  # training swings about the kink where the risk of negatives is zero
        for d in (0.3, -0.3):
            assert risk([a + (d if i == k else 0) for i, a in enumerate(w)]) > least
    for x in positive[:20]:
        z = sum(min(8, max(-8, (a - m) / s)) * b for a, m, s, b in zip(x, model.mean, model.scale, model.weights)) + model.bias
        assert abs(model.score(x[None])[0] - 1 / (1 + math.exp(-z))) < 1e-12
