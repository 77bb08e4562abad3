"""Filter audit against a plain walk through every order, and odd tables."""

from itertools import permutations

from siftframe.llm import interaction

DOCS = "doc_id long, text string, lang string, part string, mask int, good string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, lang, *_ in docs:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > least[text],
        }
        fails.append((lang or "", {f for f in failed if failed[f]}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            gone = []
            for k, letter in enumerate(order):
                here = [f for f in left if letter in f[1]]
                redundant = sum(letter in f[1] for f in gone)
                left, gone = [f for f in left if letter not in f[1]], gone + here
                removed_by[letter] += len(here)
                unique = sum(f[1] == {letter} for f in fails if f[0] == part)
                out[part, "".join(order), k + 1] = (len(left), len(here), redundant, unique, sum(f[2] for f in here), sum(f[3] for f in here))
        for key in list(out):
            if key[0] == part:
                out[key] += (removed_by[key[1][key[2] - 1]],)
    return out


def found(spark, docs, labels):
    masks = interaction.five_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*interaction.COUNTS, "shapley")) for r in interaction.audit(masks).collect()}


def words(n, distinct, extra=""):
    return " ".join(f"w{k % distinct}" for k in range(n)) + extra


def test_audit_against_brute_force(spark):
    texts = [words(250, 250), words(250, 20), words(20, 20), words(250, 250, " #"), words(250, 250, " A" * 120), words(9, 2, "\u00a0x $ B"), "", None, "\t\n", words(199, 199), words(200, 100), "É" * 50 + "A"]
    docs = [(k, texts[(k * 7) % 12], ("en", "de", None, "")[k % 4], "p", 1, "g") for k in range(60)]
    docs += [(3, texts[9], "en", "p", 1, "g")] * 2 + [(None, texts[0], "de", None, None, None)] * 2
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 50, 3)] + [(0, 1, 0), (999, 1, 1), (None, 1, 1), (6, None, None)]
    got = found(spark, docs, labels)
    assert len(got) == 3 * 600
    assert got == brute(docs, labels)


def test_no_rows_and_no_labels(spark):
    assert found(spark, [], [(1, 1, 1)]) == {}
    clean = [(1, words(300, 300), "en", None, None, None)]
    got = found(spark, clean, [])
    assert set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)} and len(got) == 600


def test_other_numbers_of_filters(spark):
    masks = spark.createDataFrame([("p", 1, True, False), ("p", 3, False, True), ("p", 0, False, False)], "part string, mask int, good boolean, toxic boolean")
    rows = {(r["filter_order"], r["step"]): r for r in interaction.audit(masks, "XY").collect()}
    assert len(rows) == 4
    assert (rows["XY", 1]["removed"], rows["XY", 2]["redundant"], rows["YX", 1]["removed"], rows["YX", 2]["removed"]) == (2, 1, 1, 1)
    assert rows["XY", 1]["shapley"] == 3 and rows["YX", 1]["shapley"] == 1
