"""Licences, fingerprints and unigram pieces against brute force."""

import hashlib
import pathlib
import random
import re
import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftframe.llm import licences, spots, unigram


def test_whole_texts_match_in_any_spelling(spark):
    mit = next(t for name, t in licences.TEXTS if name == "MIT" and len(t) > 500)
    odd = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(" ", "  ").replace(",", " ,")
    rows = [
        (1, mit, "x"), (2, odd, "x"), (2, odd, "x"), (3, None, None), (4, "", "x"),
        (5, "Some prose.\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0", "x"), (6, mit + " And more.", "x"), (None, "© 2020 A\nAll rights reserved.", "x"),
    ]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, licence string"))
    assert got.columns == ["doc_id", "text", "licence", "text_digest", "_licence", "notices"]
    found = {r["doc_id"]: (r["_licence"], r["notices"]) for r in got.collect()}
    assert found[1][0] == found[2][0] == "MIT" and found[6][0] is None
    assert found[5] == (None, ["CC-BY-NC-4.0", "MIT"]) and found[3] == found[4] == found[None] == (None, [])
    assert licences.scan(spark.createDataFrame([], "text string")).collect() == []


def test_every_known_text_holds_a_word_of_the_prefilter(spark):
    forms = [r["form"] for r in licences.known_licences(spark).collect()]
    pieces = licences.fragments(forms)
    assert 0 < len(pieces) <= 12
    assert all(re.search("|".join(pieces), text.lower()) for _, text in licences.TEXTS)
    assert licences.fragments([*forms, "and the"]) == [] and licences.fragments([f"word{k} unlike{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]) == []


def test_notices_of_a_callers_texts(spark):
    own = [("PD", "Dedicated to the public domain by its author."), ("X", "a & b")]
    rows = [(1, "one\n  * Dedicated to the Public Domain, by its author!\ntwo"), (2, "A and B"), (3, "public domain"), (4, None)]
    for texts in (own, own[:1]):
        got = {r["doc_id"]: r["notices"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), texts=texts).collect()}
        assert got == {1: ["PD"], 2: ["X"] if len(texts) > 1 else [], 3: [], 4: []}
    assert licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), texts=[]).where("size(notices) > 0 OR licence IS NOT NULL").count() == 0


def plain_signatures(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    anchor = lambda w: w in spots.ANCHORS or len(w) == spots.ANCHOR_LENGTH
    chains = []
    for k, w in enumerate(words):
        after = [x for x in words[k + 1 :] if not anchor(x)][:2]
        if anchor(w) and len(after) == 2:
            chains.append(" ".join([w, *after]))
    return sorted({hashlib.md5(x.encode()).hexdigest()[:8] for x in (chains or words)})


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("n", "rt", "mbel", "st")]
    sentence = lambda n: " ".join(rng.choice(vocabulary) if rng.random() < 0.6 else rng.choice(spots.ANCHORS) for _ in range(n))
    texts = [sentence(rng.randrange(5, 80)) for _ in range(60)]
    for k in range(25):  # near copies and copies
        words = texts[k].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return texts + [texts[0], None, "", "...", "one", "One!", "é Ünïcode the façade naïve"]


@pytest.mark.parametrize("stretch", [spots.BUCKET_ROWS, 4])
def test_edits_and_fingerprints(spark, monkeypatch, prose, stretch):
    monkeypatch.setattr(spots, "BUCKET_ROWS", stretch)
    rows = [(3 * k - 20, t, "x", 1) for k, t in enumerate(prose)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stretch string, own int").repartition(4)
    got = {r["doc_id"]: r for r in spots.fingerprint_edits(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(order):
        t, nxt, r = t or "", order[(k + 1) % len(order)][1] or "", got[i]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert r["n_chars"] == len(t) and r["edited_text"] == edited
        own, other, after = plain_signatures(t), plain_signatures(edited), plain_signatures(nxt)
        assert r["fingerprint"] == " ".join(own) and r["edited_fingerprint"] == " ".join(other)
        assert abs(r["near_edited"] - jaccard(own, other)) < 1e-12 and abs(r["near_next"] - jaccard(own, after)) < 1e-12


def test_edge_tables(spark):
    schema = "doc_id long, text string"
    assert spots.fingerprint_edits(spark.createDataFrame([], schema)).collect() == []
    one = spots.fingerprint_edits(spark.createDataFrame([(1, "abcdef")], schema)).first()
    assert one["edited_text"] == "abcdab" and one["near_next"] == 1.0
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (2, None), (2, None), (5, "the " * 60_000)], schema)
    assert spots.fingerprint_edits(odd).count() == 5
    members, pairs = spots.near_duplicates(spark.createDataFrame([], schema))
    assert members.collect() == [] and pairs.collect() == []


def test_text_ids(spark, prose, monkeypatch):
    monkeypatch.setattr(spots, "BUCKET_ROWS", 10)
    docs = [(f"id-{k:03d}", t) for k, t in enumerate(prose)]
    got = {r["doc_id"]: r["edited_text"] for r in spots.fingerprint_edits(spark.createDataFrame(docs, "doc_id string, text string").repartition(5)).collect()}
    numbered = {r["doc_id"]: r["edited_text"] for r in spots.fingerprint_edits(spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")).collect()}
    assert got == {f"id-{k:03d}": t for k, t in numbered.items()}
    mixed = spark.createDataFrame([(None, "a"), ("", "b"), ("", None), ("x", "c d e")], "doc_id string, text string")
    assert spots.fingerprint_edits(mixed).count() == 4


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_near_pairs_are_all_pairs(spark, prose, threshold):
    docs = spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")
    members, pairs = spots.near_duplicates(docs, threshold)
    name = {r["doc_id"]: r["class"] for r in members.collect()}
    sets = {name[k]: plain_signatures(t or "") for k, t in enumerate(prose)}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= threshold}
    got = [frozenset((r["a"], r["b"])) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 0
    assert len(name) == len(prose) and name[0] == name[85]


MODEL = unigram.Unigram(
    ["<unk>", "<s>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "ab", "▁a", "ba", "abab", "é", "▁▁", "中文"],
    [0.0, 0.0, *[0.0] * 256, -3.0, -2.0, -2.5, -3.5, -3.0, -4.0, -6.5, -5.0, -4.0, -7.0],
    "u" + "c" + "b" * 256 + "n" * 10,
)


def brute_score(model, text):
    """Greatest sum of scores over all segmentations."""
    table = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == "n"}
    best = {0: 0.0}
    for end in range(1, len(text) + 1):
        totals = [best[s] + table[text[s:end]] for s in range(end) if text[s:end] in table]
        if text[end - 1] not in table:
            totals.append(best[end - 1] + model.unknown_score)
        best[end] = max(totals)
    return best[len(text)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é中文x\n🎉"), max_size=12))
def test_viterbi_is_best_and_decodes_back(text):
    ids = MODEL.encode(text).tolist()
    assert MODEL.decode(ids) == text
    if text:
        marked = "▁" + text.replace(" ", "▁")
        assert ids == MODEL.viterbi(marked)
        # bytes of one unknown character count once
        at, total, table = 0, 0.0, MODEL.kinds
        for k in ids:
            if table[k] == "n":
                total += MODEL.scores[k]
            elif int(MODEL.pieces[k][3:-1], 16) & 0xC0 != 0x80:
                total += MODEL.unknown_score
        assert abs(total - brute_score(MODEL, marked)) < 1e-9


def test_decode_odd_ids():
    b = lambda x: 2 + x
    assert MODEL.decode([1, b(0xC3), b(0xA9), b(0xFF), 0]) == "é� ⁇ " and MODEL.decode([]) == ""


def test_words_longer_than_a_step_table():
    text = "ab" * 500 + " " + "ba" * 3
    assert MODEL.encode(text).tolist() == MODEL.viterbi("▁" + text.replace(" ", "▁"))


def test_unigram_of_the_library(spark):
    """The public model with its type changed to unigram is the library's own unigram."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    raw = open(path, "rb").read()
    at = raw.rfind(b"\x18\x02")  # the trainer's model_type
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2 :])
    model = unigram.load(path)
    words = set(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(F.split("text", r"\s+"))).toPandas().iloc[:, 0])
    for w in sorted(words)[:3000]:
        # the lattice's best; the library's one-best takes another of some words
        assert not w or model.encode(w).tolist() == library.nbest_encode_as_ids(w, 2)[0]


def test_columns_of_pieces(spark):
    rows = [(1, None, "i"), (2, "", "i"), (3, "ab  ▁a", "i"), (None, "é" * 50_000, "i"), (3, "ab  ▁a", "i")]
    got = unigram.decode(unigram.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), MODEL), MODEL, "_ids")
    assert got.columns == ["doc_id", "text", "ids", "_ids", "decoded"]
    found = {r["doc_id"]: r["decoded"] for r in got.collect()}
    assert found == {1: "", 2: "", 3: "ab   a", None: "é" * 50_000}
    both = unigram.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"), MODEL)
    assert {(r["doc_id"], tuple(r["_ids"]), r["decoded"]) for r in both.collect()} == {(r["doc_id"], tuple(r["_ids"]), r["decoded"]) for r in got.collect()}
    assert unigram.encode(spark.createDataFrame([], "text string"), MODEL).collect() == []


def test_wrapped_and_whole_licences(spark):
    def wrapped(text, width):
        return "\n\n".join(textwrap.fill(part, width) for part in re.split(r"\n\s*\n|\n(?=\d\.)", text))

    isc = next(t for name, t in licences.TEXTS if name == "ISC")
    usual = "Copyright (c) 2004, 2012 A. Holder <a@b.org>\nCopyright 1995-2003 by Another Holder\n\n" + isc.replace("the above\ncopyright", "the above copyright").replace(" copyright notice", "\ncopyright notice")
    folder = pathlib.Path(licences.__file__).parent / "licence_texts"
    texts = [("ISC", usual), ("ISC", "© A. Holder\nAll rights reserved.\n" + isc)]
    for file in folder.iterdir():
        text = file.read_text()
        texts += [(file.stem, text), (file.stem, text.upper()), (file.stem, "\n".join(" * " + line for line in text.splitlines()))]
    apache = (folder / "Apache-2.0.txt").read_text()
    texts += [("Apache-2.0", apache.split("APPENDIX")[0]), ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 A. Holder"))]
    texts += [(name, wrapped(t, width)) for name, t in licences.TEXTS if name in ("MIT", "BSD-2-Clause", "ISC", "MPL-2.0") or t.startswith("BSD 3") for width in (40, 60, 72, 79)]
    texts += [(None, isc + " And more."), (None, "copyright 2020 A. Holder"), (None, apache[:9000])]
    rows = [(k, text) for k, (_, text) in enumerate(texts)]
    found = {r["doc_id"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, (name, _) in enumerate(texts) if found[k] != name] == []
