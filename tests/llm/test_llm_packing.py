"""Packing: token ids of the library, gapless pieces, tight windows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftframe.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sé .1")), max_size=60))
def test_ids_are_those_of_the_library(text):
    tokenizer = packing.word_ids(PATH).tokenizer
    assert np.frombuffer(packing.word_ids(PATH).encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_string_is_one_id(tokenizer):
    text = "a <|endoftext|> b"
    ids = np.frombuffer(packing.word_ids(PATH).encode(text), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids and 50256 in ids


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 101) for _ in range(500)]
    windows = packing.best_fit(lengths, 100)
    # brute force: a list of open windows, the least remaining capacity that holds the length
    room, count = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(100 - n)
    assert len(windows) == len(room)
    assert sorted(100 - sum(lengths[k] for k in w) for w in windows) == sorted(room)
    assert sorted(k for w in windows for k in w) == list(range(500))


def test_pieces_cover_every_document(spark, tokenizer):
    rng = random.Random(4)
    texts = [None, "", "a", "same", "same", "long " * 7000] + [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(1, 900))) for _ in range(150)]
    rows = [(k if k else None, t, 1, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, sequence_id string").repartition(3)
    got = [r.asDict() for r in packing.pack(docs, PATH).collect()]
    sequences = {}
    for k, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted((r for r in got if r["doc_id"] == (k or None)), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == ids.tobytes()
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert all(r["doc_tokens"] == len(ids) for r in pieces)
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        size = sum(r["length"] for r in pieces)
        assert size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding < 0.03 * sum(r["length"] for r in got)
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_crc_of_the_query_is_of_little_endian_ids(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("x", "some words")], "doc_id string, text string")
    row = packing.pack(docs, PATH).withColumn("crc", F.crc32("ids")).first()
    assert row["crc"] == zlib.crc32(bytes(row["ids"])) and row["doc_id"] == "x"
