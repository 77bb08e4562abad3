"""Archives: exact round trip, members at their offsets, whole streams, broken streams."""

import base64
import gzip
import hashlib
import json
import os

import pytest

from siftframe.llm import warc

NASTY = [
    None,
    "",
    "plain",
    "plain",
    "a\r\n\r\nb\r\n\r\n",
    "\r\n\r\n",
    "\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n",
    "\r\n\r\r\n\r\n\n",
    "é 中文 🎉",
    "x" * 300_000,
    "x" * 300_000,
]


def pages_of(spark, htmls=NASTY):
    rows = [(k + 10, f"http://e.org/{k}\r\nX: y" if k % 3 else None, h, "d", "r") for k, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, record string").repartition(3)


def test_round_trip(spark):
    got = {r["page_id"]: r for r in warc.round_trip(pages_of(spark)).collect()}
    assert len(got) == len(NASTY)
    first = {}
    for k, h in enumerate(NASTY):
        first.setdefault(h or "", k + 10)
    for k, h in enumerate(NASTY):
        data, r = (h or "").encode(), got[k + 10]
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = first[h or ""] != k + 10
        assert r["type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (first[h or ""] if revisit else None)
        assert r["payload"] == (None if revisit else data)


def test_smaller_payloads_are_all_responses(spark):
    got = warc.round_trip(pages_of(spark, ["ab", "ab", "abcdef", "abcdef"]), least=5).collect()
    assert sorted((r["page_id"], r["type"]) for r in got) == [(10, "response"), (11, "response"), (12, "response"), (13, "revisit")]


def test_streams_and_members(spark, tmp_path):
    streams, members = f"{tmp_path}/streams", f"{tmp_path}/members"
    warc.write_archives(warc.assign_revisits(pages_of(spark)), streams)
    for name in os.listdir(streams):
        if name.endswith(".gz"):
            assert open(f"{streams}/{name}", "rb").read().count(b"\x1f\x8b\x08") >= 1
            assert gzip.open(f"{streams}/{name}").read().startswith(b"WARC/1.1\r\n")
    index = warc.normalise(spark, streams, members).collect()
    assert len(index) == len(NASTY)
    sidecars = [json.loads(line) for f in os.listdir(members) if f.endswith(".idx") for line in open(f"{members}/{f}")]
    assert sorted(map(str, sidecars)) == sorted(str(r.asDict()) for r in index)
    for r in index:
        with open(f"{members}/{r['archive']}", "rb") as f:
            f.seek(r["offset"])
            record = gzip.decompress(f.read(r["length"]))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and r["record"].encode() in record
    # the members one after the other are a whole archive too
    assert sum(gzip.open(f"{members}/{f}").read().count(b"WARC-Record-ID: ") for f in os.listdir(members) if f.endswith(".gz")) == len(NASTY)


def test_stream_that_ends_within_a_record(spark, tmp_path):
    os.makedirs(f"{tmp_path}/cut")
    with gzip.open(f"{tmp_path}/cut/a.warc.gz", "wb") as f:
        f.write(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n")
    with pytest.raises(Exception, match="ends within a record"):
        warc.normalise(spark, f"{tmp_path}/cut", f"{tmp_path}/out").collect()


def test_streams_of_like_names_stay_apart(spark, tmp_path):
    for k, name in enumerate(("in/crawl.1.warc.gz", "in/crawl.2.warc.gz", "in/crawl.warc.gz", "in/sub/crawl.1.warc.gz")):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        body = f"content {k}".encode()
        with gzip.open(f"{tmp_path}/{name}", "wb") as f:
            f.write(b"WARC/1.1\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(body)) + body + b"\r\n\r\n")
    index = warc.normalise(spark, f"{tmp_path}/in/*.gz,{tmp_path}/in/sub".split(",")[0], f"{tmp_path}/out").collect()
    index += warc.normalise(spark, f"{tmp_path}/in/sub", f"{tmp_path}/out").collect()
    assert len({r["archive"] for r in index}) == 4 and all(r["offset"] == 0 for r in index)
    for r in index:
        assert b"content " + r["record"][5:-1].encode() in gzip.open(f"{tmp_path}/out/{r['archive']}").read()


def test_empty_table(spark):
    assert warc.round_trip(pages_of(spark).limit(0)).collect() == []


def test_payloads_that_end_in_any_line_ends(spark):
    htmls = ["abc\r\n", "\r\n", "\r", "\n", "abc\r", "abc\r\n\r", "\r\n" * 3, "abc" + "\r\n" * 5, "\n\r\n", "a\r\n\r\nb\r\n", "plain"]
    for shuffled in (htmls, htmls[::-1], htmls[:1]):
        rows = [(k, "u", h) for k, h in enumerate(shuffled)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
        got = {r["page_id"]: bytes(r["payload"]) for r in warc.round_trip(pages).collect()}
        assert got == {k: h.encode() for k, h in enumerate(shuffled)}
