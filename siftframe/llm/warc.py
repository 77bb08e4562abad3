"""Web archives: writing records, normalising monolithic gzip, reading through an offset index.

``write_archives`` lets Spark's text writer stream each task's records into one gzip stream:
the two line ends after a record are its line separator. ``normalise`` inflates each such
whole-file stream once, rewrites every record as a gzip member of its own and writes an index
of offsets beside the archive. ``read_records`` seeks members by that index.

Archives lie in a folder that all executors and the driver share; tasks write under a name of
their attempt and move the file when it is whole, so a task can run again at any time.

Defined results: null html is an empty payload; of records with equal payloads of at least
``least`` bytes the one with the smallest id is the response and the others revisit it; a null
id is larger than any other and comes back as null; rows repeating id and payload are alike; null
or unusual urls are written without line ends; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftframe.llm.common import attach, filled
from siftframe.llm.exact import mark_possible_repeats
from siftframe.work import new_table_path, written

END = "\r\n"
GAP = END + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight characters for each ten hexadecimal digits."""
    digits = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def assign_revisits(pages: DataFrame, id: str = "page_id", html: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """id, url, payload, digest, refers_to: the id of the response that a row revisits, else null."""
    slim = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), filled(html).alias("payload"))
    marked, rows = mark_possible_repeats(slim, "payload", "maybe")
    marked = marked.withColumn("digest", payload_digest(F.col("payload")))
    maybe = marked.where("maybe").drop("maybe")
    long_enough = F.octet_length("payload") >= least
    groups = written(maybe.where(long_enough).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payload-groups")
    found = attach(maybe, groups, "digest", "n", rows)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    found = found.select("id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))
    alone = marked.where("not maybe").drop("maybe").withColumn("refers_to", F.lit(None).cast(slim.schema["id"].dataType))
    return alone.select(found.columns).unionByName(found)


def write_archives(records: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", per_archive: int = 50_000) -> None:
    """One gzip stream per task (and per ``per_archive`` records) of the rows of ``assign_revisits``."""
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(GAP))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", urn("id")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, urn("refers_to"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    ]
    head = F.concat_ws(END, F.lit("WARC/1.1"), *(F.concat(F.lit(f"{name}: "), value) for name, value in lines))
    texts = records.withColumn("block", block).select(F.concat(head, F.lit(GAP), F.col("block")).alias("value"))
    texts.write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split(END)
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def archive_name(source: str) -> str:
    """Name of the normalised archive of a stream, without endings: its own name and a digest of its whole path.

    Streams of the same name in other folders, and names that differ behind a dot, stay apart.
    """
    name = source.rstrip("/").rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".warc").removesuffix(".txt")
    return f"{name}-{hashlib.sha1(source.encode()).hexdigest()[:12]}"


class _Archive:
    """A normalised archive being written, with its index."""

    def __init__(self, path: str, source: str):
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(path)
        self.name = archive_name(source)
        self.attempt = TaskContext.get().taskAttemptId()
        self.files.create_dir(self.path)
        self.out = self.files.open_output_stream(self._of(f"warc.gz.{self.attempt}"), compression=None)
        self.offset, self.rows = 0, []

    def _of(self, ending: str) -> str:
        return f"{self.path}/{self.name}.{ending}"

    def add(self, head: bytes, content: bytes) -> None:
        gap, fields = GAP.encode(), _headers(head)
        member = gzip.compress(head + gap + content + gap, 6, mtime=0)
        self.out.write(member)
        self.rows.append((f"{self.name}.warc.gz", self.offset, len(member), fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri")))
        self.offset += len(member)

    def close(self) -> pd.DataFrame:
        self.out.close()
        index = pd.DataFrame(self.rows, columns=["archive", "offset", "length", "record", "type", "uri"])
        with self.files.open_output_stream(self._of(f"idx.{self.attempt}"), compression=None) as out:
            for row in self.rows:
                out.write(json.dumps(dict(zip(index.columns, row))).encode() + b"\n")
        for ending in ("warc.gz", "idx"):
            self.files.move(self._of(f"{ending}.{self.attempt}"), self._of(ending))
        return index


def normalise(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Rewrite the archives under ``path`` into ``to``; the index: archive, offset, length, record, type, uri.

    A compressed file is one split, so its parts come to one task in order. Parts between double
    line ends are put together again and cut by Content-Length, whatever line ends the content
    has at its end; a record and the next one's head are all that is held in memory.
    """

    def rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap, archive, source, head, parts, size = GAP.encode(), None, None, None, [], 0
        for batch in batches:
            for file, part in zip(batch["file"], batch["value"]):
                if file != source:
                    if head is not None:
                        raise ValueError(f"{source} ends within a record")
                    if archive:
                        yield archive.close()
                    archive, source = _Archive(to, file), file
                if head is not None:
                    parts.append(part)
                    size += len(gap) + len(part)
                    if size < wanted:
                        continue
                    content = gap.join(parts)
                    if size > wanted and not content.startswith(gap, wanted):
                        raise ValueError(f"a record of {file} is longer than its Content-Length")
                    archive.add(head, content[:wanted])
                    head, part = None, content[wanted + len(gap) :]
                    # line ends of the content joined those after it if anything is left, which is the next head
                    if not part:
                        continue
                head, parts, size = part, [], -len(gap)
                wanted = int(_headers(head)["content-length"])
        if head is not None:
            raise ValueError(f"{source} ends within a record")
        if archive:
            yield archive.close()

    parts = spark.read.option("lineSep", GAP).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    index = parts.mapInPandas(rewritten, "archive string, offset long, length long, record string, type string, uri string")
    return written(index, "archive-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of an index: record, type, uri, payload, payload_bytes, payload_digest, refers_to.

    The payload of a revisit is null; its size and digest are those its headers state of the whole
    payload. A response whose payload does not have the stated digest is an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        name, opened = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(batch["archive"], batch["offset"], batch["length"]):
                if archive != name:
                    name, opened = archive, files.open_input_file(f"{root}/{archive}")
                opened.seek(offset)
                record = zlib.decompress(opened.read(length), wbits=31)
                head, _, block = record.partition(GAP.encode())
                fields = _headers(head)
                http, _, payload = block[: int(fields["content-length"])].partition(GAP.encode())
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response":
                    found = b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != digest:
                        raise ValueError(f"{archive} at {offset}: the payload's digest is {found}, not {digest}")
                    size = len(payload)
                else:
                    payload, size = None, int(_headers(http)["content-length"])
                rows.append((fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), payload, size, digest, fields.get("warc-refers-to")))
            yield pd.DataFrame(rows, columns=["record", "type", "uri", "payload", "payload_bytes", "payload_digest", "refers_to"])

    return index.select("archive", "offset", "length").mapInPandas(read, "record string, type string, uri string, payload binary, payload_bytes long, payload_digest string, refers_to string")


def round_trip(pages: DataFrame, id: str = "page_id", html: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """Write the pages as archives, normalise these, and read every record back (see ``read_records``)."""
    spark, kind = pages.sparkSession, pages.schema[id].dataType.simpleString()
    streams, members = new_table_path(spark, "archive-streams"), new_table_path(spark, "archive-members")
    write_archives(assign_revisits(pages, id, html, url, least), streams)
    records = read_records(normalise(spark, streams, members), members)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-page:(.*)>$", 1), F.lit("")).cast(kind)
    return records.select(page("record").alias(id), page("refers_to").alias("refers_to"), "type", "uri", "payload", "payload_bytes", "payload_digest")
