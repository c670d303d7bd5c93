"""WARC archives as chunked record tables (operator 5).

A record is the byte stream of one WARC/1.1 record: header lines, payload, two line
ends. It is kept as rows (record_id, chunk, last, data) with at most `CHUNK` bytes
each, so a payload of any size is written, moved and read piece by piece and its
digest is carried from piece to piece. Records of one chunk, nearly all of them,
are read where they lie; only the chunks of larger ones are brought together, in
order, by record identifier.

Of records with equal payloads of at least `LEAST` bytes the one with the smallest
page_id is a response; the others are revisit records that refer to it and hold no
payload. Digests are compared in a narrow table (id, digest), never the payloads,
and the html is shuffled once, by page, so a payload that a third of all pages share
meets nowhere as text.

Defined cases: a null html is an empty payload; a null url gives no target header,
control characters in one are percent-encoded; a null page_id is never referred to,
its record may be a revisit; rows that repeat page_id and html are records of their
own, of the same type; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspan.llm.common import stored
from sigspan.session import shuffle_partitions
from sigspan.sources.remote import create_file

CHUNK = 256 << 10
LEAST = 100
DATE = "1970-01-01T00:00:00Z"  #: the pages carry no capture time
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = re.compile(r"<urn:page:(-?\d*)>")
CHUNKS = "record_id string, chunk int, last boolean, data binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def header(page_id, url, size: int, digest: str, refers_to) -> bytes:
    """The header block of a record, with the empty line after it."""
    name = "" if page_id is None else page_id
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else size}",
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)
        lines.insert(4, f"WARC-Target-URI: {safe}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def cut(head: bytes, payload: memoryview, size: int) -> Iterator[tuple[int, bool, bytes]]:
    """(number, last, bytes) of a record's chunks, made one at a time."""
    at, number, total = 0, 0, len(head) + len(payload)
    while True:
        body = payload[max(0, at - len(head)) : max(0, at + size - len(head))]
        piece = head[at : at + size] + bytes(body)
        at += size
        if at >= total:
            yield number, True, piece + b"\r\n\r\n"
            return
        yield number, False, piece
        number += 1


class Reader:
    """Reads one record from its chunks in order; holds no more than one of them."""

    def __init__(self):
        self.fields, self.head, self.sha, self.seen, self.next = None, b"", hashlib.sha256(), 0, 0

    def take(self, number: int, last: bool, data: bytes) -> None:
        if number != self.next:
            raise ValueError(f"chunk {self.next} of a record is missing")
        self.next += 1
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError("a record does not start with its version")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            data, self.head = self.head[end + 4 :], b""
            self.left = int(self.fields["Content-Length"])
        body = data[: self.left]
        self.sha.update(body)
        self.left -= len(body)
        if last and (self.left or data[len(body) :] != b"\r\n\r\n"):
            raise ValueError("a record's length differs from its header")

    def row(self) -> tuple:
        """page_id, payload_bytes, payload_digest, record_type, refers_to."""
        f = self.fields
        digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
        if f["WARC-Type"] == "response" and digest != self.sha.hexdigest():
            raise ValueError(f"payload digest of {f['WARC-Record-ID']} does not agree")
        number = lambda key: int(m[1]) if (m := _NAME.match(f.get(key, ""))) and m[1] else None
        return number("WARC-Record-ID"), int(f["X-Payload-Length"]), digest, f["WARC-Type"], number("WARC-Refers-To")


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat a smaller page's payload."""
    digests = pages.select("page_id", F.octet_length("html").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    digests = stored(digests.where(F.col("size") >= LEAST).select("page_id", "digest"), "warc-digests")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1 and refers_to is not null").select("digest", "refers_to")
    found = digests.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.distinct()


def records(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of one record per page."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    known = revisits(pages).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    digest = F.sha2(F.col("html").cast("binary"), 256)
    typed = pages.withColumn("digest", digest).join(
        known, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left"
    )

    def written(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        schema = pa.schema([("record_id", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary())])
        for batch in arrow:
            rows, held = [], 0
            html = batch.column("html").cast(pa.binary())
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
            for i, (page_id, url, digest, refers_to) in enumerate(zip(*columns)):
                payload = memoryview(html[i].as_buffer())
                head = header(page_id, url, len(payload), digest, refers_to)
                name = f"{task}-{count}"
                count += 1
                for number, last, data in cut(head, payload if refers_to is None else memoryview(b""), chunk):
                    rows.append((name, number, last, data))
                    held += len(data)
                    if held > 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return typed.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(written, CHUNKS)


def _read(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records whose chunks follow each other, over the borders of batches."""
    name, reader = None, None
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in arrow:
        done = []
        for record, number, last, data in zip(*(batch.column(c) for c in ("record_id", "chunk", "last", "data"))):
            if record.as_py() != name or number.as_py() == 0:
                name, reader = record.as_py(), Reader()
            reader.take(number.as_py(), last.as_py(), data.as_py())
            if last.as_py():
                done.append(reader.row())
        columns = zip(*done) if done else ((),) * 5
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read(archives: DataFrame) -> DataFrame:
    """One row per record, its payload checked against length and digest."""
    single = (F.col("chunk") == 0) & F.col("last")
    large = archives.where(~single).repartition(shuffle_partitions(archives.sparkSession), "record_id")
    large = large.sortWithinPartitions("record_id", "chunk")
    return archives.where(single).mapInArrow(_read, RECORDS).unionByName(large.mapInArrow(_read, RECORDS))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of all pages to the shared folder and reads them back."""
    return read(stored(records(pages), "warc-archives"))


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes the records as .warc.gz files, one per partition, one gzip member per record.

    Returns (path, records). The chunks of a record must follow each other, as in
    what `records` gives.
    """

    def files(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        count = 0
        with create_file(path) as out:
            member = None
            for batch in arrow:
                for number, last, data in zip(*(batch.column(c) for c in ("chunk", "last", "data"))):
                    if number.as_py() == 0:
                        member = gzip.GzipFile(fileobj=out, mode="wb", mtime=0)
                    member.write(data.as_py())
                    if last.as_py():
                        member.close()
                        count += 1
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

    return archives.mapInArrow(files, "path string, records long")
