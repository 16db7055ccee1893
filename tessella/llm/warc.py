"""WARC archives: revisit records for equal payloads, segmented records, chunked framing, reassembly.

Writing: each page becomes one record, or several segments of at most ``segment_bytes`` of its block.
Among pages with equal payloads of ``revisit_bytes`` or more, the one with the largest id is the
response; the rest are ``revisit`` records that name it and hold no payload. The block of a response is
an HTTP message whose body is in chunked transfer framing. Records are rows that Spark's text writer
puts out byte for byte, as many in a row as ``bundle_bytes`` hold, with the blank lines that end a WARC record between and after
them, so output is committed once a task, in any store.

Reading: archives are parsed once. Whole records are decoded where they lie; segments alone are shuffled, grouped by the origin's
record id, ordered by segment number and checked for gaps and against the total length. Then the chunked
framing is removed and the payload digest verified.

Scale: payloads of responses cross one join on their digest. The join's other side (one row for each
payload that occurs twice or more) is a written table, so adaptive execution can split a hot payload.
Group counts are combined before their shuffle. A reader loads a file at once, of ``bundles_per_file`` times ``bundle_bytes`` and
a record at most. A page longer than that is segments in several files; its reassembly holds the page in one task.

Null html is an empty payload, a null url a URN of the page, a null page id no ``X-Page-Id`` field.
Repeated pages each get their record: with equal ids none revisits the other. Extra columns are not
read. An empty table makes archives without records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, text_batches

VERSION = b"WARC/1.1"
CRLF = b"\r\n"
SEPARATOR = CRLF + CRLF
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stated on every record; archives of one run are dated alike, so that a task run twice writes the same bytes.
DATE = b"2000-01-01T00:00:00Z"


def chunk_body(payload: bytes, chunk_bytes: int) -> bytes:
    """A payload in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), chunk_bytes):
        part = payload[at : at + chunk_bytes]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def unchunk_body(body: bytes) -> bytes:
    """The payload of a chunked body; trailers are skipped, a body cut short raises."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP message block."""
    head, _, body = block.partition(CRLF + CRLF)
    chunked = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(CRLF)[1:])
    return unchunk_body(body) if chunked else body


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [VERSION, *[k + b": " + v for k, v in fields], b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block


def page_records(page_id, url, payload: bytes, digest: bytes, refers_to, nonce: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of a page without the blank lines that follow each."""
    named = "none" if page_id is None else str(page_id)
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{named}"
    common = [(b"WARC-Date", DATE), (b"WARC-Target-URI", target.encode())]
    shared = [
        (b"WARC-Payload-Digest", b"sha1:" + base64.b32encode(digest)),
        (b"X-Payload-Length", b"%d" % len(payload)),
        *([] if page_id is None else [(b"X-Page-Id", str(page_id).encode())]),
    ]
    name = f"<urn:page:{named}?r={nonce}>".encode()
    if refers_to is not None:
        yield _record(
            [(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", name), *common, *shared, (b"WARC-Refers-To", f"<urn:page:{refers_to}>".encode()),
             (b"WARC-Profile", REVISIT_PROFILE), (b"Content-Type", b"application/http; msgtype=response")],
            b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n",
        )
        return
    block = HTTP_HEAD + chunk_body(payload, chunk_bytes)
    first = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", name), *common, *shared, (b"Content-Type", b"application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield _record(first, block)
        return
    yield _record([*first, (b"WARC-Segment-Number", b"1")], block[:segment_bytes])
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if at + segment_bytes >= len(block) else []
        yield _record(
            [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", name[:-1] + b"&s=%d>" % number), *common,
             (b"WARC-Segment-Origin-ID", name), (b"WARC-Segment-Number", b"%d" % number), *last],
            block[at : at + segment_bytes],
        )


def parse_records(content: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(fields with lower-case names, block) of each record of an archive file."""
    at = 0
    while at < len(content):
        end = content.index(CRLF + CRLF, at)
        version, *lines = content[at:end].split(CRLF)
        if not version.startswith(b"WARC/"):
            raise ValueError("a WARC record doesn't begin where the last one ends")
        fields = {}
        for line in lines:
            key, _, value = line.partition(b":")
            fields[key.strip().lower()] = value.strip()
        start = end + 4
        at = start + int(fields[b"content-length"])
        if content[at : at + 4] != CRLF + CRLF:
            raise ValueError("a WARC record is cut short")
        yield fields, content[start:at]
        at += 4


def write_warc(
    pages: DataFrame,
    path: str,
    scratch: Scratch,
    revisit_bytes: int = 1000,
    segment_bytes: int = 1 << 16,
    chunk_bytes: int = 1 << 13,
    bundle_bytes: int = 2 << 20,
    bundles_per_file: int = 16,
) -> None:
    """Write the records of ``pages`` (page_id, url, html) as archive files under ``path``."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "n": F.octet_length("payload")})
    groups = rows.filter(F.col("n") >= revisit_bytes).groupBy("digest", "n")
    doubles = scratch.save(
        groups.agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and top is not null").drop("copies"), "doubles"
    )
    joined = rows.join(doubles.select(F.col("digest").alias("d"), F.col("n").alias("dn"), "top"), (F.col("digest") == F.col("d")) & (F.col("n") == F.col("dn")), "left")
    decided = joined.select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top")).alias("refers_to")
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, held, size = TaskContext.get().partitionId(), 0, [], 0
        bundle = lambda: pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)], pa.binary())], names=["records"])
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for record in page_records(*values, f"{part}.{row}", segment_bytes, chunk_bytes):
                    held.append(record)
                    size += len(record)
                    if size >= bundle_bytes:
                        yield bundle()
                        held, size = [], 0
                row += 1
        if held:
            yield bundle()

    with text_batches(spark):
        records = decided.mapInArrow(build, "records binary")
        records.select(F.col("records").cast("string").alias("value")).write.options(lineSep=SEPARATOR.decode(), maxRecordsPerFile=bundles_per_file).text(path)
    scratch.drop("doubles")


PAGE_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PAGE_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
SEGMENT_FIELDS = "origin binary, number int, total long, digest binary, block binary"


def _page(fields: dict, block: bytes | None, keep: bool) -> tuple:
    """A page's row from its fields and its whole block; raises if the payload isn't what its digest says."""
    stated = base64.b32decode(fields[b"warc-payload-digest"].removeprefix(b"sha1:"))
    page = int(fields[b"x-page-id"]) if b"x-page-id" in fields else None
    if fields[b"warc-type"] == b"revisit":
        refers = int(fields[b"warc-refers-to"].removeprefix(b"<urn:page:").removesuffix(b">"))
        return page, int(fields[b"x-payload-length"]), stated.hex(), "revisit", refers, None
    payload = http_payload(block)
    if hashlib.sha1(payload).digest() != stated:
        raise ValueError("a payload doesn't match its digest")
    return page, len(payload), stated.hex(), "response", None, payload if keep else None


def _parsed(keep: bool):
    """Rows of pages (``origin`` null) from whole records, and rows of segments from others."""
    names = [*PAGE_SCHEMA.names, "origin", "number", "total", "digest", "block"]
    kinds = [*PAGE_SCHEMA.types, pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def row(f: dict, block: bytes) -> tuple:
        if b"warc-segment-number" not in f:
            return (*_page(f, block, keep), None, None, None, None, None)
        total, page = f.get(b"warc-segment-total-length"), f.get(b"x-page-id")
        origin = f.get(b"warc-segment-origin-id", f[b"warc-record-id"])
        return (int(page) if page else None, None, None, None, None, None, origin, int(f[b"warc-segment-number"]), int(total) if total else None, f.get(b"warc-payload-digest"), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                columns = list(zip(*(row(*r) for r in parse_records(content.as_py())), strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def assemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a record from its (number, total length, block) segments; gaps and wrong totals raise."""
    ordered = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in ordered] != list(range(1, len(ordered) + 1)):
        raise ValueError("segments are missing or doubled")
    block = b"".join(s[2] for s in ordered)
    if ordered[-1][1] != len(block):
        raise ValueError("the segments' total length differs from the stated one")
    return block


def _reassemble(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                fields = {b"warc-type": b"response", b"warc-payload-digest": row["digest"]}
                if row["page_id"] is not None:
                    fields[b"x-page-id"] = b"%d" % row["page_id"]
                block = assemble([(s["number"], s["total"], s["block"]) for s in row["segments"]])
                rows.append(dict(zip(PAGE_SCHEMA.names, _page(fields, block, keep), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema=PAGE_SCHEMA)

    return run


def read_warc(spark: SparkSession, path: str, scratch: Scratch, keep_payload: bool = False) -> DataFrame:
    """A row per page of the archives under ``path``: page_id, payload_bytes, payload_digest, record_type,
    refers_to and, where asked for, the decoded payload of responses."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("content")
    fields = f"{PAGE_FIELDS}, payload binary"
    with text_batches(spark, 1):
        parsed = scratch.save(files.mapInArrow(_parsed(keep_payload), f"{fields}, {SEGMENT_FIELDS}"), "parsed")
    whole = parsed.filter("origin is null").select(*PAGE_SCHEMA.names)
    grouped = (
        parsed.filter("origin is not null")
        .groupBy("origin")
        .agg(F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.collect_list(F.struct("number", "total", "block")).alias("segments"))
        .select("page_id", "digest", "segments")
    )
    rows = whole.unionByName(grouped.mapInArrow(_reassemble(keep_payload), fields))
    return rows if keep_payload else rows.drop("payload")


def warc_round_trip(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write the archives of ``pages`` and return their pages as read back."""
    spark = pages.sparkSession
    write_warc(pages, scratch.path("archives"), scratch)
    with text_batches(spark, 1):
        return scratch.save(read_warc(spark, scratch.path("archives"), scratch), "pages")
