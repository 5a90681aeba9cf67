"""WARC archives with resolved revisits (operator 8).

Headers (page, payload digest, length) are grouped by digest; of records with equal
payloads the one with the largest page id is the response and the others become
revisit records that name it. Archives are WARC 1.1 in gzip, one member for each record, and
each file begins with a warcinfo record. A task puts members together until a file has
`file_bytes`; such a file is a row, which Spark's text sink writes as it is, on any
store that Spark writes, with its commit protocol. (That sink ends a row with a
separator of one byte at least: the last byte of a gzip member is one of its length's
high bytes, zero below 16 MB, so zero is the separator, and longer records are several members.)

Reading takes the files, of bounded size, as binary, walks them member by member and the
records by their Content-Length, recomputes each payload's digest, and joins revisits by
digest with the responses; a revisit without its response is an error, not a lost row.

Skew: a payload with a third of all pages is one row after the pre-aggregated
grouping, and the joins have written tables on their grouped side, so that adaptive
execution splits the pages of one digest over tasks.

Defined cases: a null payload is an empty one; a null page id is the smallest, has no
Page-ID header, and is null again when read; a null URL has no header; rows equal in
page id and payload are all responses, if that id is the largest, and then no revisit
names one of them by its record id (WARC-Refers-To may be left out); payloads below
`min_bytes` are all responses; line breaks in a URL are dropped; an empty table
writes an archive without records; other columns are not read; a record beyond
`file_bytes` is a file of its own.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.shared import Scratch

END = "\r\n\r\n"
FILE_BYTES = 32 << 20
#: Of compression; most of what a higher one costs buys little on records this small.
LEVEL = 3
#: A gzip member of fewer bytes than this has a length whose last byte is zero.
MEMBER_BYTES = 1 << 24
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hex digits: ten digits are 40 bits, and those eight digits to the base of 32."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _named(page: Column, url: Column, digest: Column) -> Column:
    """The record id of a response that others may refer to."""
    return _record_id(F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), digest)))


def _record_id(h: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), *(x for k, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str | None = None, scratch: Scratch | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write one record for each row of pages, responses with their payload and revisits without.

    `file_bytes` keeps files small enough to be held by one task; a file has more only if one record has.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.translate(F.col(url_col).cast("string"), "\r\n", "").alias("url"), payload.alias("payload"))
    rows = rows.select("*", base32_of_hex(F.sha1("payload")).alias("digest"), F.xxhash64("payload").alias("check"), F.octet_length("payload").cast("long").alias("size"))
    same = ["digest", "check", "size"]
    # rows of one page and payload are counted first, which pre-aggregates and shows repeated ones
    each = rows.where(F.col("size") >= min_bytes).groupBy(*same, "page").agg(F.count("*").alias("n"), F.max("url").alias("url"))
    groups = each.groupBy(*same).agg(F.sum("n").alias("n"), F.max(F.struct("page", "url", "n")).alias("first")).where("n > 1")
    groups = scratch.keep(groups.select(*(F.col(c).alias(c + "_") for c in same), F.col("first.page").alias("first_page"), F.col("first.url").alias("first_url"), (F.col("first.n") == 1).alias("sole"), F.lit(True).alias("shared")), "groups")
    found = rows.join(groups, [F.col(c) == F.col(c + "_") for c in same], "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page").eqNullSafe(F.col("first_page"))
    found = found.select("*", revisit.alias("revisit"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value)

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    on_revisit = lambda c: F.when(F.col("revisit"), c)
    record_id = F.when(F.col("sole") & ~F.col("revisit"), _named(F.col("page"), F.col("url"), F.col("digest"))).otherwise(_record_id(F.replace(F.uuid(), F.lit("-"))))
    refers = F.when(F.col("sole"), _named(F.col("first_page"), F.col("first_url"), F.col("digest")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        on_revisit(line("WARC-Profile", F.lit(PROFILE))),
        on_revisit(line("WARC-Refers-To", refers)),
        on_revisit(line("WARC-Refers-To-Target-URI", F.col("first_url"))),
        line("Page-ID", F.col("page").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
    )
    record = F.concat(head.cast("binary"), F.lit(END.encode()), http.cast("binary"), body, F.lit(END.encode()))
    files = found.select(record.alias("record")).mapInArrow(_files(date, file_bytes), "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def member(record: bytes) -> bytes:
    """A record as one gzip member; as several, where one would be too long for the separator."""
    out = []
    for at in range(0, len(record), MEMBER_BYTES - 1):
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out += [pack.compress(record[at : at + MEMBER_BYTES - 1]), pack.flush()]
    return b"".join(out)


def _files(date: str, file_bytes: int):
    """Whole files from a task's records; the last byte of each, a zero, is left to the separator."""

    def info() -> bytes:
        fields = b"software: tidewheel\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}{END}"
        return member(head.encode() + fields + END.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [info()], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["content"])
        for batch in batches:
            for record in batch.column(0):
                packed = member(record.as_py())
                if size and size + len(packed) > file_bytes:
                    yield whole()
                    held, size = [info()], 0
                held.append(packed)
                size += len(packed)
        if size:
            yield whole()

    return run


def unpacked(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a gzip file, member after member, as they come."""
    at, view = 0, memoryview(content)
    while at < len(view):
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            yield unpack.decompress(view[at : at + step])
            at += step
        at -= len(unpack.unused_data) + max(0, at - len(view))


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one gzipped file, which is held in part only."""
    pieces, buffer, mark = unpacked(content), bytearray(), END.encode()

    def upto(size: int) -> bool:
        while len(buffer) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while upto(1):
        seen = 0
        while (stop := buffer.find(mark, max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not upto(seen + 1):
                raise ValueError("a WARC record is cut off")
        lines = buffer[:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record where one is due: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        if not upto(stop + 4 + size + 4) or buffer[stop + 4 + size : stop + 8 + size] != mark:
            raise ValueError("a WARC record is cut off")
        block = bytes(buffer[stop + 4 : stop + 4 + size])
        del buffer[: stop + 8 + size]
        yield head, block


READ = "page_id long, record_id string, record_type string, refers string, payload_bytes long, payload_digest string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit, as its bytes say; a revisit has no payload of its own and its digest from the header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for head, block in records(content.as_py()):
                    if head["WARC-Type"] not in ("response", "revisit"):
                        continue
                    payload = block[block.index(END.encode()) + 4 :]
                    page = head.get("Page-ID")
                    if head["WARC-Type"] == "response":
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if head["WARC-Payload-Digest"] != "sha1:" + digest:
                            raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
                        own = (len(payload), digest)
                    else:
                        own = (None, head["WARC-Payload-Digest"].removeprefix("sha1:"))
                    rows.append((None if page is None else int(page), head["WARC-Record-ID"], head["WARC-Type"], head.get("WARC-Refers-To"), *own))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def read_pages(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits resolved by the digest that they share with a response.

    Of several responses with one payload, the one with the largest page id is referred to. A revisit whose response is
    not there, or is not the record that it names, is an error.
    """
    rows = scratch.keep(read_records(spark, path), "records")
    responses, revisits = rows.where("record_type = 'response'"), rows.where("record_type = 'revisit'")
    first = responses.groupBy("payload_digest").agg(F.max(F.struct("page_id", "payload_bytes", "record_id")).alias("r"))
    named = scratch.keep(first.select(F.col("payload_digest").alias("digest_"), F.col("r.page_id").alias("refers_to"), F.col("r.payload_bytes").alias("bytes_"), F.col("r.record_id").alias("id_")), "responses")
    lost = F.col("id_").isNull() | (F.col("refers") != F.col("id_"))
    missing = F.raise_error(F.concat(F.lit("no response for the revisit "), F.col("record_id"))).cast("long")
    size = F.when(F.coalesce(lost, F.lit(False)), missing).otherwise(F.col("bytes_"))
    resolved = revisits.join(named, F.col("payload_digest") == F.col("digest_"), "left").select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(resolved)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write an archive in the shared folder and return what reading it gives."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archive")
    write_archive(pages, path, scratch=scratch, **options)
    return read_pages(pages.sparkSession, path, scratch)
