"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what damage leaves.

Writing uses DataFrame functions: digests, headers and blocks are column expressions, and
Spark's text writer puts one record after the other, in any store, with the two line ends
that close a record between them; a task that fails leaves no file. With compress=True each
record is a gzip member of its own, made in Arrow batches; an empty member, which
inflates to nothing, then takes the place of the line ends.

Of records with equal payloads (least_bytes or more) the one with the smallest page id is a
response; the others are revisits that name it and hold no payload.

Reading walks through a file from record to record. Each must have a version line, headers
with a length, all of its block, its closing line ends and the digests that it states; a
member must inflate and have its checksum. Where that fails, the next place is sought from
which on a record passes: the next member's first bytes or version line. What lies between
is logged as a gap with its offset, length and the reason, and reading goes on. Files are
seen through windows of WINDOW bytes; only one record is held whole. Files up to SMALL bytes
come through Spark's reader (any store), larger ones are opened by the task that reads them.

Defined results: a null payload is empty; a null or empty URL gives a record without one;
blanks and control characters in URLs are written as %XX. Rows with one page id and one
payload are alike and are both the response; a null page id ranks last. Long payloads are
written whole. Columns are found by their exact names, others don't matter. An empty table
gives archives without records, and these an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Records that a file holds at most.
RECORDS_A_FILE = 5_000
#: Files up to this size are read by Spark; others are opened in place.
SMALL = 32 * 2**20
#: Bytes of a file that are looked at together.
WINDOW = 2**18
#: Longest header of a record.
MOST_HEADER = 2**20

# The format's line ends, version lines and first bytes of a gzip member.
CRLF = "\r\n"
END = "\r\n\r\n"
VERSION = "WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
URN = "urn:tessella:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MARKS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def base32(hexadecimal: Column) -> Column:
    """Upper-case base 32 of 40 hexadecimal digits: eight digits for every ten."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(data: Column) -> Column:
    return base32(F.sha1(data))


def prepared(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), size, digest and original: the id of the response that a revisit refers to, else null."""
    plain = common.pick(pages, "page_id", "url", "html").withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "utf-8")).drop("html")
    keyed = plain.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("digest", digest(F.col("payload")))
    first = keyed.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("size") >= least_bytes))
    first = common.materialize(first, "firsts")
    out = common.join_counted(keyed, first, ["digest", "size"], "left", wide=True)
    return out.withColumn("original", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def _record_id(page: Column, key: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), key, F.lit(">"))


def _safe(url: Column) -> Column:
    """The URL with blanks and control characters as %XX."""
    chars = F.split(url, "")
    escaped = F.array_join(F.transform(chars, lambda c: F.when(c.rlike(r"^[\x00-\x20\x7F]$"), F.concat(F.lit("%"), F.hex(F.encode(c, "utf-8")))).otherwise(c)), "")
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), escaped).otherwise(url)


def records(pages: DataFrame, date: str = "2026-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """One column record (binary): headers and block of a record for each page, without the closing line ends."""
    rows = prepared(pages, least_bytes)
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(END))
    rows = rows.withColumn("block", F.concat(F.encode(http, "utf-8"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.length("url") > 0, line("WARC-Target-URI", _safe(F.col("url")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), digest(F.col("block")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("original"), F.col("digest"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF),
    )
    return rows.select(F.concat(F.encode(header, "utf-8"), F.col("block")).alias("record"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.column("record"):
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(row.as_py() + END.encode(), 6, mtime=0)], pa.binary())], ["record"])


def write(pages: DataFrame, path: str, compress: bool = False, records_a_file: int = RECORDS_A_FILE, **parameters) -> None:
    """Writes archives of the pages below path: plain ones, or members of one record each."""
    made = records(pages, **parameters)
    end = END
    if compress:
        made, end = made.mapInArrow(_members, "record binary"), gzip.compress(b"", mtime=0).decode("latin1")
    out = made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", end).option("encoding", "ISO-8859-1")
    out.option("maxRecordsPerFile", records_a_file).mode("overwrite").text(path)


class Window:
    """Random access to a file in pieces of bounded size."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        self.size = file.seek(0, 2)
        self.at, self.held = 0, b""

    def read(self, at: int, size: int) -> bytes:
        if not (self.at <= at and at + size <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(size, WINDOW))
        return self.held[at - self.at : at - self.at + size]

    def find(self, what: bytes, at: int, most: int) -> int:
        """Place of what at or after at, within most bytes, or -1."""
        stop = min(self.size, at + most)
        while at < stop:
            found = self.read(at, min(WINDOW, stop - at)).find(what)
            if found >= 0:
                return at + found
            at += max(1, min(WINDOW, stop - at) - len(what) + 1)
        return -1

    def next_mark(self, at: int) -> int:
        """First byte at or after at that may begin a member or a record; the end if there is none."""
        while at < self.size:
            found = MARKS.search(self.read(at, WINDOW))
            if found:
                return at + found.start()
            at += max(1, WINDOW - 16)
        return self.size


class Bad(ValueError):
    """A record or member that fails a check."""


def _checked(header: bytes, block: bytes) -> dict:
    """Headers, payload and digests of a record."""
    first, *lines = header.decode("utf-8", "replace").split(CRLF)
    fields = {}
    for x in lines:
        name, colon, value = x.partition(":")
        if x and not colon:
            raise Bad("header line without a colon")
        fields.setdefault(name.strip().lower(), value.strip())
    sha = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    stated = fields.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != sha(block):
        raise Bad("block digest")
    kind, payload = fields.get("warc-type"), block
    if fields.get("content-type", "").startswith("application/http"):
        http, end, payload = block.partition(END.encode())
        if not end:
            raise Bad("HTTP header without an end")
        length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", b"\r\n" + http)
        size = int(length[1]) if length else len(payload)
    else:
        size = len(payload)
    stated = fields.get("warc-payload-digest", "")
    if kind != "revisit" and stated.startswith("sha1:") and stated[5:] != sha(payload):
        raise Bad("payload digest")
    return {"fields": fields, "payload": None if kind == "revisit" else payload, "payload_bytes": size if kind == "revisit" else len(payload), "payload_digest": stated[5:] if kind == "revisit" else sha(payload)}


def _plain(file: Window, at: int) -> tuple[int, list[dict]]:
    """The record at a version line: its end, and what it holds."""
    if not re.match(rb"WARC/1\.[01]\r\n", file.read(at, 10)):
        raise Bad("no version line")
    end = file.find(END.encode(), at, MOST_HEADER)
    if end < 0:
        raise Bad("header without an end")
    header = file.read(at, end - at)
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", header)
    if not length:
        raise Bad("no length")
    start, size = end + len(END), int(length[1])
    if start + size + len(END) > file.size:
        raise Bad("cut off")
    if file.read(start + size, len(END)) != END.encode():
        raise Bad("no line ends after the block")
    return start + size + len(END), [_checked(header, file.read(start, size))]


def _member(file: Window, at: int) -> tuple[int, list[dict]]:
    """The gzip member at a place: its end, and the records that it holds; all of it must pass."""
    inflate, place, out = zlib.decompressobj(31), at, io.BytesIO()
    try:
        while not inflate.eof:
            piece = file.read(place, WINDOW)
            if not piece:
                raise Bad("cut off")
            out.write(inflate.decompress(piece))
            place += len(piece)
    except zlib.error as e:
        raise Bad("member can't be inflated or its checksum fails") from e
    inner, found, pos = Window(out), [], 0
    while pos < inner.size:
        pos, some = _plain(inner, pos)
        found += some
    return place - len(inflate.unused_data), found


def salvage(file: BinaryIO) -> Iterator[dict]:
    """Records (offset, length, fields, payload, ...) and gaps (offset, length, reason) of an archive, in order; together they cover all of it."""
    window = Window(file)
    at, gap, reason = 0, None, ""
    while at < window.size:
        try:
            to, found = (_member if window.read(at, 3) == MEMBER else _plain)(window, at)
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            at = window.next_mark(at + 1)
            continue
        if gap is not None:
            yield {"offset": gap, "length": at - gap, "reason": reason}
            gap = None
        for x in found:
            yield {"offset": at, "length": to - at, "reason": None} | x
        at = to
    if gap is not None:
        yield {"offset": gap, "length": window.size - gap, "reason": reason}


READ = (
    "path string, offset bigint, length bigint, reason string, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary, headers map<string,string>"
)


def _row(path: str, x: dict, payloads: bool) -> tuple:
    f = x.get("fields")
    place = (path, x["offset"], x["length"], x["reason"])
    if f is None:
        return (*place, *[None] * 8)
    own = (f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-refers-to"))
    return (*place, *own, x["payload_digest"], x["payload_bytes"], x["payload"] if payloads else None, list(f.items()))


def _reader(payloads: bool):  # noqa: ANN202
    schema = pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
        ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string())),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                if "content" in batch.schema.names:
                    file = pa.BufferReader(batch.column("content")[i].as_buffer())
                else:
                    import pyarrow.fs

                    store, place = pyarrow.fs.FileSystem.from_uri(path)
                    file = store.open_input_file(place)
                rows, size = [], 0
                for x in salvage(file):
                    rows.append(_row(path, x, payloads))
                    size += len(x.get("payload") or b"") * payloads + 500
                    if size > WINDOW:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return read


def read(spark: SparkSession, path: str, payloads: bool = True, small: int = SMALL) -> DataFrame:
    """Every record and gap of the archives at path, a file, folder or pattern; a gap has a reason and nothing else but its place.

    Files are taken whatever their names are, but for those that begin with _ or a dot.
    """
    files = spark.read.format("binaryFile").load(path)
    few = files.where(F.col("length") <= small).select("path", "content").mapInArrow(_reader(payloads), READ)
    large = files.where(F.col("length") > small).select("path")
    return few.unionByName(large.mapInArrow(_reader(payloads), READ))


def gaps(read: DataFrame) -> DataFrame:
    """The quarantine log: path, offset, length and reason of every stretch of bytes that holds no sound record."""
    return read.where(F.col("reason").isNotNull()).select("path", "offset", "length", "reason")


def page_of(record_id: Column) -> Column:
    """The page id in a record id that write() made."""
    return F.nullif(F.regexp_extract(record_id, f"^<{URN}(-?[0-9]*):", 1), F.lit("")).cast("bigint")


def round_trip(pages: DataFrame, compress: bool = False, least_bytes: int = 0) -> DataFrame:
    """Writes archives of the pages and reads them: page_id, payload_bytes, payload_digest, record_type and refers_to of every record.

    A gap in them is an error, since nothing may be lost between writing and reading.
    """
    spark = pages.sparkSession
    with common.scope() as kept:
        path = common.new_path(spark, "warc")
        write(pages, path, compress, least_bytes=least_bytes)
        found = common.materialize(read(spark, path, payloads=False).drop("payload", "headers"), "records", gaps=F.count("reason"))
        kept.append(found)
    if common.total(found, "gaps"):
        raise ValueError("an archive that was just written can't be read back whole")
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
