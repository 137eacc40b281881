"""WARC archives: a writer with revisit records, and a salvage reader.

Writing: payloads that occur more than once are found by digest; one page keeps
the payload (response), the others refer to it (revisit).  Every record is a gzip
member of its own.  The members go through Spark's text writer, so files are
committed like any other table and land in whatever store the path names: a gzip
member ends in the high byte of its length, which is zero, and the writer's line
separator is that byte.

Reading: each archive is walked member by member, or record by record where it is
not compressed.  After a failed check (broken deflate data, checksum, header,
length or digest) the reader logs the bytes as a quarantined gap and searches for
the next member that opens with a version line, or the next version line, and
goes on from there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm.common import Staged, pieces

#: Payloads below this are never revisited; rows of a broadcast table of repeated payloads.
REVISIT_BYTES, BROADCAST_ROWS = 1000, 200_000
#: Bytes of compressed records that are handed to the writer as one row (a row ends with the
#: record that reaches them), and such rows of a file: files hold about 16 MB, or one larger record.
ROW_BYTES, FILE_ROWS = 2 << 20, 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/[01]\.\d+\r?\n")
#: Bytes that are inflated at once, and near damage.
STEP, FINE_STEP = 1 << 16, 64
#: Header lines that a record has once.
ONCE = frozenset(("warc-type", "warc-record-id", "warc-date", "content-length"))


def _uri(page_id) -> str:
    return f"<urn:vicinage:page:{'' if page_id is None else page_id}>"


def _page(uri: str):
    tail = uri.strip("<>").rpartition(":")[2]
    return int(tail) if re.fullmatch(r"-?\d+", tail) else None


def record(page_id, url: str | None, payload: bytes, digest: bytes, size: int, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the response's head without payload."""
    target = "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "about:blank")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *([f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte (very long data get an empty member after them)."""
    def one(x: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    member = one(data)
    return member if member[-1] == 0 else member + one(b"")


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record a row into archives below ``path``.

    Null html is an empty payload.  Of rows with equal payloads of at least
    ``REVISIT_BYTES`` the largest id is the response (all its rows, if it is
    repeated); the others revisit it.  An empty table gives an empty folder.
    Other columns of ``pages`` are ignored.  Files are rolled by bytes, so a very
    long payload makes a file of its own or closes one early; one record has to fit
    into a row of Spark (2 GB compressed).

    Repeated payloads are found in a map-side aggregate of digests.  If they are
    few they are broadcast and pages are written without any shuffle; else pages
    are joined by digest, and adaptive execution splits a hot one.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    source = source.withColumn("digest", F.unhex(F.sha1("html"))).withColumn("size", F.octet_length("html").cast("long"))
    large = source.where(F.col("size") >= REVISIT_BYTES)
    repeated = large.groupBy(F.col("digest").alias("r_digest")).agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    staged = Staged(repeated, "repeated")
    repeated = F.broadcast(staged.df) if staged.df.count() <= BROADCAST_ROWS else staged.df
    joined = source.join(repeated, (F.col("digest") == F.col("r_digest")) & (F.col("size") >= REVISIT_BYTES), "left")
    typed = joined.select("page_id", "url", "html", "digest", "size", "original", (F.col("r_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))).alias("revisit"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(parts: list[bytes]) -> pa.RecordBatch:  # the writer adds the last zero byte
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["value"])

        out, held = [], 0
        for rows in batches:
            for some in pieces(rows, 2):
                for page_id, url, html, digest, size, original, revisit in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    out.append(gzip_member(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, size, original, revisit, date)))
                    held += len(out[-1])
                    if held >= ROW_BYTES:
                        yield row(out)
                        out, held = [], 0
        if out:
            yield row(out)

    written = typed.mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", "\u0000").option("maxRecordsPerFile", FILE_ROWS).text(path)
    staged.drop()


class Broken(ValueError):
    """A record or member that fails a check."""


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """What the member at ``at`` holds, where it ends and, where it fails, why.  Of a
    member that fails, what was inflated before is returned; its end is not known then."""
    z, parts, pos, step = zlib.decompressobj(31), [], at, STEP
    while not z.eof:
        if pos >= len(data):
            return b"".join(parts), len(data), "cut member"
        copy = z.copy() if step == STEP else None
        try:
            parts.append(z.decompress(data[pos : pos + step]))
        except zlib.error as e:
            if copy is None:
                return b"".join(parts), pos, str(e)
            z, step = copy, FINE_STEP  # once more in small steps, to get what lies before the damage
            continue
        pos += step
    return b"".join(parts), min(pos, len(data)) - len(z.unused_data), None


def _opens_record(data: memoryview, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 256], 8)[:5] == b"WARC/"
    except zlib.error:
        return False


def parse(data: bytes, at: int = 0, *, verified: bool = False) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; raises :class:`Broken`.  ``verified``:
    only a record whose own digest confirms it will do."""
    if not VERSION.match(data, at):
        raise Broken("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Broken("no end of header")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header line")
        name = name.strip().lower().decode("latin-1")
        if name in head and name in ONCE:  # a cut header that runs into the next record's
            raise Broken("repeated header line")
        head[name] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Broken("no length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Broken("length")
    block = data[start:stop]
    said = head.get("warc-block-digest", "")
    if (said or verified) and said != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise Broken("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    return {"head": head, "payload": payload, "size": int(size[1]) if size else len(payload)}, stop + 4


class _Next:
    """Where a pattern stands next in the data; every byte is searched once, however
    often one asks, as long as places ascend."""

    def __init__(self, find):
        self._find, self._known = find, -1

    def __call__(self, after: int) -> int:
        if self._known < after:
            self._known = self._find(after)
        return self._known


def walk(data: bytes) -> Iterator[tuple]:
    """``("record", offset, length, record)`` and ``("gap", offset, length, reason)``
    in file order; together they cover the file but for padding bytes.

    A gzip member may hold several records: each has the member's offset, and the
    first of them its length.  Of a member that fails its check the records that
    their own block digest confirms are kept (length 0), and the member is a gap.  A
    part of a member that holds no valid record is a gap of length 0 at its offset."""
    view, at = memoryview(data), 0

    def line(after: int) -> int:
        found = VERSION.search(data, after)
        return found.start() if found else len(data)

    def magic(after: int) -> int:
        pos = data.find(MAGIC, after)
        return pos if pos >= 0 else len(data)

    next_line, next_magic = _Next(line), _Next(magic)

    def resume(after: int) -> int:
        """Start of the next valid member or version line."""
        stop = next_line(after)
        while (pos := next_magic(after)) < stop:
            if _opens_record(view, pos):
                return pos
            after = pos + 1
        return stop

    while at < len(data):
        if data[at : at + 3] == MAGIC:
            text, end, fault = _inflate(view, at)
            if fault is None and not _opens_any(text):
                fault = "no version line" if text else None  # an empty member is padding
            if fault is not None:
                for found in _salvaged(text):
                    if not isinstance(found, str):
                        yield "record", at, 0, found
                end = resume(at + 1)
                yield "gap", at, end - at, fault
            else:
                length = end - at
                for found in _salvaged(text, verified=False):
                    if isinstance(found, str):
                        yield "gap", at, 0, found
                    else:
                        yield "record", at, length, found
                        length = 0
                if length and text:  # nothing in it is valid
                    yield "gap", at, length, "no valid record"
            at = end
        elif data[at] in b"\r\n\0":
            at += 1
        else:
            try:
                found, end = parse(data, at)
                yield "record", at, end - at, found
            except Broken as e:
                end = resume(at + 1)
                yield "gap", at, end - at, str(e)
            at = end


def _opens_any(text: bytes) -> bool:
    return VERSION.search(text) is not None


def _salvaged(text: bytes, *, verified: bool = True) -> Iterator[dict | str]:
    """The records of an inflated member, and the reasons of what lies between."""
    at = 0
    while at < len(text):
        if text[at] in b"\r\n\0":
            at += 1
            continue
        try:
            found, at = parse(text, at, verified=verified)
            yield found
        except Broken as e:
            yield str(e)
            after = VERSION.search(text, at + 1)
            at = after.start() if after else len(text)


READ_SCHEMA = "archive string, offset long, length long, kind string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, reason string"


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """One row a record (``kind`` response or revisit) and one a quarantined gap
    (``kind`` gap, ``reason``), by archive and byte offset.  ``payload_digest`` is
    the bare hex SHA-1 and ``payload_bytes`` the length of the full payload, of a
    revisit that of the response it refers to.  Empty files and folders give no rows.
    A file is one row of ``binaryFile`` (2 GB at most) and one task's work; files of
    :func:`write_archives` are far smaller."""
    schema = READ_SCHEMA + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(found: Iterator[tuple], archive: str) -> Iterator[tuple]:
        for kind, offset, length, x in found:
            if kind == "gap":
                yield (archive, offset, length, "gap", None, None, None, None, None, x) + (None,) * with_payload
                continue
            head = x["head"]
            said = head.get("warc-payload-digest", "").rpartition(":")[2]
            try:
                digest = base64.b32decode(said).hex()
            except ValueError:
                digest = None
            revisit = head.get("warc-type") == "revisit"
            yield (archive, offset, length, head.get("warc-type"), _page(head.get("warc-record-id", "")), head.get("warc-target-uri"), x["size"], digest, _page(head.get("warc-refers-to", "")) if revisit else None, None) + ((x["payload"],) if with_payload else ())

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

        for files in batches:
            for archive, content in zip(files.column(0), files.column(1), strict=True):
                some = []
                for row in rows(walk(content.as_py()), archive.as_py()):
                    some.append(row)
                    if len(some) >= 512:
                        yield batch(some)
                        some = []
                if some:
                    yield batch(some)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)
