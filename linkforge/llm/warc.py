"""WARC archives: a deduplicating writer and a salvage reader.

The reader checks every record (member checksum, version line, lengths, separators, digests).
After a failed check it searches for the next valid gzip member or version line, goes on there,
and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import shared_dir, staged, text_slices

VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 16
_MOST_HEADERS = 4 << 20
_FIRST_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
_BEGIN = re.compile(rb"WARC/|\x1f\x8b\x08")
_LENGTH = re.compile(r"[0-9]{1,18}")
#: Longer URLs are written among the block's HTTP headers, so that no record's own headers pass _MOST_HEADERS.
_MOST_URL = 1 << 20


class Damaged(ValueError):
    """A check of a record or gzip member failed."""


@dataclass
class Record:
    offset: int
    length: int  # bytes of the archive that hold the record (of its gzip member, if compressed)
    headers: dict[str, str]  # names in lower case
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block without HTTP headers, where it has them."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32_sha1_column(payload) -> F.Column:
    """The same of a binary column: each 20 bits are 4 base32 digits."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _escaped(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [_escaped(f"{k}: {v}") for k, v in headers]
    return VERSION + "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The record of one page: ``response`` with its payload, or ``revisit`` with only the HTTP headers."""
    far = url is not None and len(url) > _MOST_URL
    place = f"Content-Location: {_escaped(url)}\r\n".encode() if far else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%bContent-Length: %d\r\n\r\n" % (place, len(payload))
    block = http + payload if refers_to is None else http
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None and not far:
        headers.append(("WARC-Target-URI", url))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return record_bytes(headers, block)


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# --- salvage reader


class _Bytes:
    """Reads of a seekable file by offset."""

    def __init__(self, file) -> None:
        self.file, self.size = file, file.seek(0, io.SEEK_END) or file.tell()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)


def _plain_record(source: _Bytes, at: int) -> Record:
    """The uncompressed record at ``at``; Damaged if a check fails. The block is read only if its separator is where it should be."""
    head, end = b"", -1
    while end < 0:
        more = source.read(at + len(head), _CHUNK)
        if not more or len(head) > _MOST_HEADERS:
            raise Damaged("headers don't end")
        seen, head = max(0, len(head) - 3), head + more
        if not _FIRST_LINE.match(head[:16]):
            raise Damaged("no version line")
        end = head.find(b"\r\n\r\n", seen)
    headers = {}
    for line in head[: end + 2].split(b"\r\n")[1:-1]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        raise Damaged("a mandatory header is missing")
    if not _LENGTH.fullmatch(headers.get("content-length", "")):
        raise Damaged("no length")
    start, size = at + end + 4, int(headers["content-length"])
    if start + size + 4 > source.size:
        raise Damaged("truncated")
    if source.read(start + size, 4) != b"\r\n\r\n":
        raise Damaged("no separator after the block")
    record = Record(at, end + 4 + size + 4, headers, source.read(start, size))
    for name, data in (("warc-block-digest", record.block), ("warc-payload-digest", record.payload)):
        kind, _, digest = headers.get(name, "").partition(":")
        if kind == "sha1" and not (name == "warc-payload-digest" and headers.get("warc-type") == "revisit") and base32_sha1(data) != digest.upper():
            raise Damaged(f"{name} differs")
    return record


def _member(source: _Bytes, at: int) -> tuple[IO[bytes], int]:
    """(contents, end) of the gzip member at ``at``, with its checksum and length checked; contents over 32 MiB lie in a temporary file."""
    unpacker, out, end = zlib.decompressobj(31), tempfile.SpooledTemporaryFile(32 << 20), at
    try:
        while not unpacker.eof:
            data = unpacker.unconsumed_tail or source.read(end, _CHUNK)
            if not data:
                raise Damaged("truncated member")
            end += 0 if unpacker.unconsumed_tail else len(data)
            out.write(unpacker.decompress(data, 1 << 20))
    except zlib.error as e:
        raise Damaged(f"member: {str(e)[:60]}") from None
    return out, end - len(unpacker.unused_data)


def _valid_at(source: _Bytes, at: int) -> bool:
    """Whether a record begins here, or a gzip member with a version line first."""
    try:
        if source.read(at, 3) != _MAGIC:
            return bool(_plain_record(source, at))
        with _member(source, at)[0] as inside:
            inside.seek(0)
            return bool(_FIRST_LINE.match(inside.read(16)))
    except Damaged:
        return False


def _next_valid(source: _Bytes, at: int) -> int:
    """Where the next valid member or version line begins, whatever stands before it; each byte is searched once."""
    step = 1 << 14
    while at < source.size:
        data = source.read(at, step + 4)
        for found in _BEGIN.finditer(data):
            if found.start() < step and _valid_at(source, at + found.start()):
                return at + found.start()
        at, step = at + step, min(1 << 20, 2 * step)
    return source.size


def salvage(file) -> Iterator[Record | Gap]:
    """All records of an archive, plain or of gzip members, in order, and the byte gaps between that failed a check.

    Records (members, where they are compressed) and gaps cover the archive's bytes without overlap, and no damage raises.
    """
    source, at = _Bytes(file), 0
    while at < source.size:
        try:
            if source.read(at, 3) == _MAGIC:
                inside, end = _member(source, at)
                with inside:
                    for x in salvage(inside):
                        if isinstance(x, Gap):
                            yield Gap(at, end, f"in member: {x.reason}")
                        else:
                            yield Record(at, end - at, x.headers, x.block)
                at = end
            else:
                record = _plain_record(source, at)
                yield record
                at += record.length
        except Damaged as e:
            after = _next_valid(source, at + 1)
            yield Gap(at, after, str(e))
            at = after


# --- DataFrame operators


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, payload_digest, refers_to)``: the smallest id with a payload keeps it, others refer to it.

    Payloads below ``least_bytes`` are never referred to. Null html is an empty payload. Null ids are
    larger than all others; if a payload has only null ids, each keeps it. Rows that repeat the smallest id keep it too.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("payload_digest", base32_sha1_column("payload"))
    small = pages.select(F.col(id_col).cast("long").alias("page_id"), payload.alias("payload")).where(F.octet_length("payload") >= least_bytes)
    # only digests that repeat are looked up; the partial aggregate merges copies before the shuffle
    seen = small.select("page_id", base32_sha1_column("payload").alias("payload_digest")).groupBy("payload_digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    least = seen.where("n > 1 and least is not null").select("payload_digest", "least")
    revisit = ~F.col("page_id").eqNullSafe(F.col("least")) & F.col("least").isNotNull() & (F.octet_length("payload") >= least_bytes)
    return base.join(least, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", F.when(revisit, F.col("least")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, roll_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", compress: bool = True) -> DataFrame:
    """Write the records of ``mark_revisits`` as archives of about ``roll_bytes`` each; returns their manifest ``(path, records, bytes)``.

    File names carry the partition and the task attempt; only committed attempts are in the
    manifest, so a task that is run again after a lost executor leaves no duplicates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        system, top = pafs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        done, out, held, count = [], None, 0, 0

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name}", count, held))

        for part in text_slices(batches, "payload", 8 << 20):
            for page_id, url, payload, digest, refers_to in zip(*(part.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))):
                if out is None:
                    name = f"{stem}-{len(done):04d}.warc" + ".gz" * compress
                    out, held, count = system.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                data = page_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date)
                data = gzip_member(data) if compress else data
                out.write(data)
                held, count = held + len(data), count + 1
                if held >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return staged(records.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", urn or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


ROWS = "path string, offset long, length long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _row(path: str, x: Record | Gap) -> tuple:
    if isinstance(x, Gap):
        return path, x.start, x.end - x.start, x.reason, None, None, None, None, None, None
    kind, payload = x.headers.get("warc-type"), x.payload
    if kind == "revisit":  # the payload is elsewhere; the HTTP headers tell its length
        size = re.search(rb"(?i)\r\ncontent-length: *([0-9]{1,18})\r\n", x.block)
        n, digest = int(size[1]) if size else None, x.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        n, digest = len(payload), base32_sha1(payload)
    url = x.headers.get("warc-target-uri")
    if url is None and (place := re.match(rb"(?is)[^\r]*\r\n(?:[^\r]*\r\n)*?content-location: ([^\r]*)\r\n", x.block)):
        url = place[1].decode("utf-8", "replace")
    return path, x.offset, x.length, None, _number(x.headers.get("warc-record-id")), url, kind, _number(x.headers.get("warc-refers-to")), n, digest


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for every record and every quarantined gap (``reason`` not null) of the archives in ``paths(path)``.

    ``payloads`` adds the payload as a binary column. Memory is bounded by the largest record.
    """
    names = [c.split(" ")[0] for c in ROWS.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = pafs.FileSystem.from_uri(path)
                rows, data, held = [], [], 0

                def flushed() -> pa.RecordBatch:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    return pa.RecordBatch.from_arrays(columns + [pa.array(data, pa.binary())] * payloads, names + ["payload"] * payloads)

                with system.open_input_file(inner) as file:
                    for x in salvage(file):
                        rows.append(_row(path, x))
                        if payloads:
                            data.append(x.payload if isinstance(x, Record) else None)
                            held += len(data[-1] or b"")
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield flushed()
                            rows, data, held = [], [], 0
                if rows:
                    yield flushed()

    many = max(1, paths.count())
    return paths.select("path").repartition(many).mapInArrow(run, ROWS + ", payload binary" * payloads)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write all pages as WARC records and read the archives back: one row a page, plus one a gap, as ``read_archives`` returns them.

    Empty tables give no archives and no rows; repeated rows give repeated records; other columns are ignored.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(mark_revisits(pages, id_col, url_col, html_col), folder))
