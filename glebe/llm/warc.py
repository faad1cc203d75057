"""Web archives: records written as gzip members, and a salvage reader for damaged archives.

The reader checks each member and record. After a failed check it searches on for the next gzip member or version line
that passes the checks, recovers what follows, and tells the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glebe.llm.common import in_batches, rows_of

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROW = "urn:x-row:"
#: Longer headers are damage.
HEADER_BYTES = 1 << 20
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")
_START = re.compile(re.escape(_MEMBER) + b"|" + _VERSION.pattern)
_END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, key: str | None, url: str | None, date: str, digest: str, size: int, payload: bytes,
            refers_to: str | None) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    headers = {"WARC-Type": kind, "WARC-Record-ID": f"<{_ROW}{_header(key)}>", "WARC-Date": date}
    if url is not None:
        headers["WARC-Target-URI"] = _header(url)
    if refers_to is not None:
        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{_ROW}{_header(refers_to)}>"}
    headers |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
                "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + _END


def _header(value: str | None) -> str:
    """A value on one line; control characters and per cent signs as %XX."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m.group()):02X}", value) if value is not None else ""


def _unheader(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m.group(1), 16)), value)


def write_archives(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, date: str = DATE, level: int = 6) -> None:
    """One record per row, as gzip members in the files of a folder.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the largest key are responses and the
    others revisits that refer to it; smaller ones are all responses, and so are equal payloads without any key. A
    null payload is empty. Rows with equal payloads meet in one join that may be split; payloads are sent once.

    Spark's text writer lays the files, one member a line: a member's last byte is the zero that ends a line here.
    (The last byte of a member is the top byte of its size. From 16 MB on an empty member is added, which ends so.)
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key_col).alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha1(payload).alias("sha1"))
    equal = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(
        F.max("key").alias("response"), F.count("*").alias("n")).filter("n > 1").select("sha1", "response")
    told = rows.join(equal, "sha1", "left")
    refers = F.when((F.octet_length("payload") >= min_bytes) & ~F.col("key").eqNullSafe(F.col("response")), F.col("response"))
    told = told.select(F.col("key").cast("string").alias("key"), "url", "payload", refers.cast("string").alias("refers"))

    def members(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for key, url, data, refers_to in rows_of(batch, "key", "url", "payload", "refers"):
                digest = payload_digest(data)
                kind = "response" if refers_to is None else "revisit"
                record = _record(kind, key, url, date, digest, len(data), data if refers_to is None else b"", refers_to)
                member = gzip.compress(record, level, mtime=0)
                member = member if member[-1] == 0 else member + gzip.compress(b"", mtime=0)
                out.append(member[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    (in_batches(told, members, "member binary").select(F.col("member").cast("string").alias("value"))
     .write.option("lineSep", "\0").text(path))


@dataclass
class Piece:
    """A record, or a gap if ``reason`` is set, at a place in an archive."""

    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str | None = None


class _Damaged(Exception):
    pass


def salvage(data: bytes) -> Iterator[Piece]:
    """Records and gaps of an archive in order; together with zero bytes of padding they cover all its bytes.

    Plain records and gzip members may be mixed. A member with a damaged record among its records still gives the
    others; its gap is told with the member's place.
    """
    at, gap, reason, ends = 0, None, "", _Ends(data)
    while at < len(data):
        try:
            pieces, end = _member(data, at) if data.startswith(_MEMBER, at) else _plain(data, at, ends)
        except _Damaged as problem:
            if gap is None:
                gap, reason = at, str(problem)
            found = _START.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap is not None:
            yield Piece(gap, at, reason=reason)
            gap = None
        yield from pieces
        at = end
        while at < len(data) and data[at] == 0:
            at += 1
    if gap is not None:
        yield Piece(gap, len(data), reason=reason)


def _member(data: bytes, at: int) -> tuple[list[Piece], int]:
    unpack, parts, view, fed = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not unpack.eof and fed < len(data):
            parts.append(unpack.decompress(view[fed:fed + 65536]))
            fed += 65536
    except zlib.error as problem:
        raise _Damaged(f"gzip: {problem}") from None
    if not unpack.eof:
        raise _Damaged("gzip: ends early")
    end = min(fed, len(data)) - len(unpack.unused_data)
    content = b"".join(parts)
    pieces, inner, bad, ends = [], 0, None, _Ends(content)
    while inner < len(content):
        try:
            found, inner = _plain(content, inner, ends)
            pieces += found
        except _Damaged as problem:
            bad = bad or str(problem)
            again = _VERSION.search(content, inner + 1)
            inner = again.start() if again else len(content)
    if bad and not pieces:
        raise _Damaged(bad)
    return [Piece(at, end, p.headers, p.block) for p in pieces] + ([Piece(at, end, reason=bad)] if bad else []), end


class _Ends:
    """Where headers end next. The place is remembered, so that many starts in a row read the bytes after them once."""

    def __init__(self, data: bytes):
        self.data, self.asked, self.found = data, 0, -1

    def after(self, at: int) -> int | None:
        if not self.asked <= at <= self.found:
            found = self.data.find(_END, at)
            self.asked, self.found = at, found if found >= 0 else len(self.data)
        return self.found if self.found < len(self.data) else None


def _plain(data: bytes, at: int, ends: _Ends) -> tuple[list[Piece], int]:
    version = _VERSION.match(data, at)
    if not version:
        raise _Damaged("neither a member nor a version line")
    stop = ends.after(at)
    if stop is None:
        raise _Damaged("headers do not end")
    if stop - at > HEADER_BYTES:
        raise _Damaged("the headers are too long")
    headers, line_at = {}, version.end()
    # Line by line, so that a start without headers costs no more than its first line.
    while line_at <= stop:
        line_end = data.find(b"\r\n", line_at, stop)
        line_end = stop if line_end < 0 else line_end
        name, colon, value = data[line_at:line_end].decode("utf-8", "replace").partition(":")
        if not colon:
            raise _Damaged("not a header line")
        headers[name.strip().lower()] = value.strip()
        line_at = line_end + 2
    size = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size) or "warc-type" not in headers or "warc-record-id" not in headers:
        raise _Damaged("a mandatory header is missing")
    start, end = stop + 4, stop + 4 + int(size)
    if data[end:end + 4] != _END:
        raise _Damaged("the record does not end where its length says")
    block = data[start:end]
    for name, checked in (("warc-block-digest", block), ("warc-payload-digest", _payload(headers, block))):
        given = headers.get(name, "")
        whole = headers["warc-type"] != "revisit" or name == "warc-block-digest"
        if whole and given.lower().startswith("sha1:") and given[5:].upper() != payload_digest(checked):
            raise _Damaged(f"{name} differs")
    return [Piece(at, end + 4, headers, block)], end + 4


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP headers, if it has them."""
    if headers.get("content-type", "").startswith("application/http"):
        return block[block.find(_END) + 4:] if _END in block else b""
    return block


def _full_size(piece: Piece) -> int:
    """Bytes of the payload; of a revisit, those its HTTP headers tell."""
    if piece.headers["warc-type"] == "revisit":
        told = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", piece.block)
        return int(told.group(1)) if told else 0
    return len(_payload(piece.headers, piece.block))


def _key(record_id: str | None) -> str | None:
    inner = (record_id or "").strip("<>")
    return _unheader(inner.removeprefix(_ROW)) or None if inner.startswith(_ROW) else None


_PIECES = ("path string, start bigint, end bigint, reason string, record_type string, record_id string, key string, "
           "refers_to string, uri string, date string, payload_digest string, payload_bytes bigint, payload binary")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below a path, plain or gzip; a gap has a ``reason`` and no record columns.

    ``payload_digest`` is checked or, where a record has none, computed; ``payload_bytes`` of a revisit is that of the
    payload it refers to. An archive is read whole by one task, at most 2 GB; larger ones should be split first.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def pieces(batches):
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]
        names = [part.split()[0] for part in _PIECES.split(", ")]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for path_, content in rows_of(batch, "path", "content"):
                rows, held = [], 0
                for p in salvage(content):
                    h = p.headers
                    if p.reason is not None:
                        rows.append((path_, p.start, p.end, p.reason, *[None] * 9))
                        continue
                    payload = _payload(h, p.block)
                    digest = h.get("warc-payload-digest", "").partition(":")[2].upper() or payload_digest(payload)
                    rows.append((path_, p.start, p.end, None, h["warc-type"], h["warc-record-id"], _key(h["warc-record-id"]),
                                 _key(h.get("warc-refers-to")), h.get("warc-target-uri"), h.get("warc-date"), digest,
                                 _full_size(p), payload if with_payload else None))
                    held += len(payload) if with_payload else 100
                    if held > 4_000_000:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    return in_batches(files, pieces, _PIECES)


def whole_records(pieces: DataFrame) -> DataFrame:
    """The records; a gap is an error, for archives that must not have lost any."""
    lost = F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(": "), "reason")).cast("boolean")
    return pieces.filter(F.when(F.col("reason").isNull(), True).otherwise(lost)).drop("reason")


def records(pieces: DataFrame) -> DataFrame:
    return pieces.filter("reason is null").drop("reason")


def gaps(pieces: DataFrame) -> DataFrame:
    """The quarantine log: (path, start, end, reason) of the byte ranges that gave no record."""
    return pieces.filter("reason is not null").select("path", "start", "end", "reason")
