"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Each record is written as a gzip member of its own.  The reader takes members of any number of records and
yields each record as soon as it has parsed.  When a member or record fails its checks, the reader looks for the
next member or version line, inside the inflated bytes too, goes on from there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, scratch_path, staged
from .wavelet import put

GZIP, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/[01]\.\d\r?\n")
READ_BYTES, INFLATE_BYTES = 1 << 20, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Settings:
    """``revisit_from``: payloads of so many bytes at least are stored once.  ``file_bytes``: an archive
    is closed at this size.  ``record_bytes``: of a longer record the body is measured and digested as it streams
    past, but not held."""

    revisit_from: int = 0
    file_bytes: int = 32 << 20
    record_bytes: int = 512 << 20


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes
    gap: str = field(default="")
    body: tuple[int, str] | None = None  # size and digest of a payload that was not held


class Damaged(Exception):
    pass


class Broken(Damaged):
    """A gzip member that can't be inflated any further."""


def _base32(data: bytes) -> str:
    return base64.b32encode(data).decode()


def digest(data: bytes) -> str:
    return _base32(hashlib.sha1(data).digest())


def record(kind: str, record_id: str, uri: str, block: bytes, **headers: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{digest(block)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Bytes:
    """A file read on demand; what has been passed is dropped."""

    def __init__(self, file):
        self.file, self.held, self.at, self.ended = file, bytearray(), 0, False

    def more(self) -> bool:
        if not self.ended:
            new = self.file.read(READ_BYTES)
            self.held += new
            self.ended = not new
        return not self.ended

    def want(self, n: int) -> bool:
        while len(self.held) < n and self.more():
            pass
        return len(self.held) >= n

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n


class _Inflated(_Bytes):
    """A gzip member at the start of another source, inflated on demand.

    Compressed bytes stay held until the records made of them are sound, so that a search for the next member can
    begin behind the last sound record."""

    def __init__(self, source: _Bytes):
        super().__init__(None)
        self.source, self.inflate, self.used, self.before, self.start = source, zlib.decompressobj(31), 0, 0, source.at

    def more(self) -> bool:
        if self.inflate.eof:
            self.ended = True
        while not self.ended:
            if self.used >= len(self.source.held) and not self.source.more():
                raise Broken("cut short")
            piece = bytes(self.source.held[self.used : self.used + INFLATE_BYTES])
            try:
                new = self.inflate.decompress(piece, 16 * INFLATE_BYTES)
            except zlib.error as e:
                raise Broken("gzip check") from e
            rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.before, self.used = self.used, self.used + len(piece) - len(rest)
            self.held += new
            self.ended = self.inflate.eof
            if new:
                return True
        return False

    def sound(self) -> None:
        """Let go what the records so far were made of, but for the last piece."""
        self.source.drop(self.before)
        self.used, self.before = self.used - self.before, 0

    def length(self) -> int:
        return self.source.at + self.used - self.start


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Named fields; a line that begins with white space goes on with the one before."""
    out, name = {}, ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header without colon")
        name = key.decode("latin-1").strip().lower()
        out[name] = value.decode("utf-8", "replace").strip()
    return out


def take(source: _Bytes, limit: int) -> tuple[Record, int]:
    """The record at the source's start, and how many bytes to pass; a body over the limit has been passed already."""
    source.want(16)
    if not VERSION.match(source.held):
        raise Damaged("no version line")
    seen = 0
    while (end := source.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
        seen = len(source.held)
        if seen > limit or not source.more():
            raise Damaged("headers don't end")
    headers = _headers(bytes(source.held[:end]).split(b"\r\n")[1:])
    said, digits = headers.get("warc-block-digest", ""), headers.get("content-length", "")
    if not digits.isascii() or not digits.isdigit():
        raise Damaged("no content length")
    if not headers.get("warc-record-id") or not headers.get("warc-type"):
        raise Damaged("no record id or type")
    size, at = int(digits), end + 4
    if size <= limit:
        if not source.want(at + size + 4) or source.held[at + size : at + size + 4] != b"\r\n\r\n":
            raise Damaged("block and content length differ")
        block = bytes(source.held[at : at + size])
        if said.startswith("sha1:") and said[5:] != digest(block):
            raise Damaged("block digest differs")
        return Record(source.at, 0, headers, block), at + size + 4
    source.drop(at)
    source.want(min(size, READ_BYTES))
    head = bytes(source.held[: min(size, READ_BYTES)])
    head = head[: head.find(b"\r\n\r\n") + 4] if b"\r\n\r\n" in head else b""
    whole, body, left = hashlib.sha1(), hashlib.sha1(), size
    while left and source.want(1):
        chunk = bytes(source.held[: min(left, READ_BYTES)])
        skip = max(0, len(head) - (size - left))
        whole.update(chunk)
        body.update(chunk[skip:])
        left -= len(chunk)
        source.drop(len(chunk))
    if left or not source.want(4) or source.held[:4] != b"\r\n\r\n":
        raise Damaged("block and content length differ")
    if said.startswith("sha1:") and said[5:] != _base32(whole.digest()):
        raise Damaged("block digest differs")
    return Record(source.at, 0, headers, head, "", (size - len(head), _base32(body.digest()))), 4


def _seek(source: _Bytes, packed: bool) -> bool:
    """Go to the next version line or, where ``packed``, gzip member.  False at the end."""
    source.drop(1)
    while True:
        version, at = VERSION.search(source.held), source.held.find(GZIP) if packed else -1
        starts = [x for x in (at, version.start() if version else -1) if x >= 0]
        if starts:
            source.drop(min(starts))
            return True
        source.drop(max(0, len(source.held) - 11))
        if not source.more():
            source.drop(len(source.held))
            return False


def _member(source: _Bytes, limit: int) -> Iterator[Record]:
    """Records of the member at the source's start, as they parse, and gaps between them.  The last is held back
    until the member has passed its own check, unless its digest speaks for it."""
    inside, held, empty = _Inflated(source), None, True
    start = source.at
    try:
        while inside.want(1):
            empty, at, place = False, inside.at, inside.length()
            try:
                one, step = take(inside, limit)
            except Broken:
                raise
            except Damaged as e:
                more = _seek(inside, False)
                if held:
                    yield held
                    held = None
                yield Record(start + (place if at else 0), inside.length() - (place if at else 0), {}, b"", f"{e}, inflated bytes {at} to {inside.at}" if at or more else str(e))
                continue
            inside.drop(step)
            if held:
                yield held
                inside.sound()
            one.offset, one.length = start, inside.length()
            held = one
        if empty:
            raise Damaged("an empty member")
    except Broken:
        if held and "warc-block-digest" in held.headers:
            yield held
            inside.sound()
        raise
    if held:
        held.length = inside.length()
        yield held
    source.drop(inside.used)


def read(file, limit: int = Settings().record_bytes) -> Iterator[Record]:
    """Records of an archive in order; a record with ``gap`` set stands for bytes that gave none.

    Of a record in a member ``offset`` and ``length`` are the member's, as far as it had been read.  A body over the
    limit that fails its check is lost as far as its content length reaches, as it isn't held.
    """
    source, lost, why = _Bytes(file), None, ""
    while source.want(1):
        source.want(16)
        at = source.at
        try:
            if source.held.startswith(GZIP):
                for one in _member(source, limit):
                    if lost is not None:
                        yield Record(lost, at - lost, {}, b"", why)
                        lost = None
                    yield one
            elif VERSION.match(source.held):
                one, step = take(source, limit)
                source.drop(step)
                if lost is not None:
                    yield Record(lost, at - lost, {}, b"", why)
                    lost = None
                one.offset, one.length = at, source.at - at
                yield one
            else:
                raise Damaged("neither member nor version line")
        except Damaged as e:
            if lost is None:
                lost, why = source.at, str(e)
            _seek(source, True)
    if lost is not None:
        yield Record(lost, source.at - lost, {}, b"", why)


def _page_id(text: str | None) -> int | None:
    m = re.search(r"urn:x-page:(-?\d+)>?$", text or "")
    return int(m[1]) if m else None


def _write(batches: Iterator[pa.RecordBatch], folder: str, s: Settings) -> Iterator[pa.RecordBatch]:
    held, size, records = [], 0, 0

    def close() -> pa.RecordBatch:
        nonlocal held, size, records
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        put(path, b"".join(held))
        row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])
        held, size, records = [], 0, 0
        return row

    for batch in batches:
        for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            uri, own = re.sub(r"[\x00-\x20]", "%20", url or ""), f"urn:x-page:{'null' if page_id is None else page_id}"
            if first is None:
                data = record("response", own, uri, http + payload, WARC_Payload_Digest=f"sha1:{digest(payload)}")
            else:
                data = record("revisit", own, uri, http, WARC_Payload_Digest=f"sha1:{digest(payload)}", WARC_Profile=PROFILE, WARC_Refers_To=f"<urn:x-page:{first}>")
            held.append(member(data))
            size, records = size + len(held[-1]), records + 1
            if size >= s.file_bytes:
                yield close()
    if held:
        yield close()


def _sha() -> Column:
    return F.sha1(F.coalesce("html", F.lit("")).cast("binary"))


def first_copies(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(copy_id, copy_sha, refers_to) of the pages whose payload a page of a smaller id has."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select("page_id", _sha().alias("sha"), F.length(payload).alias("n")).filter(F.col("n") >= settings.revisit_from)
    first = narrow.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("times")).filter("times > 1").drop("times")
    return narrow.join(first, "sha").filter("page_id <> refers_to").select(F.col("page_id").alias("copy_id"), F.col("sha").alias("copy_sha"), "refers_to").distinct()


def write(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Archives of all pages; the list of their files (path, records, bytes).  A null html is an empty payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.join(first_copies(rows, settings), (F.col("page_id") == F.col("copy_id")) & (_sha() == F.col("copy_sha")), "left").select("page_id", "url", "html", "refers_to")
    return staged(map_batches(rows, _write, "path string, records long, bytes long", folder, settings), "archives")


READ_SCHEMA = "path string, offset long, length long, kind string, record_id string, uri string, payload binary, payload_bytes long, payload_digest string, refers_to string, note string"


def _read(batches: Iterator[pa.RecordBatch], s: Settings, bodies: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def rows(path: str):
        system, name = pafs.FileSystem.from_uri(path)
        with system.open_input_stream(name, compression=None) as f:
            for r in read(f, s.record_bytes):
                if r.gap:
                    yield path, r.offset, r.length, "gap", None, None, None, None, None, None, r.gap
                    continue
                head, _, payload = r.block.partition(b"\r\n\r\n")
                kind, said, note = r.headers.get("warc-type"), r.headers.get("warc-payload-digest", "").removeprefix("sha1:"), None
                size = re.search(rb"\ncontent-length:\s*(\d+)", head, re.I)
                n, sha = r.body or (len(payload), digest(payload))
                if r.body:
                    note = "payload not held: over the limit"
                if kind == "response" and said and said != sha:
                    note = "payload digest differs"
                if kind == "revisit":
                    n, sha = int(size[1]) if size else n, said or sha
                yield path, r.offset, r.length, kind, r.headers.get("warc-record-id"), r.headers.get("warc-target-uri"), payload if bodies and not r.body else None, n, sha, r.headers.get("warc-refers-to"), note

    for batch in batches:
        for path in batch.column("path").to_pylist():
            held, size = [], 0
            for row in rows(path):
                held.append(row)
                size += len(row[6] or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def dealt(files: DataFrame, most_parts: int) -> DataFrame:
    """The files, one in each partition; beyond ``most_parts`` of them, several."""
    listed = staged(files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("i")), "listed")
    parts = max(1, min(listed.count(), most_parts))
    return listed.repartitionById(parts, (F.col("i") % parts).cast("int")).select("path")


def salvage(files: DataFrame, settings: Settings = Settings(), bodies: bool = True, most_parts: int = 100_000) -> DataFrame:
    """Every record and every gap of the files in column path; each archive is read by a task of its own."""
    return map_batches(dealt(files, most_parts), _read, READ_SCHEMA, settings, bodies)


def gaps(records: DataFrame) -> DataFrame:
    """The quarantined bytes: path, offset, length and why."""
    return records.filter("kind = 'gap'").select("path", "offset", "length", F.col("note").alias("reason"))


def round_trip(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pages written as archives and read back: what each page's record holds.

    Pages that repeat an id are records each of their own, copies of a page of a smaller id are revisits; a null id has
    no place in the links and is always a response.  Other columns are not looked at; an empty table gives no rows.
    """
    files = write(pages, scratch_path(pages.sparkSession, "warc"), settings)
    got = salvage(files, settings, bodies=False).filter("kind in ('response', 'revisit')")
    number = lambda c: F.nullif(F.regexp_extract(c, r"urn:x-page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))
