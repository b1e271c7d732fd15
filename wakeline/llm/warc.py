"""WARC archives (operator 3): a writer, and a reader that salvages what a damaged file still holds.

Writing: a record a page. Payloads of 100 bytes or more that are equal leave one response, that of
the smallest page id; the others are revisits that name it and carry the HTTP header with the
full length and the digest, so nothing about a page is lost. Records are gzip members, written
by Spark's text sink (raw bytes, an archive a line and a line a file; its line separator is an empty member, which
gzip allows), so files are committed, retried and stored as any Spark output is. Archives are bounded by
bytes, so the reader, which takes a file whole, is too.

Reading: a file's members, or the records of a plain file, are checked one after another: gzip's
own sums, version line, header lines, lengths, trailer, block and payload digests. After a failed
check the reader searches for the next valid member (or version line) and goes on; the bytes it
passed over are logged as a gap with their offset, length and reason. Of a damaged member the whole records before
the fault are kept if their own digests prove them; its gap then says how far into its content they reach.

Defined results: a null page is an empty payload; a null url leaves the target out; a null id is
written as such, never first among equals while others have ids; rows that repeat the first's
id are responses too; an empty table gives archives without records; an empty or hopeless file gives
no record, and one gap if it has bytes; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import as_bytes, shared_path, small_batches, written

MIN_REVISIT = 100
FILE_BYTES = 1 << 25  # of an archive's members; a larger record has a file of its own
DATE = "2000-01-01T00:00:00Z"
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) not in '<>"%')


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of refers_to, as WARC bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write pages as .warc.gz files below path.

    Only digests are shuffled. Digests met twice or more go to a small table of their own, which
    Spark broadcasts if its files are small and joins by a shuffle if not.
    """
    spark = pages.sparkSession
    small_batches(spark)
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    twice = p.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = written(twice.select(F.col("digest").alias("again"), "first"), "warc-digests")
    p = p.join(twice, p.digest == twice.again, "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda x: pa.RecordBatch.from_arrays([pa.array([b"".join(x)], pa.binary())], names=["archive"])
        out: list[bytes] = []
        size = 0
        for b in batches:
            ids, urls, digests, refers = (b.column(k).to_pylist() for k in (0, 1, 3, 4))
            for x in zip(ids, urls, as_bytes(b.column(2)), digests, refers, strict=True):
                member = gzip_member(record(*x))
                if out and size + len(member) > FILE_BYTES:
                    yield whole(out)
                    out, size = [], 0
                out.append(member)
                size += len(member)
        if out:
            yield whole(out)

    out = p.mapInArrow(members, "archive binary").select(F.col("archive").cast("string"))  # a cast keeps the bytes
    out.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)
    _named(spark, path)


def _named(spark: SparkSession, path: str) -> None:
    """Give the files of the text sink the ending .warc.gz: a rename for each FILE_BYTES, no data in a file system."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(s.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".warc.gz"))


class Bad(Exception):
    """A failed check; its text is the reason logged. partial: what a member held before the fault."""

    def __init__(self, reason: str, partial: bytes = b"") -> None:
        super().__init__(reason)
        self.partial = partial


def _until_fault(data: memoryview, at: int) -> bytes:
    """What a damaged member gives before its fault, in small pieces as a fault takes its piece with it."""
    d, out = zlib.decompressobj(31), []
    try:
        for pos in range(at, len(data), 256):
            out.append(d.decompress(data[pos : pos + 256]))
    except zlib.error:
        pass
    return b"".join(out)


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content and the end of the gzip member at an offset, its checksum verified."""
    if data[at : at + 3] != MAGIC:
        raise Bad("no gzip member")
    d, out, pos = zlib.decompressobj(31), [], at
    try:
        while not d.eof and pos < len(data):
            piece = data[pos : pos + (1 << 16)]
            out.append(d.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Bad(f"gzip: {e}", _until_fault(data, at)) from e
    if not d.eof:
        raise Bad("truncated member", b"".join(out))
    return b"".join(out), pos - len(d.unused_data)


def _record(data: bytes, at: int, digested: bool = False) -> tuple[dict[str, Any], int]:
    """The record at an offset and its end, all checks passed; digested: only if a digest is one of them."""
    m = _VERSION.match(data, at)
    if not m:
        raise Bad("no version line")
    ends = [(k, n) for k, n in ((data.find(b"\r\n\r\n", at), 4), (data.find(b"\n\n", at, data.find(b"\r\n\r\n", at) + 1 or len(data)), 2)) if k >= 0]
    if not ends:
        raise Bad("header without end")
    end, width = min(ends)
    head: dict[str, str] = {}
    for line in data[m.end() : end].splitlines():
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Bad("bad header line")
        head[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isascii() or not head.get("content-length", "").isdigit():
        raise Bad("no content length")
    begin = end + width
    stop = begin + int(head["content-length"])
    if stop > len(data):
        raise Bad("block beyond the end")
    block = data[begin:stop]
    after = stop
    for trailer in (b"\r\n\r\n", b"\n\n"):
        if data.startswith(trailer, stop):
            after = stop + len(trailer)
            break
    else:
        if stop < len(data):
            raise Bad("no trailer")
    want = head.get("warc-block-digest", "")
    checked = want.lower().startswith("sha1:")
    if checked and want[5:].upper() != _digest(block)[5:]:
        raise Bad("block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not head.get("content-type", "").startswith("application/http") or not gap:
        http, payload = b"", block
    kind, digest, length = head.get("warc-type"), head.get("warc-payload-digest", ""), len(payload)
    if kind == "revisit":
        found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        length = int(found[1]) if found else None
    elif digest.lower().startswith("sha256:"):
        checked = True
        if digest[7:].lower() != hashlib.sha256(payload).hexdigest():
            raise Bad("payload digest")
    elif digest.lower().startswith("sha1:") and not checked and not re.search(rb"(?im)^transfer-encoding:", http):
        # writers differ on whether a transfer encoding counts; a block digest has proved the bytes already
        checked = True
        if digest[5:].upper() != _digest(payload)[5:]:
            raise Bad("payload digest")
    if digested and not checked:
        raise Bad("no digest")
    return {
        "kind": "record", "record_type": kind, "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to": head.get("warc-refers-to"),
        "payload_bytes": length, "payload_digest": digest.rpartition(":")[2].lower() or (hashlib.sha256(payload).hexdigest() if kind != "revisit" else None), "payload": None if kind == "revisit" else payload,
    }, after


def _gap(offset: int, length: int, reason: str, inner: int | None = None) -> dict[str, Any]:
    return {"kind": "gap", "offset": offset, "length": length, "reason": reason, "inner_offset": inner}


def _plain(data: bytes, base: int | None = None) -> Iterator[dict[str, Any]]:
    """Records and gaps of uncompressed bytes; base: the offset of the member that held them."""
    at = 0
    while at < len(data):
        try:
            found, end = _record(data, at)
            yield found | ({"offset": at, "length": end - at} if base is None else {"offset": base, "length": None, "inner_offset": at})
            at = end
        except Bad as bad:
            next_ = at + 1
            while True:
                m = _VERSION.search(data, next_)
                if not m:
                    next_ = len(data)
                    break
                next_ = m.start()
                try:
                    _record(data, next_)
                    break
                except Bad:
                    next_ += 1
            yield _gap(at, next_ - at, str(bad)) if base is None else _gap(base, next_ - at, str(bad), at)
            at = next_


def _next(content: bytes, data: memoryview, at: int) -> int:
    """The first offset from here on of a valid member or record, else the end."""
    n = len(content)
    while at < n:
        member, plain = content.find(MAGIC, at), _VERSION.search(content, at)
        at = min([x for x in (member, plain.start() if plain else -1) if x >= 0], default=n)
        if at == n:
            break
        try:
            if at == member:
                _member(data, at)
            else:
                _record(content, at)
            break
        except Bad:
            at += 1
    return at


def salvage(content: bytes) -> Iterator[dict[str, Any]]:
    """Records and gaps of an archive, gzip members or plain, in order.

    A plain file and a member are told apart at each offset, so a file may mix them.
    """
    data, at, n = memoryview(content), 0, len(content)
    while at < n:
        if _VERSION.match(content, at):
            # a record is tried against all that follows: its payload may itself hold members
            try:
                found, end = _record(content, at)
                yield found | {"offset": at, "length": end - at}
                at = end
                continue
            except Bad as bad:
                begin, reason = at, str(bad)
            at = _next(content, data, begin + 1)
            yield _gap(begin, at - begin, reason)
            continue
        try:
            found, end = _member(data, at)
            yield from (x | {"length": end - at} if x["kind"] == "record" else x for x in _plain(found, at))
            at = end
        except Bad as bad:
            begin, inner = at, 0
            # whole records before the fault are kept if their own digests prove them
            while inner < len(bad.partial):
                try:
                    found, end = _record(bad.partial, inner, digested=True)
                except Bad:
                    break
                yield found | {"offset": begin, "length": None, "inner_offset": inner}
                inner = end
            at = _next(content, data, at + 1)
            yield _gap(begin, at - begin, str(bad), inner or None)


_SCHEMA = {
    "path": "string", "kind": "string", "offset": "long", "length": "long", "inner_offset": "long", "reason": "string", "record_type": "string", "record_id": "string", "target_uri": "string", "date": "string",
    "refers_to": "string", "payload_bytes": "long", "payload_digest": "string", "payload": "binary",
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records (kind record) and quarantined gaps (kind gap) of the archives below path, one file a row of
    Spark's binaryFile source, so any store that Spark reads will do."""
    small_batches(spark)
    columns = {k: t for k, t in _SCHEMA.items() if with_payload or k != "payload"}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out: list[dict[str, Any]] = []
                size = 0
                for x in salvage(content.as_py()):
                    out.append(x | {"path": path})
                    size += len(x.get("payload") or b"") * with_payload
                    if len(out) >= 2000 or size > 1 << 24:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    def _batch(out: list[dict[str, Any]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.get(k) for x in out], _ARROW[t]) for k, t in columns.items()], names=list(columns))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(rows, ", ".join(f"{k} {t}" for k, t in columns.items()))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages into a new folder of the shared place and return what the archives hold."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col)
    found = read_archives(pages.sparkSession, path, with_payload=False).where("kind = 'record'")
    number = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1), F.lit("")).cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
