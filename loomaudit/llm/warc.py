"""WARC archives: a deduplicating writer and a splittable reader of gzip members.

Writer: every record is a gzip member of its own, one archive a task, in a folder
that all workers share (``pyarrow.fs`` opens it by its URI).  A task's file name
holds a fresh random part, and a manifest written as a table names the files of the
tasks that counted; a repeated task leaves only an unnamed file behind.

Reader: archives are cut into byte ranges, one row each, dealt over tasks.  A task
scans its range for gzip magic, takes a candidate for a member if its first bytes
inflate to a ``WARC/1.`` header, and owns the records that start inside its range,
reading past the end for the last one.  After a record the next member's place is
known; the scan starts again only where that place holds no member.  A payload that
holds whole gzip members of WARC records uncompressed could mislead the scan; UTF-8
payloads cannot, as the magic is not UTF-8.

Records with equal payloads of at least ``least`` bytes: the smallest id is the
response, the others are revisits with a ``WARC-Refers-To`` and the HTTP header
alone.  The join that finds them is on the digest with both sides dealt anew, so a
payload shared by a third of all pages is split by AQE.

Defined cases: a null payload is empty; a null id is never referred to and is always
a response; of rows with equal ids and payloads, all are responses or all revisits;
a null URL becomes ``urn:unknown``; line breaks in URLs are percent-encoded; an empty
table gives an archive list and a reading without rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
MANIFEST = "path string, bytes bigint"
RECORD = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, digest_ok boolean, payload binary"
)


def _urn(value: object) -> str:
    """A record id; the key is kept in it and comes back with :func:`key_of`."""
    return f"urn:record:{value}"


def key_of(column):
    return F.regexp_extract(column, r"^urn:record:(.*)$", 1)


def _record(key, url, payload: bytes, digest: str, refers) -> bytes:
    url = (url or "urn:unknown").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{_urn(key)}>"]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += ["WARC-Block-Digest: sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode()]
    if refers is not None:
        head += [f"WARC-Refers-To: <{_urn(refers)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _deflate(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, size, path = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for key, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    store, place = _filesystem(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    stream = store.open_output_stream(place, compression=None)  # members are compressed already
                member = _deflate(_record(key, url, payload.encode(), digest, refers), level)
                stream.write(member)
                size += len(member)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], ["path", "bytes"])

    return run


def write_warc(
    pages: DataFrame, folder: str | None = None, least: int = 100, level: int = 6, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Write one record for each row; returns the manifest ``path, bytes`` as written."""
    spark = pages.sparkSession
    folder = folder or common.scratch_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    light = pages.select(F.col(id_col).alias("key"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= least)
    first = light.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    marked = common.fresh_join(rows, first, ["digest"], "left")
    refers = F.when(F.col("key") != F.col("first"), F.col("first"))
    files = marked.select("key", "url", "payload", "digest", refers.alias("refers")).mapInArrow(_writer(folder, level), MANIFEST)
    return common.materialise(files, "manifest")


def _inflate_head(data: bytes) -> bytes:
    try:
        return zlib.decompressobj(31).decompress(data, 8)
    except zlib.error:
        return b""


class _Range:
    """Bytes of an archive from a range's start on, read ahead as needed."""

    def __init__(self, stream, start: int, size: int, step: int = 1 << 20):
        self.stream, self.base, self.size, self.step, self.data = stream, start, size, step, bytearray()
        stream.seek(start)

    def need(self, until: int) -> bool:
        """Hold the bytes up to a place; false at the archive's end."""
        while self.base + len(self.data) < min(until, self.size):
            block = self.stream.read(min(self.step, self.size - self.base - len(self.data)))
            if not block:
                raise EOFError("the archive is shorter than its manifest says")
            self.data += block
        return until <= self.size

    def forget(self, before: int) -> None:
        if before - self.base > self.step:
            del self.data[: before - self.base]
            self.base = before

    def member(self, at: int) -> bool:
        """Whether a member of a WARC record starts at a place."""
        self.need(at + 512)
        head = bytes(self.data[at - self.base : at - self.base + 512])
        return head.startswith(MAGIC) and _inflate_head(head).startswith(b"WARC/1.")

    def search(self, at: int, end: int) -> int:
        """The first member that starts at or after ``at`` and before ``end``, or -1."""
        while at < end:
            self.need(min(at + self.step, end) + 2)
            found = self.data.find(MAGIC, at - self.base, min(at + self.step, end) + 2 - self.base)
            if found < 0:
                at = min(at + self.step, end)
            elif self.base + found >= end:
                return -1
            elif self.member(self.base + found):
                return self.base + found
            else:
                at = self.base + found + 1
            self.forget(at)
        return -1

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """A member's content and its end; none if it is broken."""
        z, parts, here = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                if here >= self.size:
                    return None
                self.need(here + 65536)
                block = bytes(self.data[here - self.base : here - self.base + 65536])
                parts.append(z.decompress(block))
                here += len(block)
        except zlib.error:
            return None
        return b"".join(parts), here - len(z.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the space after the colon is optional, and a folded line continues the one before."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def _parse(content: bytes) -> list[tuple]:
    """All records of a member's content; one without a sound length reaches to the end."""
    out = []
    while content.startswith(b"WARC/"):
        head, _, rest = content.partition(b"\r\n\r\n")
        fields = _fields(head)
        size = _number(fields.get("content-length"))
        block = rest if size is None else rest[:size]
        out.append(_one(fields, block))
        content = rest[len(block) :].lstrip(b"\r\n")
    return out


def _one(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    stated = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    kind = fields.get("warc-type", "")
    if kind == "revisit":
        length = _number(_fields(http).get("content-length"))
        length, digest, ok, payload = len(payload) if length is None else length, stated, None, b""
    else:
        digest = hashlib.sha256(payload).hexdigest()
        length, ok = len(payload), stated is None or stated == digest
    bare = lambda x: x.strip("<>") if x else None
    return bare(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")), length, digest, ok, payload


def _reader(with_payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = _filesystem(path)
                rows, held = [], 0
                with store.open_input_file(place) as stream:
                    data = _Range(stream, start, size)
                    at = data.search(start, end)
                    while 0 <= at < end:
                        got = data.inflate(at)
                        if got is None:
                            at = data.search(at + 1, end)
                            continue
                        for row in _parse(got[0]):
                            rows.append(row if with_payload else (*row[:-1], None))
                            held += len(row[-1]) if with_payload else 0
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, held = [], 0
                        data.forget(got[1])
                        at = got[1] if got[1] < end and data.member(got[1]) else data.search(got[1], end)
                if rows:
                    yield batch_of(rows)

    return run


def read_warc(spark: SparkSession, manifest: DataFrame, split_bytes: int = 4 << 20, with_payload: bool = True) -> DataFrame:
    """Records of all archives named by ``path, bytes``; see :data:`RECORD` for the columns.

    ``digest_ok`` tells whether a payload has the stated digest; it is null for a
    revisit, whose length and digest are those stated.
    """
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))
    ranges = manifest.filter("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    ranges = ranges.select("path", "bytes", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    ranges = ranges.repartition(max(1, min(100_000, -(-total // split_bytes))), "path", "start")
    return ranges.mapInArrow(_reader(with_payload), RECORD)
