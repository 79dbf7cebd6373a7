"""WARC archives: writer with payload revisits, and a sequential reader.

The writer gives each record a gzip member of its own.  Of pages with equal
payloads the one with the largest id is a response record, the others are
revisit records that name it.  The reader goes through a file once: it
decompresses member by member in small steps, frames each record by its
Content-Length, and checks block and payload digests as the bytes pass.

Defined results: a null payload is the empty one; pages below the size for
revisits are all responses; repeated rows of the responding page are all
responses; a null id is never named by a revisit, and a group of null ids
only is all responses; a null address becomes ``urn:page:<id>``; an empty
table writes no file and reads as no rows; other columns are ignored.  A
file that breaks off or whose digests don't match raises an error that names
the file and the record.  Archives of other writers (WARC 1.0 and 1.1, a gzip
member per record) are read as well: every record is a row of its own type, its
id is text and page_id null unless this writer named it, and a digest that is
missing or of an unknown algorithm isn't checked.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, fresh_name, shared_folder, stored, utf8

# A task closes a file at about this size and begins another.
FILE_BYTES = 64_000_000
STEP_BYTES = 1 << 16
# Fixed values of the format.
VERSION = b"WARC/1.1"
VERSIONS = ("WARC/1.0", "WARC/1.1")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_PAGE = re.compile(r"<urn:page:(-?\d+)>")
_ALGORITHMS = {"md5", "sha1", "sha256", "sha512"}


def digest32(raw: bytes) -> str:
    """A SHA-1 digest as bare upper-case base32."""
    return base64.b32encode(raw).decode("ascii")


# -- writing ---------------------------------------------------------------------

def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
                  min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, refers_to): refers_to is the id of the equal page
    that responds, null for responses."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"),
                        utf8(payload).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    largest = rows.groupBy("digest").agg(F.max("id").alias("responds"))
    return rows.join(largest, "digest").select("id", "url", "payload", F.when(
        (F.octet_length("payload") >= min_bytes) & (F.coalesce("id", F.lit(-1)) != F.col("responds")),
        F.col("responds")).alias("refers_to"))


def _uri(number: int | None) -> str:
    return f"<urn:page:{'null' if number is None else number}>"


def record(number: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record as its own gzip member."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode("ascii")
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _uri(number)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else _uri(number)[1:-1]),
        ("WARC-Payload-Digest", "sha1:" + digest32(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", "sha1:" + digest32(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head[4:4] = [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    lines = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(lines) + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


def write(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z",
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write rows (id, url, payload, refers_to) as .warc.gz files below the
    shared ``folder``; returns the table of files (path, records, bytes).

    Each attempt of a task writes files of its own names, and only those of
    the attempt that Spark accepted are in the table.
    """
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        task = TaskContext.get().partitionId()
        name, out, n = "", None, 0

        def close() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pylist(
                [{"path": f"{folder}/{name}", "records": n, "bytes": size}], schema=schema)

        for batch in batches:
            for page in range(batch.num_rows):
                number, url, payload, refers_to = (c[page].as_py() for c in batch.columns)
                if out is None:
                    name, n = fresh_name(f"part-{task:05d}", ".warc.gz"), 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(record(number, url, payload, refers_to, date))
                n += 1
                if out.tell() >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return stored(rows.select("id", "url", "payload", "refers_to").mapInArrow(
        run, "path string, records long, bytes long"), "warc-files")[0]


# -- reading ---------------------------------------------------------------------

class _Member:
    """The bytes of one gzip member, decompressed step by step."""

    def __init__(self, raw: BinaryIO, left: bytes):
        self.raw, self.left, self.out = raw, left, b""
        self.gz = zlib.decompressobj(31)

    def more(self) -> bool:
        """Decompress another step; False at the member's end."""
        while not self.gz.eof:
            if not self.left:
                self.left = self.raw.read(STEP_BYTES)
                if not self.left:
                    raise ValueError("the file breaks off inside a record")
            got = self.gz.decompress(self.left, STEP_BYTES)
            self.left = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if got:
                self.out += got
                return True
        return False

    def line_block(self) -> list[str]:
        """Header lines up to the empty line."""
        while b"\r\n\r\n" not in self.out:
            if not self.more():
                raise ValueError("a record without an end of its header")
        head, self.out = self.out.split(b"\r\n\r\n", 1)
        return head.decode("utf-8").split("\r\n")

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in steps."""
        while size:
            if not self.out and not self.more():
                raise ValueError("a record shorter than its Content-Length")
            got, self.out = self.out[:size], self.out[size:]
            size -= len(got)
            yield got


def _fields(lines: list[str]) -> dict[str, str]:
    """Names and values; a line that begins with white space goes on with the
    value before it, and one without a colon says nothing."""
    found, name = {}, ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _number(uri: str | None) -> int | None:
    """The page of an id of this writer, null for any other id."""
    found = _PAGE.fullmatch(uri or "")
    return int(found[1]) if found else None


def _matches(stated: str | None, digests: dict[str, "hashlib._Hash"]) -> bool:
    """Whether a stated digest (base32 or hex) is the one of the bytes; also
    true if there is none, or one of an unknown algorithm."""
    name, _, value = (stated or "").partition(":")
    raw = digests.get(name.lower().replace("-", ""))
    if raw is None or not value:
        return True
    return value.upper().rstrip("=") in (digest32(raw.digest()).rstrip("="), raw.hexdigest().upper())


def _algorithm(stated: str | None) -> list[str]:
    name = (stated or "").partition(":")[0].lower().replace("-", "")
    return [name] if name in _ALGORITHMS else []


def records(raw: BinaryIO, keep_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, in order, in bounded memory (the payload of
    the current record if it is kept)."""
    left = raw.read(STEP_BYTES)
    while left:
        member = _Member(raw, left)
        lines = member.line_block()
        head = _fields(lines)
        name = head.get("warc-record-id", "?")
        if lines[0] not in VERSIONS:
            raise ValueError(f"{name}: not a record of {' or '.join(VERSIONS)}")
        kind, stated = head["warc-type"], head.get("warc-payload-digest")
        block = {a: hashlib.new(a) for a in _algorithm(head.get("warc-block-digest"))}
        payload = {a: hashlib.new(a) for a in {"sha1", *_algorithm(stated)}}
        kept, size = [], 0
        # the payload of an HTTP message comes after its header, that of any other block is the block
        http, body = b"", not head.get("content-type", "").lower().startswith("application/http")
        for step in member.take(int(head["content-length"])):
            for digest in block.values():
                digest.update(step)
            if not body:
                http += step
                if b"\r\n\r\n" not in http:
                    continue
                http, step = http.split(b"\r\n\r\n", 1)
                body = True
            for digest in payload.values():
                digest.update(step)
            size += len(step)
            if keep_payload:
                kept.append(step)
        if b"".join(member.take(4)) != b"\r\n\r\n" or member.out or member.more():
            raise ValueError(f"{name}: the record doesn't end after its block")
        message = _fields(http.decode("latin-1").split("\r\n"))
        length = message.get("content-length", "")
        # a revisit keeps the length of the payload that it doesn't repeat
        declared = int(length) if length.isdecimal() and (kind == "revisit" or "transfer-encoding" not in message) else size
        if not _matches(head.get("warc-block-digest"), block):
            raise ValueError(f"{name}: the block digest doesn't match")
        whole = kind != "revisit" and "warc-truncated" not in head
        if whole and not _matches(stated, payload) or kind == "response" and whole and size != declared:
            raise ValueError(f"{name}: the payload digest or length doesn't match")
        target = head.get("warc-target-uri")
        yield {"page_id": _number(name), "url": target and target.removeprefix("<").removesuffix(">"),
               "payload_bytes": declared if whole or kind == "revisit" else size,
               "payload_digest": stated.partition(":")[2] if stated else digest32(payload["sha1"].digest()),
               "record_type": kind, "refers_to": _number(head.get("warc-refers-to")),
               "payload": b"".join(kept) if keep_payload and kind != "revisit" else None,
               "record_id": head.get("warc-record-id"), "refers_to_id": head.get("warc-refers-to")}
        left = member.left or raw.read(STEP_BYTES)


def read(files: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the archives in ``files`` (path); a file is one task's work."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
              ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, base = file_system(path)
                held, size = [], 0
                with fs.open_input_stream(base, compression=None) as raw:
                    try:
                        for row in records(raw, keep_payload):
                            held.append(row)
                            size += len(row["payload"] or b"") + 200
                            if size > 4_000_000:
                                yield pa.RecordBatch.from_pylist(held, schema=schema)
                                held, size = [], 0
                    except (ValueError, KeyError, zlib.error) as e:
                        raise ValueError(f"{path}: {e}") from e
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    spark = files.sparkSession
    tasks = max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return files.select("path").repartition(tasks, "path").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
             "refers_to long, payload binary, record_id string, refers_to_id string")


def archive(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url",
            payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives and return the table of files."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return write(with_revisits(pages, key, url, payload, min_bytes), folder)
