"""WARC archives: one gzip member per record, written and read in order (operator 1).

Writing: each task writes its rows to archives of about ``roll_bytes`` in a shared folder; the table of
archives that it returns is written as Parquet, so files of lost or repeated task attempts are never read.
Of records with equal payloads the one with the largest page id is a response; the others are revisits that
refer to it and carry the HTTP head only.

Reading: an archive is streamed in small chunks, gzip members are inflated as they come, and a record's
block is taken by its Content-Length. Block digests of all records and payload digests of responses are
computed again; a record that fails is marked, a broken frame ends the job with its place.

Null html is an empty payload; empty payloads are payloads like others. Rows with a null id are responses
that nothing refers to. Rows that share the largest id and the payload are all responses. Null URLs give
records without a target. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..plans.storage import scratch_path, stable

CHUNK = 1 << 16
ROLL_BYTES = 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def _named(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record as one gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_named(page)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_named(refers_to)}", f"WARC-Profile: {REVISIT}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: sha1:{digest32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, folder: str, min_bytes: int = 0, id_column: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes archives below ``folder``; returns the written table ``path, records``.

    Payloads shorter than ``min_bytes`` are never revisited.
    """
    read = pages.select(F.col(id_column).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    read = read.withColumn("same", F.when(F.length("payload") >= min_bytes, F.concat_ws(":", F.sha1("payload"), F.length("payload"))))
    # the keeper of each payload that stands more than once; a hot payload is joined by broadcast, see spread_join
    keepers = read.where("same IS NOT NULL").groupBy("same").agg(F.max("page").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    told = spread_join(read, keepers, "same", "n", ["keeper"])
    told = told.select("page", "url", "payload", F.when(F.col("page") < F.col("keeper"), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        files.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0
        for batch in batches:
            for page, target, payload, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    path, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{path}", compression=None)
                data = record(page.as_py(), target.as_py(), payload.as_py(), refers.as_py(), date)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [n]})

    return stable(told.mapInArrow(run, "path string, records bigint"), "archives")


class Members:
    """Bytes of consecutive gzip members, inflated as they are asked for."""

    def __init__(self, stream, path: str):
        self.stream, self.path, self.raw, self.held, self.ended = stream, path, b"", b"", False
        self.inflate = None

    def more(self) -> bool:
        """Adds inflated bytes of the member at hand; False at its end."""
        if self.inflate is None:
            return False
        if self.inflate.eof:
            self.raw = self.inflate.unused_data
            self.inflate = None
            return False
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            if not self.raw:
                raise ValueError(f"{self.path}: ends inside a gzip member")
        self.held += self.inflate.decompress(self.raw, 4 * CHUNK)
        self.raw = self.inflate.unconsumed_tail
        return True

    def begin(self) -> bool:
        """Opens the next member; False at the end of the archive."""
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        if not self.raw:
            return False
        self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                raise ValueError(f"{self.path}: a record ends before its head does")
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError(f"{self.path}: a block is shorter than its Content-Length")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            if out:
                yield out

    def finish(self) -> None:
        while self.more():
            pass
        if self.held != b"\r\n\r\n":
            raise ValueError(f"{self.path}: a record is not followed by two line ends and the end of its member")
        self.held = b""


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)}


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def records(stream, path: str, with_payload: bool = True) -> Iterator[dict]:
    """The records of one archive, in order, with at most one record's payload in memory."""
    members = Members(stream, path)
    while members.begin():
        fields = _fields(members.until(b"\r\n\r\n"))
        size = int(fields["content-length"])
        block, payload, head, n, parts = hashlib.sha1(), hashlib.sha1(), b"", 0, []
        inside = not fields.get("content-type", "").startswith("application/http")
        for part in members.take(size):
            block.update(part)
            if not inside:
                head += part
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                part, head, inside = head[at + 4 :], head[:at], True
            payload.update(part)
            n += len(part)
            if with_payload:
                parts.append(part)
        members.finish()
        kind = fields.get("warc-type")
        told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        ok = fields.get("warc-block-digest", "").removeprefix("sha1:") == digest32(block.digest())
        if kind == "revisit":  # the HTTP head still tells the length of the payload left out
            n = int(_fields(head).get("content-length", 0))
        else:
            ok = ok and told == digest32(payload.digest())
        yield {
            "page_id": _page(fields.get("warc-record-id")), "url": urllib.parse.unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
            "record_type": kind, "payload_bytes": n, "payload_digest": told, "refers_to": _page(fields.get("warc-refers-to")) if kind == "revisit" else None,
            "verified": ok, "payload": b"".join(parts) if with_payload and kind != "revisit" else None,
        }


SHAPE = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "verified": pa.bool_(), "payload": pa.binary()}


def read(archives: DataFrame, with_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the archives in column ``path``; an archive is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(k, t) for k, t in SHAPE.items() if with_payload or k != "payload"])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = store(path)
                held, size = [], 0
                with files.open_input_stream(place, compression=None, buffer_size=CHUNK) as stream:
                    for row in records(stream, path, with_payload):
                        held.append(row)
                        size += 200 + len(row["payload"] or b"")
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    shape = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, verified boolean" + (", payload binary" if with_payload else "")
    paths = archives.select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(run, shape)


def round_trip(pages: DataFrame, with_payload: bool = False, **settings) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder, **settings), with_payload)
