"""WARC archives: writing, reading, and assembly of transactions.

Each capture is written as a request, a response (or revisit) and a metadata
record; request and metadata name the response in WARC-Concurrent-To.  Reading
parses archives as streams, one gzip member a record; assembly joins the three
kinds of records through that header into one nested row a capture.

Of captures with equal payloads of at least ``least`` bytes, the one with the
smallest page_id is the response and the others revisit it.  Defined results: a
null html is an empty payload; rows that share page_id and payload are all
responses; a row without page_id revisits a numbered one with its payload, else it's
a response; null and odd URLs are kept percent-encoded; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, scratch, small, stash, utf8

RECORD = "path string, record_id string, record_type string, concurrent_to string, target_uri string, payload_bytes long, payload_digest string, block_digest string, refers_to string, fields map<string,string>"
_ARROW = pa.schema([*((c, pa.string()) for c in ("path", "record_id", "record_type", "concurrent_to", "target_uri")), ("payload_bytes", pa.int64()), *((c, pa.string()) for c in ("payload_digest", "block_digest", "refers_to")), ("fields", pa.map_(pa.string(), pa.string()))])
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, record_id: str, block: bytes, **headers: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    head = "\r\n".join([*lines, f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _id(*parts: object) -> str:
    return str(uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest()))


def _write(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        name, trial = f"{root}/{part:06d}.warc.gz", f"{root}/.{part:06d}-{context.taskAttemptId()}"
        out, n = None, 0
        for batch in chunks(batches, by="html"):
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(trial, compression=None)
            for page, url, first, payload in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("first").to_pylist(), utf8(batch.column("html")), strict=True):
                payload = payload or b""
                uri = None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~%-._")
                digest = f"sha1:{base32_sha1(payload)}"
                own = {k: _id(part, n, k) for k in ("request", "response", "metadata")}
                n += 1
                to = f"<urn:uuid:{own['response']}>"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                ask = f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode()
                out.write(_record("request", own["request"], ask, WARC_Target_URI=uri, WARC_Concurrent_To=to, Content_Type="application/http;msgtype=request"))
                if first is None or first == page:
                    out.write(_record("response", own["response"], http + payload, WARC_Target_URI=uri, WARC_Payload_Digest=digest, Content_Type="application/http;msgtype=response"))
                else:
                    out.write(_record("revisit", own["response"], http, WARC_Target_URI=uri, WARC_Payload_Digest=digest, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<urn:page:{first}>", Content_Type="application/http;msgtype=response"))
                facts = "" if page is None else f"page-id: {page}\r\n"
                out.write(_record("metadata", own["metadata"], facts.encode(), WARC_Target_URI=uri, WARC_Concurrent_To=to, Content_Type="application/warc-fields"))
        if out is not None:
            out.close()
            system.move(trial, name)  # a task that runs twice leaves one archive
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "captures"])

    return run


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> list[str]:
    """One archive a partition of ``pages`` (page_id, url, html); returns their paths."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    seen = rows.filter(F.octet_length("html") >= least).select(digest.alias("d"), "page_id").groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = seen.filter("n > 1").select("d", "first")
    marked = rows.withColumn("d", F.when(F.octet_length("html") >= least, digest)).join(small(stash(repeated)), "d", "left")
    return [r["path"] for r in marked.select("page_id", "url", "html", "first").mapInArrow(_write(folder), "path string, captures long").collect()]


class _Members(io.RawIOBase):
    """The plain bytes of a file of gzip members, as a stream."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.rest, self.z = raw, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            data = self.rest or self.raw.read(1 << 18)
            if not data:
                return 0
            plain = self.z.decompress(data, len(into))
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            if plain:
                into[: len(plain)] = plain
                return len(plain)


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a plain WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().strip()) != b"":
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        size, block = int(headers["content-length"]), bytearray()
        while len(block) < size:
            part = stream.read(size - len(block))
            if not part:
                raise EOFError("a record is cut off")
            block += part
        yield headers, bytes(block)


def _bare(value: str | None, *prefixes: str) -> str | None:
    value = value and value.strip("<>")
    for p in prefixes:
        value = value.removeprefix(p) if value else value
    return value


def _parse(system_of: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(system_of)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                raw = system.open_input_stream(path, compression=None)
                for h, block in records(io.BufferedReader(_Members(raw), 1 << 18)):
                    kind, body, fields = h["warc-type"], block, {}
                    n = digest = None
                    if kind in ("request", "response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        http = dict(x.lower().split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
                        fields = http
                    if kind == "response":
                        n, digest = len(body), base32_sha1(body)
                    elif kind == "revisit":
                        n, digest = int(http["content-length"]), _bare(h.get("warc-payload-digest"), "sha1:")
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                    uri = h.get("warc-target-uri")
                    rows.append((path, _bare(h["warc-record-id"], "urn:uuid:"), kind, _bare(h.get("warc-concurrent-to"), "urn:uuid:"), uri and unquote(uri), n, digest, _bare(h.get("warc-block-digest"), "sha1:"), _bare(h.get("warc-refers-to"), "urn:page:"), list(fields.items())))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def read_warc(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    """One row a record; each archive is a task of its own and is read as a stream."""
    if not paths:
        return spark.createDataFrame([], RECORD)
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return files.mapInArrow(_parse(folder), RECORD)


def transactions(rows: DataFrame) -> DataFrame:
    """One nested row a capture: request, response (or revisit) and metadata, joined through concurrent-to identifiers."""
    of = F.when(F.col("record_type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    record = F.struct("record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "block_digest", "refers_to", "fields")
    part = lambda *kinds: F.any_value(F.when(F.col("record_type").isin(*kinds), record), True)
    # three records a capture, so one aggregation is the join of the three kinds
    return rows.withColumn("capture_id", of).filter("capture_id is not null").groupBy("capture_id").agg(part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata"))


def captures(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages``, read the archives back and assemble: page_id, payload_bytes, payload_digest, record_type, refers_to and the nested capture."""
    folder = folder or scratch(pages.sparkSession)
    nested = transactions(read_warc(pages.sparkSession, folder, write_warc(pages, folder, least)))
    r = F.col("response")
    return nested.select(F.col("metadata.fields").getItem("page-id").cast("long").alias("page_id"), r["payload_bytes"].alias("payload_bytes"), r["payload_digest"].alias("payload_digest"), r["record_type"].alias("record_type"), r["refers_to"].cast("long").alias("refers_to"), "capture_id", "request", "response", "metadata")
