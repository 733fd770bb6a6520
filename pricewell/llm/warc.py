"""WARC archives: writing with revisit records, and a sequential reader.

Writing: payloads meet by digest in one join (the join's small side has one row for each digest,
combined before its shuffle), then each task appends its records to .warc.gz files, one
gzip member a record, under a folder all machines share. The table of files that a finished job
returns says which of them count; ``publish`` then moves these to the folder itself, so what a lost executor has left behind stays apart
and a reader of the folder never meets it.

Reading: one task walks through a file from front to back. It inflates members
incrementally, takes headers up to the blank line, frames content by Content-Length and checks block and
payload digests; memory holds one record's content and one chunk of the file.

Cases: a null payload is an empty one. Rows may repeat: of records with equal payload the smallest key is
the response and every other row of a larger key revisits it; rows that repeat the smallest key are
responses too. A null key sorts last and is kept as null. An empty table writes no file and reads as an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm.common import Scratch, partitions

CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(key: int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def _key_of(record_id: str) -> int | None:
    value = record_id.strip("<>").rpartition(":")[2]
    return int(value) if value else None


def _one_line(value: str) -> str:
    """A header value: line breaks would end the header."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _from_line(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit carries the HTTP head with the payload's length and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_record_id(key)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_one_line(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """One gzip member, the same bytes for the same record."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses)."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("_sha", F.sha1(F.encode("payload", "utf-8"))).withColumn("_n", F.octet_length("payload"))
    # only digests that several rows have; a third of all rows under one digest is a few rows here
    several = rows.filter(F.col("_n") >= min_bytes).groupBy("_sha", "_n").agg(F.min("page_id").alias("_first"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    met = rows.join(several.hint("shuffle_hash"), ["_sha", "_n"], "left")
    later = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")))
    return met.select("page_id", "url", "payload", F.when(later, F.col("_first")).alias("refers_to"))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it; addresses without a scheme are local."""
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


WORK = "_work"


def write_archives(records: DataFrame, folder: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Append records to archives under ``folder``; returns (path, records, bytes) of the files.

    Running the result writes; keep it, for a second run writes other files. Paths carry the folder's scheme. A file closes at about ``most_bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(f"{folder}/{WORK}")
        fs.create_dir(base, recursive=True)
        out, done = None, []
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = member(record(row["page_id"], row["url"], row["payload"].encode(), row["refers_to"]))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= most_bytes:
                    out.close()
                    done.append((f"{folder}/{WORK}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{WORK}/{name}", n, size))
        if done:
            paths, ns, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(ns, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def publish(files: DataFrame) -> DataFrame:
    """``files`` moved from their work folder to the folder itself; what was moved before is left, so a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = []
            for path in b.column("path").to_pylist():
                fs, old = open_fs(path)
                new = old.replace(f"/{WORK}/", "/")
                if fs.get_file_info(old).type != pafs.FileType.NotFound:
                    fs.move(old, new)
                paths.append(path.replace(f"/{WORK}/", "/"))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), b.column("records"), b.column("bytes")], ["path", "records", "bytes"])

    return files.select("path", "records", "bytes").mapInArrow(run, "path string, records long, bytes long")


class _Members:
    """The records' bytes, member after member, inflated as they are asked for."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk, self.raw, self.ready, self.z = stream, chunk, b"", b"", None

    def start(self) -> bool:
        """Begin the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(self.chunk)
        if not self.raw:
            return False
        self.z, self.ready = zlib.decompressobj(31), b""
        return True

    def _more(self) -> bool:
        while not self.z.eof:
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
                if not self.raw:
                    raise ValueError("the archive ends within a member")
            piece = self.z.decompress(self.raw, self.chunk)
            self.raw = self.z.unconsumed_tail or self.z.unused_data
            if piece:
                self.ready += piece
                return True
        return False

    def line(self) -> bytes:
        while b"\r\n" not in self.ready:
            if not self._more():
                raise ValueError("the member ends within a header")
        line, self.ready = self.ready.split(b"\r\n", 1)
        return line

    def take(self, n: int) -> bytes:
        pieces, have = [self.ready], len(self.ready)
        while have < n:
            self.ready = b""
            if not self._more():
                raise ValueError("the member is shorter than its Content-Length")
            pieces.append(self.ready)
            have += len(self.ready)
        whole = b"".join(pieces)
        self.ready = whole[n:]
        return whole[:n]

    def finish(self) -> None:
        end = self.ready
        self.ready = b""
        while self._more():
            end += self.ready
            self.ready = b""
        if end != b"\r\n\r\n":
            raise ValueError("a record does not end with its member")


def read_records(stream, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of each record from front to back; digests are verified."""
    members = _Members(stream, chunk)
    while members.start():
        if not members.line().startswith(b"WARC/"):
            raise ValueError("a member does not begin with a WARC version")
        head: dict[str, str] = {}
        while line := members.line():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        content = members.take(int(head["content-length"]))
        members.finish()
        told = head.get("warc-block-digest")
        if told and told != f"sha1:{sha1_base32(content)}":
            raise ValueError(f"block digest of {head.get('warc-record-id')} differs")
        yield head, content


def _row(head: dict[str, str], content: bytes, with_payload: bool) -> tuple:
    http, _, payload = content.partition(b"\r\n\r\n")
    fields = dict(x.split(b":", 1) for x in http.split(b"\r\n")[1:])
    kind = head["warc-type"]
    told = head["warc-payload-digest"].removeprefix("sha1:")
    length = int(fields[b"Content-Length"])
    if kind == "response" and (sha1_base32(payload) != told or len(payload) != length):
        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest or length")
    refers = head.get("warc-refers-to")
    url = head.get("warc-target-uri")
    row = (_key_of(head["warc-record-id"]), None if url is None else _from_line(url), length, told, kind, None if refers is None else _key_of(refers))
    return (*row, payload if kind == "response" else None) if with_payload else row


def read_archives(files: DataFrame, payload: bool = False, rows: int = 500) -> DataFrame:
    """Rows of the records in the archives at ``path``. With ``payload`` the responses' payload follows as binary."""
    names = [x.split()[0] for x in RECORDS.split(", ")] + (["payload"] if payload else [])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=False)], names)

        held = []
        for b in batches:
            for value in b.column(0).to_pylist():
                fs, path = open_fs(value)
                stream = fs.open_input_stream(path, compression=None)
                for head, content in read_records(stream):
                    held.append(_row(head, content, payload))
                    if len(held) >= rows:
                        yield out(held)
                        held = []
                stream.close()
        if held:
            yield out(held)

    return files.select("path").mapInArrow(run, RECORDS + (", payload binary" if payload else ""))


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back as rows."""
    scratch = Scratch(spark, "warc")
    files = scratch.table(write_archives(with_revisits(pages, min_bytes=min_bytes), scratch.path("archives")), "files")
    files = scratch.table(publish(files), "published")
    # a task reads one file at a time; files are many small rows, dealt out evenly
    return read_archives(files.repartition(max(partitions(spark), 1)))
