"""WARC archives of web pages, with a reader that salvages damaged files.

write_archives writes one gzip member per record. Of pages with equal payloads the one with the smallest id becomes
a response record, the others become revisit records without payload that name it. read_archive walks a file member
by member; where a check fails (no gzip header, broken stream, bad version line, wrong length or digest) it searches
for the next place where a whole valid record starts, goes on from there and reports the bytes between as a gap.

Defined results: a null html is an empty payload; a null id sorts after all others and is written as "null"; of rows
equal in id and payload one comes first and the rest are revisits of it; an empty table gives no archive and an empty
result; only page_id, url and html are read, whatever other columns there are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agoraflow.llm.shared import fresh_path, staged

#: A task begins another file after so many bytes.
FILE_BYTES = 64 << 20
#: Tasks that read at most.
READ_TASKS = 4096
#: Bytes read at a time.
BLOCK = 1 << 20
#: Bytes within which the headers of a record are to end.
HEAD = 1 << 20
MAGIC = b"\x1f\x8b\x08"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
_NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
ID = "<urn:page:%s:%d>"
READ_SCHEMA = "path string, kind string, start long, stop long, reason string, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, url string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    start: int
    stop: int

    @property
    def payload(self) -> bytes:
        """The body of the HTTP message."""
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


def make_record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """A record as bytes, not compressed."""
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    fields = {"WARC-Type": kind, **headers, "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Length": str(len(block))}
    return VERSIONS[1] + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page_id: int | None, nth: int, url: str | None, html: str | None, first: bool, refers_to: int | None, digest: str, size: int) -> bytes:
    """The response or revisit record of a page."""
    name = lambda x: "null" if x is None else str(x)
    head = {"WARC-Record-ID": ID % (name(page_id), nth), "WARC-Date": "2000-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(size)}
    if url is not None:
        head["WARC-Target-URI"] = url
    start = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first:
        return make_record("response", head, start + b"Content-Length: %d\r\n\r\n" % size + (html or "").encode())
    head |= {"WARC-Refers-To": ID % (name(refers_to), 1), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return make_record("revisit", head, start + b"\r\n")


class Window:
    """A file's bytes from a place on, read in blocks; what lies before the place is let go."""

    def __init__(self, file):
        self.file, self.data, self.at, self.ended = file, b"", 0, False

    def more(self) -> bool:
        block = b"" if self.ended else self.file.read(BLOCK)
        self.ended = not block
        self.data += block
        return not self.ended

    def has(self, size: int) -> bool:
        while len(self.data) < size and self.more():
            pass
        return len(self.data) >= size

    def skip(self, size: int) -> None:
        self.data, self.at = self.data[size:], self.at + size


def inflate(win: Window) -> tuple[bytes, int]:
    """The content of the gzip member at the window's place and its compressed length."""
    z, out, fed = zlib.decompressobj(31), [], 0
    while not z.eof:
        if fed >= len(win.data) and not win.more():
            raise ValueError("the member is cut off")
        piece = win.data[fed:]
        out.append(z.decompress(piece))
        fed += len(piece)
    return b"".join(out), fed - len(z.unused_data)


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the start of data, all checks passed."""
    if not data.startswith(VERSIONS):
        raise ValueError("no version line")
    head, mark, _ = data.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("the headers do not end")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon or not _NAME.fullmatch(k.strip()):
            raise ValueError("a header has no name")
        headers[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no length")
    start, stop = len(head) + 4, len(head) + 4 + int(headers["content-length"])
    block = data[start:stop]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("wrong length")
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != sha1_base32(block):
        raise ValueError("wrong block digest")
    return headers, block, stop + 4


def next_record(win: Window) -> Record:
    """The record at the window's place; ValueError where there is none that passes the checks."""
    if win.has(3) and win.data.startswith(MAGIC):
        try:
            data, size = inflate(win)
        except zlib.error as e:
            raise ValueError(f"broken stream: {e}") from e
        headers, block, used = parse(data)
        if used != len(data):
            raise ValueError("bytes after the record in its member")
    else:
        if not win.has(10) or not win.data.startswith(VERSIONS):
            raise ValueError("neither a member nor a version line")
        while (end := win.data.find(b"\r\n\r\n")) < 0 and len(win.data) < HEAD and win.more():
            pass
        length = next((line.partition(b":")[2].strip() for line in win.data[: max(end, 0)].split(b"\r\n") if line.lower().startswith(b"content-length:")), b"")
        if length.isdigit():
            win.has(end + 8 + int(length))
        headers, block, size = parse(win.data)
    return Record(headers, block, win.at, win.at + size)


def read_archive(file, on_gap: Callable[[int, int, str], None] = lambda *_: None) -> Iterator[Record]:
    """The valid records of a file; on_gap hears the start, end and reason of every stretch of bytes that is skipped."""
    win, gap, reason = Window(file), None, ""
    while win.has(1):
        try:
            record = next_record(win)
        except ValueError as e:
            if gap is None:
                gap, reason = win.at, str(e)
            step = 1
            while True:  # to the next place that may start a record
                found = [x for m in (MAGIC, *VERSIONS) if (x := win.data.find(m, step)) >= 0]
                if found:
                    win.skip(min(found))
                    break
                step = max(1, len(win.data) - 9)
                win.skip(step)
                step = 0
                if not win.more():
                    win.skip(len(win.data))
                    break
            continue
        if gap is not None:
            on_gap(gap, record.start, reason)
            gap = None
        yield record
        win.skip(record.stop - record.start)
    if gap is not None:
        on_gap(gap, win.at, reason)


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, bytes, refers_to, nth, first of every page.

    Only ids and digests meet by digest, where copies may be many; html is dealt by id and digest.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    base = base.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    slim = base.select("key", "page_id", "digest").distinct()
    groups = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    # the window has the keys of the join, so html is shuffled once
    both = base.join(slim.join(groups, "digest").drop("page_id"), ["key", "digest"])
    nth = F.row_number().over(W.partitionBy("key", "digest").orderBy("url"))
    return both.withColumn("nth", nth).withColumn("first", (F.col("nth") == 1) & F.col("page_id").eqNullSafe(F.col("refers_to")))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as archives into folder (a URI); returns the paths of complete files.

    A file has a name of its own in every attempt of a task, and only what the successful attempt wrote is listed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, done = None, "", 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                html = row["html"].encode()
                data = gzip_member(page_record(row["page_id"], row["nth"], row["url"], row["html"], row["first"], row["refers_to"], base64.b32encode(bytes.fromhex(row["digest"])).decode(), len(html)))
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    out.close()
                    done, out = [*done, name], None
        if out is not None:
            out.close()
            done.append(name)
        if done:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{x}" for x in done]})

    return staged(typed(pages).mapInArrow(write, "path string"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """A row for every record (kind record) and every quarantined stretch of bytes (kind gap) of the files in column path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if not x or x.split(":")[2] == "null" else int(x.split(":")[2])
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        kinds = {"start": pa.int64(), "stop": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as file:
                    rows: list[dict] = []
                    gap = lambda a, b, why: rows.append({"path": path, "kind": "gap", "start": a, "stop": b, "reason": why})  # noqa: B023, E731
                    for r in read_archive(file, gap):
                        h, digest = r.headers, r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        kind, size = h.get("warc-type"), int(h.get("x-payload-length", 0))
                        if kind == "response":
                            if digest and sha1_base32(r.payload) != digest:
                                gap(r.start, r.stop, "wrong payload digest")
                                continue
                            size, digest = len(r.payload), sha1_base32(r.payload)
                        rows.append({"path": path, "kind": "record", "start": r.start, "stop": r.stop, "record_type": kind, "page_id": number(h.get("warc-record-id")), "refers_to": number(h.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "url": h.get("warc-target-uri")})
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows.clear()
                    yield pa.RecordBatch.from_pylist(rows, schema)

    parts = min(max(1, files.count()), READ_TASKS)
    return files.repartition(parts, "path").mapInArrow(read, READ_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return read_archives(files).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least, row_number() OVER (PARTITION BY h ORDER BY page_id) AS nth FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth = 1 THEN NULL ELSE least END AS refers_to
FROM r
"""
