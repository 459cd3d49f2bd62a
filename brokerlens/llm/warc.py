"""Web archives: range-sorted records in files rolled by compressed size, and reading them back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brokerlens.llm.common import free_name, same, slices, written
from brokerlens.llm.stores import Output, new_folder, opened

ROLL_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
MANIFEST = "name string, records long, bytes long, first string, last string, crc32 long"


def record_id(page_id, digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name the response of another file."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _block_digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if " " <= c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One gzip member without a time of its own; equal records give equal bytes."""
    fields = [*headers, ("WARC-Block-Digest", _block_digest(block)), ("Content-Length", str(len(block)))]
    head = VERSION + "\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=level, mtime=0)


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, level: int) -> bytes:
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url if url else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", "sha1:" + digest),
        ("Content-Type", HTTP_TYPE),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page-Id", str(refers_to)))
        return record(headers, reply, level)
    return record(headers, reply + payload, level)


class RollingWriter:
    """Files of one partition, one open at a time; a new one begins once the open one has ``roll_bytes``."""

    def __init__(self, folder: str, part: int, roll_bytes: int, level: int):
        self.folder, self.part, self.roll_bytes, self.level = folder, part, roll_bytes, level
        self.number, self.out = 0, None
        self.done: list[tuple] = []

    def add(self, page_id, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.number:04d}.warc.gz"
            self.out = Output(self.folder, self.name)
            self.number += 1
            self.records, self.crc, self.first = 0, 0, page_id
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", self.name)), ("WARC-Date", DATE),
                    ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._put(record(info, b"format: WARC File Format 1.1\r\n", self.level))
        self._put(data)
        self.records, self.last = self.records + 1, page_id
        if self.out.size >= self.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.crc = zlib.crc32(data, self.crc)

    def close(self) -> None:
        if self.out is not None:
            self.out.commit()
            ends = [None if x is None else str(x) for x in (self.first, self.last)]
            self.done.append((self.name, self.records, self.out.size, *ends, self.crc))
            self.out = None


def write(
    pages: DataFrame,
    html: str = "html",
    url: str = "url",
    key: str = "page_id",
    least_revisit_bytes: int = 0,
    roll_bytes: int = ROLL_BYTES,
    level: int = 6,
) -> tuple[str, DataFrame]:
    """Write a record per row; gives (folder, manifest of the complete files).

    Of rows with equal payloads of at least ``least_revisit_bytes`` the one with the smallest key is the response and
    the others revisit it; of repeated rows of that key the first one. Null keys come last. A null payload is empty.

    First keys per digest are taken with partial sums, and only light rows (key, digest) are joined to them. These
    marks then travel with the pages through one range shuffle by key, in front of their page, so payloads are
    shuffled once and no payload, however often repeated, gathers in a task.
    """
    folder = new_folder(pages.sparkSession, "warc")
    kind = pages.schema[key].dataType
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )
    light = rows.select("key", F.sha1("html").alias("digest"), F.octet_length("html").alias("size"))
    light = light.where(F.col("size") >= least_revisit_bytes)
    counts = light.groupBy("digest").agg(F.min("key").alias("refers"), F.count("*").alias("n")).where("n > 1")
    marks = light.select("key", "digest").join(counts.select("digest", "refers"), "digest").distinct()
    both = rows.select("key", "url", "html", F.sha1("html").alias("digest"), F.lit(None).cast(kind).alias("refers"), F.lit(1).alias("page"))
    both = both.unionByName(
        marks.select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers", F.lit(0).alias("page"))
    )
    order = [F.col("key").isNull(), F.col("key")]
    both = both.repartitionByRange(*order).sortWithinPartitions(*order, "page", "digest", "url")
    target = to_arrow_schema(T._parse_datatype_string(MANIFEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = RollingWriter(folder, TaskContext.get().partitionId(), roll_bytes, level)
        current, first, seen = object(), {}, set()
        for whole in batches:
            for batch in slices(whole, ["html"]):
                for row in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html", "digest", "refers", "page"))):
                    page_id, address, text, digest, refers, page = row
                    if page_id != current:
                        current, first, seen = page_id, {}, set()
                    if not page:
                        first[digest] = refers
                        continue
                    again = digest in first and (first[digest] != page_id or digest in seen)
                    seen.add(digest)
                    to = first[digest] if again else None
                    writer.add(page_id, page_record(page_id, address, text.encode(), base32(digest), to, again, level))
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*writer.done), target)], schema=target)

    return folder, written(both.mapInArrow(run, MANIFEST), "manifest")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every gzip member; one record is in memory at a time."""
    held, member, out = b"", None, []
    for chunk in chunks:
        held += chunk
        while held:
            member = member or zlib.decompressobj(31)
            out.append(member.decompress(held))
            held = b""
            if member.eof:
                held, member = member.unused_data, None
                yield _parsed(b"".join(out))
                out = []
    if member is not None:
        raise ValueError("the last record is cut off")


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:40]}")
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def _chunks(file, size: int = 1 << 20) -> Iterator[bytes]:
    while data := file.read(size):
        yield data


def read(folder: str, manifest: DataFrame, key: T.StructField) -> DataFrame:
    """Per page record: key, payload_bytes, payload_digest, record_type, refers_to. Digests of responses are checked."""
    whole = key.dataType.typeName() != "string"
    schema = T.StructType([T.StructField(key.name, key.dataType)]).add("payload_bytes", "long")
    schema = schema.add("payload_digest", "string").add("record_type", "string")
    schema = schema.add(T.StructField(free_name(schema.names, "refers_to"), key.dataType))
    target = to_arrow_schema(schema)

    def ident(value: str | None):
        return value if value is None or not whole else int(value)

    def parse(headers: dict[str, str], block: bytes) -> tuple:
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"digest of {headers['WARC-Record-ID']} does not hold")
        return (ident(headers.get("X-Page-Id")), int(headers["X-Payload-Length"]), digest, headers["WARC-Type"],
                ident(headers.get("X-Refers-To-Page-Id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows: list[tuple] = []
                with opened(folder, name) as file:
                    for headers, block in records(_chunks(file)):
                        if headers["WARC-Type"] != "warcinfo":
                            rows.append(parse(headers, block))
                        if len(rows) == 5000:
                            yield _batch(rows, target)
                            rows = []
                if rows:
                    yield _batch(rows, target)

    files = max(1, manifest.count())  # given as a number, so that each file keeps a task of its own
    return manifest.select("name").repartition(files).mapInArrow(run, schema)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)
