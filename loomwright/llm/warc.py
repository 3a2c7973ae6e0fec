"""WARC archives: one gzip member per record, revisit records for repeated payloads, and a
sequential reader that inflates, frames and verifies with constant memory.

Archives are real ``.warc.gz`` files in a folder that executors share, opened through
``pyarrow.fs`` (local, S3, GCS, HDFS, ABFS addresses). A writing task names its files with a
fresh id and reports them in a manifest table; files of failed or repeated tasks are in no
manifest and so are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.texts import utf8
from loomwright.session import Workspace

#: Payloads below this size are always written in full.
LEAST_REVISIT = 1000
#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 64 << 10
ID = "urn:loomwright:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "page_id bigint, record_type string, target_uri string, payload_bytes bigint, payload_digest string, "
    "refers_to bigint, verified boolean"
)


def with_revisits(pages: DataFrame, work: Workspace, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to: of equal payloads of ``least`` bytes or
    more, all but that with the largest page_id refer to it. Only groups of two or more are
    joined back, so unique payloads carry no partner; they are written first, so that the join has an
    exchange on both sides and Spark can split a hot payload."""
    full = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"), utf8(F.col("html")).alias("payload")
    ).withColumn("payload_digest", F.sha1("payload"))
    leaders = (
        full.where(F.octet_length("payload") >= least)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    leaders = work.put(leaders, "leaders")
    refers = F.when(F.col("leader") != F.coalesce("page_id", F.lit(-(1 << 63))), F.col("leader"))
    return full.join(leaders, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit's block has the HTTP header only, with the full length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block += payload if refers_to is None else b""
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{ID}{'none' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "", safe="!#$&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{ID}{refers_to}>"}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Lazy manifest (path, records) of the archives that hold ``rows`` of ``with_revisits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, path, size, count = None, "", 0, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for row in zip(*columns):
                if out is None:
                    path, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(record(*(x.as_py() for x in row), date)) + packer.flush()
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [count]})

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records bigint")


class Inflated:
    """Bytes of a file of gzip members, inflated step by step; ``members`` counts those begun."""

    def __init__(self, stream):
        self.stream, self.unzip, self.data, self.members = stream, None, bytearray(), 0
        self.raw = b""

    def more(self) -> bool:
        """Inflates a further piece; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(READ_BYTES)
        if not self.raw:
            if self.unzip is not None and not self.unzip.eof:
                raise ValueError("the archive ends within a gzip member")
            return False
        if self.unzip is None or self.unzip.eof:
            self.unzip, self.members = zlib.decompressobj(31), self.members + 1
        self.data += self.unzip.decompress(self.raw, READ_BYTES)
        self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
        return True

    def between(self) -> bool:
        """Whether the member ends here; a member's end may need further bytes of the file."""
        while not self.unzip.eof and not self.data and self.more():
            pass
        return self.unzip.eof and not self.data

    def head(self) -> bytes | None:
        """Bytes up to and with the next empty line; None at the end of the file."""
        at, seen = -1, 0
        while at < 0:
            at = self.data.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(self.data)
            if at < 0 and not self.more():
                if self.data:
                    raise ValueError("the archive ends within a record's header")
                return None
        return self.take(at + 4)

    def take(self, n: int) -> bytes:
        got = bytes(self.data[:n])
        del self.data[:n]
        return got

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not self.data and not self.more():
                raise ValueError("the archive ends within a record's block")
            got = self.take(min(n, len(self.data)))
            n -= len(got)
            yield got


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _page(value: str | None) -> int | None:
    found = (value or "").strip("<>").removeprefix(ID)
    return int(found) if found.lstrip("-").isdigit() else None


def records_of(stream) -> Iterator[tuple]:
    """A row of RECORDS for each record of one archive."""
    data, count = Inflated(stream), 0
    while (head := data.head()) is not None:
        count += 1
        if not head.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        warc, block, payload = _fields(head), hashlib.sha1(), hashlib.sha1()
        http, size = b"", 0
        body = False
        for piece in data.pieces(int(warc["content-length"])):
            block.update(piece)
            if not body:
                http += piece
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                body, piece, http = True, http[at + 4 :], http[: at + 4]
            payload.update(piece)
            size += len(piece)
        if b"".join(data.pieces(4)) != b"\r\n\r\n":
            raise ValueError("a record's block does not end where its length says")
        if data.data or data.members != count or not data.between():
            raise ValueError("a gzip member does not hold one record")
        told = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:"))
        good = base64.b32decode(warc["warc-block-digest"].removeprefix("sha1:")) == block.digest()
        kind = warc["warc-type"]
        if kind == "response":
            good = good and told == payload.digest()
        else:
            size = int(_fields(http).get("content-length", 0))
        uri = unquote(warc.get("warc-target-uri", ""))
        yield _page(warc["warc-record-id"]), kind, uri, size, told.hex(), _page(warc.get("warc-refers-to")), good


def read_archives(manifest: DataFrame, tasks: int) -> DataFrame:
    """The records (RECORDS) of the archives in ``manifest`` (path), each read once, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, local = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with store.open_input_stream(local, compression=None) as stream:
                    for row in records_of(stream):
                        rows.append(row)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives and reads them back: a row of RECORDS per page.

    Null html is an empty payload, a null url an empty address; a null page_id comes back as
    null and never leads a group. Rows with one page_id and equal payloads are all responses if
    that id leads. A record whose digests don't match its bytes has verified = false; broken
    framing, or a gzip member that doesn't hold just one record, is an error. An empty table gives no rows; other columns are ignored.
    """
    work = Workspace(pages.sparkSession, "warc")
    spark = pages.sparkSession
    work.put(spark.range(0), "archives")  # makes the folder
    folder = f"{work.path}/archives"
    manifest = work.put(write_archives(with_revisits(pages, work, least), folder), "manifest")
    return read_archives(manifest, max(1, min(10_000, manifest.count())))
