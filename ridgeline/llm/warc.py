"""WARC archives with revisit resolution.

Headers (digest, id, length) are shuffled by payload digest and pre-aggregated to the first record of
each payload; later records with the same payload become revisits of it.  Archives are written with
fresh headers, one gzip member per record, and read back member by member.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import new_folder

LEAST_BYTES = 100
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 256 << 20
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean, archive string"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def _uri(url: str) -> str:
    """A header value of one line: what is not printable ASCII is percent-encoded."""
    return "".join(chr(b) if 33 <= b < 127 else f"%{b:02X}" for b in url.encode("utf-8", "surrogatepass"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def resolve(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses) of ``pages`` (page_id, url, html).

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response; rows that
    repeat this page are responses too.  Null html is an empty payload; rows without page_id are
    always responses.  Payloads travel once, by page; only headers are shuffled by digest.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    heads = rows.where((F.length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    again = heads.join(first, "digest").where("page_id != first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(resolved: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records to gzip archives below ``folder``; returns (path, records), already written.

    A task writes under a name of its own and renames a file when it is whole; only the files of
    the attempt that Spark counts are listed, so a repeated task leaves no double records behind.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        made: list[tuple[str, int]] = []
        sink, name, n, size = None, "", 0, 0

        def close():
            nonlocal sink
            if sink is not None:
                sink.close()
                where.move(f"{root}/.{name}", f"{root}/{name}")
                made.append((f"{folder}/{name}", n))
                sink = None

        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*batch.columns, strict=True):
                if sink is None or size >= file_bytes:
                    close()
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = where.open_output_stream(f"{root}/.{name}", compression=None)
                z = zlib.compressobj(3, zlib.DEFLATED, 31)
                made_bytes = z.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py(), refers.is_valid)) + z.flush()
                sink.write(made_bytes)
                n, size = n + 1, size + len(made_bytes)
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["path", "records"])

    files = resolved.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long").collect()  # one row per file
    return resolved.sparkSession.createDataFrame([tuple(r) for r in files], "path string, records long")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one record each."""
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        z, out = zlib.decompressobj(31), io.BytesIO()
        while not z.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    raise ValueError("the archive ends inside a record")
            out.write(z.decompress(rest))
            rest = z.unused_data
        yield out.getvalue()


def parse(raw: bytes) -> tuple:
    """(page_id, url, payload bytes, digest, type, refers_to, payload agrees with its digest)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:20]}")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1])
    digest, revisit = h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"] == "revisit"
    sound = not payload if revisit else len(payload) == length and hashlib.sha256(payload).hexdigest() == digest
    return page_of(h["warc-record-id"]), h.get("warc-target-uri"), length, digest, h["warc-type"], page_of(h.get("warc-refers-to")), sound


def read_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Every record of the listed archives."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok", "archive"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, file = fs.FileSystem.from_uri(path)
                rows = []
                with where.open_input_stream(file, compression=None) as f:
                    for raw in members(f):
                        rows.append((*parse(raw), path))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path").repartition(max(1, min(10_000, files.count())), "path").mapInArrow(run, _READ)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write deduplicated archives of ``pages`` to a new shared folder and read them back."""
    return read_archives(spark, write_archives(resolve(pages), new_folder(spark, "warc")))
