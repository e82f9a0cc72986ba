"""Training-order materialisation: fixed-stride token shards in a keyed pseudo-random order.

Every document is cut into sequences.  A sequence has the index (id, piece) in a dense grid of all
ids by the most pieces any text can have; a keyed Feistel network with cycle-walking permutes the
grid, so the order depends on ids and key alone, not on how the table is dealt out.  The permuted
grid is range-partitioned; each partition sorts its sequences and writes one shard of records of one
fixed size.  A sequence's global slot is the number of records before its shard plus its place in the
shard: 0..N-1 without gaps (points of the grid that no sequence has take no slot).  The manifest holds
the first slot of each shard, and a reader seeks straight to any slot and reads on.

One pass reads and encodes the documents; the grid's size comes from ids and text lengths alone.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import new_folder, slices
from ridgeline.llm.tokens import default_files, document_ids, encoder

SEQ_LEN = 512
END_ID = 2
PER_SHARD = 8192
#: Record header: doc_id, piece, number of ids, whether doc_id is null; then seq_len unsigned 16-bit ids, zero-padded.
HEADER = "<qiH?x"
HEADER_BYTES = struct.calcsize(HEADER)
_ROUNDS = 4
#: To choose the number of shards only.
BYTES_PER_TOKEN = 2.5
READ_RECORDS = 1024


def feistel(x: np.ndarray, n: int, key: str) -> np.ndarray:
    """Permutation of 0..n-1: a balanced Feistel network on the smallest even number of bits, cycle-walked into range."""
    if n <= 1:
        return np.zeros_like(x)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(_ROUNDS)]

    def once(v):
        left, right = v >> shift, v & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << shift) | right

    out = once(x.astype(np.uint64))
    outside = np.flatnonzero(out >= np.uint64(n))
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Grid:
    """Ids from ``low`` on (``ids`` of them, one more for null) by ``pieces``; ids too far apart are hashed."""

    low: int
    ids: int
    pieces: int
    hashed: bool

    @property
    def size(self) -> int:
        return (self.ids + 1) * self.pieces


def grid_of(docs: DataFrame, seq_len: int) -> tuple[Grid, int]:
    """The grid, and the bytes of all texts; a token takes a byte at least."""
    length = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    r = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(length).alias("longest"), F.sum(length).alias("bytes")).first()
    low, high = (0, 0) if r["low"] is None else (r["low"], r["high"])
    pieces, ids = (r["longest"] or 0) // seq_len + 1, high - low + 1
    hashed = (ids + 1) * pieces >= 1 << 62
    return Grid(0 if hashed else low, (1 << 62) // pieces - 1 if hashed else ids, pieces, hashed), r["bytes"] or 0


def _point(grid: Grid, doc_id: int | None, pieces: int) -> np.ndarray:
    """Indices in the grid of the pieces of a document; hashed ids may share points, which the sort settles by the record."""
    if doc_id is None:
        row = grid.ids
    elif grid.hashed:
        row = int.from_bytes(hashlib.sha256(str(doc_id).encode()).digest()[:8], "little") % grid.ids
    else:
        row = doc_id - grid.low
    return np.arange(row * grid.pieces, row * grid.pieces + pieces, dtype=np.int64)


def write_shards(
    docs: DataFrame, folder: str, key: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, per_shard: int = PER_SHARD,
    files: tuple[str, str] | None = None,
) -> DataFrame:
    """Write the shards of ``docs`` (doc_id, text) below ``folder``; returns the manifest (shard, path, first_slot, records).

    ``per_shard`` is the number of records a shard holds about (the permutation deals them out evenly).
    Null text is empty and still yields a sequence (the end id); rows that repeat yield theirs each
    time, next to each other; a null doc_id is kept as such; no rows write no shard.  A task writes to
    a name of its own and renames at the end, so a repeated task leaves one whole shard.
    """
    files = files or default_files()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grid, n_bytes = grid_of(docs, seq_len)
    n_shards = max(1, round(n_bytes / BYTES_PER_TOKEN / seq_len / per_shard))

    def encode_rows(batches) -> Iterator[pa.RecordBatch]:
        encode, z = encoder(*files), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "text"):
                points, blobs = [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = document_ids(encode, text.as_py(), end_id).astype("<u2")
                    pieces = -(-len(ids) // seq_len)
                    points.append(_point(grid, doc_id, pieces))
                    for k in range(pieces):
                        own = ids[k * seq_len : (k + 1) * seq_len]
                        blobs.append(z.compress(struct.pack(HEADER, 0 if doc_id is None else doc_id, k, len(own), doc_id is None) + own.tobytes()))
                place = feistel(np.concatenate(points), grid.size, key)
                shard = (place / grid.size * n_shards).astype(np.int64).clip(0, n_shards - 1)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(place), pa.array(blobs, pa.binary())], ["shard", "place", "record"])

    stride = HEADER_BYTES + 2 * seq_len

    def write(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        made, shard, sink, name, n, z = [], None, None, "", 0, zstandard.ZstdDecompressor()
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)

        def close():
            if sink is not None:
                sink.close()
                where.move(name, f"{root}/shard-{shard:06d}.bin")
                made.append((shard, f"{folder}/shard-{shard:06d}.bin", n))

        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != shard:
                    close()
                    shard, name, n = s, f"{root}/.part-{uuid.uuid4().hex}", 0
                    sink = where.open_output_stream(name, buffer_size=1 << 18)
                sink.write(z.decompress(blob.as_py()).ljust(stride, b"\0"))
                n += 1
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], ["shard", "path", "records"])

    rows = docs.mapInArrow(encode_rows, "shard long, place long, record binary")
    # a shard is a range of the permuted grid, so dealing by shard is a range partitioning without a sampling pass
    dealt = rows.repartition(n_shards, "shard").sortWithinPartitions("shard", "place", "record").select("shard", "record")
    done = sorted(tuple(r) for r in dealt.mapInArrow(write, "shard long, path string, records long").collect())  # one row per shard
    first = np.concatenate([[0], np.cumsum([n for *_, n in done])]).tolist()
    manifest = [(s, path, first[k], n) for k, (s, path, n) in enumerate(done)]
    return docs.sparkSession.createDataFrame(manifest, "shard long, path string, first_slot long, records long")


def read_shards(spark: SparkSession, manifest: DataFrame, seq_len: int = SEQ_LEN, first_slot: int = 0) -> DataFrame:
    """Records from ``first_slot`` on (a reader that resumes): slot, shard, doc_id, piece, n_tokens, ids_crc32."""
    stride = HEADER_BYTES + 2 * seq_len
    todo = manifest.where(F.col("first_slot") + F.col("records") > first_slot)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        names = ["slot", "shard", "doc_id", "piece", "n_tokens", "ids_crc32"]
        for batch in batches:
            for shard, path, first, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, file = fs.FileSystem.from_uri(path)
                at = max(0, first_slot - first)
                with where.open_input_file(file) as f:
                    f.seek(at * stride)
                    while at < records:
                        n = min(READ_RECORDS, records - at)
                        block, rows = f.read(n * stride), []
                        for k in range(n):
                            doc_id, piece, size, null = struct.unpack_from(HEADER, block, k * stride)
                            ids = np.frombuffer(block, "<u2", size, k * stride + HEADER_BYTES).astype("<u4")
                            rows.append((first + at + k, shard, None if null else doc_id, piece, size, zlib.crc32(ids)))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        at += n

    return todo.repartition(max(1, min(10_000, manifest.count())), "shard").mapInArrow(
        run, "slot long, shard long, doc_id long, piece int, n_tokens int, ids_crc32 long"
    )


def materialise(spark: SparkSession, docs: DataFrame, key: str, **options) -> DataFrame:
    """Write ``docs`` as shards in a new shared folder and read every record back."""
    manifest = write_shards(docs, new_folder(spark, "shards"), key, **options)
    return read_shards(spark, manifest, options.get("seq_len", SEQ_LEN))
