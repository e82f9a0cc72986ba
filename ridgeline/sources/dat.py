"""Headerless float32 volumes (C order, i3 slowest) as a Spark data source.

One partition per block of i3 slices, filters on i3 prune partitions, and the sink writes one
block of slices per task and joins the blocks in order, so neither side ever holds the volume.
Paths may be URIs of any file system that Arrow reaches.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

from ridgeline.session import file_system

_SCHEMA = "i3 int, i2 int, trace array<float>"


def _dims(options) -> tuple[int, int, int]:
    n3, n2, n1 = (int(x) for x in options["shape"].split(","))
    if min(n3, n2, n1) <= 0:
        raise ValueError("shape must be positive")
    return n3, n2, n1


def _dtype(options) -> np.dtype:
    endian = options.get("endian", "big")
    if endian not in ("big", "little"):
        raise ValueError("endian must be 'big' or 'little'")
    return np.dtype(">f4" if endian == "big" else "<f4")


class Slab(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class DatReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dims, self.dtype = options["path"], _dims(options), _dtype(options)
        self.depth = int(options.get("slabdepth", options.get("slabDepth", "8")))
        self.lo, self.hi = 0, self.dims[0]
        n3, n2, n1 = self.dims
        where, file = file_system(self.path)
        info = where.get_file_info(file)
        if not info.is_file:
            raise ValueError(f"{self.path} is no regular file")
        if info.size != n3 * n2 * n1 * 4:
            raise ValueError(f"{self.path} holds {info.size} bytes, shape {self.dims} needs {n3 * n2 * n1 * 4}")

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("i3",):
                if isinstance(f, EqualTo):
                    self.lo, self.hi = max(self.lo, f.value), min(self.hi, f.value + 1)
                    continue
                if isinstance(f, GreaterThanOrEqual):
                    self.lo = max(self.lo, f.value)
                    continue
                if isinstance(f, GreaterThan):
                    self.lo = max(self.lo, f.value + 1)
                    continue
                if isinstance(f, LessThan):
                    self.hi = min(self.hi, f.value)
                    continue
                if isinstance(f, LessThanOrEqual):
                    self.hi = min(self.hi, f.value + 1)
                    continue
            yield f

    def partitions(self):
        cuts = range(self.lo, self.hi, self.depth)
        return [Slab(a, min(a + self.depth, self.hi)) for a in cuts] or [Slab(0, 0)]

    def read(self, partition):
        _, n2, n1 = self.dims
        where, file = file_system(self.path)
        with where.open_input_file(file) as f:
            f.seek(partition.start * n2 * n1 * 4)
            for i3 in range(partition.start, partition.stop):
                flat = np.frombuffer(f.read(n2 * n1 * 4), dtype=self.dtype).astype(np.float32)
                if not np.isfinite(flat).all():
                    raise ValueError(f"non-finite sample in slice {i3}")
                traces = pa.FixedSizeListArray.from_arrays(pa.array(flat), n1).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n2, i3, np.int32)), pa.array(np.arange(n2, dtype=np.int32)), traces],
                    names=["i3", "i2", "trace"],
                )


class DatSource(DataSource):
    """``spark.read.format("ridgeline_dat").option("shape", "n3,n2,n1").load(path)``."""

    @classmethod
    def name(cls):
        return "ridgeline_dat"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return DatReader(self.options)


def register(spark: SparkSession) -> None:
    # lets range conditions on i3 reach DatReader.pushFilters
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DatSource)


def read_dat(spark: SparkSession, path: str, shape: tuple[int, int, int], endian: str = "big", slab_depth: int = 8) -> DataFrame:
    register(spark)
    return (
        spark.read.format("ridgeline_dat").option("shape", ",".join(map(str, shape))).option("endian", endian)
        .option("slabDepth", slab_depth).load(path)
    )


def write_dat(
    df: DataFrame, path: str, shape: tuple[int, int, int], col: str = "trace", endian: str = "big", slab_depth: int = 8
) -> None:
    """Write a dense trace-layout volume to one file.

    Traces are dealt by block of slices and sorted; each task writes its block whole under a name of
    its own (a repeated task writes another, only the counted one is used).  The blocks are then
    joined in order and the result is renamed into place.
    """
    n3, n2, n1 = shape
    dtype = np.dtype(">f4" if endian == "big" else "<f4")
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    blocks = -(-n3 // slab_depth)

    def store(batches):
        where, folder = file_system(parts)
        where.create_dir(folder, recursive=True)
        made, block, sink, name, expect = [], None, None, "", 0

        def close():
            if sink is not None:
                sink.close()
                made.append((block, name, expect - block * slab_depth * n2))

        for batch in batches:
            flats = batch.column(1).to_numpy()
            lists = batch.column(2)
            if not (np.diff(lists.offsets.to_numpy()) == n1).all():
                raise ValueError("trace length differs from the shape")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, n1)
            start = 0
            for own in np.unique(batch.column(0).to_numpy()):
                n = int((batch.column(0).to_numpy() == own).sum())
                if own != block:
                    close()
                    block, name, expect = int(own), f"{folder}/{own}-{uuid.uuid4().hex}", int(own) * slab_depth * n2
                    sink = where.open_output_stream(name)
                if (flats[start : start + n] != np.arange(expect, expect + n)).any():
                    raise ValueError(f"the volume is not dense at trace {expect}")
                sink.write(values[start : start + n].tobytes())
                start, expect = start + n, expect + n
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["block", "name", "n"])

    flat = F.col("i3").cast("bigint") * n2 + F.col("i2")
    rows = df.select(F.floor(F.col("i3") / slab_depth).cast("bigint").alias("block"), flat.alias("flat"), F.col(col).cast("array<float>").alias("v"))
    dealt = rows.repartition(min(blocks, 10_000), "block").sortWithinPartitions("flat")
    done = sorted(tuple(r) for r in dealt.mapInArrow(store, "block bigint, name string, n bigint").collect())  # one row per block
    wrote = sum(n for *_, n in done)
    if wrote != n3 * n2 or [b for b, *_ in done] != list(range(blocks)):
        raise ValueError(f"wrote {wrote} traces, shape {shape} needs {n3 * n2}")
    where, target = file_system(path)
    with where.open_output_stream(f"{target}.part") as out:
        for _, name, _ in done:
            with where.open_input_stream(name, compression=None) as block:
                while chunk := block.read(4 << 20):
                    out.write(chunk)
    where.move(f"{target}.part", target)
    where.delete_dir(file_system(parts)[1])


def fill_missing(df: DataFrame, shape: tuple[int, int, int], col: str = "trace", value: float = 0.0) -> DataFrame:
    """A volume with holes (traces that are absent, NULL or empty) made dense for :func:`write_dat`."""
    n3, n2, n1 = shape
    have = df.where(F.size(col) > 0).select("i3", "i2", F.col(col).cast("array<float>").alias(col))
    i = F.col("id")
    frame = df.sparkSession.range(n3 * n2).select(F.floor(i / n2).cast("int").alias("i3"), F.pmod(i, F.lit(n2)).cast("int").alias("i2"))
    empty = F.array_repeat(F.lit(float(value)).cast("float"), n1)
    return frame.join(have.hint("merge"), ["i3", "i2"], "left").select("i3", "i2", F.coalesce(col, empty).alias(col))


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of the files under a folder (one task per file)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
