"""Stages in the shared folder, word arrays, and hashing shared by the operators.

Python code here runs inside Arrow tasks: Spark deals the rows out, a task works through
slices of bounded size, and nothing is gathered on the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.session import ship_package

SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch: texts are long, the default of 10,000 rows takes too much of an executor.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as a URI; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if "root" not in _own:
        _own["root"] = "file://" + tempfile.mkdtemp(prefix="ridgeline-shared-")
    return _own["root"]


def ready(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers and use small Arrow batches, unless the session has its own size."""
    ship_package(spark)
    if spark.conf.get(_BATCH_CONF, "10000") == "10000":
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return spark


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder that nothing else uses (not made yet)."""
    return f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, replaces: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here.

    ``replaces`` is the folder of an earlier round that nothing needs any more; it is removed once
    the new one is whole.  The result's own folder is its attribute ``folder``.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    if replaces is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(replaces)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of ``column`` exceed a bound; one row at least each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.cumsum(size), 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
        pa.default_memory_pool().release_unused()


def split_words(texts) -> tuple[np.ndarray, pa.Array]:
    """(row offsets, words): runs of anything but ASCII white space; null is empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return before[offsets - offsets[0]], flat.filter(full)


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct values)."""
    d = values.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element by element."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(words: pa.Array) -> np.ndarray:
    """Stable 64-bit hashes of words."""
    import pandas as pd

    codes, distinct = coded(words)
    values = np.array(distinct.to_pylist(), dtype=object)
    return pd.util.hash_array(values, categorize=False)[codes] if len(values) else np.zeros(0, np.uint64)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
