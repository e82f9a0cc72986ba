"""Session helpers: shipping the package to workers and cutting lineage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per SparkContext.

    The same thing ``spark-submit --py-files`` does; needed when the session
    was started by somebody else and the repository is not on the workers' path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_ridgeline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("ridgeline", os.path.relpath(path, root)))
    target = os.path.join(tempfile.mkdtemp(prefix="ridgeline-"), "ridgeline_pkg.zip")
    with open(target, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(target)
    sc._ridgeline_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back only where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    if not shared:
        if sc.master.split("[")[0] != "local":  # local-cluster has executors of its own
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="ridgeline-checkpoint-")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_own_root: list[str] = []


def new_folder(spark: SparkSession, prefix: str) -> str:
    """URI of a folder below the cluster's shared folder that nothing else uses (not made yet).

    Works for any file system Spark reads; a temporary folder is used only in local mode.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="ridgeline-shared-"))
        root = _own_root[0]
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/{prefix.strip('-')}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """(file system, path) of a URI or of a plain local path, for use on the driver and inside tasks."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)
