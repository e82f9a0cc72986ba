"""Exact Euclidean distance from voxels to the nearest voxel of a sparse set.

Separable over the axes: squared distances are taken along i1 inside a trace, then
minimised over i2 inside a slab, then over i3.  Each step is a shuffle on grid
coordinates, so group sizes follow from the axis lengths, never from the data, and
no pair of points is ever formed.  Chunks along i1 shrink as the i3 axis grows, so a
group holds a bounded number of values, and each pass looks only as far as the
distances found so far.  Short slabs and lines share a group: what a group costs by
itself would otherwise outweigh the work in it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.tiles import with_keys

_CHUNK = 256
_GROUP_VALUES = 1 << 22  # distances held by one group
_SHARED_VALUES = 1 << 18  # distances up to which slabs, and lines along i3, share a group
_FEW = 64
_FAR = np.iinfo(np.int64).max // 4


def _spread(f: np.ndarray) -> np.ndarray:
    """min over j of f[j] + (i - j)^2 along the first axis; stops at the largest distance left."""
    best = f.copy()
    for k in range(1, len(f)):
        if k * k >= best.max():
            break
        np.minimum(best[k:], f[:-k] + k * k, out=best[k:])
        np.minimum(best[:-k], f[k:] + k * k, out=best[:-k])
    return best


def _reach(f: np.ndarray, first: int, i3: np.ndarray, i1: np.ndarray) -> np.ndarray:
    """min over planes p of f[p - first, i1] + (i3 - p)^2 for points; a point rests once nothing nearer can come."""
    at, last = i3 - first, len(f) - 1
    best = np.full(i3.size, _FAR)
    live = np.arange(i3.size)
    k = 0
    while live.size:
        for step in {k, -k}:
            j = at[live] + step
            ok = (j >= 0) & (j <= last)
            hit = live[ok]
            best[hit] = np.minimum(best[hit], f[j[ok], i1[hit]] + k * k)
        k += 1
        inside = (at[live] + k <= last) | (at[live] - k >= 0)
        live = live[inside & (best[live] > k * k) | (inside & (best[live] == _FAR))]
        if k > last + abs(int(at.max(initial=0))) + abs(int(at.min(initial=0))) + 1:
            break
    return best



def nearest_distance(points: DataFrame, targets: DataFrame, n2, chunk: int = _CHUNK, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``points`` (keys, i3, i2, i1) that have a target in their key, with ``d2``.

    ``n2`` is a Column or int: the extent of i2.
    """
    n2c = F.lit(n2) if isinstance(n2, int) else n2
    k = [*keys]
    ends = targets.agg(F.max("i3").alias("i3"), F.max("i1").alias("i1")).first()  # two numbers
    n3 = int(ends["i3"] or 0) + 1
    chunk = max(16, min(chunk, _GROUP_VALUES // n3, int(ends["i1"] or 0) + 1))  # no wider than the traces
    lines = targets.groupBy(*k, "i3", "i2").agg(F.array_sort(F.collect_set("i1")).alias("at"))
    wanted = points.select(*k, F.floor(F.col("i1") / chunk).cast("int").alias("c1")).distinct()
    if keys:
        lines = lines.join(F.broadcast(wanted), k)  # a few rows a key
    else:
        lines = lines.withColumn("c1", F.explode(wanted.agg(F.collect_set("c1").alias("c")).select("c").scalar()))
    slabs_shared = F.greatest(F.lit(1), F.floor(_SHARED_VALUES / (F.col("n2") * chunk)))
    lines = lines.withColumn("n2", n2c.cast("int")).withColumn("_g", F.col("i3") - F.col("i3") % slabs_shared)
    key_ddl = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in points.schema.fields if f.name in keys)

    def slab(pdf: pd.DataFrame) -> pd.DataFrame:
        i1 = np.arange(chunk, dtype=np.int64) + int(pdf["c1"].iloc[0]) * chunk
        rows = np.arange(int(pdf["n2"].iloc[0]), dtype=np.int64)
        planes, blocks = [], []
        for plane, mine in pdf.groupby("i3"):
            best = np.full((rows.size, chunk), _FAR)
            few = len(mine) <= _FEW
            for i2, at in zip(mine["i2"], mine["at"]):
                at = np.asarray(at, dtype=np.int64)
                j = np.searchsorted(at, i1)
                near = np.minimum(
                    np.abs(at[np.minimum(j, at.size - 1)] - i1), np.abs(at[np.maximum(j - 1, 0)] - i1)
                )
                if few:
                    np.minimum(best, (near * near)[None, :] + ((rows - i2) ** 2)[:, None], out=best)
                else:
                    best[i2] = np.minimum(best[i2], near * near)
            planes.append(plane)
            blocks.append(best if few else _spread(best))
        out = pd.DataFrame({"i3": np.repeat(planes, rows.size), "i2": np.tile(rows, len(planes)), "d2": list(np.concatenate(blocks))})
        return with_keys(out, pdf, [*k, "c1"])[[*k, "i3", "c1", "i2", "d2"]]

    # An explicit count: the rows are short but the work on them is not, so they must not be coalesced.
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slabs = lines.repartition(n, *k, "_g", "c1").groupBy(*k, "_g", "c1").applyInPandas(
        slab, f"{key_ddl}i3 int, c1 int, i2 int, d2 array<bigint>"
    )
    lines_shared = max(1, _SHARED_VALUES // (n3 * chunk))
    beside = (F.col("i2") - F.col("i2") % lines_shared).alias("_g")
    slabs = slabs.select("*", beside)
    asked = points.select(*k, "i3", "i2", "i1", F.floor(F.col("i1") / chunk).cast("int").alias("c1"), beside)

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = [*k, "i3", "i2", "i1", "d2"]
        none = pd.DataFrame({c: pd.Series([], dtype=object) for c in cols})
        if left.empty or right.empty:
            return none
        parts = []
        found = dict(iter(right.groupby("i2")))
        for i2, mine in left.groupby("i2"):
            if (grid := found.get(i2)) is None:
                continue
            parts.append(line(mine, grid["i3"].to_numpy(np.int64), np.stack(grid["d2"].to_numpy())))
        return with_keys(pd.concat(parts), left, k)[cols] if parts else none

    def line(mine: pd.DataFrame, planes: np.ndarray, grid: np.ndarray) -> pd.DataFrame:
        i3 = mine["i3"].to_numpy(np.int64)
        i1 = mine["i1"].to_numpy(np.int64) - int(mine["c1"].iloc[0]) * chunk
        if planes.size <= _FEW:
            best = np.full(i3.size, _FAR)
            for p, row in zip(planes, grid):
                np.minimum(best, row[i1] + (i3 - p) ** 2, out=best)
        else:
            first = int(planes.min())
            dense = np.full((int(planes.max()) - first + 1, grid.shape[1]), _FAR)
            dense[planes - first] = grid
            best = _reach(dense, first, i3, i1)
        return mine[["i3", "i2", "i1"]].assign(d2=best)

    return (
        asked.repartition(n, *k, "_g", "c1").groupBy(*k, "_g", "c1")
        .cogroup(slabs.repartition(n, *k, "_g", "c1").groupBy(*k, "_g", "c1"))
        .applyInPandas(across, f"{key_ddl}i3 int, i2 int, i1 int, d2 bigint")
    )
