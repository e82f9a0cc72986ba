"""Small volumes and brute-force twins."""

from __future__ import annotations

import numpy as np

XYZ = ["i3", "i2", "i1"]


def traces(spark, **arrays):
    """Trace-layout DataFrame of equally shaped (i3, i2, i1) arrays."""
    first = next(iter(arrays.values()))
    rows = []
    for i3 in range(first.shape[0]):
        for i2 in range(first.shape[1]):
            rows.append((i3, i2, *[[float(x) for x in a[i3, i2]] for a in arrays.values()]))
    ddl = "i3 int, i2 int, " + ", ".join(f"{n} array<float>" for n in arrays)
    return spark.createDataFrame(rows, ddl)


def voxels(spark, **arrays):
    first = next(iter(arrays.values()))
    rows = [(*map(int, i), *[float(a[tuple(i)]) for a in arrays.values()]) for i in np.ndindex(first.shape)]
    return spark.createDataFrame(rows, "i3 int, i2 int, i1 int, " + ", ".join(f"{n} float" for n in arrays))


def to_array(df, col, shape):
    """Dense array from trace rows."""
    out = np.zeros(shape, np.float32)
    for r in df.select("i3", "i2", col).collect():
        out[r["i3"], r["i2"]] = np.asarray(r[col], np.float32)
    return out


def gauss_axis(a, weights, axis):
    r, n = len(weights) // 2, a.shape[axis]
    i = np.arange(n)
    return sum(w * np.take(a, np.clip(i + k - r, 0, n - 1), axis=axis) for k, w in enumerate(weights)).astype(np.float32)


def greedy(score, keep, d, late_first, second=None):
    """Best-first picks with everything inside the box of a pick dropped."""
    flat = np.flatnonzero(keep)
    sec = np.zeros(score.size) if second is None else second.ravel()
    order = sorted(flat, key=lambda f: (-score.ravel()[f], -sec[f], -f if late_first else f))
    picked = []
    for f in order:
        p = np.array(np.unravel_index(f, score.shape))
        if all(np.abs(p - q).max() > d for q in picked):
            picked.append(p)
    return {tuple(int(x) for x in p) for p in picked}
