"""Derivative-bank orientation scans: a per-voxel argmax over literal angles.

One halo exchange for the derivatives, then a vectorised fold over the (small,
fixed) list of orientations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.kernels import angle_samples
from ridgeline.grid import DEFAULT_TILING, I1, I2, I3, Tiling, to_voxels
from ridgeline.operators.quantiles import quantile
from ridgeline.session import cut_lineage
from ridgeline.operators.stencil import DERIVATIVES_2D, DERIVATIVES_3D, gaussian_derivatives


def bank_2d(thetas: list[float]) -> list[dict]:
    """Normal components and cell angle per feature angle."""
    return [
        {
            "n1": -math.sin(math.radians(t)), "n2": math.cos(math.radians(t)),
            "pt": float(np.float32((180.0 - t) % 180.0)),
        }
        for t in thetas
    ]


def bank_3d(phis: list[float], thetas: list[float]) -> list[dict]:
    out = []
    for phi in phis:
        for theta in thetas:
            p, t = math.radians(phi), math.radians(theta)
            w = np.float32([-math.cos(t), math.sin(t) * math.cos(p), -math.sin(t) * math.sin(p)])
            out.append({"w1": float(w[0]), "w2": float(w[1]), "w3": float(w[2]), "pt": float(phi), "tt": float(theta)})
    return out


def _pick(bank: list[dict], score, names: list[str], angles: tuple[str, ...]) -> Column:
    """struct(s, angles...) of the best orientation per voxel.

    An Arrow UDF over the derivative columns: the same fold written with built-in
    array functions is interpreted for every voxel and orientation.
    Strictly better scores replace, so the first orientation wins ties.
    """
    table = {a: np.float32([b[a] for b in bank]) for a in angles}

    @F.pandas_udf("s float, " + ", ".join(f"{a} float" for a in angles))
    def best_of(cols: pd.DataFrame) -> pd.DataFrame:
        d = {n: cols[n].to_numpy(np.float64) for n in names}
        best = np.zeros(len(cols), np.float32)
        code = np.zeros(len(cols), np.int32)
        for k, b in enumerate(bank):
            s = score(b, d).astype(np.float32)
            better = s > best
            best = np.where(better, s, best)
            code[better] = k
        return pd.DataFrame({"s": best, **{a: t[code] for a, t in table.items()}})

    return best_of(F.struct(*names))


def normalize_p995(df: DataFrame, score: str, out: str) -> DataFrame:
    """Divide by the 99.5th percentile and clip to [0, 1]; 0 when that is not positive."""
    high = quantile(df, score, 0.995).cast("float")
    ratio = (F.col(score) / F.when(high > 0, high)).cast("float")
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)).cast("float")
    return df.withColumn(out, F.coalesce(clipped, F.lit(0.0).cast("float")))


def scan_fast_2d(
    df: DataFrame, col: str, theta_min: float, theta_max: float, sigma1: float, tiling: Tiling = DEFAULT_TILING
) -> DataFrame:
    """2-D scan; trace layout in, voxel layout (score, pt, ft) out."""
    s = max(0.75, 0.5 * sigma1)
    bank = bank_2d(angle_samples(theta_min, theta_max, sigma1))
    g = gaussian_derivatives(df, col, s, DERIVATIVES_2D, tiling, dims=2)
    vox = to_voxels(g, list(DERIVATIVES_2D), list(tiling.keys))

    def score(b, d):
        edge = np.abs(b["n1"] * d["d1"] + b["n2"] * d["d2"])
        ridge = np.abs(b["n1"] * b["n1"] * d["d11"] + 2.0 * b["n1"] * b["n2"] * d["d12"] + b["n2"] * b["n2"] * d["d22"])
        return edge + s * ridge

    best = vox.withColumn("_b", _pick(bank, score, list(DERIVATIVES_2D), ("pt",)))
    out = best.select(*tiling.keys, I3, I2, I1, F.col("_b.s").alias("score"), F.col("_b.pt").alias("pt"))
    # the scan is stored once: the normalisation reads it again
    return normalize_p995(cut_lineage(out), "score", "ft")


def scan_fast_3d(
    df: DataFrame, col: str, phis: list[float], thetas: list[float], sigma1: float, sigma2: float,
    tiling: Tiling = DEFAULT_TILING,
) -> DataFrame:
    """3-D scan; trace layout in, voxel layout (score, pt, tt, ft) out."""
    s = max(0.75, 0.5 * min(sigma1, sigma2))
    bank = bank_3d(phis, thetas)
    g = gaussian_derivatives(df, col, s, DERIVATIVES_3D, tiling)
    vox = to_voxels(g, list(DERIVATIVES_3D), list(tiling.keys))

    def score(b, d):
        edge = np.abs(b["w1"] * d["d1"] + b["w2"] * d["d2"] + b["w3"] * d["d3"])
        ridge = np.abs(
            b["w1"] * b["w1"] * d["d11"] + b["w2"] * b["w2"] * d["d22"] + b["w3"] * b["w3"] * d["d33"]
            + 2.0 * b["w1"] * b["w2"] * d["d12"] + 2.0 * b["w1"] * b["w3"] * d["d13"] + 2.0 * b["w2"] * b["w3"] * d["d23"]
        )
        return edge + s * ridge

    best = vox.withColumn("_b", _pick(bank, score, list(DERIVATIVES_3D), ("pt", "tt")))
    out = best.select(
        *tiling.keys, I3, I2, I1, F.col("_b.s").alias("score"), F.col("_b.pt").alias("pt"), F.col("_b.tt").alias("tt")
    )
    # the scan is stored once: the normalisation reads it again
    return normalize_p995(cut_lineage(out), "score", "ft")


def argmax_of_backends(df: DataFrame, backends: list[tuple[str, float]]) -> DataFrame:
    """Prior-weighted argmax over per-backend columns ``ft_<b>, pt_<b>, tt_<b>``; the first wins ties."""
    picks = [
        F.struct(
            (F.col(f"ft_{b}") * F.lit(w)).cast("float").alias("s"), F.lit(-k).alias("o"), F.lit(b).alias("backend"),
            F.col(f"pt_{b}").alias("pt"), F.col(f"tt_{b}").alias("tt"),
        )
        for k, (b, w) in enumerate(backends)
    ]
    return df.withColumn("_best", F.greatest(*picks))
