"""Rotate-smooth-score orientation sweeps on halo tiles.

The sweep resamples a lattice rotated about the middle of the whole volume.  A tile
evaluates that same global lattice around its own samples, so tiling changes nothing
but the place where the work is done: one exchange, no broadcast of the volume, and
the running best over all orientations stays inside the task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.kernels import angle_samples, gaussian_weights, shear_of_dip
from ridgeline.grid import DEFAULT_TILING, Tiling, key_ddl, shape_of, with_halo, with_totals
from ridgeline.operators.metrics import normalize_unit
from ridgeline.operators.tiles import with_keys

_F = np.float32
_EDGE = 1.0e-4  # a sample this close outside a bound counts as on it (rounding of rotated corners)


def block_of(pdf: pd.DataFrame, col: str) -> tuple[np.ndarray, int, int]:
    """Dense block (i3, i2, i1) of the traces of a tile, and its first i3, i2."""
    a3, a2 = int(pdf["i3"].min()), int(pdf["i2"].min())
    out = np.zeros((int(pdf["i3"].max()) - a3 + 1, int(pdf["i2"].max()) - a2 + 1, len(pdf[col].iloc[0])), _F)
    out[pdf["i3"].to_numpy() - a3, pdf["i2"].to_numpy() - a2] = np.stack(pdf[col].to_numpy())
    return out, a3, a2


def core_rows(pdf: pd.DataFrame, a3: int, a2: int, **arrays: np.ndarray) -> pd.DataFrame:
    """Traces of the tile's own samples, cut from arrays indexed like the block."""
    core = pdf.loc[pdf["_core"], ["i3", "i2"]]
    if core.empty:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("i3", "i2", *arrays)})
    at = (core["i3"].to_numpy() - a3, core["i2"].to_numpy() - a2)
    return core.assign(**{n: list(a[at]) for n, a in arrays.items()})


def _convolve(a: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    """'Valid' weighted sum along an axis (the input is wider by the kernel)."""
    n = a.shape[axis] - len(weights) + 1
    out = 0
    for k, w in enumerate(weights):
        cut = [slice(None)] * a.ndim
        cut[axis] = slice(k, k + n)
        out = out + _F(w) * a[tuple(cut)]
    return out


def _bilinear(a, y, x, ylo, yhi, xlo, xhi, a_y, a_x, fill):
    """Sample axes 0/1 of block ``a`` (origin a_y, a_x) at global (y, x); ``fill`` outside the bounds.

    ``fill=None`` clamps to the bounds instead.
    """
    inside = (y >= ylo - _EDGE) & (y <= yhi + _EDGE) & (x >= xlo - _EDGE) & (x <= xhi + _EDGE)
    y, x = np.clip(y, ylo, yhi), np.clip(x, xlo, xhi)
    fy, fx = np.floor(y), np.floor(x)
    wy, wx = (y - fy).astype(_F), (x - fx).astype(_F)
    ny, nx = a.shape[0] - 1, a.shape[1] - 1
    y0 = np.clip(fy.astype(np.int64) - a_y, 0, ny)
    x0 = np.clip(fx.astype(np.int64) - a_x, 0, nx)
    y1, x1 = np.minimum(y0 + 1, ny), np.minimum(x0 + 1, nx)
    if a.ndim == 3:
        wy, wx, inside = wy[..., None], wx[..., None], inside[..., None]
    v = (a[y0, x0] * (1 - wx) + a[y0, x1] * wx) * (1 - wy) + (a[y1, x0] * (1 - wx) + a[y1, x1] * wx) * wy
    return v if fill is None else np.where(inside, v, _F(fill))


class _Best:
    """Running best and second-best score; strictly better replaces, so the first wins ties."""

    def __init__(self, shape):
        self.best, self.second = np.zeros(shape, _F), np.zeros(shape, _F)
        self.code = np.zeros(shape, np.int32)

    def update(self, score: np.ndarray, code: int) -> None:
        score = np.maximum(score.astype(_F), _F(0))
        better = score > self.best
        self.second = np.where(better, self.best, np.maximum(self.second, score))
        self.best = np.where(better, score, self.best)
        self.code[better] = code


# ---------------------------------------------------------------- 2-D


def _sweep_2d(block, a2, n2, thetas, sigma1):
    """Scores of the rows of a 2-D block: rotate, smooth (1 across, sigma1 along), rotate back."""
    n1 = block.shape[1]
    h1, h2 = n1 // 2, n2 // 2
    w2, w1 = gaussian_weights(1.0), gaussian_weights(sigma1)
    r2, r1 = len(w2) // 2, len(w1) // 2
    rows, cols = np.mgrid[a2 : a2 + block.shape[0], 0:n1].astype(np.float64)
    best = _Best(block.shape)
    for code, theta in enumerate(thetas):
        t = math.radians(-theta)
        c, s = math.cos(t), math.sin(t)
        m2 = max(abs(round(h2 * c + h1 * s)), abs(round(h2 * c - h1 * s)))
        m1 = max(abs(round(h1 * c - h2 * s)), abs(round(h1 * c + h2 * s)))
        x1 = np.clip(c * (cols - h1) - s * (rows - h2), -m1, m1)
        x2 = np.clip(s * (cols - h1) + c * (rows - h2), -m2, m2)
        lo2, hi2 = int(np.floor(x2.min())), int(np.floor(x2.max())) + 1
        lo1, hi1 = int(np.floor(x1.min())), int(np.floor(x1.max())) + 1
        k2, k1 = np.meshgrid(
            np.clip(np.arange(lo2 - r2, hi2 + r2 + 1), -m2, m2), np.clip(np.arange(lo1 - r1, hi1 + r1 + 1), -m1, m1),
            indexing="ij",
        )
        lattice = _bilinear(
            block, k2 * c - k1 * s + h2, k1 * c + k2 * s + h1, 0, n2 - 1, 0, n1 - 1, a2, 0, None
        )
        smooth = _convolve(_convolve(lattice, w2, 0), w1, 1)
        back = _bilinear(smooth, x2, x1, -m2, m2, -m1, m1, lo2, lo1, None)
        best.update(1 - back**4, code)
    return best


def scan_reference_2d(
    df: DataFrame, col: str, theta_min: float, theta_max: float, sigma1: float, normalize: bool = True,
    tiling: Tiling = DEFAULT_TILING, shape: tuple[int, int] | None = None,
) -> DataFrame:
    """2-D sweep of an image in trace layout (i3 = 0); adds arrays ft and pt."""
    thetas = angle_samples(theta_min, theta_max, sigma1)
    cell = np.float32([(180.0 - t) % 180.0 for t in thetas])
    n2 = shape[0] if shape else int(shape_of(df).first()["n2"])
    lo = df.agg(F.min(F.array_min(col)).alias("v")).select("v").scalar().cast("double")
    hi = df.agg(F.max(F.array_max(col)).alias("v")).select("v").scalar().cast("double")
    if normalize:
        src = df.withColumns({"_lo": lo, "_span": hi - lo}).select(
            "i3", "i2", F.col("_span"),
            F.transform(col, lambda x: F.try_divide(x - F.col("_lo"), F.col("_span")).cast("float")).alias("g"),
        )
        src = src.withColumn("g", F.transform("g", lambda x: F.coalesce(x, F.lit(1.0).cast("float")))).drop("_span")
    else:
        src = df.select("i3", "i2", F.col(col).alias("g"))
    r = math.ceil(math.hypot(int(4 * sigma1 + 0.5), 4)) + 2

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        block, a3, a2 = block_of(pdf, "g")
        b = _sweep_2d(block[0], a2, n2, thetas, sigma1)
        ft = np.clip(b.best, 0, 1) if normalize else b.best
        return core_rows(pdf, a3, a2, ft=ft[None], pt=cell[b.code][None])

    tiles = with_halo(src, 0, r, tiling)
    out = tiles.groupBy(*tiling.tile_cols).applyInPandas(tile, "i3 int, i2 int, ft array<float>, pt array<float>")
    return _constant(out, lo == hi, {"ft": 0.0, "pt": float(cell[0])})


def _constant(traces: DataFrame, flat, values: dict[str, float]) -> DataFrame:
    """A constant input has no orientation: fixed values (zero likelihood, first sampled angles) where ``flat`` holds."""
    marked = traces.withColumn("_flat", flat)
    kept = [c for c in traces.columns if c not in values]
    filled = lambda c, v: F.transform(c, lambda _x: F.lit(v).cast("float"))
    put = [F.when(F.col("_flat"), filled(c, v)).otherwise(F.col(c)).alias(c) for c, v in values.items()]
    return marked.select(*kept, *put)


def stronger_branch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per sample the stronger of two scans (trace layout, ft and pt); the left wins ties."""
    r = right.select("i3", "i2", F.col("ft").alias("_ft"), F.col("pt").alias("_pt"))
    j = left.join(r, ["i3", "i2"])
    z = F.arrays_zip("ft", "pt", "_ft", "_pt")
    return j.select(
        "i3", "i2",
        F.transform(z, lambda e: F.greatest(e["ft"], e["_ft"])).alias("ft"),
        F.transform(z, lambda e: F.when(e["_ft"] > e["ft"], e["_pt"]).otherwise(e["pt"])).alias("pt"),
    )


def scan_dip_2d(df: DataFrame, col: str, theta_min: float, theta_max: float, sigma1: float, tiling: Tiling = DEFAULT_TILING) -> DataFrame:
    """Both dip branches, the stronger one per sample."""
    left = scan_reference_2d(df, col, 90.0 - theta_max, 90.0 - theta_min, sigma1, tiling=tiling)
    right = scan_reference_2d(df, col, 90.0 + theta_min, 90.0 + theta_max, sigma1, tiling=tiling)
    return stronger_branch(left, right)


# ---------------------------------------------------------------- 3-D rotate and shear


def _half_widths(n2: int, n3: int, c: float, s: float) -> tuple[float, float]:
    """Extent of the rotated (i2, i3) rectangle along the rotated axes."""
    a, b = 0.5 * (n2 - 1), 0.5 * (n3 - 1)
    return abs(a * c) + abs(b * s), abs(a * s) + abs(b * c)


def _lattice_size(radius: float) -> int:
    near = round(radius)
    return 2 * (near if math.isclose(radius, near, abs_tol=1e-6) else math.ceil(radius)) + 1


def _dip_smooth(strike, lo2, size2, j2, h, c1, weights):
    """Shear by h, smooth along i1, shear back; at lattice columns j2 (rows of axis 1).

    ``strike`` holds columns from lo2 on; outside [0, size2-1] the sheared image is 1.
    """
    n1 = strike.shape[2]
    i1 = np.arange(n1)
    r = len(weights) // 2
    x = j2[:, None] + h * (i1 - c1)[None, :]
    t0 = np.floor(x)
    f = (x - t0).astype(_F)
    out = np.zeros((strike.shape[0], j2.size, n1), _F)
    top = strike.shape[1] - 1
    for k, w in enumerate(weights):
        at = np.clip(i1 + k - r, 0, n1 - 1)
        for dt, share in ((0, 1 - f), (1, f)):
            y = (t0 + dt) - h * (at - c1)[None, :]
            y0 = np.floor(y)
            g = (y - y0).astype(_F)
            p = np.clip(y0.astype(np.int64) - lo2, 0, top)
            v = strike[:, p, at[None, :]] * (1 - g) + strike[:, np.minimum(p + 1, top), at[None, :]] * g
            out += _F(w) * share * np.where((y >= -_EDGE) & (y <= size2 - 1 + _EDGE), v, _F(1))
    return np.where((x >= -_EDGE) & (x <= size2 - 1 + _EDGE), out, _F(1))


def _sweep_3d(block, a3, a2, core, shape, phis, thetas, sigma):
    """Best orientation of the core columns ``core`` = (i3, i2) index arrays of the tile."""
    n3, n2, n1 = shape
    ws = gaussian_weights(sigma) if sigma > 0 else [1.0]
    rs = len(ws) // 2
    i3, i2 = core
    c1, c2, c3 = _F(0.5 * (n1 - 1)), 0.5 * (n2 - 1), 0.5 * (n3 - 1)
    best = _Best((i3.size, n1))
    dips = []
    for theta in thetas:
        sd = sigma * abs(math.sin(math.radians(theta)))
        w = gaussian_weights(sd) if sd > 0 else [1.0]
        dips.append((shear_of_dip(theta), w, math.ceil(abs(shear_of_dip(theta)) * (len(w) // 2)) + 2))
    margin = max(m for _, _, m in dips)
    for a, phi in enumerate(phis):
        c, s = float(_F(math.cos(math.radians(phi)))), float(_F(math.sin(math.radians(phi))))
        e2, e3 = _half_widths(n2, n3, c, s)
        size2, size3 = _lattice_size(e2), _lattice_size(e3)
        x2 = (i2 - c2) * c - (i3 - c3) * s + e2
        x3 = (i2 - c2) * s + (i3 - c3) * c + e3
        lo2, hi2 = max(int(np.floor(x2.min())), 0), min(int(np.floor(x2.max())) + 1, size2 - 1)
        lo3, hi3 = max(int(np.floor(x3.min())), 0), min(int(np.floor(x3.max())) + 1, size3 - 1)
        cols = np.arange(lo2 - margin, hi2 + margin + 1)
        rows = np.clip(np.arange(lo3 - rs, hi3 + rs + 1), 0, size3 - 1)
        d3, d2 = np.meshgrid(rows - e3, cols - e2, indexing="ij")
        rot = _bilinear(block, c3 - d2 * s + d3 * c, c2 + d2 * c + d3 * s, 0, n3 - 1, 0, n2 - 1, a3, a2, 1.0)
        strike = _convolve(rot, ws, 0)
        j2 = np.arange(lo2, hi2 + 1)
        for b, (h, w, _) in enumerate(dips):
            u = np.clip(_dip_smooth(strike, int(cols[0]), size2, j2, h, c1, w), 0, 1)
            score = _bilinear(1 - u**4, x3, x2, 0, size3 - 1, 0, size2 - 1, lo3, lo2, 0.0)
            best.update(np.clip(score, 0, 1), a * len(thetas) + b)
    return best


def _sweep_3d_directional(block, a3, a2, core, shape, phis, thetas, sigma):
    """Directional Gaussian along strike, then along dip, sampled trilinearly (radius ceil(3 sigma))."""
    n3, n2, n1 = shape
    i3, i2 = core
    r = math.ceil(3.0 * sigma)
    off = np.arange(-r, r + 1)
    w = np.exp(-0.5 * (off / sigma) ** 2).astype(_F)
    w /= w.sum(dtype=_F)
    best = _Best((i3.size, n1))
    code = 0
    depth = np.arange(n1)
    for phi in phis:
        p = math.radians(phi)
        sp, cp = float(_F(math.sin(p))), float(_F(math.cos(p)))
        for theta in thetas:
            t = math.radians(theta)
            dip = [float(_F(x)) for x in (math.sin(t), math.cos(t) * cp, -math.cos(t) * sp)]
            total = np.zeros((i3.size, n1), _F)
            for kd, wd in zip(off, w):
                y3, y2 = np.clip(i3 + kd * dip[2], 0, n3 - 1), np.clip(i2 + kd * dip[1], 0, n2 - 1)
                y1 = np.clip(depth + kd * dip[0], 0, n1 - 1)
                f1 = np.floor(y1).astype(np.int64)
                g1 = (y1 - f1).astype(_F)
                up = np.minimum(f1 + 1, n1 - 1)
                # the strike-smoothed volume at the four surrounding columns
                for q3, u3 in ((np.floor(y3), 1 - (y3 - np.floor(y3))), (np.floor(y3) + 1, y3 - np.floor(y3))):
                    for q2, u2 in ((np.floor(y2), 1 - (y2 - np.floor(y2))), (np.floor(y2) + 1, y2 - np.floor(y2))):
                        col = np.zeros((i3.size, n1), _F)
                        for ks, wk in zip(off, w):
                            col += wk * _bilinear(
                                block, np.minimum(q3, n3 - 1) + ks * cp, np.minimum(q2, n2 - 1) + ks * sp,
                                0, n3 - 1, 0, n2 - 1, a3, a2, None,
                            )
                        total += wd * (u3 * u2).astype(_F)[:, None] * (col[:, f1] * (1 - g1) + col[:, up] * g1)
            total = np.clip(total, 0, 1)
            best.update(1 - total**4, code)
            code += 1
    return best


def scan_sweep_3d(
    df: DataFrame, col: str, phis: list[float], thetas: list[float], sigma: float, backend: str = "rotate_shear",
    tiling: Tiling = DEFAULT_TILING, shape: tuple[int, int, int] | None = None, normalize: bool = True,
) -> DataFrame:
    """3-D sweep of a planarity volume in trace layout.

    Returns the tiling's keys, i3, i2 and arrays ft, pt, tt, gap (best minus second-best score).
    Volumes of several keys are swept side by side; they share one shape.
    """
    if backend not in ("rotate_shear", "directional"):
        raise ValueError("backend must be 'rotate_shear' or 'directional'")
    row = None if shape else shape_of(df).first()
    n3, n2, n1 = shape or (int(row["n3"]), int(row["n2"]), int(row["n1"]))
    if backend == "rotate_shear":
        rs = int(4 * sigma + 0.5)
        margin = max(math.ceil(abs(shear_of_dip(t)) * int(4 * sigma * abs(math.sin(math.radians(t))) + 0.5)) + 2 for t in thetas)
        halo = math.ceil(math.hypot(rs + 2, margin + 2)) + 1
    else:
        halo = 2 * math.ceil(3.0 * sigma) + 3
    strikes, dips, keys = np.float32(phis), np.float32(thetas), tiling.keys
    sweep = _sweep_3d if backend == "rotate_shear" else _sweep_3d_directional

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["_core"].any():
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (*keys, "i3", "i2", "ft", "pt", "tt", "gap")})
        block, a3, a2 = block_of(pdf, "g")
        own = with_keys(pdf.loc[pdf["_core"], ["i3", "i2"]], pdf, keys)[[*keys, "i3", "i2"]]
        core = own["i3"].to_numpy(np.int64), own["i2"].to_numpy(np.int64)
        b = sweep(block, a3, a2, core, (n3, n2, n1), phis, thetas, sigma)
        return own.assign(
            ft=list(np.clip(b.best, 0, 1) if normalize else b.best), pt=list(strikes[b.code // len(thetas)]),
            tt=list(dips[b.code % len(thetas)]), gap=list(np.maximum(b.best - b.second, 0)),
        )

    src = df.select(*keys, "i3", "i2", F.col(col).alias("g"))
    out = with_halo(src, halo, halo, tiling).groupBy(*tiling.tile_cols).applyInPandas(
        tile, f"{key_ddl(src, keys)}i3 int, i2 int, ft array<float>, pt array<float>, tt array<float>, gap array<float>"
    )
    out = with_totals(out, src, keys, _lo=F.min(F.array_min("g")), _hi=F.max(F.array_max("g")))
    flat = F.col("_lo") == F.col("_hi")
    return _constant(out, flat, {"ft": 0.0, "pt": float(phis[0]), "tt": float(thetas[0]), "gap": 0.0}).drop("_lo", "_hi")


def confidence(voxels: DataFrame, gap: str = "gap", out: str = "confidence") -> DataFrame:
    """Best-minus-second gap scaled to [0, 1] over the volume."""
    return normalize_unit(voxels, gap, out)
