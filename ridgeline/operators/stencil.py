"""Gaussian smoothing and derivatives of trace-layout volumes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.grid import DEFAULT_TILING, Tiling
from ridgeline.operators.tiles import gauss, tile_map


def along_trace(col: str | Column, weights: list[float]) -> Column:
    """Weighted sum along i1 of one trace, indices clamped at both ends."""
    c = F.col(col) if isinstance(col, str) else col
    r = len(weights) // 2

    def at(_x, i):
        last = F.size(c) - 1
        terms = [
            F.get(c, F.greatest(F.lit(0), F.least(last, i + (k - r)))) * F.lit(w)
            for k, w in enumerate(weights)
        ]
        return reduce(lambda a, b: a + b, terms).cast("float")

    return F.transform(c, at)


def radius(sigma: float) -> int:
    return int(4.0 * sigma + 0.5) if sigma > 0 else 0


def smooth(
    df: DataFrame,
    col: str,
    out: str,
    sigmas: float | tuple[float, float, float],
    tiling: Tiling = DEFAULT_TILING,
) -> DataFrame:
    """Gaussian smoothing of a trace-layout volume with nearest edges."""
    s3, s2, s1 = sigmas if isinstance(sigmas, tuple) else (sigmas,) * 3
    keep = [c for c in df.columns if c not in ("i3", "i2", out, *tiling.keys)]

    def fn(b, _a3, _a2):
        return {out: gauss(gauss(gauss(b[col], s3, 0), s2, 1), s1, 2)}

    if out == col:
        keep = [c for c in keep if c != col]
    return tile_map(df, [col], (radius(s3), radius(s2)), fn, {out: "array<float>"}, tiling, keep)


# derivative name -> orders along (i3, i2, i1)
DERIVATIVES_3D = {
    "d1": (0, 0, 1), "d2": (0, 1, 0), "d3": (1, 0, 0),
    "d11": (0, 0, 2), "d22": (0, 2, 0), "d33": (2, 0, 0),
    "d12": (0, 1, 1), "d13": (1, 0, 1), "d23": (1, 1, 0),
}
DERIVATIVES_2D = {k: DERIVATIVES_3D[k] for k in ("d1", "d2", "d11", "d22", "d12")}


def gaussian_derivatives(
    df: DataFrame,
    col: str,
    sigma: float,
    which: dict[str, tuple[int, int, int]] = DERIVATIVES_3D,
    tiling: Tiling = DEFAULT_TILING,
    dims: int = 3,
) -> DataFrame:
    """Gaussian derivatives; passes shared between outputs, one exchange in all."""
    r = radius(sigma)

    def fn(b, _a3, _a2):
        along3 = {o[0]: gauss(b[col], sigma, 0, o[0]) if dims == 3 else b[col] for o in which.values()}
        along2 = {o[:2]: gauss(along3[o[0]], sigma, 1, o[1]) for o in which.values()}
        return {n: gauss(along2[o[:2]], sigma, 2, o[2]) for n, o in which.items()}

    return tile_map(df, [col], (r if dims == 3 else 0, r), fn, {n: "array<float>" for n in which}, tiling)
