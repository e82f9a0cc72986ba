"""Ridge thinning of vote volumes.

Trace layout in; every mode reads a few neighbouring traces, so one halo exchange feeds
all of them.  Plateau runs may be as long as an axis and cross tiles: they are found
with gaps-and-islands windows over the surviving candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.angles import _c, normal_vector
from ridgeline.functions.scores import NONZERO_EPSILON
from ridgeline.grid import DEFAULT_TILING, I1, I2, I3, Tiling, to_voxels, with_shape
from ridgeline.operators import tiles as T
from ridgeline.operators.stencil import radius

_ARRAY, _FLAGS, _INTS = "array<float>", "array<boolean>", "array<int>"
_EPS = np.float32(NONZERO_EPSILON)


def _traces(df: DataFrame, tiling: Tiling, *new: str) -> list[str]:
    """Trace columns to pass through."""
    return [c for c in df.columns if c not in (I3, I2, *tiling.keys, *new)]


def _flat_smooth(a, sigma):
    return T.gauss(T.gauss(a, sigma, 0), sigma, 1)


def _full_smooth(a, sigma):
    return T.gauss(_flat_smooth(a, sigma), sigma, 2)


def binned_maxima(
    df: DataFrame, value: str, strike: str, sigma: float = 1.0, strict: bool = True,
    tiling: Tiling = DEFAULT_TILING, out: str = "keep",
) -> DataFrame:
    """Boolean array: local maxima of the i3/i2-smoothed value in the i2-i3 plane."""
    r = radius(sigma) + 1

    def fn(b, _a3, _a2):
        return {out: T.binned_maximum(_flat_smooth(b[value], sigma), b[strike], strict)}

    return T.tile_map(df, [value, strike], (r, r), fn, {out: _FLAGS}, tiling, _traces(df, tiling, out))


def thin_reference(
    df: DataFrame, value: str, strike: str, sigma: float = 1.0, reinforce_vertical: bool = True,
    tiling: Tiling = DEFAULT_TILING, out: str = "thin", keep_out: str = "keep",
) -> DataFrame:
    """Strike-binned maxima keep their *smoothed* value; steep ones also write i3-1."""
    r = radius(sigma) + 2

    def fn(b, _a3, _a2):
        s = _flat_smooth(b[value], sigma)
        keep = T.binned_maximum(s, b[strike])
        thin = T.reinforced(s, b[strike], keep) if reinforce_vertical else np.where(keep, s, np.float32(0))
        return {out: thin, keep_out: keep}

    return T.tile_map(
        df, [value, strike], (r, r), fn, {out: _ARRAY, keep_out: _FLAGS}, tiling, _traces(df, tiling, out, keep_out)
    )


def _normal(b, value, strike, dip, sigma, a3, a2):
    fs = _full_smooth(b[value], sigma)
    plus, minus = T.sides(fs, b[strike], b[dip], a3, a2)
    return fs, plus, minus, np.where((plus < fs) & (minus < fs), b[value], np.float32(0))


def thin_normal(
    df: DataFrame, value: str, strike: str, dip: str, sigma: float = 1.0,
    tiling: Tiling = DEFAULT_TILING, out: str = "thin",
) -> DataFrame:
    """Strict maxima of the smoothed value along the normal keep their *original* value."""
    r = radius(sigma) + 1

    def fn(b, a3, a2):
        return {out: _normal(b, value, strike, dip, sigma, a3, a2)[3]}

    return T.tile_map(df, [value, strike, dip], (r, r), fn, {out: _ARRAY}, tiling, _traces(df, tiling, out))


# ---------------------------------------------------------------- plateau runs


def _axis_by_component(strike: Column, dip: Column) -> Column:
    """Axis (0=i3, 1=i2, 2=i1) of the largest |normal| component; x1 first on ties."""
    w1, w2, w3 = (F.abs(x) for x in normal_vector(strike, dip))
    return F.when((w1 >= w2) & (w1 >= w3), 2).when(w2 >= w3, 1).otherwise(0)


def collapse_runs(
    cells: DataFrame, axis: str, tie: str, keys: tuple[str, ...] = (), group: tuple[str, ...] = ()
) -> DataFrame:
    """Keep one sample per unbroken run along each cell's axis.

    The first largest ``tie`` wins; the middle one when all are equal.  ``axis``
    holds 0/1/2.  Lines are at most one grid axis long and share one exchange.
    """
    pos = F.when(F.col(axis) == 0, F.col(I3)).when(F.col(axis) == 1, F.col(I2)).otherwise(F.col(I1))
    la = F.when(F.col(axis) == 0, F.col(I2)).otherwise(F.col(I3))
    lb = F.when(F.col(axis) == 2, F.col(I2)).otherwise(F.col(I1))
    work = cells.withColumns({"_pos": pos, "_la": la, "_lb": lb})
    line = [*keys, *group, axis, "_la", "_lb"]
    work = work.withColumn("_run", F.col("_pos") - F.row_number().over(Window.partitionBy(*line).orderBy("_pos")))
    run = Window.partitionBy(*line, "_run")
    work = work.withColumns(
        {
            "_lo": F.min("_pos").over(run), "_hi": F.max("_pos").over(run),
            "_tmin": F.min(tie).over(run), "_tmax": F.max(tie).over(run),
            "_first": F.min(F.struct(-F.col(tie).cast("double"), F.col("_pos"))).over(run),
        }
    )
    kept = F.when(F.col("_tmin") == F.col("_tmax"), F.floor((F.col("_lo") + F.col("_hi")) / 2)).otherwise(
        F.col("_first")["_pos"]
    )
    helpers = ["_pos", "_la", "_lb", "_run", "_lo", "_hi", "_tmin", "_tmax", "_first"]
    return work.where(F.col("_pos") == kept).drop(*helpers)


def thin_plateau(
    df: DataFrame, value: str, strike: str, dip: str, tie: str | None = None, tolerance: float = 1.0e-6,
    sigma: float = 1.0, tiling: Tiling = DEFAULT_TILING, out: str = "thin",
) -> DataFrame:
    """Plateau-aware normal thinning; returns the retained voxels only."""
    tie = tie or value
    r = radius(sigma) + 1
    tol = np.float32(tolerance)

    def fn(b, a3, a2):
        fs, plus, minus, _ = _normal(b, value, strike, dip, sigma, a3, a2)
        return {"_cand": (b[value] > _EPS) & (fs >= plus - tol) & (fs >= minus - tol)}

    cols = list(dict.fromkeys([value, strike, dip, tie]))
    t = T.tile_map(df, [value, strike, dip], (r, r), fn, {"_cand": _FLAGS}, tiling, cols)
    vox = to_voxels(t, [*cols, "_cand"], list(tiling.keys)).where("_cand")
    vox = vox.withColumn("_axis", _axis_by_component(F.col(strike).cast("double"), F.col(dip).cast("double")))
    return collapse_runs(vox, "_axis", tie, tiling.keys).select(*tiling.keys, I3, I2, I1, F.col(value).alias(out))


# ---------------------------------------------------------------- roughness, counts, hybrids


def orientation_roughness(
    df: DataFrame, strike: str, dip: str, support: str, tiling: Tiling = DEFAULT_TILING, out: str = "roughness"
) -> DataFrame:
    """Largest step of (strike, dip) to a supported face neighbour."""

    def fn(b, _a3, _a2):
        return {out: T.roughness(b[strike], b[dip], b[support])}

    return T.tile_map(df, [strike, dip, support], (1, 1), fn, {out: _ARRAY}, tiling)


def local_count(df: DataFrame, mask: str, tiling: Tiling = DEFAULT_TILING, out: str = "count27") -> DataFrame:
    """Number of true samples in the 3x3x3 neighbourhood."""
    return T.tile_map(df, [mask], (1, 1), lambda b, _a3, _a2: {out: T.count27(b[mask])}, {out: _INTS}, tiling)


def thin_hybrid(
    df: DataFrame, value: str, strike: str, dip: str, threshold: float = 8.0, sigma: float = 1.0,
    tiling: Tiling = DEFAULT_TILING, out: str = "thin",
) -> DataFrame:
    """Reference thinning where orientation is smooth, normal thinning where it is rough."""
    r = radius(sigma) + 2

    def fn(b, a3, a2):
        s = _flat_smooth(b[value], sigma)
        ref = T.reinforced(s, b[strike], T.binned_maximum(s, b[strike]))
        nrm = _normal(b, value, strike, dip, sigma, a3, a2)[3]
        return {out: np.where(T.roughness(b[strike], b[dip], b[value] > 0) <= threshold, ref, nrm)}

    return T.tile_map(df, [value, strike, dip], (r, r), fn, {out: _ARRAY}, tiling, _traces(df, tiling, out))


def hybrid_v2_traces(
    df: DataFrame, value: str, strike: str, dip: str, tie: str | None = None, threshold: float = 8.0,
    edge_margin: int = 2, tolerance: float = 1.0e-6, sigma: float = 1.0,
    tiling: Tiling = DEFAULT_TILING, out: str = "thin",
) -> DataFrame:
    """Hybrid thinning with plateau recovery in the edge shell; strike and dip pass through.

    Recovered samples are few: they are gathered per trace and join whole traces.
    """
    r = radius(sigma) + 2
    at = [*tiling.keys, I3, I2]

    def fn(b, a3, a2):
        s = _flat_smooth(b[value], sigma)
        ref = T.reinforced(s, b[strike], T.binned_maximum(s, b[strike]))
        nrm = _normal(b, value, strike, dip, sigma, a3, a2)[3]
        rough = T.roughness(b[strike], b[dip], b[value] > _EPS) > threshold
        return {
            "_base": np.where(rough & (nrm > 0), nrm, ref), "_open": (nrm <= 0) | (T.count27(nrm > 0) <= 1),
        }

    t = T.tile_map(df, [value, strike, dip], (r, r), fn, {"_base": _ARRAY, "_open": _FLAGS}, tiling, [strike, dip])
    plateau = with_shape(thin_plateau(df, value, strike, dip, tie, tolerance, sigma, tiling, "_pl"), df)
    edge = F.least(
        F.col(I3), F.col("n3") - 1 - F.col(I3), F.col(I2), F.col("n2") - 1 - F.col(I2),
        F.col(I1), F.col("n1") - 1 - F.col(I1),
    ) < edge_margin
    found = plateau.where(edge & (F.col("_pl") > 0)).groupBy(*at).agg(F.collect_list(F.struct(I1, "_pl")).alias("_p"))
    recovered = F.pandas_udf(_recovered, _ARRAY)
    return t.join(found.hint("merge"), at, "left").select(
        *at, recovered("_base", "_open", F.col(f"_p.{I1}"), F.col("_p._pl")).alias(out), strike, dip
    )


def _recovered(base: pd.Series, free: pd.Series, at: pd.Series, values: pd.Series) -> pd.Series:
    """Traces with the given samples put in where they are free."""
    out = []
    for b, f, i, v in zip(base, free, at, values):
        if i is not None and len(i):
            use = f[i]
            b = b.copy()
            b[i[use]] = v[use]
        out.append(b)
    return pd.Series(out)


def thin_hybrid_v2(
    df: DataFrame, value: str, strike: str, dip: str, tie: str | None = None, threshold: float = 8.0,
    edge_margin: int = 2, tolerance: float = 1.0e-6, sigma: float = 1.0,
    tiling: Tiling = DEFAULT_TILING, out: str = "thin",
) -> DataFrame:
    """:func:`hybrid_v2_traces` in voxel layout."""
    t = hybrid_v2_traces(df, value, strike, dip, tie, threshold, edge_margin, tolerance, sigma, tiling, out)
    return to_voxels(t, [out], list(tiling.keys))


def _edge_effect(strike: Column, dip: Column, width: int = 5) -> Column:
    """Whether a sample near an i3/i2 face has a normal that points at it."""
    c = np.float32(np.cos(np.radians(30.0)))
    limit = F.lit(float(c * c)).cast("float")
    _, w2, w3 = normal_vector(strike.cast("double"), dip.cast("double"))

    def near(i, n):
        return (F.col(i) < width) | (F.col(i) >= F.greatest(F.col(n) - width, F.lit(0)))

    return (near(I3, "n3") & ((w3 * w3).cast("float") > limit)) | (near(I2, "n2") & ((w2 * w2).cast("float") > limit))


def remove_edge_effects(df: DataFrame, value: str, strike: str, dip: str, width: int = 5) -> DataFrame:
    """Zero samples near i3/i2 faces whose normal points at the face (voxels with n3, n2).

    Fixed values: within five samples, squared normal component above cos(30 deg)^2.
    """
    keep = (F.col(value) != 0) & ~_edge_effect(_c(strike), _c(dip), width)
    zero = F.lit(0.0).cast("float")
    return df.withColumn("keep", keep).withColumns(
        {c_: F.when(F.col("keep"), F.col(c_)).otherwise(zero) for c_ in (value, strike, dip)}
    )


def scanner_thin_reference(
    df: DataFrame, ft: str = "ft", pt: str = "pt", tt: str = "tt", sigma: float = 1.0,
    remove_edges: bool = True, tiling: Tiling = DEFAULT_TILING,
) -> DataFrame:
    """Thinned scan attributes in voxel layout; angles are 0 where nothing is kept."""
    thin = thin_reference(df, ft, pt, sigma, reinforce_vertical=False, tiling=tiling, out="_thin", keep_out="_keep")
    vox = _masked_attributes(thin, ft, pt, tt, tiling)
    if remove_edges:
        vox = remove_edge_effects(with_shape(vox, df), ft, pt, tt).drop("keep", "n3", "n2", "n1")
    return vox


def scanner_thin_traces(
    df: DataFrame, ft: str = "ft", pt: str = "pt", tt: str = "tt", sigma: float = 1.0, tiling: Tiling = DEFAULT_TILING,
    shape: tuple[int, int, int] | None = None,
) -> DataFrame:
    """:func:`scanner_thin_reference` with edge effects removed, in trace layout: no voxel is shuffled to make traces again."""
    thin = thin_reference(df, ft, pt, sigma, reinforce_vertical=False, tiling=tiling, out="_thin", keep_out="_keep")
    thin = thin.withColumns(dict(zip(("n3", "n2", "n1"), map(F.lit, shape)))) if shape else with_shape(thin, df)
    zero = F.lit(0.0).cast("float")

    def sample(e):
        p, t = (F.when(e["_keep"], e[c]).otherwise(zero) for c in ("_p", "_t"))
        keep = (e["_v"] != 0) & ~_edge_effect(p, t)
        return F.struct(*[F.when(keep, x).otherwise(zero).alias(n) for n, x in ((ft, e["_v"]), (pt, p), (tt, t))])

    named = [F.col(c).alias(n) for c, n in (("_thin", "_v"), ("_keep", "_keep"), (pt, "_p"), (tt, "_t"))]
    zipped = thin.select(*tiling.keys, I3, I2, "n3", "n2", *named).withColumn("_z", F.transform(F.arrays_zip("_v", "_keep", "_p", "_t"), sample))
    return zipped.select(*tiling.keys, I3, I2, *[F.col("_z").getField(c).alias(c) for c in (ft, pt, tt)])


def scanner_thin_normal(
    df: DataFrame, ft: str = "ft", pt: str = "pt", tt: str = "tt", tiling: Tiling = DEFAULT_TILING
) -> DataFrame:
    """Positive maxima of the unsmoothed likelihood along the normal."""
    thin = thin_normal(df, ft, pt, tt, 0.0, tiling, out="_thin")
    thin = thin.withColumn("_keep", F.transform("_thin", lambda x: x > 0))
    return _masked_attributes(thin, ft, pt, tt, tiling)


def _masked_attributes(df: DataFrame, ft: str, pt: str, tt: str, tiling: Tiling) -> DataFrame:
    keys = list(tiling.keys)
    vox = to_voxels(df, ["_thin", "_keep", pt, tt], keys)
    zero = F.lit(0.0).cast("float")
    return vox.select(
        *keys, I3, I2, I1, F.col("_thin").alias(ft),
        *[F.when(F.col("_keep"), F.col(c)).otherwise(zero).alias(c) for c in (pt, tt)],
    )


def thin_2d(
    df: DataFrame, value: str, d1: str, d2: str, positive_only: bool, tiling: Tiling = DEFAULT_TILING, out: str = "keep"
) -> DataFrame:
    """2-D maxima against one linear-sampled step along +-(d1, d2); arrays of displacements."""

    def fn(b, _a3, a2):
        x = b[value]
        i2, i1 = np.ogrid[a2 : a2 + x.shape[1], 0 : x.shape[2]]
        ok = np.ones(x.shape, bool)
        for sign in (1, -1):
            o2, o1 = (
                (i + sign * b[d].astype(np.float64)).astype(np.float32).astype(np.float64) - i for i, d in ((i2, d2), (i1, d1))
            )
            total = np.zeros(x.shape)
            for k2 in (-1, 0, 1):
                for k1 in (-1, 0, 1):
                    hat = np.maximum(0, 1 - np.abs(o2 - k2)) * np.maximum(0, 1 - np.abs(o1 - k1))
                    total += hat * T.moved(x, 0, k2, k1, edge=True)
            ok &= total.astype(np.float32) < x
        return {out: ok & (x > 0) if positive_only else ok}

    return T.tile_map(df, [value, d1, d2], (0, 1), fn, {out: _FLAGS}, tiling, _traces(df, tiling, out))
