"""Optimal-path (2-D) and optimal-surface (3-D) voting.

Seeds are sent to the tile that owns them, next to the traces of that tile and a halo
as wide as the search box; every task solves its seeds together and emits votes that
are already summed per voxel.  One more exchange adds the partial sums of neighbouring
tiles.  No volume is broadcast and no task holds more than a tile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.scores import sharpen, unit_range
from ridgeline.grid import DEFAULT_TILING, Tiling, key_ddl, shape_of, with_halo, with_totals
from ridgeline.operators import masked, paths
from ridgeline.operators.scan_sweep import block_of
from ridgeline.operators.stencil import smooth
from ridgeline.operators.tiles import with_keys
from ridgeline.session import cut_lineage

_F = np.float32
_BATCH_VALUES = 4_000_000  # cost samples solved together in a task
BOUNDARY_POLICIES = ("reference", "masked_in_bounds")
_SEED_COLUMNS = ("i3", "i2", "i1", "flat", "score")


@dataclass(frozen=True)
class Voter:
    """Search radii and smoothing; defaults are the fixed values of the method."""

    ru: int
    rv: int
    rw: int = 0
    stride1: int = 4
    stride2: int = 4
    attribute_passes: int = 1
    smoothing1: float = 2.0
    smoothing2: float = 2.0
    orientation_sigma: float | None = None  # max(rv, rw) when not set
    min_support: float = 0.0
    support_exponent: float = 0.0
    final_sigma: float = 0.0
    boundary: str = "reference"  # or "masked_in_bounds": seed boxes are cropped to what lies in the volume

    def __post_init__(self) -> None:
        if self.boundary not in BOUNDARY_POLICIES:
            raise ValueError(f"unknown boundary policy: {self.boundary}")

    def with_strain(self, strain1: float, strain2: float | None = None) -> "Voter":
        """Strides from maximum strains: the smallest step count that allows one lag."""
        s2 = strain1 if strain2 is None else strain2
        return replace(self, stride1=math.ceil(1.0 / strain1), stride2=math.ceil(1.0 / s2))

    @property
    def reach(self) -> int:
        return math.ceil(math.sqrt(self.ru**2 + self.rv**2 + self.rw**2)) + 2


def _frame(strike: np.ndarray, dip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """float32 normal, dip and strike vectors (seed, 3) in x1, x2, x3."""
    p, t = np.deg2rad(strike.astype(np.float64)), np.deg2rad(dip.astype(np.float64))
    cp, sp, ct, st = np.cos(p), np.sin(p), np.cos(t), np.sin(t)
    zero = np.zeros_like(cp)
    return (
        np.stack([-ct, st * cp, -st * sp], 1).astype(_F),
        np.stack([st, ct * cp, -ct * sp], 1).astype(_F),
        np.stack([zero, sp, cp], 1).astype(_F),
    )


def _nearest(x: np.ndarray) -> np.ndarray:
    return np.floor(x.astype(np.float64) + 0.5).astype(np.int64)


def _surface_angles(n, d, s, du_dv, du_dw):
    g = (n - du_dv[:, None].astype(_F) * d - du_dw[:, None].astype(_F) * s).astype(_F)
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    g = np.where(g[:, :1] > 0, -g, g)
    dip = np.rad2deg(np.arccos(np.clip(-g[:, 0].astype(np.float64), -1, 1)))
    return np.mod(np.rad2deg(np.arctan2(-g[:, 2], g[:, 1])).astype(np.float64), 360.0), dip


@dataclass
class _Boxes:
    """Search boxes of some seeds: frames, and costs over (seed, w, v, lag) with what may be chosen there."""

    pos: np.ndarray
    n: np.ndarray
    d: np.ndarray
    s: np.ndarray
    w: np.ndarray
    v: np.ndarray
    cost: np.ndarray
    allowed: np.ndarray
    inside: np.ndarray

    def world(self, u: np.ndarray, seeds=slice(None), w: np.ndarray | None = None, v: np.ndarray | None = None) -> list[np.ndarray]:
        """Coordinates x1, x2, x3 of lags u (seed, w, v) or (seed, w, v, lag) of some seeds and columns."""
        w, v = self.w if w is None else w, self.v if v is None else v
        out = []
        for k in range(3):
            n, d, s = (a[seeds, k].astype(np.float64) for a in (self.n, self.d, self.s))
            base = self.pos[seeds, k][:, None, None] + w[None, :, None] * s[:, None, None]
            base = base + v[None, None, :] * d[:, None, None]
            base = base[..., None] if u.ndim == 4 else base
            out.append((base + u * n.reshape((-1,) + (1,) * (u.ndim - 1))).astype(_F))
        return out


def _boxes(seeds: pd.DataFrame, block, a3, a2, shape, v: Voter) -> _Boxes:
    n3, n2, n1 = shape
    pos = seeds[["i1", "i2", "i3"]].to_numpy(np.float64)
    n, d, s = _frame(seeds["pt"].to_numpy(), seeds["tt"].to_numpy())
    lag = np.arange(-v.ru, v.ru + 1)
    allowed = np.abs(lag)[None, None, :] <= paths.lag_bounds_3d(v.ru, v.rv, v.rw)[:, :, None]
    box = _Boxes(pos, n, d, s, np.arange(-v.rw, v.rw + 1), np.arange(-v.rv, v.rv + 1), None, allowed, None)
    j1, j2, j3 = (_nearest(c) for c in box.world(lag.reshape(1, 1, 1, -1).astype(np.float64)))
    box.inside = (j1 >= 0) & (j1 < n1) & (j2 >= 0) & (j2 < n2) & (j3 >= 0) & (j3 < n3)
    c1, c2, c3 = np.clip(j1, 0, n1 - 1), np.clip(j2, 0, n2 - 1), np.clip(j3, 0, n3 - 1)
    box.cost = np.where(allowed[None], _F(1) - block[c3 - a3, c2 - a2, c1], _F(1)).astype(_F)
    return box


def _values(block, a3, a2, y3, y2, y1, ok) -> np.ndarray:
    at = np.clip(y3 - a3, 0, block.shape[0] - 1), np.clip(y2 - a2, 0, block.shape[1] - 1), np.clip(y1, 0, block.shape[2] - 1)
    return np.where(ok, block[at], 0)


def _orientation_sigma(v: Voter) -> float:
    return float(max(v.rv, v.rw)) if v.orientation_sigma is None else v.orientation_sigma


def _thick(b3, b2, b1, seed, n, shape) -> np.ndarray:
    """Votes (i3, i2, i1, seed) at samples and at their two neighbours along i3 or i2, where those exist."""
    n3, n2, _ = shape
    along3 = np.abs(n[:, 2]) > np.abs(n[:, 1])
    parts = []
    for k in (0, -1, 1):
        m3 = b3 + np.where(along3[seed], k, 0)
        m2 = b2 + np.where(along3[seed], 0, k)
        good = (m3 >= 0) & (m3 < n3) & (m2 >= 0) & (m2 < n2)
        parts.append(np.stack([m3[good], m2[good], b1[good], seed[good]], 1))
    return np.concatenate(parts)


def _on_face(y3, y2, y1, shape) -> np.ndarray:
    n3, n2, n1 = shape
    return (y1 == 0) | (y1 == n1 - 1) | (y2 == 0) | (y2 == n2 - 1) | (y3 == 0) | (y3 == n3 - 1)


def _vote_batch_3d(seeds, block, a3, a2, shape, v: Voter):
    """Votes of some seeds: per-seed diagnostics and the emitted (i3, i2, i1, seed) samples."""
    n3, n2, n1 = shape
    box = _boxes(seeds, block, a3, a2, shape, v)
    columns = len(box.w) * len(box.v)
    surface = paths.find_surfaces(box.cost, v.stride1, v.stride2, -v.ru, v.attribute_passes, v.smoothing1, v.smoothing2)
    y1, y2, y3 = (_nearest(c) for c in box.world(surface.astype(np.float64)))
    ok = (y1 >= 0) & (y1 < n1) & (y2 > 0) & (y2 < n2 - 1) & (y3 > 0) & (y3 < n3 - 1)
    value = _values(block, a3, a2, y3, y2, y1, ok)
    count = ok.sum((1, 2))
    fa = np.where(count > 0, value.sum((1, 2), dtype=np.float64) / np.maximum(count, 1), 0).astype(_F)
    support = count / float(columns)
    skip = np.where(count == 0, "no_valid_surface_samples", np.where(support < v.min_support, "support_below_min_fraction", ""))
    if v.support_exponent > 0:
        fa = (fa * (support**v.support_exponent).astype(_F)).astype(_F)
    strike, dip = _surface_angles(box.n, box.d, box.s, *paths.center_slopes(surface, _orientation_sigma(v)))
    vote = ok & (skip == "")[:, None, None]
    report = pd.DataFrame(
        {
            "flat": seeds["flat"].to_numpy(), "admissible": int(box.allowed.sum()),
            "in_bounds": (box.inside & box.allowed[None]).sum((1, 2, 3)), "support": support, "skip_reason": skip,
            "invalid_samples": columns - count, "fa": fa, "vp": strike.astype(_F), "vt": dip.astype(_F),
            "columns": columns, "projected": 0, "center_votes": vote.sum((1, 2)),
            "face_votes": (vote & _on_face(y3, y2, y1, shape)).sum((1, 2)), "orientation": np.where(skip == "", "surface", ""),
        }
    )
    seed, iw, iv = np.nonzero(vote)
    return report, _thick(y3[seed, iw, iv], y2[seed, iw, iv], y1[seed, iw, iv], seed, box.n, shape)


def _vote_batch_masked(seeds, block, a3, a2, shape, v: Voter):
    """As :func:`_vote_batch_3d`, but only lags inside the volume may be chosen.

    A seed's box is cropped to the largest rectangle of columns around the seed that hold such lags;
    votes reach the faces of the volume.  A cropped box says too little about slopes, so its votes keep
    the seed's angles.  Seeds of equal crops are solved together.
    """
    n3, n2, n1 = shape
    box = _boxes(seeds, block, a3, a2, shape, v)
    valid = box.inside & box.allowed[None]
    nw, nv = len(box.w), len(box.v)
    b, columns = len(seeds), nw * nv
    report = pd.DataFrame(
        {
            "flat": seeds["flat"].to_numpy(), "admissible": int(box.allowed.sum()), "in_bounds": valid.sum((1, 2, 3)),
            "support": 0.0, "skip_reason": "no_supported_origin", "invalid_samples": 0, "fa": np.zeros(b, _F),
            "vp": seeds["pt"].to_numpy(_F), "vt": seeds["tt"].to_numpy(_F), "columns": 0, "projected": 0, "center_votes": 0,
            "face_votes": 0, "orientation": "",
        }
    )
    groups: dict[tuple[int, int, int, int], list[int]] = {}
    supported = valid.any(3)
    for k in range(b):
        cut = masked.origin_rectangle(supported[k], v.rw, v.rv)
        if cut is not None:
            groups.setdefault(cut, []).append(k)
    samples = []
    for (w0, v0, w1, v1), members in groups.items():
        at = np.asarray(members)
        cost, mask = box.cost[at, w0:w1, v0:v1], valid[at, w0:w1, v0:v1]
        surface, feasible, moved = masked.find_surfaces(
            cost, mask, v.stride1, v.stride2, -v.ru, v.attribute_passes, v.smoothing1, v.smoothing2
        )
        y1, y2, y3 = (_nearest(c) for c in box.world(surface.astype(np.float64), at, box.w[w0:w1], box.v[v0:v1]))
        cell = masked.cells_of(surface, -v.ru)
        ok = (y1 >= 0) & (y1 < n1) & (y2 >= 0) & (y2 < n2) & (y3 >= 0) & (y3 < n3) & (cell >= 0) & (cell < mask.shape[3])
        ok &= np.take_along_axis(mask, np.clip(cell, 0, mask.shape[3] - 1)[..., None], 3)[..., 0]
        ok &= feasible[:, None, None]
        count, size = ok.sum((1, 2)), (w1 - w0) * (v1 - v0)
        fa = (_values(block, a3, a2, y3, y2, y1, ok).sum((1, 2), dtype=np.float64) / np.maximum(count, 1)).astype(_F)
        support = count / float(columns)
        skip = np.select(
            [~feasible, count < size, support < v.min_support],
            ["no_feasible_surface", "invalid_selected_sample", "support_below_min_fraction"], "",
        )
        if v.support_exponent > 0:
            fa = (fa * (support**v.support_exponent).astype(_F)).astype(_F)
        whole, voted = size == columns, skip == ""
        report.loc[at, "columns"], report.loc[at, "projected"] = size, moved
        report.loc[at, "support"], report.loc[at, "skip_reason"], report.loc[at, "fa"] = support, skip, fa
        report.loc[at, "invalid_samples"] = np.where(feasible, size - count, 0)
        if whole and nw >= 3 and nv >= 3:
            strike, dip = _surface_angles(box.n[at], box.d[at], box.s[at], *paths.center_slopes(surface, _orientation_sigma(v)))
            report.loc[at, "vp"], report.loc[at, "vt"] = strike.astype(_F), dip.astype(_F)
            source = "surface"
        else:
            source = "seed_small_surface_fallback" if whole else "seed_boundary_fallback"
        vote = ok & voted[:, None, None]
        report.loc[at, "orientation"] = np.where(voted, source, "")
        report.loc[at, "center_votes"] = vote.sum((1, 2))
        report.loc[at, "face_votes"] = (vote & _on_face(y3, y2, y1, shape)).sum((1, 2))
        seed, iw, iv = np.nonzero(vote)
        samples.append(_thick(y3[seed, iw, iv], y2[seed, iw, iv], y1[seed, iw, iv], at[seed], box.n, shape))
    return report, np.concatenate(samples) if samples else np.zeros((0, 4), np.int64)


_SOLVERS_3D = {"reference": _vote_batch_3d, "masked_in_bounds": _vote_batch_masked}


def _sum_votes(samples: np.ndarray, report: pd.DataFrame, rank: np.ndarray, extra: list[str]) -> pd.DataFrame:
    """Per voxel: summed score and the attributes of its strongest (then earliest) seed."""
    v = pd.DataFrame(samples, columns=["i3", "i2", "i1", "seed"])
    v["fa"] = report["fa"].to_numpy()[samples[:, 3]].astype(np.float64)
    v["rank"] = rank[samples[:, 3]]
    v = v.sort_values(["i3", "i2", "i1", "fa", "rank"], ascending=[True, True, True, False, True], kind="stable")
    g = v.groupby(["i3", "i2", "i1"], sort=False)
    top = v.drop_duplicates(["i3", "i2", "i1"]).reset_index(drop=True)
    top["fe"] = g["fa"].sum().to_numpy()
    for c in extra:
        top[c] = report[c].to_numpy()[top["seed"]]
    return top


def _with_seeds(volume: DataFrame, seeds: DataFrame, reach: tuple[int, int], tiling: Tiling):
    """Traces with halo, and each seed in its own tile."""
    tiles = with_halo(volume, *reach, tiling)
    # fresh column ids: seeds usually descend from the same volume
    at = seeds.select(*[F.col(c).alias(c) for c in seeds.columns]).withColumns(
        {"_tile3": F.floor(F.col("i3") / tiling.block3).cast("int"), "_tile2": F.floor(F.col("i2") / tiling.block2).cast("int")}
    )
    return tiles.groupBy(*tiling.tile_cols), at.groupBy(*tiling.tile_cols)


def _batches(n: int, size: int):
    step = max(1, _BATCH_VALUES // size)
    return [slice(i, i + step) for i in range(0, n, step)]


_VOTES_3D = "i3 int, i2 int, i1 int, fe double, fa double, rank_score double, rank_flat bigint, vp float, vt float"
_SEED_3D = (
    "flat bigint, admissible int, in_bounds int, support double, skip_reason string, invalid_samples int, fa float, vp float, vt float, "
    "columns int, projected int, center_votes int, face_votes int, orientation string"
)


def seed_surfaces(volume: DataFrame, col: str, seeds: DataFrame, voter: Voter, tiling: Tiling = DEFAULT_TILING,
                  shape: tuple[int, int, int] | None = None, votes: bool = True) -> DataFrame:
    """Solve all seeds.  ``votes``: per-tile vote sums; otherwise one diagnostic row per seed.

    ``seeds``: i3, i2, i1, flat, score, pt, tt.  Seeds meet the volume of their own keys (``tiling.keys``);
    all volumes share one shape.
    """
    keys = list(tiling.keys)
    if missing := [c for c in (*_SEED_COLUMNS, "pt", "tt") if c not in seeds.columns]:
        raise ValueError(f"seeds lack columns: {', '.join(missing)}")
    solver = _SOLVERS_3D[voter.boundary]
    row = None if shape else shape_of(volume).first()
    dims = shape or (int(row["n3"]), int(row["n2"]), int(row["n1"]))
    size = (2 * voter.rw + 1) * (2 * voter.rv + 1) * (2 * voter.ru + 1)
    field = volume.select(*keys, "i3", "i2", F.col(col).alias("f"))
    left, right = _with_seeds(field, seeds, (voter.reach,) * 2, tiling)
    head = key_ddl(field, tiling.keys)

    def solve(traces: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in (_VOTES_3D if votes else _SEED_3D).split(", ")]
        none = pd.DataFrame({c: pd.Series([], dtype=object) for c in [*keys, *names]})
        if traces.empty or mine.empty:
            return none
        block, a3, a2 = block_of(traces, "f")
        out = []
        for cut in _batches(len(mine), size):
            part = mine.iloc[cut]
            report, samples = solver(part, block, a3, a2, dims, voter)
            if not votes:
                out.append(report[names])
                continue
            if not len(samples):
                continue
            order = np.lexsort((-part["flat"].to_numpy(np.int64), -part["score"].to_numpy()))
            rank = np.empty(len(part), np.int64)
            rank[order] = np.arange(len(part))
            top = _sum_votes(samples, report, rank, ["vp", "vt"])
            top["rank_score"] = part["score"].to_numpy()[top["seed"]]
            top["rank_flat"] = part["flat"].to_numpy()[top["seed"]]
            out.append(top[names])
        if not out:
            return none
        return with_keys(pd.concat(out), mine, keys)[[*keys, *names]]

    return left.cogroup(right).applyInPandas(solve, head + (_VOTES_3D if votes else _SEED_3D))


def accumulate_votes(votes: DataFrame, attributes: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Add partial sums; attributes come from the strongest vote, then the earliest seed.

    Seeds are ordered by (score, flat index) descending.  ``votes``: i3, i2, i1, fe, fa,
    rank_score, rank_flat and the attributes.
    """
    best = F.max(F.struct("fa", "rank_score", "rank_flat", *attributes))
    g = votes.groupBy(*keys, "i3", "i2", "i1").agg(F.sum("fe").cast("float").alias("fe"), best.alias("b"))
    return g.select(*keys, "i3", "i2", "i1", "fe", *[F.col(f"b.{a}").alias(a) for a in attributes])


def surface_voting(
    volume: DataFrame, seeds: DataFrame, voter: Voter, tiling: Tiling = DEFAULT_TILING,
    shape: tuple[int, int, int] | None = None, col: str = "ft",
) -> DataFrame:
    """3-D voting: dense traces with fv, vp, vt.

    Votes are scored on the smoothed (sigma 1), unit-range likelihood.  Volumes of several keys
    (``tiling.keys``) vote side by side; every range is taken within a key.
    """
    keys = tiling.keys
    sm = cut_lineage(smooth(volume.select(*keys, "i3", "i2", col), col, "_fs", 1.0, tiling))
    unit = with_totals(sm, sm, keys, _lo=F.min(F.array_min("_fs")), _hi=F.max(F.array_max("_fs")))
    unit = unit.withColumn("f", F.transform("_fs", lambda x: unit_range(x, F.col("_lo"), F.col("_hi"))))
    votes = seed_surfaces(unit.select(*keys, "i3", "i2", "f"), "f", seeds, voter, tiling, shape)
    sums = accumulate_votes(votes, ["vp", "vt"], keys)
    return finish_votes(volume.select(*keys, "i3", "i2", F.size(col).alias("n1")), sums, ["vp", "vt"], 8, voter.final_sigma, tiling)


def finish_votes(
    frame: DataFrame, sums: DataFrame, attributes: list[str], power: int, sigma: float, tiling: Tiling
) -> DataFrame:
    """Sparse vote sums -> dense traces with the sharpened score ``fv`` and the attributes."""
    names = ["fe", *attributes]
    spread = F.pandas_udf(_spread_rows, "array<float>")
    at = [*tiling.keys, "i3", "i2"]
    packed = sums.groupBy(*at).agg(F.collect_list(F.struct("i1", *names)).alias("p"))  # at most one trace
    dense = frame.join(packed.hint("merge"), at, "left").select(
        *at, *[spread(F.col("n1"), F.col("p.i1"), F.col(f"p.{a}")).alias(a) for a in names]
    )
    if sigma > 0:
        s3 = sigma if dims_of(frame) == 3 else 0.0
        dense = smooth(dense, "fe", "fe", (s3, sigma, sigma), tiling)
    dense = cut_lineage(dense)  # votes are stored once: the normalisation reads them again
    dense = with_totals(dense, dense, tiling.keys, _lo=F.min(F.array_min("fe")), _hi=F.max(F.array_max("fe")))
    return dense.select(
        *at, F.transform("fe", lambda x: sharpen(unit_range(x, F.col("_lo"), F.col("_hi")).cast("double"), power)).alias("fv"),
        *attributes,
    )


def _spread_rows(n1: pd.Series, at: pd.Series, values: pd.Series) -> pd.Series:
    """Sparse samples of a trace -> the dense trace, zeros elsewhere."""
    out = []
    for n, i, v in zip(n1, at, values):
        dense = np.zeros(n, _F)
        if i is not None:
            dense[i] = v
        out.append(dense)
    return pd.Series(out)


def dims_of(frame: DataFrame) -> int:
    """2 for an image (the i3 column is the literal 0 of an image source), else 3."""
    return 2 if frame.schema["i3"].metadata.get("image") else 3


def voting_summary(report: DataFrame) -> DataFrame:
    """Counts and support over the seeds of a run (1.0 when there are none)."""
    return report.agg(
        F.count(F.lit(1)).alias("seed_count"),
        F.count_if(F.col("in_bounds") < F.col("admissible")).alias("boundary_affected_seed_count"),
        F.count_if(F.col("skip_reason") == "").alias("voted_seed_count"),
        F.count_if(F.col("skip_reason") != "").alias("skipped_seed_count"),
        F.coalesce(F.min("support"), F.lit(1.0)).alias("support_fraction_min"),
        F.coalesce(F.avg("support"), F.lit(1.0)).alias("support_fraction_mean"),
        F.coalesce(F.sum("invalid_samples"), F.lit(0)).alias("selected_invalid_sample_count"),
        F.coalesce(F.sum("projected"), F.lit(0)).alias("surface_projection_count"),
        F.coalesce(F.sum("center_votes"), F.lit(0)).alias("center_vote_write_count"),
        F.coalesce(F.sum("face_votes"), F.lit(0)).alias("face_center_vote_count"),
    )


# ---------------------------------------------------------------- 2-D

_VOTES_2D = "i3 int, i2 int, i1 int, fe double, fa double, rank_score double, rank_flat bigint, w1 float, w2 float"


def _vote_batch_2d(seeds, block, a2, shape, v: Voter):
    n2, n1 = shape
    p = np.deg2rad(seeds["pt"].to_numpy(np.float64))
    nrm = np.stack([np.sin(p), np.cos(p)], 1).astype(_F)
    tan = np.stack([-np.cos(p), np.sin(p)], 1).astype(_F)
    pos = seeds[["i1", "i2"]].to_numpy(np.float64)
    step, lag = np.arange(-v.rv, v.rv + 1), np.arange(-v.ru, v.ru + 1)
    allowed = np.abs(lag)[None, :] <= paths.lag_bounds_2d(v.ru, v.rv)[:, None]

    def world(u):
        out = []
        for k in range(2):
            base = pos[:, k][:, None] + step[None, :] * tan[:, k].astype(np.float64)[:, None]
            base = base[..., None] if u.ndim == 3 else base
            out.append(base + u * nrm[:, k].astype(np.float64).reshape((-1,) + (1,) * (u.ndim - 1)))
        return out

    j1, j2 = (_nearest(c) for c in world(lag.reshape(1, 1, -1).astype(np.float64)))
    cost = np.where(allowed[None], _F(1) - block[np.clip(j2, 0, n2 - 1) - a2, np.clip(j1, 0, n1 - 1)], _F(1)).astype(_F)
    path = paths.find_paths(cost, v.stride1, -v.ru, v.attribute_passes, v.smoothing1)
    y1, y2 = (_nearest(c) for c in world(path.astype(np.float64)))
    ok = (y1 > 0) & (y1 < n1 - 1) & (y2 > 0) & (y2 < n2 - 1)
    value = np.where(ok, block[np.clip(y2 - a2, 0, block.shape[0] - 1), np.clip(y1, 0, n1 - 1)], 0)
    count = ok.sum(1)
    fa = np.where(count > 0, value.sum(1, dtype=np.float64) / np.maximum(count, 1), 0).astype(_F)
    slope = np.diff(path, axis=1, prepend=path[:, :1])
    slope[:, 0] = path[:, 1] - path[:, 0] if path.shape[1] > 1 else 0
    inv = (1.0 / np.sqrt(slope.astype(np.float64) ** 2 + 1)).astype(_F)
    w = [nrm[:, k][:, None] * -inv + tan[:, k][:, None] * (slope * inv) for k in range(2)]
    seed, iv = np.nonzero(ok)
    return fa, np.stack([np.zeros_like(seed), y2[seed, iv], y1[seed, iv], seed], 1), w[0][seed, iv], w[1][seed, iv]


def path_voting(
    image: DataFrame, seeds: DataFrame, voter: Voter, tiling: Tiling = DEFAULT_TILING,
    shape: tuple[int, int] | None = None, col: str = "ft",
) -> DataFrame:
    """2-D voting: dense traces with fv and the unit vectors w1, w2.  Seeds: i3, i2, i1, flat, score, pt."""
    row = None if shape else shape_of(image.select("i3", "i2", col)).first()
    dims = shape or (int(row["n2"]), int(row["n1"]))
    size = (2 * voter.rv + 1) * (2 * voter.ru + 1)
    left, right = _with_seeds(image.select("i3", "i2", F.col(col).alias("f")), seeds, (0, voter.reach), tiling)
    names = [c.split()[0] for c in _VOTES_2D.split(", ")]

    def solve(traces: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        if traces.empty or mine.empty:
            return none
        block, _, a2 = block_of(traces, "f")
        out = []
        for cut in _batches(len(mine), size):
            part = mine.iloc[cut]
            fa, samples, w1, w2 = _vote_batch_2d(part, block[0], a2, dims, voter)
            if not len(samples):
                continue
            v = pd.DataFrame(samples, columns=["i3", "i2", "i1", "seed"])
            v = v.assign(
                fa=fa[samples[:, 3]].astype(np.float64), rank_score=part["score"].to_numpy()[samples[:, 3]],
                rank_flat=part["flat"].to_numpy()[samples[:, 3]], w1=w1, w2=w2,
            )
            # a path may cross a voxel twice: its first sample there gives the direction
            v = v.sort_values(["i2", "i1", "fa", "rank_score", "rank_flat"], ascending=[True, True, False, False, False], kind="stable")
            top = v.drop_duplicates(["i2", "i1"]).reset_index(drop=True)
            top["fe"] = v.groupby(["i2", "i1"], sort=False)["fa"].sum().to_numpy()
            out.append(top[names])
        return pd.concat(out) if out else none

    votes = left.cogroup(right).applyInPandas(solve, _VOTES_2D)
    sums = accumulate_votes(votes, ["w1", "w2"])
    frame = image.select("i3", "i2", F.size(col).alias("n1"))
    return _finish_2d(frame, sums, tiling)


def _finish_2d(frame: DataFrame, sums: DataFrame, tiling: Tiling) -> DataFrame:
    """2-D votes are smoothed (sigma 1) before they are scaled and sharpened (power 4)."""
    meta = frame.withColumn("i3", F.col("i3").alias("i3", metadata={"image": True}))
    return finish_votes(meta, sums, ["w1", "w2"], 4, 1.0, tiling)
