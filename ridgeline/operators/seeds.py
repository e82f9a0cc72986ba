"""Seed selection: exact greedy suppression on halo tiles.

Taking candidates best-first and dropping all within a Chebyshev box gives the
lexicographically first maximal independent set.  A tile accepts what is best in a box it
sees whole and drops what that covers, as far as its rows tell; only what hangs on rows outside
its halo waits for the next exchange, which deals wider tiles.  No task sees more than a
tile, and the result is the sequential one.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.grid import DEFAULT_TILING, TILE2, TILE3, Tiling, key_ddl, with_halo
from ridgeline.operators.quantiles import quantile
from ridgeline.operators.tiles import with_keys
from ridgeline.session import cut_lineage

_TILE_VOXELS = 4_000_000  # a tile of a later round spans no more (two flags each)
_HALO = 4  # in distances; one is needed, more lets a tile settle more by itself
XYZ = ["i3", "i2", "i1"]


def settle(pdf: pd.DataFrame, d: int, late_first: bool, seen: tuple[tuple[float, float], tuple[float, float]]) -> np.ndarray:
    """Per row: 1 accepted, 0 still open, -1 dropped; rows ``fixed`` were accepted before and only cover others.

    ``seen`` holds, for i3 and i2, the index range whose candidates are all in ``pdf``.  A row is
    accepted when it is the best open one of its box and its box is seen whole; that is final.  What may
    depend on unseen rows stays open and blocks others.
    """
    pos = pdf[XYZ].to_numpy(np.int64)
    whole = np.ones(len(pdf), bool)
    for axis, (lo, hi) in enumerate(seen):
        whole &= (pos[:, axis] - d >= lo) & (pos[:, axis] + d < hi)
    last = (pdf["flat"] if late_first else -pdf["flat"]).to_numpy(np.int64)
    order = np.lexsort((last, pdf["score2"].to_numpy(), pdf["score"].to_numpy()))[::-1]
    low = pos - pos.min(axis=0)  # corner of a row's box in grids that are d wider on each side
    shape = low.max(axis=0) + 2 * d + 1
    covered, blocked = np.zeros(shape, bool), np.zeros(shape, bool)
    wide = 2 * d + 1
    fixed = pdf["fixed"].to_numpy() == 1
    for x, y, z in low[fixed].tolist():
        covered[x : x + wide, y : y + wide, z : z + wide] = True
    state = np.full(len(pdf), -1)
    order = order[~fixed[order]]
    order = order[~covered[tuple((low[order] + d).T)]]
    # best first, so every row finds what its betters have marked: one pass, however long the chain of rows is
    for k, free, (x, y, z) in zip(order.tolist(), whole[order].tolist(), low[order].tolist()):
        at = (x + d, y + d, z + d)
        if covered[at]:
            continue
        taken = free and not blocked[at]
        state[k] = 1 if taken else 0
        (covered if taken else blocked)[x : x + wide, y : y + wide, z : z + wide] = True
    return state


def _wider(tiling: Tiling, halo: int, ends) -> Tiling:
    """Tiles of twice the size along the axis they cover least of, up to a bounded number of voxels.

    Equal scores make chains of rows that reach through the whole volume, of which a tile settles its own
    part in each round; wider tiles keep the number of rounds from growing with the volume.
    """
    left = {"block3": (ends["i3"] + 1) / tiling.block3, "block2": (ends["i2"] + 1) / tiling.block2}
    name = max(left, key=left.get)
    wide = replace(tiling, **{name: 2 * getattr(tiling, name)})
    spans = [min(ends[c] + 1, b + 2 * halo) for c, b in (("i3", wide.block3), ("i2", wide.block2))]
    return wide if left[name] > 1 and spans[0] * spans[1] * (ends["i1"] + 1) <= _TILE_VOXELS else tiling


def pick_seeds(
    candidates: DataFrame, distance: int, late_first: bool = True, tiling: Tiling = DEFAULT_TILING,
    second: str | None = None,
) -> DataFrame:
    """Greedy suppression of (i3, i2, i1, flat, score) rows; other columns are kept.

    ``second`` names a column that ranks equal scores (descending).

    Ties in score go to the larger flat index with ``late_first`` (voting seeds),
    to the smaller one without it (skin seeds).  Volumes of several keys (``tiling.keys``) are
    settled side by side, in as many rounds as the slowest of them needs.
    """
    keys = list(tiling.keys)
    if distance == 0:
        return candidates
    alive = cut_lineage(candidates.select(
        *keys, *XYZ, "flat", F.col("score").cast("double").alias("score"),
        (F.col(second) if second else F.lit(0.0)).cast("double").alias("score2"), F.lit(0).alias("fixed"),
    ))
    accepted = []
    halo, head = _HALO * distance, key_ddl(alive, tiling.keys)
    ends = alive.agg(*[F.max(c).alias(c) for c in XYZ]).first()  # three numbers
    if ends["i3"] is None:
        return candidates

    def decider(tiling: Tiling):
        def decide(pdf: pd.DataFrame) -> pd.DataFrame:
            seen = []
            for axis, block, tile in (("i3", tiling.block3, TILE3), ("i2", tiling.block2, TILE2)):
                low, high = int(pdf[tile].iloc[0]) * block - halo, (int(pdf[tile].iloc[0]) + 1) * block + halo
                seen.append((-np.inf if low <= 0 else low, np.inf if high > ends[axis] else high))
            state = settle(pdf, distance, late_first, tuple(seen))
            keep = pdf["_core"].to_numpy() & (state >= 0)
            out = with_keys(pdf.loc[keep, [*XYZ, "flat", "score", "score2"]], pdf, keys)[[*keys, *XYZ, "flat", "score", "score2"]]
            return out.assign(fixed=state[keep].astype(np.int32))

        return decide

    while True:
        tiles = with_halo(alive, halo, halo, tiling)
        done = cut_lineage(
            tiles.groupBy(*tiling.tile_cols).applyInPandas(
                decider(tiling), f"{head}i3 int, i2 int, i1 int, flat bigint, score double, score2 double, fixed int"
            )
        )
        accepted.append(done.where("fixed = 1").select(*keys, "flat"))
        alive = done  # the new picks go along once more: they cover rows that other tiles still hold open
        if done.where("fixed = 0").isEmpty():
            break
        tiling = _wider(tiling, halo, ends)
    chosen = reduce(lambda a, b: a.unionByName(b), accepted)
    return candidates.join(chosen.hint("merge"), [*keys, "flat"], "left_semi")  # as long as the volume


def center_margins(shape: tuple[int, int, int], crop: tuple[int, int, int]) -> tuple[int, int, int]:
    """Margins that keep a crop of this shape around a centre inside the volume."""
    if any(c > n for c, n in zip(crop, shape)):
        raise ValueError("the crop is larger than the volume")
    return tuple(c // 2 if c < n else 0 for c, n in zip(crop, shape))


def pick_centers(
    df: DataFrame, value: str, count: int = 3, separation: float = 48.0, percentile: float = 99.9,
    margins: tuple[int, int, int] | None = None,
) -> list[tuple[int, int, int]]:
    """At most ``count`` strong voxels at least ``separation`` apart (a short report).

    Only voxels at or above the percentile of the eligible ones are picked; with ``margins``
    (i3, i2, i1) a voxel is eligible when it lies that far inside (needs n3, n2, n1).  The pool is
    stored once, each pick is one distributed top-1 of it; ties go to the smallest (i3, i2, i1).
    """
    if count == 0:
        return []
    pool = df
    if margins is not None:
        for c, n, m in zip(XYZ, ("n3", "n2", "n1"), margins):
            pool = pool.where((F.col(c) >= m) & (F.col(c) < F.col(n) - m))
        if pool.isEmpty():
            raise ValueError("no eligible centers remain inside the margins")
    pool = cut_lineage(pool.select(*XYZ, value).where(F.col(value) >= quantile(pool, value, percentile / 100.0)))
    picks: list[tuple[int, int, int]] = []
    while len(picks) < count:
        top = pool.orderBy(F.desc(value), *XYZ).select(*XYZ).head(1)
        if not top:
            break
        p = tuple(int(x) for x in top[0])
        picks.append(p)
        d2 = sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(XYZ, p)), F.lit(0))
        pool = pool.where(d2 >= separation * separation)
    return picks


def retain_boundary_seeds(
    volume: DataFrame, distance: int, threshold: float, margin: int, tiling: Tiling = DEFAULT_TILING
) -> DataFrame:
    """Default seeds plus edge-shell seeds on a positive target (column ``added``); ``score`` is ft for both, as voters need it.

    ``volume``: i3, i2, i1, n3, n2, n1, flat, ft, pt, tt, target.  Edge candidates need
    ft above min(threshold, half the largest ft of the shell); they are spaced among
    themselves by (target, ft, earlier index), default seeds are never repeated.
    """
    from ridgeline.functions.scores import near_edge, positive

    base = pick_seeds(
        volume.where(F.col("ft") > F.lit(threshold).cast("float")).withColumn("score", F.col("ft")), distance, True, tiling
    )
    base = base.withColumn("added", F.lit(False))
    shell = volume.where(near_edge(margin))
    limit = F.least(F.lit(float(threshold)), 0.5 * shell.agg(F.max("ft").alias("m")).select("m").scalar().cast("double"))
    pool = shell.where(positive("target") & (F.col("ft") > F.coalesce(limit, F.lit(0.0)).cast("float")))
    pool = pool.join(base.select("flat"), "flat", "left_anti")
    if distance > 0:
        pool = pick_seeds(pool.withColumn("score", F.col("target")), distance, False, tiling, "ft").drop("score")
    return base.unionByName(pool.withColumn("score", F.col("ft")).withColumn("added", F.lit(True)))
