"""Analytic fault cases on any voxel grid.

The grid itself is a DataFrame (``i3, i2, i1, n3, n2, n1``): it may come from
``spark.range`` (:func:`range_grid`) or from the index columns of a stored volume.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.angles import strike_dip_of_normal
from ridgeline.grid import once

# Fixed values of the standard cases.
SIGMA = 1.25
HALF_WIDTH = 1.0
CASES = (
    "single_vertical_plane",
    "single_dipping_plane",
    "curved_surface",
    "parallel_planes",
    "crossing_planes",
    "boundary_plane",
    "weak_noisy_plane",
)
CASE_SETS = {
    "minimal": ("single_vertical_plane",),
    "geometry": ("single_vertical_plane", "single_dipping_plane", "curved_surface"),
    "extended": CASES,
}
STOCHASTIC_CASES = ("weak_noisy_plane",)


@dataclass(frozen=True)
class Plane:
    strike: float
    dip: float
    center: tuple[Column, Column, Column]  # x1, x2, x3


def range_grid(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    n3, n2, n1 = shape
    ids = spark.range(n3 * n2 * n1)
    i = F.col("id")
    return ids.select(
        F.floor(i / (n2 * n1)).cast("int").alias("i3"),
        F.pmod(F.floor(i / n1), F.lit(n2)).cast("int").alias("i2"),
        F.pmod(i, F.lit(n1)).cast("int").alias("i1"),
        F.lit(n3).alias("n3"), F.lit(n2).alias("n2"), F.lit(n1).alias("n1"),
    )


def _middle() -> tuple[Column, Column, Column]:
    return tuple((F.col(n) - 1) / 2.0 for n in ("n1", "n2", "n3"))


def planes_of(case: str) -> list[Plane]:
    """The planes of a standard case, placed relative to the grid's shape."""
    c1, c2, c3 = _middle()
    if case == "single_vertical_plane":
        return [Plane(0.0, 90.0, (c1, c2, c3))]
    if case == "single_dipping_plane":
        return [Plane(45.0, 65.0, (c1, c2, c3))]
    if case == "boundary_plane":
        return [Plane(0.0, 90.0, (c1, F.lit(1.0), c3))]
    if case == "parallel_planes":
        gap = F.least(F.greatest(F.lit(6.0), 0.18 * F.col("n2")), F.col("n2") - 1.0)
        return [Plane(0.0, 90.0, (c1, c2 - gap / 2.0, c3)), Plane(0.0, 90.0, (c1, c2 + gap / 2.0, c3))]
    if case == "crossing_planes":
        return [Plane(0.0, 90.0, (c1, c2, c3)), Plane(60.0, 70.0, (c1, c2, c3))]
    if case == "weak_noisy_plane":
        return [Plane(35.0, 70.0, (c1, c2, c3))]
    raise ValueError(f"not a plane case: {case}")


def _normal(strike: float, dip: float) -> tuple[float, float, float]:
    p, t = math.radians(strike), math.radians(dip)
    n = (-math.cos(t), math.sin(t) * math.cos(p), -math.sin(t) * math.sin(p))
    return tuple(float(np.float32(x)) for x in n)


def plane_columns(grid: DataFrame, planes: list[Plane], noise: Column | None = None) -> DataFrame:
    """Truth and oracle columns of one or more planes.

    The nearest plane gives id, distance and angles (the first on ties); the
    likelihood is the largest over the planes.  ``noise`` turns the likelihood
    into the weak, noisy variant 0.03 + 0.65*base + noise.
    """
    structs, likelihoods, masks, distances = [], [], [], {}
    for number, pl in enumerate(planes, start=1):
        w = _normal(pl.strike, pl.dip)
        distances[f"_d{number}"] = reduce(
            lambda a, b: a + b,
            [(F.col(ix) - c) * F.lit(n) for ix, c, n in zip(("i1", "i2", "i3"), pl.center, w)],
        )
        d = F.col(f"_d{number}")
        d32 = d.cast("float")
        if noise is None:
            like = F.exp(-0.5 * (d / SIGMA) * (d / SIGMA))
        else:
            z = d32.cast("double") / SIGMA
            like = 0.03 + 0.65 * F.exp(-0.5 * z * z) + noise
        likelihoods.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), like)).cast("float"))
        masks.append(F.abs(d32) <= HALF_WIDTH)
        structs.append(
            F.struct(
                F.abs(d32).alias("a"), F.lit(number).alias("id"), d32.alias("d"),
                F.lit(pl.strike).cast("float").alias("strike"), F.lit(pl.dip).cast("float").alias("dip"),
            )
        )
    nearest = F.least(*structs) if len(structs) > 1 else structs[0]
    like = F.greatest(*likelihoods) if len(likelihoods) > 1 else likelihoods[0]
    mask = reduce(lambda a, b: a | b, masks)
    out = once(once(grid, **distances), _near=nearest, truth_mask=mask, ft=like)
    return out.select(
        *grid.columns, "truth_mask",
        F.when(F.col("truth_mask"), F.col("_near.id")).otherwise(0).alias("truth_id"),
        F.col("_near.d").alias("truth_distance"),
        F.col("_near.strike").alias("truth_strike"), F.col("_near.dip").alias("truth_dip"),
        "ft", F.col("_near.strike").alias("pt"), F.col("_near.dip").alias("tt"),
    )


def curved_columns(
    grid: DataFrame,
    slope2: float = 0.18,
    slope3: float = -0.12,
    curvature2: float = 0.35,
    curvature3: float = -0.25,
) -> DataFrame:
    """A quadratic surface x1(x2, x3) through the middle of the grid."""
    c1, c2, c3 = _middle()
    dx2, dx3 = F.col("i2") - c2, F.col("i3") - c3
    s2 = F.greatest(F.col("n2") - 1.0, F.lit(1.0))
    s3 = F.greatest(F.col("n3") - 1.0, F.lit(1.0))
    surface = c1 + slope2 * dx2 + slope3 * dx3 + curvature2 * (dx2 * dx2 / s2) + curvature3 * (dx3 * dx3 / s3)
    g2 = slope2 + 2.0 * curvature2 * dx2 / s2
    g3 = slope3 + 2.0 * curvature3 * dx3 / s3
    out = once(grid, _d=F.col("i1") - surface, _g2=g2, _g3=g3)
    norm = F.sqrt(1.0 + F.col("_g2") * F.col("_g2") + F.col("_g3") * F.col("_g3"))
    u = [(x / norm).cast("float") for x in (F.lit(1.0), -F.col("_g2"), -F.col("_g3"))]
    strike, dip = strike_dip_of_normal(*u)
    out = once(out, _strike=strike, _dip=dip)
    strike, dip = F.col("_strike"), F.col("_dip")
    z = F.col("_d") / SIGMA
    mask = F.abs(F.col("_d")) <= HALF_WIDTH
    return out.select(
        *grid.columns, mask.alias("truth_mask"), F.when(mask, 1).otherwise(0).alias("truth_id"),
        F.col("_d").cast("float").alias("truth_distance"),
        strike.alias("truth_strike"), dip.alias("truth_dip"),
        F.exp(-0.5 * z * z).cast("float").alias("ft"), strike.alias("pt"), dip.alias("tt"),
    )


def case_columns(grid: DataFrame, case: str, noise: Column | None = None) -> DataFrame:
    """A standard case on the grid; ``noise`` is needed by the stochastic one."""
    if case == "curved_surface":
        return curved_columns(grid)
    if case in STOCHASTIC_CASES:
        if noise is None:
            raise ValueError(f"{case} needs a noise column")
        return plane_columns(grid, planes_of(case), noise)
    return plane_columns(grid, planes_of(case))


def scanner_input(
    ft: Column, noise: Column | None = None, background: float = 1.0, contrast: float = 0.85
) -> Column:
    """Low-on-fault input image: background - contrast*ft (+ noise), clipped to [0, 1]."""
    x = background - contrast * ft.cast("double")
    if noise is not None:
        x = x + noise
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)).cast("float")


_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


def draw_bits(seed: Column | str, index: Column | str, lane: int) -> Column:
    """52 random bits that depend on (seed, index, lane) alone, never on partitions or row order."""
    text = F.concat_ws(":", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in (seed, index)], F.lit(str(lane)))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("bigint")


def seeded_normal(seed: Column | str, index: Column | str) -> Column:
    """Standard normal draw of a voxel from counter bits (Box-Muller); NULL seeds or indices count as empty text."""
    u, w = [(draw_bits(seed, index, lane).cast("double") + 0.5) / 2.0 ** (4 * _DIGITS) for lane in (0, 1)]
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * w)


def expand_trials(cases: DataFrame, seeds: DataFrame) -> DataFrame:
    """One trial per deterministic case, one per seed for stochastic cases.

    ``cases`` (case_id, is_stochastic) is the short registry; ``seeds`` may be long.
    """
    fixed = cases.where("not is_stochastic").select("case_id", F.col("case_id").alias("trial_id"), F.lit(None).cast("bigint").alias("seed"))
    names = cases.where("is_stochastic").agg(F.collect_list("case_id").alias("c")).select("c").scalar()
    drawn = seeds.select("seed", F.explode(names).alias("case_id")).select(
        "case_id", F.concat("case_id", F.lit("__seed_"), F.col("seed").cast("string")).alias("trial_id"),
        F.col("seed").cast("bigint").alias("seed"),
    )
    return fixed.unionByName(drawn)
