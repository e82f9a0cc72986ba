"""Sub-voxel sampling, image warps, point and section look-ups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XYZ = ["i3", "i2", "i1"]


def sample(volume: DataFrame, points: DataFrame, value: str, shape: tuple[str, str, str] = ("n3", "n2", "n1"),
           nearest: bool = False) -> DataFrame:
    """Linear (or nearest) samples at fractional positions, coordinates clamped to the grid.

    ``points``: point_id, x3, x2, x1, n3, n2, n1.  Each point asks its corner voxels by
    an equi-join on the grid index; weights are added up per point.
    """
    p = points
    for x, n in zip(("x3", "x2", "x1"), shape):
        p = p.withColumn(x, F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, F.col(x).cast("float").cast("double"))))
    if nearest:
        at = p.select("point_id", *[F.floor(F.col(f"x{k}") + 0.5).cast("int").alias(f"i{k}") for k in (3, 2, 1)])
        return at.join(volume.select(*XYZ, value), XYZ).select("point_id", value)
    corners = F.array(
        *[
            F.struct(*[F.lit(b).alias(f"b{k}") for k, b in zip((3, 2, 1), bits)])
            for bits in [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
        ]
    )
    c = p.select("point_id", "x3", "x2", "x1", F.explode(corners).alias("c"))
    w = F.lit(1.0)
    index = []
    for k in (3, 2, 1):
        x, b = F.col(f"x{k}"), F.col(f"c.b{k}")
        frac = x - F.floor(x)
        w = w * F.when(b == 1, frac).otherwise(1.0 - frac)
        index.append((F.floor(x) + b).cast("int").alias(f"i{k}"))
    ask = c.select("point_id", *index, w.alias("w")).where("w > 0")
    hit = ask.join(volume.select(*XYZ, value), XYZ)
    return hit.groupBy("point_id").agg(F.sum(F.col("w") * F.col(value).cast("double")).cast("float").alias(value))


def rotation_points(image: DataFrame, degrees: float) -> DataFrame:
    """Where each pixel of an image rotated about its middle comes from (same shape)."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    m2, m1 = (F.col("n2") - 1) / 2.0, (F.col("n1") - 1) / 2.0
    d2, d1 = F.col("i2") - m2, F.col("i1") - m1
    return image.select(
        F.struct("i2", "i1").alias("point_id"), F.lit(0.0).alias("x3"), (c * d2 + s * d1 + m2).alias("x2"),
        (-s * d2 + c * d1 + m1).alias("x1"), F.lit(1).alias("n3"), "n2", "n1",
    )


def rotate_image(image: DataFrame, value: str, degrees: float) -> DataFrame:
    """Rotate a 2-D image (voxels with i3 = 0, n2, n1) by linear interpolation, nearest edges."""
    out = sample(image, rotation_points(image, degrees), value)
    return out.select(F.col("point_id.i2").alias("i2"), F.col("point_id.i1").alias("i1"), value)


def warp_image(image: DataFrame, value: str, x2: str, x1: str) -> DataFrame:
    """Sample a 2-D image at per-pixel coordinates held in two columns."""
    pts = image.select(
        F.struct("i2", "i1").alias("point_id"), F.lit(0.0).alias("x3"), F.col(x2).cast("double").alias("x2"),
        F.col(x1).cast("double").alias("x1"), F.lit(1).alias("n3"), "n2", "n1",
    )
    out = sample(image, pts, value)
    return out.select(F.col("point_id.i2").alias("i2"), F.col("point_id.i1").alias("i1"), value)


def seeds_to_image(grid: DataFrame, seeds: DataFrame, value: str, minimum: float) -> DataFrame:
    """Dense image that holds the value at seed voxels above ``minimum``, 0 elsewhere."""
    hit = seeds.select(*XYZ).distinct().withColumn("_seed", F.lit(True))
    on = F.col("_seed") & (F.col(value) > F.lit(minimum).cast("float"))
    zero = F.lit(0.0).cast("float")
    return grid.join(hit, XYZ, "left").select(*XYZ, F.when(on, F.col(value)).otherwise(zero).alias("seed_value"))


def richest_sections(ridge: DataFrame, bins: int = 4) -> DataFrame:
    """Per axis, the index with most ridge samples in each of ``bins`` equal bins.

    ``ridge``: i3, i2, i1 with n3, n2, n1.  Ties go to the smallest index.
    """
    axes = F.array(
        *[F.struct(F.lit(a).alias("axis"), F.col(a).alias("idx"), F.col(n).alias("n")) for a, n in zip(XYZ, ("n3", "n2", "n1"))]
    )
    c = ridge.select(F.explode(axes).alias("a")).groupBy("a.axis", "a.idx", "a.n").agg(F.count(F.lit(1)).alias("samples"))
    c = c.withColumn("bin", F.floor(F.col("idx") * bins / F.col("n")).cast("int"))
    best = F.max(F.struct("samples", -F.col("idx")))
    return c.groupBy("axis", "bin").agg(best["samples"].alias("samples"), (-best["col2"]).alias("idx"))


def map_region(cells: DataFrame, offset: tuple[int, int, int]) -> DataFrame:
    """Move crop-local indices into the frame of an enclosing crop."""
    return cells.withColumns({c: F.col(c) + o for c, o in zip(XYZ, offset)})
