"""Comparisons between stages and between overlapping crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.scores import ratio
from ridgeline.operators.distance import nearest_distance
from ridgeline.operators.sampling import map_region

XYZ = ["i3", "i2", "i1"]


def centroid_shift(stages: DataFrame, order: list[str]) -> DataFrame:
    """Shift of the centroid from each stage to the next (long table: stage, i3, i2, i1)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    c = stages.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in XYZ]).withColumn("k", rank)
    w = Window.orderBy("k")  # one row per stage
    moves = [F.col(x) - F.lag(x).over(w) for x in XYZ]
    c = c.withColumns({f"shift_{x}": m for x, m in zip(XYZ, moves)} | {"previous": F.lag("stage").over(w), "n_previous": F.lag("n").over(w)})
    c = c.where("previous is not null")
    length = F.sqrt(sum((F.col(f"shift_{x}") * F.col(f"shift_{x}") for x in XYZ), F.lit(0.0)))
    return c.select(
        "previous", "stage", *[f"shift_{x}" for x in XYZ], length.alias("shift"), ratio("n", "n_previous").alias("count_ratio")
    )


def far_candidates(candidate: DataFrame, reference: DataFrame, n2, threshold: float) -> DataFrame:
    """Candidate voxels farther than ``threshold`` from the reference, with their distance."""
    d = nearest_distance(candidate, reference, n2).withColumn("distance", F.sqrt(F.col("d2").cast("double")))
    return d.where(F.col("distance") > threshold).drop("d2")


def outlier_persistence(base: DataFrame, context: DataFrame, offset: tuple[int, int, int]) -> DataFrame:
    """Which base-crop outliers are still outliers when the crop sits in a larger context.

    ``base``: crop indices and distance; ``context``: enclosing indices and distance.
    """
    b = map_region(base, offset).select(*XYZ, F.col("distance").alias("base_distance"))
    c = context.select(*XYZ, F.col("distance").alias("context_distance"))
    j = b.join(c, XYZ, "left")
    return j.withColumn("persists", F.col("context_distance").isNotNull())


def same_region(base: DataFrame, context: DataFrame, offset: tuple[int, int, int], value: str) -> DataFrame:
    """Values of a crop next to those of the same voxels in its context."""
    b = map_region(base, offset).select(*XYZ, F.col(value).alias("base_value"))
    return b.join(context.select(*XYZ, F.col(value).alias("context_value")), XYZ)
