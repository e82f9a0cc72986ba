"""Boundary clean-up of thinned votes against a scanner target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.angles import dominant_axis
from ridgeline.functions.scores import near_edge, positive
from ridgeline.operators.thinning import collapse_runs
from ridgeline.session import cut_lineage

XYZ = ["i3", "i2", "i1"]


def _moved(axis, shift):
    return [(F.col(c) + F.when(F.col(axis) == k, F.col(shift)).otherwise(0)).cast("int").alias(c) for k, c in enumerate(XYZ)]


def recenter(cells: DataFrame, target: DataFrame, margin: int, max_shift: int = 3) -> DataFrame:
    """Move positive edge-shell samples along their normal axis to a stronger target.

    ``cells``: i3, i2, i1, n3, n2, n1, fvt, vp, vt.  ``target``: i3, i2, i1, target.
    Only a strictly stronger target moves a sample; among equals the shorter shift,
    then the lower offset.  If two samples meet, the larger value stays, then the
    earlier one in C order.  Returns (i3, i2, i1, fvt).
    """
    c = cells.where(positive("fvt")).withColumns(
        {
            "edge": near_edge(margin), "axis": dominant_axis(F.col("vp").cast("double"), F.col("vt").cast("double")),
            "flat": (F.col("i3").cast("bigint") * F.col("n2") + F.col("i2")) * F.col("n1") + F.col("i1"),
        }
    )
    shifts = F.when(F.col("edge"), F.sequence(F.lit(-max_shift), F.lit(max_shift))).otherwise(F.array(F.lit(0)))
    probe = c.select("flat", "fvt", "axis", "i3", "i2", "i1", F.explode(shifts).alias("shift")).select(
        "flat", "fvt", "shift", *_moved("axis", "shift")
    )
    seen = probe.join(target, XYZ, "inner")
    best = seen.groupBy("flat").agg(
        F.max("fvt").alias("fvt"),
        F.max(F.struct("target", -F.abs("shift"), -F.col("shift"), *XYZ)).alias("b"),
        F.max(F.when(F.col("shift") == 0, F.struct("target", *XYZ))).alias("own"),
    )
    stay = F.col("b.target") <= F.col("own.target")
    dest = best.select("flat", "fvt", *[F.when(stay, F.col(f"own.{x}")).otherwise(F.col(f"b.{x}")).alias(x) for x in XYZ])
    kept = dest.groupBy(*XYZ).agg(F.max(F.struct("fvt", -F.col("flat"))).alias("k"))
    return kept.select(*XYZ, F.col("k.fvt").alias("fvt"))


def skeletonize(labelled: DataFrame, value: str = "fvt") -> DataFrame:
    """Per component, one sample per run along the dominant normal axis.

    Largest value, then target membership, then closest to the run's middle, then
    index.  ``labelled``: component, i3, i2, i1, vp, vt, target (boolean) and the value.
    """
    from pyspark.sql import Window

    c = labelled.withColumn("axis", dominant_axis(F.col("vp").cast("double"), F.col("vt").cast("double")))
    pos = F.when(F.col("axis") == 0, F.col("i3")).when(F.col("axis") == 1, F.col("i2")).otherwise(F.col("i1"))
    c = c.withColumns(
        {"_pos": pos, "_la": F.when(F.col("axis") == 0, F.col("i2")).otherwise(F.col("i3")),
         "_lb": F.when(F.col("axis") == 2, F.col("i2")).otherwise(F.col("i1"))}
    )
    line = ["component", "axis", "_la", "_lb"]
    c = c.withColumn("_run", F.col("_pos") - F.row_number().over(Window.partitionBy(*line).orderBy("_pos")))
    run = Window.partitionBy(*line, "_run")
    c = c.withColumn("_mid", (F.min("_pos").over(run) + F.max("_pos").over(run)) / 2.0)
    rank = F.struct(-F.col(value).cast("double"), F.when(F.col("target"), 0).otherwise(1), F.abs(F.col("_pos") - F.col("_mid")), F.col("_pos"))
    c = c.withColumn("_best", F.min(rank).over(run)).where(F.col("_best") == rank)
    return c.drop("_pos", "_la", "_lb", "_run", "_mid", "_best")


def thin_edge_lines(
    cells: DataFrame, plateau: DataFrame, margin: int
) -> DataFrame:
    """Replace edge-shell samples of a line by the best target-supported plateau sample.

    ``cells``: dense voxels with fvt, fv, vp, vt, target, n3, n2, n1; ``plateau``: the
    voxels kept by plateau thinning.  Per (dominant axis, line) the candidate with the
    largest (target, fv, -flat) wins; it clears the line's edge samples if it also beats
    the best of them, and then takes its ``fv``.  Returns (i3, i2, i1, fvt), positives only.
    """
    c = cut_lineage(cells).withColumns(  # read four times below
        {
            "edge": near_edge(margin),
            "flat": (F.col("i3").cast("bigint") * F.col("n2") + F.col("i2")) * F.col("n1") + F.col("i1"),
        }
    )
    key = [
        F.when(F.col("axis") == 0, F.col("i2")).otherwise(F.col("i3")).alias("la"),
        F.when(F.col("axis") == 2, F.col("i2")).otherwise(F.col("i1")).alias("lb"),
    ]
    order = F.struct(F.col("target"), F.col("fv"), -F.col("flat"))
    cand = (
        c.where(F.col("edge") & positive("target")).join(plateau.select(*XYZ), XYZ, "left_semi")
        .withColumn("axis", dominant_axis(F.col("vp").cast("double"), F.col("vt").cast("double")))
        .select("axis", *key, order.alias("rank"), "fv", "flat", *XYZ)
        .groupBy("axis", "la", "lb")
        .agg(F.max(F.struct("rank", "fv", *XYZ)).alias("best"), F.min("flat").alias("turn"))
    )
    base = c.where(F.col("edge") & positive("fvt"))
    axes = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("axis")
    on_line = base.select("*", axes).select("axis", *key, order.alias("rank"), *XYZ)
    best_base = on_line.groupBy("axis", "la", "lb").agg(F.max("rank").alias("base_rank"))
    wins = cand.join(best_base, ["axis", "la", "lb"], "left").where(
        F.col("base_rank").isNull() | (F.col("best.rank") > F.col("base_rank"))
    )
    # lines take turns (by their first candidate): a later line may clear what an earlier one placed
    cleared = on_line.join(wins.select("axis", "la", "lb", "turn"), ["axis", "la", "lb"]).groupBy(*XYZ).agg(
        F.max("turn").alias("cleared_at")
    )
    placed = wins.groupBy(*[F.col(f"best.{x}").alias(x) for x in XYZ]).agg(
        F.max(F.struct("turn", F.col("best.fv").alias("fvt"))).alias("p")
    )
    stays = placed.join(cleared, XYZ, "left").where(F.col("cleared_at").isNull() | (F.col("cleared_at") <= F.col("p.turn")))
    kept = c.where(positive("fvt")).select(*XYZ, "fvt").join(cleared, XYZ, "left_anti").join(placed, XYZ, "left_anti")
    return kept.unionByName(stays.select(*XYZ, F.col("p.fvt").alias("fvt")))


__all__ = ["collapse_runs", "recenter", "skeletonize", "thin_edge_lines"]
