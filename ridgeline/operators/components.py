"""Connected components of a sparse voxel set, and what is decided from them.

Voxels are first contracted to runs along i1 (a window), runs of neighbouring traces
are linked where they touch, and labels are spread over the much smaller run graph
with pointer jumping.  Joins are keyed by grid position or salted, so a component
holding most of the voxels does not overload a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.scores import ratio
from ridgeline.operators.joins import salted_join
from ridgeline.session import cut_lineage

_BUCKET = 32

# (d3, d2) of half of the neighbouring traces -> slack along i1, per connectivity
_LINKS = {
    "face": {(0, 1): 0, (1, 0): 0},
    "edge": {(0, 1): 1, (1, 0): 1, (1, 1): 0, (1, -1): 0},
    "corner": {(0, 1): 1, (1, 0): 1, (1, 1): 1, (1, -1): 1},
}


def _runs(cells: DataFrame) -> DataFrame:
    """cells (i3, i2, i1, flat) plus the flat index of their run's first voxel."""
    trace = Window.partitionBy("i3", "i2").orderBy("i1")
    c = cells.withColumn("_g", F.col("i1") - F.row_number().over(trace))
    return c.withColumn("run", F.min("flat").over(Window.partitionBy("i3", "i2", "_g"))).drop("_g")


def _run_edges(runs: DataFrame, connectivity: str) -> DataFrame:
    """Pairs of touching runs of neighbouring traces, matched inside short i1 buckets."""
    r = runs.groupBy("i3", "i2", "run").agg(F.min("i1").alias("s"), F.max("i1").alias("e"))
    offsets = F.array(
        *[
            F.struct(F.lit(a).alias("d3"), F.lit(b).alias("d2"), F.lit(slack).alias("slack"))
            for (a, b), slack in _LINKS[connectivity].items()
        ]
    )
    left = r.select(
        "run", "s", "e", F.explode(offsets).alias("o"), "i3", "i2"
    ).select(
        F.col("run").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1"), F.col("o.slack").alias("slack"),
        (F.col("i3") + F.col("o.d3")).alias("i3"), (F.col("i2") + F.col("o.d2")).alias("i2"),
    )

    def buckets(lo, hi):
        return F.explode(F.sequence(F.floor(lo / _BUCKET), F.floor(hi / _BUCKET)))

    left = left.withColumn("k", buckets(F.col("s1") - F.col("slack"), F.col("e1") + F.col("slack")))
    right = r.select(
        F.col("run").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"), "i3", "i2",
        buckets(F.col("s"), F.col("e")).alias("k"),
    )
    touch = (F.col("s1") <= F.col("e2") + F.col("slack")) & (F.col("s2") <= F.col("e1") + F.col("slack"))
    return left.join(right, ["i3", "i2", "k"]).where(touch).select("a", "b").distinct()


def label_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest node id of each connected component."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    # nodes without an edge keep their own label and take no part in the rounds
    linked = cut_lineage(nodes.select("id").join(both.select(F.col("a").alias("id")), "id", "left_semi"))
    labels = linked.select("id", F.col("id").alias("label"))
    while True:
        seen = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        lower = labels.join(seen, "id", "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("new"))
        hop = (
            lower.select(F.col("new").alias("id")).distinct()
            .join(lower.select("id", F.col("new").alias("next")), "id")
            .select(F.col("id").alias("new"), "next")
        )
        step = cut_lineage(
            salted_join(lower, hop, "new", ["id"])
            .select("id", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved"))
        )
        labels = step.select("id", "label")
        if step.where("moved").isEmpty():
            known = labels.withColumnRenamed("label", "_label")
            return nodes.select("id").join(known, "id", "left").select("id", F.coalesce("_label", "id").alias("label"))


def connected_components(cells: DataFrame, connectivity: str = "corner") -> DataFrame:
    """``cells`` (i3, i2, i1, flat, ...) plus ``component``: the smallest flat index in it."""
    runs = cut_lineage(_runs(cells))
    nodes = runs.select(F.col("run").alias("id")).distinct()
    labels = label_graph(nodes, _run_edges(runs, connectivity))
    return runs.join(labels.select(F.col("id").alias("run"), F.col("label").alias("component")), "run").drop("run")


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def component_skins(labelled: DataFrame, min_size: int | None = None) -> DataFrame:
    """Cells with ``skin_size``; skins below ``min_size`` dropped.

    Skins are ordered by (-skin_size, component) wherever an order is shown.
    """
    s = component_sizes(labelled).withColumnRenamed("size", "skin_size")
    if min_size is not None:
        s = s.where(F.col("skin_size") >= min_size)
    return salted_join(labelled, s, "component", ["flat"])  # one component may hold most voxels


def main_components(sizes: DataFrame, keep: int = 3, floor: int = 8, share: float = 0.05, of_largest: float = 0.10) -> DataFrame:
    """Up to ``keep`` components that are large enough, or the largest when none is."""
    n = sizes.agg(F.sum("size").alias("n")).select("n").scalar()
    big = sizes.agg(F.max("size").alias("m")).select("m").scalar()
    limit = F.greatest(F.lit(floor).cast("bigint"), F.ceil(F.lit(share) * n).cast("bigint"))
    ok = (F.col("size") >= limit) & (F.col("size") >= F.lit(of_largest) * big)
    ranked = sizes.withColumn("ok", ok).orderBy(F.desc("ok"), F.desc("size"), F.asc("component")).limit(keep)
    first = F.row_number().over(Window.orderBy(F.desc("ok"), F.desc("size"), F.asc("component")))
    return ranked.withColumn("_r", first).where(F.col("ok") | (F.col("_r") == 1)).select("component", "size")


def main_components_by(sizes: DataFrame, key: str, keep: int = 3, floor: int = 8, share: float = 0.05, of_largest: float = 0.10) -> DataFrame:
    """:func:`main_components` for each value of ``key`` (few values, many components): key, component, size."""
    totals = sizes.groupBy(key).agg(F.sum("size").alias("_n"), F.max("size").alias("_big"))
    limit = F.greatest(F.lit(floor).cast("bigint"), F.ceil(F.lit(share) * F.col("_n")).cast("bigint"))
    ok = (F.col("size") >= limit) & (F.col("size") >= F.lit(of_largest) * F.col("_big"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ok"), F.desc("size"), F.asc("component")))
    ranked = sizes.join(totals, key).withColumn("ok", ok).withColumn("_r", rank).where(F.col("_r") <= keep)  # limited before the shuffle
    return ranked.where(F.col("ok") | (F.col("_r") == 1)).select(key, "component", "size")


def fallback_components(labelled: DataFrame, small: int, min_size: int | None = None, filtered: bool = True) -> DataFrame:
    """One row about the components that a fallback would use (see :func:`main_components` for the filter)."""
    sizes = component_sizes(labelled)
    taken = main_components(sizes) if filtered else (sizes if min_size is None else sizes.where(F.col("size") >= min_size))
    ranked = F.row_number().over(Window.orderBy(F.desc("size"), "component"))
    top = sizes.orderBy(F.desc("size"), "component").limit(3).withColumn("r", ranked).agg(  # three rows
        F.coalesce(F.max(F.when(F.col("r") == 1, F.col("size"))), F.lit(0)).alias("largest_component_size"), F.coalesce(F.sum("size"), F.lit(0)).alias("top3_component_cell_count"),
    )
    kept = taken.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("cells"))
    all_ = sizes.agg(
        F.count(F.lit(1)).alias("component_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("candidate_cell_count"),
        F.count_if(F.col("size") < small).alias("small_component_count"),
    )
    out = all_.withColumns({c: top.select(c).scalar() for c in top.columns} | {
        "accepted_component_count": kept.select("n").scalar(), "accepted_component_cell_count": kept.select("cells").scalar(),
    })
    return out.withColumns({
        "largest_component_fraction": ratio("largest_component_size", "candidate_cell_count"),
        "top3_component_fraction": ratio("top3_component_cell_count", "candidate_cell_count"),
        "discarded_component_count": F.col("component_count") - F.col("accepted_component_count"),
    })


def choose_skins(primary: DataFrame, fallback: DataFrame, replace: Column) -> DataFrame:
    """The primary skins, or the fallback's where the one-row condition holds; ``replaced`` tells which."""
    names = [c for c in primary.columns if c in fallback.columns]
    use = F.coalesce(replace, F.lit(False))
    return primary.where(~use).select(*names, F.lit(False).alias("replaced")).unionByName(
        fallback.where(use).select(*names, F.lit(True).alias("replaced"))
    )


def fallback_guardrail(topology: DataFrame, positive_count, pruned_fraction) -> DataFrame:
    """Reasons against replacing the primary skins (one-row topology in, one row out).

    Fixed values: at most 3 skins, coverage 0.75-1.25, small share <= 0.20,
    largest share >= 0.50, pruned share <= 0.60.
    """
    cov = F.coalesce(F.try_divide(F.col("unique_cell_count").cast("double"), positive_count), F.lit(0.0))
    t = topology.withColumns({"coverage_of_fvt_positive": cov, "pruned_fraction": pruned_fraction})
    checks = [
        (F.col("skin_count") > 3, "fallback_skin_count_exceeds_max"),
        (F.col("coverage_of_fvt_positive") < 0.75, "coverage_of_fvt_positive_below_min"),
        (F.col("coverage_of_fvt_positive") > 1.25, "coverage_of_fvt_positive_above_max"),
        (F.col("small_skin_cell_fraction") > 0.20, "small_skin_cell_fraction_exceeds_max"),
        (F.col("largest_skin_fraction") < 0.50, "largest_skin_fraction_below_min"),
        (F.col("pruned_fraction") > 0.60, "pruned_fraction_exceeds_max"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks]))
    return t.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def primary_degraded(topology: DataFrame, positive_count) -> DataFrame:
    """Reasons why a primary skin result counts as degraded.

    Fixed values: coverage < 0.50, at least 8 skins, largest share < 0.75, small share > 0.25.
    """
    n = F.lit(positive_count) if isinstance(positive_count, int) else positive_count
    t = topology.withColumn(
        "cell_coverage", F.coalesce(F.try_divide(F.col("unique_cell_count").cast("double"), n), F.lit(0.0))
    )
    some = F.col("skin_count") > 0
    checks = [
        (~some, "empty_primary_skin"),
        (F.col("cell_coverage") < 0.50, "low_fvt_positive_coverage"),
        (some & ((F.col("skin_count") >= 8) | (F.col("largest_skin_fraction") < 0.75)), "fragmented_primary_skins"),
        (F.col("small_skin_cell_fraction") > 0.25, "high_small_skin_cell_fraction"),
    ]
    reasons = F.array_compact(F.array(*[F.when((n > 0) & c, F.lit(r)) for c, r in checks]))
    return t.withColumn("reasons", reasons)


def boundary_degraded(generic: DataFrame, positive_count, fvt_edge, primary_edge, target_p95) -> DataFrame:
    """Boundary-local reasons, given a row of :func:`primary_degraded`.

    Fixed values: edge share >= 0.25, p95 to target >= 2.0, coverage < 0.50 with
    edge shares >= 0.15 and >= 0.05.
    """
    checks = [
        (fvt_edge >= 0.25, "fvt_positive_edge_shell"),
        (F.coalesce(target_p95 >= 2.0, F.lit(False)), "fvt_far_from_scanner_target"),
        ((F.col("cell_coverage") < 0.50) & (fvt_edge >= 0.15) & (primary_edge >= 0.05),
         "low_primary_coverage_with_edge_local_candidates"),
    ]
    on = (F.size("reasons") > 0) & (positive_count > 0)
    return generic.withColumn(
        "boundary_reasons", F.array_compact(F.array(*[F.when(on & c, F.lit(r)) for c, r in checks]))
    )


def minimum_component_size(candidates: Column) -> Column:
    """Five hundredths of the candidates, eight at least."""
    return F.greatest(F.lit(8), F.ceil(0.05 * candidates)).cast("bigint")
