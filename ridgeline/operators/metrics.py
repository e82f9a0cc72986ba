"""Scores of volumes and masks: reports, overlap, distance, orientation error."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.angles import axial_normal_angle, normal_vector, periodic_error
from ridgeline.functions.scores import f1, near_edge, ratio, unit_range
from ridgeline.operators.distance import nearest_distance
from ridgeline.operators.joins import salted_join
from ridgeline.operators.masks import percentile_mask
from ridgeline.operators.quantiles import grouped_quantiles

XYZ = ["i3", "i2", "i1"]


# ---------------------------------------------------------------- value reports


def finite_report(df: DataFrame, col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of finite, NaN and infinite samples; min, max, mean of the finite ones."""
    x = F.col(col).cast("double")
    inf = F.lit(float("inf"))
    finite = ~F.isnan(x) & (F.abs(x) != inf)
    ok = F.when(finite, x)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(finite).alias("finite_count"),
        F.count_if(F.isnan(x)).alias("nan_count"),
        F.count_if(x == inf).alias("posinf_count"),
        F.count_if(x == -inf).alias("neginf_count"),
        ratio(F.count_if(finite), F.count(F.lit(1))).alias("finite_fraction"),
        F.min(ok).alias("finite_min"), F.max(ok).alias("finite_max"), F.avg(ok).alias("finite_mean"),
    )


def normalized_correlation(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Zero-mean correlation; 0 when either side is constant."""
    stats = df.groupBy(*keys).agg(
        F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias("_c"),
        F.stddev_pop(F.col(a).cast("double")).alias("_a"), F.stddev_pop(F.col(b).cast("double")).alias("_b"),
    )
    return stats.select(*keys, ratio(F.col("_c"), F.col("_a") * F.col("_b")).alias("correlation"))


def distribution_summary(df: DataFrame, col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, population std, median and median absolute deviation."""
    k = list(keys)
    x = df.select(*k, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    base = x.groupBy(*k).agg(
        F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std")
    )
    med = grouped_quantiles(x, k, "_x", {"median": 0.5})
    dev = (salted_join(x, med, k, ["_x"]) if k else x.withColumn("median", med.select("median").scalar())).select(
        *k, F.abs(F.col("_x") - F.col("median")).alias("_d")
    )
    mad = grouped_quantiles(dev, k, "_d", {"median_absolute_deviation": 0.5})
    if k:
        return base.join(med, k, "left").join(mad, k, "left")
    return base.withColumns(
        {"median": med.select("median").scalar(),
         "median_absolute_deviation": mad.select("median_absolute_deviation").scalar()}
    )


def normalize_unit(df: DataFrame, col: str, out: str) -> DataFrame:
    """Scale by the global minimum and maximum (scalar subqueries over one aggregate)."""
    s = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    return df.withColumn(out, unit_range(F.col(col), s.select("lo").scalar(), s.select("hi").scalar()))


# ---------------------------------------------------------------- overlap


def ball_offsets(radius: float) -> list[tuple[int, int, int]]:
    r = math.ceil(radius)
    span = range(-r, r + 1)
    return [o for o in itertools.product(span, span, span) if sum(x * x for x in o) <= radius * radius]


def dilate(mask: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Voxels within ``radius`` of the mask (may leave the grid; duplicates possible)."""
    offs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", o)]) for o in ball_offsets(radius)])
    return mask.select(*keys, *XYZ, F.explode(offs).alias("_o")).select(
        *keys, *[(F.col(c) + F.col(f"_o.{n}")).alias(c) for c, n in zip(XYZ, "abc")]
    )


def overlap_flags(candidate: DataFrame, truth: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per voxel of either mask: in candidate, in truth, near truth, near candidate.

    Both masks and both dilated masks are stacked and grouped once; duplicates
    collapse before the shuffle.
    """
    cols = [*keys, *XYZ]

    def tag(df, **flags):
        on = {"c": 0, "t": 0, "nt": 0, "nc": 0, **flags}
        return df.select(*cols, *[F.lit(v).alias(n) for n, v in on.items()])

    stack = (
        tag(candidate, c=1).unionByName(tag(truth, t=1))
        .unionByName(tag(dilate(truth, radius, keys), nt=1))
        .unionByName(tag(dilate(candidate, radius, keys), nc=1))
    )
    return stack.groupBy(*cols).agg(*[F.max(n).alias(n) for n in ("c", "t", "nt", "nc")]).where("c = 1 or t = 1")


def buffered_overlap(candidate: DataFrame, truth: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts, precision/recall/F1/Jaccard, exact and within a buffer."""
    n = overlap_flags(candidate, truth, radius, keys).groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(e), F.lit(0)).cast("bigint").alias(name)
            for name, e in {
                "candidate_count": F.col("c"), "truth_count": F.col("t"),
                "intersection_count": F.col("c") * F.col("t"), "union_count": F.greatest("c", "t"),
                "candidate_in_truth_buffer_count": F.col("c") * F.col("nt"),
                "truth_in_candidate_buffer_count": F.col("t") * F.col("nc"),
            }.items()
        ]
    )
    n = n.withColumns(
        {
            "precision": ratio("intersection_count", "candidate_count"),
            "recall": ratio("intersection_count", "truth_count"),
            "jaccard": ratio("intersection_count", "union_count"),
            "buffered_precision": ratio("candidate_in_truth_buffer_count", "candidate_count"),
            "buffered_recall": ratio("truth_in_candidate_buffer_count", "truth_count"),
        }
    )
    return n.withColumns(
        {"f1": f1("precision", "recall"), "buffered_f1": f1("buffered_precision", "buffered_recall"),
         "radius": F.lit(float(radius))}
    )


def ridge_overlap(df: DataFrame, reference: str, candidate: str, percentile: float = 99.0, radius: float = 2.0) -> DataFrame:
    """Buffered overlap of the top-percentile ridges of two columns."""
    c = percentile_mask(df, candidate, percentile).where("mask").select(*XYZ)
    t = percentile_mask(df, reference, percentile).where("mask").select(*XYZ)
    return buffered_overlap(c, t, radius)


def percentile_overlap(df: DataFrame, a: str, b: str, percentile: float = 95.0, positive_only: bool = False) -> DataFrame:
    """Plain overlap of two top-percentile masks."""
    m = percentile_mask(df, a, percentile, "_a", positive_only)
    m = percentile_mask(m, b, percentile, "_b", positive_only)
    n = m.agg(
        F.count(F.lit(1)).alias("size"), F.count_if("_a").alias("a_count"), F.count_if("_b").alias("b_count"),
        F.count_if(F.col("_a") & F.col("_b")).alias("overlap_count"),
        F.count_if(F.col("_a") | F.col("_b")).alias("union_count"),
    )
    return n.select(
        "a_count", "b_count", "overlap_count", "union_count",
        ratio("a_count", "size").alias("a_fraction"), ratio("b_count", "size").alias("b_fraction"),
        ratio("overlap_count", "size").alias("overlap_fraction"),
        ratio("overlap_count", "a_count").alias("overlap_over_a"),
        ratio("overlap_count", "b_count").alias("overlap_over_b"),
        ratio("overlap_count", "union_count").alias("jaccard"),
    )


def edge_false_positives(candidate: DataFrame, truth: DataFrame, margin: int, radius: float) -> DataFrame:
    """Share of candidates in the edge shell that lie outside the truth buffer.

    ``candidate`` carries n3, n2, n1.
    """
    near = dilate(truth, radius)
    c = candidate.select(*XYZ, near_edge(margin).alias("edge"))
    flags = c.join(near.withColumn("near", F.lit(True)).dropDuplicates(XYZ), XYZ, "left")
    n = flags.agg(
        F.count(F.lit(1)).alias("candidate_count"), F.count_if("edge").alias("edge_candidate_count"),
        F.count_if(F.col("edge") & F.col("near").isNull()).alias("edge_false_positive_count"),
    )
    return n.withColumns(
        {
            "edge_candidate_fraction": ratio("edge_candidate_count", "candidate_count"),
            "edge_false_positive_fraction_of_candidates": ratio("edge_false_positive_count", "candidate_count"),
            "edge_false_positive_fraction_of_edge_candidates": ratio("edge_false_positive_count", "edge_candidate_count"),
        }
    )


# ---------------------------------------------------------------- distance

_PROBS = {"median": 0.5, "p90": 0.9, "p95": 0.95}


def _summaries(d: DataFrame, group: str) -> DataFrame:
    q = grouped_quantiles(d, [group], "d", _PROBS)
    return d.groupBy(group).agg(F.avg("d").alias("mean")).join(q, group)


def directional_distances(candidate: DataFrame, truth: DataFrame, n2) -> DataFrame:
    """(direction, d): candidate->truth and truth->candidate distances."""
    a = nearest_distance(candidate, truth, n2).select(F.lit("candidate_to_truth").alias("direction"), "d2")
    b = nearest_distance(truth, candidate, n2).select(F.lit("truth_to_candidate").alias("direction"), "d2")
    return a.unionByName(b).select("direction", F.sqrt(F.col("d2").cast("double")).alias("d"))


def surface_distance(candidate: DataFrame, truth: DataFrame, shape: DataFrame, empty_as_null: bool = False) -> DataFrame:
    """Mean/median/p90/p95 both ways, chamfer mean and p95 Hausdorff.

    Both empty: 0.  One empty: the volume diagonal, or NULL with ``empty_as_null``.
    """
    s = _summaries(directional_distances(candidate, truth, shape.select("n2").scalar()), "direction")
    cols = {}
    for d in ("candidate_to_truth", "truth_to_candidate"):
        for m in ("mean", "median", "p90", "p95"):
            cols[f"{d}_{m}"] = F.max(F.when(F.col("direction") == d, F.col(m)))
    wide = s.agg(*[c.alias(n) for n, c in cols.items()])
    nc = candidate.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    nt = truth.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    wide = wide.withColumns({"candidate_count": nc, "truth_count": nt})
    diag = shape.select(
        F.sqrt(sum(((F.col(n) - 1).cast("double") * (F.col(n) - 1) for n in ("n3", "n2", "n1")), F.lit(0.0))).alias("d")
    ).select("d").scalar()
    both = (F.col("candidate_count") == 0) & (F.col("truth_count") == 0)
    one = (F.col("candidate_count") == 0) | (F.col("truth_count") == 0)
    null = F.lit(None).cast("double")
    fill = F.when(F.lit(empty_as_null) & one, null).when(both, F.lit(0.0)).when(one, diag)
    wide = wide.withColumns({n: F.when(one, fill).otherwise(F.col(n)) for n in cols})
    return wide.withColumns(
        {
            "symmetric_chamfer_mean": 0.5 * (F.col("candidate_to_truth_mean") + F.col("truth_to_candidate_mean")),
            "hausdorff_p95": F.greatest("candidate_to_truth_p95", "truth_to_candidate_p95"),
        }
    )


# ---------------------------------------------------------------- orientation


def orientation_error(
    df: DataFrame, strike: str, dip: str, true_strike: str, true_dip: str, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Mean/median/p90/p95 of strike (period 180) and dip errors; zeros when empty (no keys)."""
    k = list(keys)
    e = df.select(
        *k,
        F.explode(
            F.array(
                F.struct(F.lit("strike").alias("what"), periodic_error(
                    F.col(strike).cast("double"), F.col(true_strike).cast("double"), 180.0).alias("d")),
                F.struct(F.lit("dip").alias("what"), F.abs(
                    F.col(dip).cast("double") - F.col(true_dip).cast("double")).alias("d")),
            )
        ).alias("e"),
    ).select(*k, "e.what", "e.d")
    s = e.groupBy(*k, "what").agg(F.count("d").alias("n"), F.avg("d").alias("mean")).join(
        grouped_quantiles(e, [*k, "what"], "d", _PROBS), [*k, "what"]
    )
    aggs = [F.coalesce(F.max("n"), F.lit(0)).alias("count")]
    for what in ("strike", "dip"):
        for m in ("mean", "median", "p90", "p95"):
            aggs.append(F.coalesce(F.max(F.when(F.col("what") == what, F.col(m))), F.lit(0.0)).alias(f"{what}_{m}"))
    return s.groupBy(*k).agg(*aggs)


def orientation_pair(
    df: DataFrame, left: tuple[str, str, str], right: tuple[str, str, str], percentile: float = 99.0
) -> DataFrame:
    """Strike (period 360), dip and axial normal differences where both ridges agree."""
    m = percentile_mask(df, left[0], percentile, "_l")
    m = percentile_mask(m, right[0], percentile, "_r").where("_l and _r")
    d = lambda c: F.col(c).cast("double")
    nl = normal_vector(d(left[1]), d(left[2]))
    nr = normal_vector(d(right[1]), d(right[2]))
    items = {
        "strike": periodic_error(d(left[1]), d(right[1]), 360.0),
        "dip": F.abs(d(left[2]) - d(right[2])),
        "normal": axial_normal_angle([x.cast("double") for x in nl], [x.cast("double") for x in nr]),
    }
    e = m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), c.alias("d")) for n, c in items.items()])).alias("e"))
    e = e.select("e.what", "e.d")
    q = grouped_quantiles(e, ["what"], "d", {"median": 0.5, "p95": 0.95})
    return e.groupBy("what").agg(F.count("d").alias("support"), F.avg("d").alias("mean"), F.max("d").alias("max")).join(q, "what")


def orientation_report(df: DataFrame, likelihood: str, strike: str, dip: str, percentile: float = 99.0) -> DataFrame:
    """Distribution of strike and dip where the likelihood is high."""
    m = percentile_mask(df, likelihood, percentile).where("mask")
    e = m.select(
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("what"), F.col(c).cast("double").alias("x")) for n, c in (("strike", strike), ("dip", dip))
        ])).alias("e")
    ).select("e.what", "e.x")
    return distribution_summary(e, "x", ("what",))


# ---------------------------------------------------------------- stages


def masked_mean(mask: Column, value: Column) -> Column:
    return F.coalesce(F.avg(F.when(mask, value.cast("double"))), F.lit(0.0))


def input_association(df: DataFrame, value: str, distance: str, half_width: float = 0.5) -> DataFrame:
    """Mean input on the truth surface and far from it, and their contrast."""
    far = max(3.0, half_width + 2.0)
    d = F.abs(F.col(distance))
    s = df.agg(
        masked_mean(d <= F.lit(half_width).cast("float"), F.col(value)).alias("truth_surface_mean"),
        masked_mean(d >= F.lit(far).cast("float"), F.col(value)).alias("far_from_truth_mean"),
    )
    return s.withColumn("contrast", F.col("far_from_truth_mean") - F.col("truth_surface_mean"))


def stage_profiles(stages: DataFrame, margin: int) -> DataFrame:
    """Per stage mask (long table: stage, i3, i2, i1, n3, n2, n1): size, edge share, centroid."""
    return stages.groupBy("stage").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        ratio(F.count_if(near_edge(margin)), F.count(F.lit(1))).alias("edge_shell_fraction"),
        *[F.avg(c).alias(f"centroid_{c}") for c in XYZ],
    )


def stage_transition(source: DataFrame, target: DataFrame, radius: float) -> DataFrame:
    """Overlap and size ratio between two consecutive stage masks."""
    o = buffered_overlap(target, source, radius)
    return o.select(
        F.col("truth_count").alias("source_count"), F.col("candidate_count").alias("target_count"),
        ratio("candidate_count", "truth_count").alias("target_to_source_count_ratio"),
        F.col("buffered_f1").alias("buffered_f1_r2"),
    )


def projection(df: DataFrame, col: str, keep: tuple[str, str]) -> DataFrame:
    """Maximum-intensity projection onto two axes."""
    return df.groupBy(*keep).agg(F.max(col).alias("mip"))


def histogram(df: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """Counts in equal bins over the common range of all columns (last bin closed)."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in cols])).alias("e")
    ).select("e.series", "e.x")
    r = long.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = r.select("lo").scalar(), r.select("hi").scalar()
    b = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / F.when(hi > lo, hi - lo) * bins))
    return long.groupBy("series", F.coalesce(b, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
