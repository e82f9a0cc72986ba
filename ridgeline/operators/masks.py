"""Masks of voxel volumes: percentile, top-k, truth-count, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.scores import NONZERO_EPSILON, nonzero, positive, ratio
from ridgeline.operators.quantiles import cut_at_rank, quantile, ranks_by_key
from ridgeline.session import cut_lineage


def nonzero_report(df: DataFrame, col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and fraction of non-empty and positive samples."""
    n, nz = F.count(F.lit(1)), F.count_if(nonzero(col))
    return df.groupBy(*keys).agg(
        n.alias("size"),
        nz.alias("nonzero_count"),
        F.count_if(positive(col)).alias("positive_count"),
        ratio(nz, n).alias("nonzero_fraction"),
    )


# Percentile of the positive samples and the range it is kept in; the result without any.
_ADAPTIVE = (0.70, 0.25, 0.75, 1.0)


def adaptive_threshold(df: DataFrame, col: str) -> DataFrame:
    """One row ``threshold``: the clipped 70th percentile of the positive samples, 1.0 without any; non-finite is an error."""
    p, low, high, none = _ADAPTIVE
    one = df.sparkSession.range(1)
    q = quantile(df.where((F.col(col) > 0) | F.isnan(col)), col, p)
    return one.select(F.when(q.isNull(), F.lit(none)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), q))).alias("threshold"))


def percentile_mask(
    df: DataFrame,
    col: str,
    percentile: float,
    out: str = "mask",
    positive_only: bool = True,
    epsilon: float = 0.0,
) -> DataFrame:
    """True at or above the percentile (of the positive samples)."""
    pool = df.where(positive(col, epsilon)) if positive_only else df
    threshold = quantile(pool, col, percentile / 100.0)
    hit = F.coalesce(F.col(col).cast("double") >= threshold, F.lit(False))
    if positive_only:
        hit = hit & positive(col, epsilon)
    return df.withColumn(out, hit)


def top_k_mask(
    df: DataFrame,
    col: str,
    k: int | Column,
    flat: str = "flat",
    out: str = "mask",
    positive_only: bool = False,
    epsilon: float = NONZERO_EPSILON,
) -> DataFrame:
    """True for the k largest samples; equal values in ascending flat order.

    Two order statistics (the k-th value, and the flat index where its ties are
    cut) replace a global sort, so k may be as large as the volume.  ``df`` is read
    several times: store it first when it is expensive.
    """
    pool = df.where(F.col(col) > F.lit(float(epsilon))) if positive_only else df
    kc = (F.lit(k) if isinstance(k, int) else k).cast("bigint")
    n_pool = pool.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    last = F.least(kc, n_pool) - 1
    top = cut_at_rank(pool, col, last, ascending=False)
    v, cut = F.col(col).cast("double"), top["value"]
    flat_cut = cut_at_rank(pool.where(v == cut), flat, last - top["above"])["value"]
    hit = (v > cut) | ((v == cut) & (F.col(flat) <= flat_cut))
    if positive_only:
        hit = hit & (F.col(col) > F.lit(float(epsilon)))
    return df.withColumn(out, F.coalesce(hit & (kc > 0), F.lit(False)))


def top_k_by_key(
    df: DataFrame, col: str, k: str, keys: list[str], flat: str = "flat", out: str = "mask", positive_only: bool = False,
    epsilon: float = NONZERO_EPSILON,
) -> DataFrame:
    """:func:`top_k_mask` within each key; ``k`` names a column that is the same on all rows of a key.

    Ranks are found by counting (:func:`ranks_by_key`), so no key is ever sorted in one task.  ``df`` is read
    five times, and only rows near the cut are shuffled: store it first when it is expensive.
    Keys and ``k`` must not be NULL; a key without rows to choose from gets no true row.
    """
    v = F.col(col).cast("double")
    pool = df.where(F.col(col) > F.lit(float(epsilon))) if positive_only else df
    of = lambda name: F.col("_k").getField(name)
    cuts = cut_lineage(ranks_by_key(pool, [*keys, k], v, F.col("_total") - F.least(of(k), F.col("_total"))).select(
        *[of(c).alias(c) for c in keys], F.col("_v").alias("_cut"),
        (F.least(of(k), F.col("_total")) - F.col("_total") + F.col("_upto")).alias("_need"),
    ))  # one row per key, used twice
    ties = pool.join(F.broadcast(cuts), keys).where(v == F.col("_cut"))
    last = ranks_by_key(ties, [*keys, "_need"], flat, of("_need") - 1).select(
        *[of(c).alias(c) for c in keys], F.col("_v").alias("_last")
    )
    hit = (v > F.col("_cut")) | ((v == F.col("_cut")) & (F.col(flat) <= F.col("_last")))
    if positive_only:
        hit = hit & (F.col(col) > F.lit(float(epsilon)))
    out_rows = df.join(F.broadcast(cuts.join(last, keys)), keys, "left")
    return out_rows.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_cut", "_need", "_last")


def top_truth_count_mask(
    df: DataFrame, col: str, truth: str, flat: str = "flat", out: str = "mask", positive_only: bool = False
) -> DataFrame:
    """Top-k with k the number of truth voxels."""
    k = df.agg(F.count_if(F.col(truth)).alias("k")).select("k").scalar()
    return top_k_mask(df, col, k, flat, out, positive_only)


def region_columns(df: DataFrame, margin: int) -> DataFrame:
    """Interior / edge-shell flags of voxels that carry n3, n2, n1."""
    from ridgeline.functions.scores import edge_distance

    d = edge_distance()
    return df.withColumns({"edge_distance": d, "is_edge": d < margin, "is_interior": d >= margin})
