"""Exact order statistics that never gather a group in one task.

Values are first counted per distinct value (map-side combine, hashed on the
value too, so no group is hot).  A histogram over data-independent, monotone
buckets of the value then tells which bucket holds each wanted rank, and only
that bucket (1/65536 of an octave) is ordered.  The input is read once, or twice where it
is stored: a first reading then finds the range of buckets of each wanted rank, and
only the values of those ranges are counted and shuffled.
NULL is left out; NaN and infinite values are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut_lineage

_PER_OCTAVE = 65536
_SHIFT = 100_000_000
_RANGE = 4096  # buckets


def _bucket(v: Column) -> Column:
    """Monotone integer bucket of a finite double."""
    mag = F.floor(F.log2(F.abs(v)) * _PER_OCTAVE) + _SHIFT
    return F.when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0)).cast("bigint")


def _finite(v: Column) -> Column:
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("values must be finite"))).otherwise(v)


def _ranked(df: DataFrame, keys: list[str], value: str | Column, wanted: Column, stored: bool = False) -> DataFrame:
    """One row per wanted rank: group key, label, value at that 0-based ascending rank.

    ``wanted`` is an array of structs (label, rank, ...) computed from ``_total``.  ``stored``: ``df`` is cheap to read twice.
    """
    v = _finite((F.col(value) if isinstance(value, str) else value).cast("double"))
    k = F.struct(*keys) if keys else F.lit(0)
    upto = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_k")
    above, start = F.col("_cum"), F.col("_cum") - F.col("_cn")

    def holding(ranges: DataFrame, *more: str) -> DataFrame:
        """The ranges of buckets that hold a wanted rank: a few rows per key."""
        return (
            ranges.withColumns({"_cum": F.sum("_cn").over(upto), "_total": F.sum("_cn").over(whole)})
            .withColumn("_all", wanted)
            .withColumn("_r", F.filter("_all", lambda w: (w["rank"] >= start) & (w["rank"] < above)))
            .where(F.size("_r") > 0)
            .select("_k", "_c", "_r", "_total", start.alias("_start"), *more)
        )

    rows = df.select(k.alias("_k"), v.alias("_v")).where(F.col("_v").isNotNull())
    if stored:
        ranges = rows.groupBy("_k", F.floor(_bucket(F.col("_v")) / _RANGE).alias("_c")).agg(
            F.count(F.lit(1)).alias("_cn"), F.min("_v").alias("_from"), F.max("_v").alias("_to")
        )
        hit = cut_lineage(holding(ranges, "_from", "_to"))
        plain = (F.col(value) if isinstance(value, str) else value).cast("double")  # the first reading found all finite
        rows = df.select(k.alias("_k"), plain.alias("_v")).join(F.broadcast(hit.select("_k", "_from", "_to")), "_k").where(
            (F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to"))
        ).select("_k", "_v")
    counted = (
        rows.groupBy("_k", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", _bucket(F.col("_v")))
        .where(F.col("_b").isNotNull())  # same filter in both uses below, so their shuffle is shared
        .repartition("_k", "_b")  # what is counted per bucket and what is looked up in buckets lie together
    )
    if stored:
        counted = cut_lineage(counted)  # used twice below; the optimizer would read ``df`` for each
    # ranks are found among few ranges of buckets first, then among the buckets of the ranges that hold one
    # the long side of a join must not be broadcast, however well it is compressed: the short side is hashed
    per_bucket = counted.groupBy("_k", "_b").agg(F.sum("_n").alias("_bn")).withColumn("_c", F.floor(F.col("_b") / _RANGE))
    if not stored:
        hit = holding(per_bucket.groupBy("_k", "_c").agg(F.sum("_bn").alias("_cn")))
    within = Window.partitionBy("_k", "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_start") + F.col("_upto_b")
    targets = (
        per_bucket.join(hit.hint("shuffle_hash"), ["_k", "_c"]).withColumn("_upto_b", F.sum("_bn").over(within))
        .withColumn("_w", F.filter("_r", lambda w: (w["rank"] >= end - F.col("_bn")) & (w["rank"] < end)))
        .where(F.size("_w") > 0)
        .select("_k", "_b", "_w", "_total", (end - F.col("_bn")).alias("_below"))
    )
    inside = Window.partitionBy("_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.join(targets.hint("shuffle_hash"), ["_k", "_b"]).withColumn("_upto", F.sum("_n").over(inside) + F.col("_below"))
    mine = F.filter("_w", lambda w: (w["rank"] >= F.col("_upto") - F.col("_n")) & (w["rank"] < F.col("_upto")))
    return reached.select("_k", F.explode(mine).alias("_w"), "_total", "_v", "_upto")


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float], stored: bool = False
) -> DataFrame:
    """Linear-interpolated quantiles per group: one column per entry of ``probs``.  ``stored``: ``df`` is cheap to read twice."""
    total = F.col("_total") - 1
    wants = []
    for name, p in probs.items():
        pos = total * F.lit(float(p))
        wants.append(F.struct(F.lit(name).alias("name"), F.lit(0).alias("side"), F.floor(pos).alias("rank")))
        wants.append(F.struct(F.lit(name).alias("name"), F.lit(1).alias("side"), F.ceil(pos).alias("rank")))
    picked = _ranked(df, keys, value, F.array(*wants), stored)
    aggs = []
    for name in probs:
        hit = F.col("_w.name") == name
        aggs.append(F.max(F.when(hit & (F.col("_w.side") == 0), F.col("_v"))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when(hit & (F.col("_w.side") == 1), F.col("_v"))).alias(f"_hi_{name}"))
    aggs.append(F.max("_total").alias("_total"))
    out = picked.groupBy("_k").agg(*aggs)
    cols = [F.col(f"_k.{k}").alias(k) for k in keys]
    for name, p in probs.items():
        pos = total * F.lit(float(p))
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * frac).alias(name))
    return out.select(*cols)


def ranks_by_key(df: DataFrame, keys: list[str], value: str | Column, rank: Column) -> DataFrame:
    """Per key (struct ``_k``) the value ``_v`` at a 0-based ascending rank computed from ``_k`` and ``_total``.

    ``_upto`` counts the rows up to and with that value; keys whose rank is out of range give no row.  ``df`` is read twice.
    """
    return _ranked(df, keys, value, F.array(F.struct(F.lit("r").alias("name"), rank.cast("bigint").alias("rank"))), stored=True)


def quantile(df: DataFrame, value: str | Column, p: float) -> Column:
    """A single quantile as a scalar subquery (NULL for empty input)."""
    return grouped_quantiles(df, [], value, {"q": p}).select("q").scalar()


def cut_at_rank(df: DataFrame, value: str | Column, rank: Column, ascending: bool = True) -> Column:
    """struct(value, above) at a 0-based rank as a scalar subquery: the value there and
    how many rows lie strictly above it.  NULL when the rank is out of range."""
    r = rank.cast("bigint")
    r = r if ascending else F.col("_total") - 1 - r
    want = F.array(F.struct(F.lit("r").alias("name"), r.alias("rank")))
    one = _ranked(df, [], value, want).agg(
        F.max(F.struct(F.col("_v").alias("value"), (F.col("_total") - F.col("_upto")).alias("above"))).alias("cut")
    )
    return one.select("cut").scalar()
