"""Ratios, likelihoods and masks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: samples at or below this magnitude count as empty.
NONZERO_EPSILON = 1.0e-6


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def nonzero(x, epsilon: float = NONZERO_EPSILON) -> Column:
    return F.abs(_c(x)) > F.lit(epsilon).cast("float")


def positive(x, epsilon: float = NONZERO_EPSILON) -> Column:
    return _c(x) > F.lit(epsilon).cast("float")


def ratio(a, b) -> Column:
    """a/b, and 0 for an empty denominator."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def f1(p, r) -> Column:
    return ratio(2.0 * _c(p) * _c(r), _c(p) + _c(r))


def planarity_likelihood(s) -> Column:
    """1 - clip(s)^4, clipped to [0, 1]."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(s)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.pow(x, F.lit(4.0)))).cast("float")


def sharpen(x, power: int) -> Column:
    """1 - (1-x)^power, clipped to [0, 1]."""
    y = 1.0 - F.pow(1.0 - _c(x), F.lit(float(power)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)).cast("float")


def unit_range(x, low, high) -> Column:
    """(x-low)/(high-low) clipped to [0, 1]; x-low (all zero) when the span is empty."""
    span = _c(high) - _c(low)
    y = F.when(span > 0, (_c(x) - _c(low)) / F.when(span > 0, span)).otherwise(_c(x) - _c(low))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)).cast("float")


def improvement(value, direction) -> Column:
    """Signed so that larger is better; NULL for metrics without a direction."""
    return F.when(_c(direction) == "higher", _c(value)).when(_c(direction) == "lower", -_c(value))


def edge_distance() -> Column:
    """Voxel distance to the closest face."""
    return F.least(
        F.col("i3"), F.col("n3") - 1 - F.col("i3"),
        F.col("i2"), F.col("n2") - 1 - F.col("i2"),
        F.col("i1"), F.col("n1") - 1 - F.col("i1"),
    )


def near_edge(margin: int) -> Column:
    return edge_distance() < margin
