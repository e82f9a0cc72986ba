"""Angle and vector expressions (x1 down, x2/x3 horizontal; degrees)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.kernels import STEEPEST_LEAN, UPRIGHT


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def range360(a) -> Column:
    """Wrap to [0, 360)."""
    return F.pmod(_c(a), F.lit(360.0))


def range180(a) -> Column:
    """Wrap to [-180, 180]; a negative half turn stays -180."""
    w = range360(a)
    return F.when((w == 180.0) & (_c(a) < 0), F.lit(-180.0)).when(w > 180.0, w - 360.0).otherwise(w)


def nearest_index(x) -> Column:
    """Round half up to an index: floor(x + 0.5), also for negatives."""
    return F.floor(_c(x) + 0.5).cast("int")


def dip_vector(strike, dip) -> list[Column]:
    p, t = F.radians(_c(strike)), F.radians(_c(dip))
    return [
        F.sin(t).cast("float"),
        (F.cos(t) * F.cos(p)).cast("float"),
        (-F.cos(t) * F.sin(p)).cast("float"),
    ]


def strike_vector(strike) -> list[Column]:
    p = F.radians(_c(strike))
    return [F.lit(0.0).cast("float"), F.sin(p).cast("float"), F.cos(p).cast("float")]


def normal_vector(strike, dip) -> list[Column]:
    p, t = F.radians(_c(strike)), F.radians(_c(dip))
    return [
        (-F.cos(t)).cast("float"),
        (F.sin(t) * F.cos(p)).cast("float"),
        (-F.sin(t) * F.sin(p)).cast("float"),
    ]


def strike_of_dip_vector(u2, u3) -> Column:
    return range360(F.degrees(F.atan2(-_c(u3), _c(u2))))


def dip_of_dip_vector(u1) -> Column:
    return F.degrees(F.asin(_c(u1)))


def strike_of_strike_vector(v2, v3) -> Column:
    return range360(F.degrees(F.atan2(_c(v2), _c(v3))))


def strike_of_normal(w2, w3) -> Column:
    return range360(F.degrees(F.atan2(-_c(w3), _c(w2))))


def dip_of_normal(w1) -> Column:
    return F.degrees(F.acos(-_c(w1)))


def strike_dip_of_normal(u1, u2, u3) -> tuple[Column, Column]:
    """Strike and dip of a normal of either sense (a downward one is flipped)."""
    s = F.when(_c(u1) > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    strike = range360(F.degrees(F.atan2(-(_c(u3) * s), _c(u2) * s))).cast("float")
    dip = F.degrees(F.acos(-(_c(u1) * s))).cast("float")
    return strike, dip


def strike_dip_of_surface(normal, dip, strike, du_dv, du_dw) -> tuple[Column, Column]:
    """Orientation of a surface u(v, w) given in a local (normal, dip, strike) frame."""
    g = [_c(n) - _c(du_dv) * _c(d) - _c(du_dw) * _c(s) for n, d, s in zip(normal, dip, strike)]
    norm = F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2])
    w = [x / norm for x in g]
    s = F.when(w[0] > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    dip_angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -(w[0] * s)))))
    return range360(F.degrees(F.atan2(-(w[2] * s), w[1] * s))), dip_angle


def cross(u, v) -> list[Column]:
    """Cross product in the (x1, x2, x3) sign convention of the dip/strike frame."""
    u1, u2, u3 = map(_c, u)
    v1, v2, v3 = map(_c, v)
    return [u3 * v2 - u2 * v3, u1 * v3 - u3 * v1, u2 * v1 - u1 * v2]


def normal_vector_2d(angle) -> list[Column]:
    a = F.radians(_c(angle))
    return [F.sin(a).cast("float"), F.cos(a).cast("float")]


def strike_vector_2d(angle) -> list[Column]:
    a = F.radians(_c(angle))
    return [(-F.cos(a)).cast("float"), F.sin(a).cast("float")]


def feature_to_cell_angle(theta) -> Column:
    return F.pmod(180.0 - _c(theta), F.lit(180.0)).cast("float")


def periodic_error(actual, expected, period: float = 180.0) -> Column:
    """Smallest absolute difference of two angles with the given period."""
    half = period / 2.0
    return F.abs(F.pmod(_c(actual) - _c(expected) + half, F.lit(period)) - half)


def axial_normal_angle(a, b) -> Column:
    """Angle in degrees between two unit normals, sign ignored."""
    dot = sum((_c(x) * _c(y) for x, y in zip(a, b)), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot))))


def dominant_axis(strike, dip) -> Column:
    """0, 1 or 2 for the array axis (i3, i2, i1) the fault normal is most aligned with."""
    w1, w2, w3 = normal_vector(strike, dip)
    a3, a2, a1 = F.abs(w3), F.abs(w2), F.abs(w1)
    return F.when((a3 >= a2) & (a3 >= a1), 0).when(a2 >= a1, 1).otherwise(2)


def dip_shear(theta) -> Column:
    """Column form of :func:`ridgeline.functions.kernels.shear_of_dip`."""
    lean = F.greatest(F.lit(-STEEPEST_LEAN), F.least(F.lit(STEEPEST_LEAN), 90.0 - _c(theta)))
    return F.when(F.abs(F.sin(F.radians(lean))) <= UPRIGHT, F.lit(0.0)).otherwise(-F.tan(F.radians(lean))).cast("float")
