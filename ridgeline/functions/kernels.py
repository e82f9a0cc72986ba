"""Stencil weights, computed on the driver as short literal lists."""

from __future__ import annotations

import math

import numpy as np


def gaussian_weights(sigma: float, order: int = 0, truncate: float = 4.0) -> list[float]:
    """Weights for offsets -r..r, r = int(truncate*sigma + 0.5); order 0, 1 or 2."""
    radius = int(truncate * sigma + 0.5)
    k = np.arange(-radius, radius + 1, dtype=np.float64)
    phi = np.exp(-0.5 * (k / sigma) ** 2)
    phi /= phi.sum()
    if order == 0:
        w = phi
    elif order == 1:
        w = phi * k / sigma**2
    elif order == 2:
        w = phi * (k * k / sigma**4 - 1.0 / sigma**2)
    else:
        raise ValueError("order must be 0, 1 or 2")
    return [float(x) for x in w]


def angle_samples(lo: float, hi: float, sigma: float) -> list[float]:
    """Evenly spaced angles whose step follows from the smoothing scale."""
    if hi < lo:
        raise ValueError("upper angle below lower angle")
    if lo == hi:
        return [float(np.float32(lo))]
    count = max(2, int(1 + (hi - lo) / math.degrees(0.5 / sigma)))
    return [float(x) for x in np.linspace(lo, hi, count, dtype=np.float32)]


def strike_samples(lo: float, hi: float) -> list[float]:
    """Multiples of 20 degrees in [0, 340] inside the range; the lower bound if none is."""
    if lo == hi:
        return [float(lo)]
    inside = [20.0 * k for k in range(18) if lo <= 20.0 * k <= hi]
    return inside or [float(lo)]


def dip_samples(lo: float, hi: float) -> list[float]:
    """About 5 degrees apart, both bounds included."""
    if lo == hi:
        return [float(lo)]
    count = max(2, int(round((hi - lo) / 5.0)) + 1)
    return [float(x) for x in np.linspace(lo, hi, count, dtype=np.float32)]


def refine_samples(samples: list[float], factor: int) -> list[float]:
    """Insert factor-1 evenly spaced angles between neighbours."""
    if factor == 1 or len(samples) < 2:
        return list(samples)
    out = set(np.float32(samples).tolist())
    for a, b in zip(np.float32(samples[:-1]), np.float32(samples[1:])):
        for j in range(1, factor):
            out.add(float(np.float32(a + np.float32(j) / np.float32(factor) * (b - a))))
    return sorted(out)


# A cosine below the first is upright, and the steepest shear.
UPRIGHT, STEEPEST = 1e-6, 1e4
STEEPEST_LEAN = math.degrees(math.atan(STEEPEST))


def shear_of_dip(theta: float) -> float:
    """Shear that makes planes of a dip in [0, 180] vertical: minus the cotangent, clamped where the sine vanishes."""
    lean = min(max(90.0 - theta, -STEEPEST_LEAN), STEEPEST_LEAN)
    return 0.0 if abs(math.sin(math.radians(lean))) <= UPRIGHT else -math.tan(math.radians(lean))
