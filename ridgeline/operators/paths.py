"""Strain-limited dynamic programming over lag windows, batched over leading axes.

Small NumPy helpers used inside the voting tasks: every array is (batch..., step, lag)
and one call advances all seeds of a task together.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

_F = np.float32


def lag_bounds_2d(ru: int, rv: int) -> np.ndarray:
    """Admissible lags per step: 0 within two steps of the seed, then growing with distance."""
    v = np.abs(np.arange(-rv, rv + 1))
    return np.where(v > 2, np.minimum(v, ru), 0)


def lag_bounds_3d(ru: int, rv: int, rw: int) -> np.ndarray:
    w, v = np.mgrid[-rw : rw + 1, -rv : rv + 1]
    r = np.sqrt(w * w + v * v)
    return np.where(r > 2.0, np.minimum(np.floor(r + 0.5).astype(int), ru), 0)


def _sides(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same array seen from one lag to the left and to the right (ends repeat)."""
    return np.concatenate([a[..., :1], a[..., :-1]], -1), np.concatenate([a[..., 1:], a[..., -1:]], -1)


def accumulate(cost: np.ndarray, stride: int, forward: bool = True) -> np.ndarray:
    """Cumulative cost; a lag change of one is spread over ``stride`` steps."""
    c = cost if forward else cost[..., ::-1, :]
    acc = np.empty_like(c)
    acc[..., 0, :] = c[..., 0, :]
    for i in range(1, c.shape[-2]):
        j = max(i - stride, 0)
        minus, plus = _sides(acc[..., j, :])
        between = [_sides(c[..., k, :]) for k in range(i - 1, j, -1)]
        for lo, hi in between:
            minus = minus + lo
            plus = plus + hi
        acc[..., i, :] = np.minimum(np.minimum(minus, acc[..., i - 1, :]), plus) + c[..., i, :]
    return acc if forward else acc[..., ::-1, :]


def smooth_costs(cost: np.ndarray, stride: int) -> np.ndarray:
    """Cost of the best path through each (step, lag)."""
    return (accumulate(cost, stride) + accumulate(cost, stride, False) - cost).astype(_F)


def best_path(cost: np.ndarray, stride: int, first_lag: int) -> np.ndarray:
    """Lag per step of the cheapest path, traced back from the last step; (batch, step) in lags.

    Staying wins ties; a step to the side is spread evenly over ``stride`` samples.
    """
    b, n, m = cost.shape
    acc = accumulate(cost, stride)
    rows = np.arange(b)
    mid = min(max(-first_lag, 0), m - 1)
    end = acc[:, n - 1, :]
    lag = np.where(end.min(1) < end[:, mid], end.argmin(1), mid)
    at = np.full(b, n - 1)
    path = np.zeros((b, n), _F)
    path[rows, at] = lag + first_lag
    while (at > 0).any():
        live = np.flatnonzero(at > 0)
        i, l = at[live], lag[live]
        prev, far = i - 1, np.maximum(i - stride, 0)
        left, right = np.maximum(l - 1, 0), np.minimum(l + 1, m - 1)
        stay = acc[live, prev, l]
        minus, plus = acc[live, far, left].copy(), acc[live, far, right].copy()
        for k in range(stride - 1):
            step = prev - k
            on = step > far
            minus[on] += cost[live[on], step[on], left[on]]
            plus[on] += cost[live[on], step[on], right[on]]
        side = np.minimum(minus, plus) < stay
        new = np.where(side, np.where(minus <= plus, left, right), l)
        changed = new != l
        here = path[live, i]
        du = np.where(changed, (new + first_lag - here) / _F(stride), 0).astype(_F)
        path[live, prev] = np.where(changed, here + du, new + first_lag)
        for k in range(stride - 1):
            step = prev - 1 - k
            on = changed & (step >= far)
            path[live[on], step[on]] = path[live[on], step[on] + 1] + du[on]
        lag[live] = new
        at[live] = np.where(changed, far, prev)
    return path


def gaussian_matrix(n: int, sigma: float) -> np.ndarray:
    """Row i holds the weights that smooth a line of n samples at i, nearest edges."""
    from ridgeline.functions.kernels import gaussian_weights

    w = gaussian_weights(sigma)
    r = len(w) // 2
    out = np.zeros((n, n))
    for i in range(n):
        np.add.at(out[i], np.clip(np.arange(i - r, i + r + 1), 0, n - 1), w)
    return out


def find_paths(cost: np.ndarray, stride: int, first_lag: int, passes: int, path_sigma: float) -> np.ndarray:
    """(batch, step, lag) costs -> smoothed lag paths."""
    for _ in range(passes):
        cost = smooth_costs(cost, stride)
    p = best_path(cost, stride, first_lag)
    if path_sigma > 0:
        p = (p @ gaussian_matrix(p.shape[1], path_sigma * stride).T).astype(_F)
    return p


def find_surfaces(
    cost: np.ndarray, stride1: int, stride2: int, first_lag: int, passes: int, sigma1: float, sigma2: float
) -> np.ndarray:
    """(batch, w, v, lag) costs -> lag surfaces (batch, w, v)."""
    for _ in range(passes):
        cost = smooth_costs(cost, stride1)
        cost = np.ascontiguousarray(smooth_costs(cost.transpose(0, 2, 1, 3), stride2).transpose(0, 2, 1, 3))
    b, nw, nv, m = cost.shape
    s = best_path(cost.reshape(b * nw, nv, m), stride1, first_lag).reshape(b, nw, nv)
    if sigma2 > 0:
        s = np.einsum("ij,bjk->bik", gaussian_matrix(nw, sigma2), s).astype(_F)
    if sigma1 > 0:
        s = np.einsum("ij,bkj->bki", gaussian_matrix(nv, sigma1), s).astype(_F)
    return s


def center_slopes(surface: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """du/dv and du/dw at the middle of each (smoothed) surface."""
    nw, nv = surface.shape[1:]
    iw, iv = nw // 2, nv // 2
    mw = gaussian_matrix(nw, sigma) if sigma > 0 else np.eye(nw)
    mv = gaussian_matrix(nv, sigma) if sigma > 0 else np.eye(nv)
    patch = np.einsum("ij,bjk->bik", mw[iw - 1 : iw + 2], surface).astype(_F)
    patch = np.einsum("ij,bkj->bki", mv[iv - 1 : iv + 2], patch).astype(_F)
    return 0.5 * (patch[:, 1, 2] - patch[:, 1, 0]), 0.5 * (patch[:, 2, 1] - patch[:, 0, 1])


def line_paths(df: DataFrame, key: str, col: str, ru: int, rv: int, stride: int = 1, passes: int = 1, sigma: float = 0.0, barrier: float = 1000.0) -> DataFrame:
    """Cheapest lag paths of independent cost lines, one row each.

    ``col`` holds the costs of (2*rv+1) steps by (2*ru+1) lags, step after step.  Lags outside the
    window of their step cost ``barrier``.  Adds flat arrays ``cost``, ``forward``, ``backward``
    (cumulative), ``smoothed`` (after ``passes``), and ``path`` (lag per step, smoothed by ``sigma``).
    """
    import pyarrow as pa

    steps, lags = 2 * rv + 1, 2 * ru + 1
    out = ("cost", "forward", "backward", "smoothed", "path")

    def run(batches):
        outside = np.abs(np.arange(-ru, ru + 1))[None, :] > lag_bounds_2d(ru, rv)[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            cost = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(_F).reshape(-1, steps, lags)
            cost = np.where(outside[None], _F(barrier), cost)
            smoothed = cost
            for _ in range(passes):
                smoothed = smooth_costs(smoothed, stride)
            path = find_paths(cost, stride, -ru, passes, sigma)
            arrays = (cost, accumulate(cost, stride), accumulate(cost, stride, False), smoothed, path)
            flat = [pa.array(list(a.reshape(len(a), -1).astype(_F)), pa.list_(pa.float32())) for a in arrays]
            yield pa.RecordBatch.from_arrays([batch.column(0), *flat], ["_key", *out])

    kind = df.schema[key].dataType.simpleString()
    rows = df.selectExpr(f"`{key}` AS _key", f"`{col}` AS _cost").mapInArrow(run, f"_key {kind}, " + ", ".join(f"{n} array<float>" for n in out))
    return rows.withColumnRenamed("_key", key)
