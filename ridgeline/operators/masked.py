"""Optimal paths and surfaces over a mask of lag states.

A state outside the mask costs infinitely much, and a path that moves to a neighbouring lag must stay in
the mask on all samples in between.  Everything is batched: the first axis counts lines or seeds.
Surfaces that break the strain are brought back by bounds that travel over the grid (a
Lipschitz envelope in the strain metric), never by repeated local repair.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np

from ridgeline.operators.paths import gaussian_matrix

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

_F = np.float32
_INF = _F(np.inf)
_SLACK = _F(1e-6)
#: Fixed value: branches looked at for one surface at most, where columns have several separate runs of lags.
_BRANCHES = 512


def _moves(m: int, stride: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For a step to the lag below and above: the target lags, and the lags passed after 1 .. stride samples."""
    here, out = np.arange(m), []
    for side in (-1, 1):
        to = np.clip(here + side, 0, m - 1)
        lag, step, passed = here.astype(_F), ((to - here) * _F(1.0 / stride)).astype(_F), []
        for _ in range(stride):
            lag = (lag + step).astype(_F)
            passed.append(np.floor(lag.astype(np.float64) + 0.5).astype(np.int64))
        out.append((to, passed))
    return out


def _fenced(cost: np.ndarray, valid: np.ndarray) -> np.ndarray:
    return np.where(valid & np.isfinite(cost), cost, _INF).astype(_F)


def accumulate(cost: np.ndarray, valid: np.ndarray, stride: int, forward: bool = True) -> np.ndarray:
    """Cumulative cost of (line, step, lag); infinite where no path inside the mask leads."""
    if not forward:
        return accumulate(cost[:, ::-1], valid[:, ::-1], stride)[:, ::-1]
    c, moves = _fenced(cost, valid), _moves(cost.shape[2], stride)
    acc = np.full_like(c, _INF)
    acc[:, 0] = c[:, 0]
    for i in range(1, c.shape[1]):
        j = max(i - stride, 0)
        best = acc[:, i - 1]
        sides = []
        for to, passed in moves:
            via = acc[:, j, to]
            for k in range(i - 1, j, -1):
                via = via + c[:, k, to]
            free = np.ones(via.shape, bool)
            for k, lags in zip(range(i - 1, j - 1, -1), passed):
                free &= valid[:, k, lags]
            sides.append(np.where(free, via, _INF))
        acc[:, i] = np.minimum(np.minimum(sides[0], best), sides[1]) + c[:, i]
    return acc


def smooth_costs(cost: np.ndarray, valid: np.ndarray, stride: int) -> np.ndarray:
    """Cost of the best masked path through each (step, lag)."""
    fore, back = accumulate(cost, valid, stride), accumulate(cost, valid, stride, False)
    open_ = valid & np.isfinite(cost) & np.isfinite(fore) & np.isfinite(back)
    with np.errstate(invalid="ignore"):
        return np.where(open_, fore + back - cost, _INF).astype(_F)


def cells_of(lags: np.ndarray, first_lag: int) -> np.ndarray:
    """Index of the lag cell a value rounds to."""
    return np.floor((lags - _F(first_lag)).astype(np.float64) + 0.5).astype(np.int64)


def _inside(lags: np.ndarray, valid: np.ndarray, first_lag: int) -> np.ndarray:
    """Whether each value rounds into the mask (last axis of ``valid`` is the lag)."""
    k = cells_of(lags, first_lag)
    ok = (k >= 0) & (k < valid.shape[-1])
    return ok & np.take_along_axis(valid, np.clip(k, 0, valid.shape[-1] - 1)[..., None], -1)[..., 0]


def best_path(cost: np.ndarray, valid: np.ndarray, stride: int, first_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag per step, whether a path exists) of the cheapest masked path of each line, traced back from the last step.

    Staying wins ties, then the lower lag; a change of lag is spread evenly over ``stride`` samples.
    """
    c, acc, moves = _fenced(cost, valid), accumulate(cost, valid, stride), _moves(cost.shape[2], stride)
    b, n, m = c.shape
    end, mid = acc[:, n - 1], min(max(-first_lag, 0), m - 1)
    lag = np.where(end.min(1) < end[:, mid], end.argmin(1), mid)
    found = np.isfinite(end[np.arange(b), lag])
    path = np.zeros((b, n), _F)
    at = np.where(found, n - 1, 0)
    path[np.arange(b), n - 1] = lag + first_lag
    while (live := np.flatnonzero(at > 0)).size:
        i, l = at[live], lag[live]
        far = np.maximum(i - stride, 0)
        stay = acc[live, i - 1, l]
        options = []
        for to, passed in moves:
            t = to[l]
            via, free = acc[live, far, t].copy(), np.ones(len(live), bool)
            for k in range(stride):
                s = i - 1 - k
                on = s >= far
                free[on] &= valid[live[on], s[on], passed[k][l[on]]]
                on = s > far
                via[on] = via[on] + c[live[on], s[on], t[on]]
            options.append((np.where(free, via, _INF), t))
        (low, l_low), (high, l_high) = options
        best = np.minimum(np.minimum(low, high), stay)
        new = np.where(best == stay, l, np.where(best == low, l_low, l_high))
        stuck = ~np.isfinite(best)
        found[live[stuck]] = False
        moved = (new != l) & ~stuck
        here = path[live, i]
        du = np.where(moved, (new + first_lag - here) * _F(1.0 / stride), 0).astype(_F)
        path[live, i - 1] = np.where(moved, here + du, new + first_lag)
        for k in range(1, stride):
            s = i - 1 - k
            on = moved & (s >= far)
            path[live[on], s[on]] = path[live[on], s[on] + 1] + du[on]
        lag[live] = new
        at[live] = np.where(stuck, 0, np.where(moved, far, i - 1))
    return path, found & _inside(path, valid, first_lag).all(1)


def respects(surface: np.ndarray, valid: np.ndarray, stride1: int, stride2: int, first_lag: int) -> np.ndarray:
    """Per seed: finite, inside the mask, and within both strains."""
    good = np.isfinite(surface).all((1, 2)) & (surface >= first_lag).all((1, 2)) & (surface <= first_lag + valid.shape[-1] - 1).all((1, 2))
    out = good & _inside(np.where(np.isfinite(surface), surface, first_lag), valid, first_lag).all((1, 2))
    for axis, stride in ((2, stride1), (1, stride2)):
        step = np.abs(np.diff(surface, axis=axis))
        out &= ~(step > _F(1.0 / stride) + _SLACK).any((1, 2))
    return out


def _cell_bounds(m: int, first_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest float32 value of each lag cell (the outer halves of the end cells are cut off)."""
    lag = (first_lag + np.arange(m)).astype(_F)
    low, high = lag - _F(0.5), np.nextafter(lag + _F(0.5), -_INF)
    low[0], high[-1] = lag[0], lag[-1]
    return low, high


def project(surface: np.ndarray, valid: np.ndarray, first_lag: int) -> np.ndarray:
    """Each value moved to the nearest value of a valid cell; values in one stay, ties go to the lower lag."""
    low, high = _cell_bounds(valid.shape[-1], first_lag)
    x = surface[..., None]
    edge = (first_lag + np.arange(valid.shape[-1])).astype(_F) + _F(0.5)
    edge[-1] = high[-1]
    far = np.where(x < low, low.astype(np.float64) - x, np.where(x > high, x - edge.astype(np.float64), 0.0))
    k = np.where(valid, far, np.inf).argmin(-1)
    return np.clip(surface, low[k], high[k]).astype(_F)


def _envelope(bound: np.ndarray, strain1: float, strain2: float) -> np.ndarray:
    """Least surface above ``bound`` that changes by no more than the strains from sample to sample (w, v)."""
    out = bound.copy()
    for axis, strain in ((1, strain1), (0, strain2)):
        line = np.moveaxis(out, axis, 0)
        for k in range(1, len(line)):
            line[k] = np.maximum(line[k], line[k - 1] - strain)
        for k in range(len(line) - 2, -1, -1):
            line[k] = np.maximum(line[k], line[k + 1] - strain)
    return out


def _runs(column: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of valid lags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], column.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]


def recover(target: np.ndarray, valid: np.ndarray, stride1: int, stride2: int, first_lag: int) -> np.ndarray | None:
    """A surface (w, v) inside the mask and both strains, near ``target``; None where none was found.

    Every column starts with the interval of its valid cells; the strains tighten all intervals at
    once.  A column with several separate runs of lags tries them from the nearest on.
    """
    low_cell, high_cell = _cell_bounds(valid.shape[-1], first_lag)
    low_cell, high_cell = low_cell.astype(np.float64), high_cell.astype(np.float64)
    runs = {at: _runs(valid[at]) for at in np.ndindex(*target.shape)}
    if not all(runs.values()):
        return None
    left = [_BRANCHES]

    def tightened(low, high):
        low, high = _envelope(low, 1 / stride1, 1 / stride2), -_envelope(-high, 1 / stride1, 1 / stride2)
        return None if (low > high).any() else (low, high)

    def settle(low, high):
        width = high - low
        total = float((width * width).sum())
        share = min(max(float(((target - low) * width).sum()) / total, 0.0), 1.0) if total > 0 else 0.0
        for s in (low + share * width, low, high, 0.5 * (low + high)):
            if respects(s.astype(_F)[None], valid[None], stride1, stride2, first_lag)[0]:
                return s.astype(_F)
        return None

    def search(options):
        if left[0] <= 0:
            return None
        left[0] -= 1
        low = np.array([low_cell[options[at][0][0]] for at in runs]).reshape(target.shape)
        high = np.array([high_cell[options[at][-1][1]] for at in runs]).reshape(target.shape)
        while True:
            both = tightened(low, high)
            if both is None:
                return None
            fitting = {at: [r for r in options[at] if high_cell[r[1]] >= both[0][at] and low_cell[r[0]] <= both[1][at]] for at in runs}
            if not all(fitting.values()):
                return None
            low = np.maximum(both[0], np.array([low_cell[fitting[at][0][0]] for at in runs]).reshape(target.shape))
            high = np.minimum(both[1], np.array([high_cell[fitting[at][-1][1]] for at in runs]).reshape(target.shape))
            if fitting == options:
                break
            options = fitting
        several = [at for at in runs if len(options[at]) > 1]
        if not several:
            both = tightened(low, high)
            return None if both is None else settle(*both)
        at = min(several, key=lambda a: len(options[a]))
        x = float(target[at])
        for r in sorted(options[at], key=lambda r: (max(low_cell[r[0]] - x, x - high_cell[r[1]], 0.0), r[0])):
            if (got := search({**options, at: [r]})) is not None:
                return got
        return None

    return search(runs)


def find_surfaces(
    cost: np.ndarray, valid: np.ndarray, stride1: int, stride2: int, first_lag: int, passes: int, sigma1: float, sigma2: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, w, v, lag) costs and mask -> lag surfaces, whether each is feasible, and columns that smoothing left to be moved."""
    b, nw, nv, m = cost.shape
    lines = lambda a: a.reshape(b * nw, nv, m)
    across = lambda a: np.ascontiguousarray(a.transpose(0, 2, 1, 3)).reshape(b * nv, nw, m)
    smoothed = cost.astype(_F)
    for _ in range(passes):
        smoothed = smooth_costs(lines(smoothed), lines(valid), stride1).reshape(cost.shape)
        smoothed = smooth_costs(across(smoothed), across(valid), stride2).reshape(b, nv, nw, m).transpose(0, 2, 1, 3)
    usable = valid & np.isfinite(smoothed)
    ok = usable.any(-1).all((1, 2))
    path, found = best_path(lines(smoothed), lines(usable), stride1, first_lag)
    whole = found.reshape(b, nw).all(1)
    cheapest = np.where(usable, smoothed, _INF).argmin(-1) + _F(first_lag)
    surface = np.where(whole[:, None, None], path.reshape(b, nw, nv), cheapest).astype(_F)

    def mended(surface: np.ndarray, target: np.ndarray) -> np.ndarray:
        for k in np.flatnonzero(ok & ~respects(surface, usable, stride1, stride2, first_lag)):
            got = recover(target[k], usable[k], stride1, stride2, first_lag)
            ok[k] = got is not None
            surface[k] = got if got is not None else first_lag
        return surface

    surface = mended(surface, surface.copy())
    moved = np.zeros(b, np.int64)
    if sigma1 > 0 or sigma2 > 0:
        raw = surface
        if sigma2 > 0:
            raw = np.einsum("ij,bjk->bik", gaussian_matrix(nw, sigma2), raw).astype(_F)
        if sigma1 > 0:
            raw = np.einsum("ij,bkj->bki", gaussian_matrix(nv, sigma1), raw).astype(_F)
        surface = mended(np.where(ok[:, None, None], project(raw, usable, first_lag), surface), raw)
        moved = np.where(ok, (surface != raw).sum((1, 2)), 0)
    return surface, ok, moved


def origin_rectangle(supported: np.ndarray, w0: int, v0: int) -> tuple[int, int, int, int] | None:
    """(w start, v start, w stop, v stop) of the largest all-supported rectangle around the origin.

    Equal areas go to the more symmetric one, then to the smaller starts and stops.
    """
    if not supported[w0, v0]:
        return None
    best, nw = None, len(supported)
    up = np.minimum.accumulate(supported[w0::-1], axis=0)  # row k: whether rows w0-k .. w0 all support
    down = np.minimum.accumulate(supported[w0:], axis=0)
    for a in range(w0 + 1):
        for z in range(nw - w0):
            row = up[a] & down[z]
            if not row[v0]:
                break
            left, right = np.flatnonzero(~row[: v0 + 1]), np.flatnonzero(~row[v0:])
            lo, hi = (int(left[-1]) + 1 if len(left) else 0), (v0 + int(right[0]) if len(right) else len(row))
            key = (-(a + z + 1) * (hi - lo), abs(a - z) + abs((v0 - lo) - (hi - 1 - v0)), w0 - a, lo, w0 + z + 1, hi)
            best = key if best is None else min(best, key)
    return best[2:]


def line_paths(df: DataFrame, key: str, cost: str, valid: str, ru: int, rv: int, stride: int = 1, passes: int = 1) -> DataFrame:
    """Cheapest paths of independent cost lines inside a mask of lags, one row each.

    ``cost`` and ``valid`` hold (2*rv+1) steps by (2*ru+1) lags, step after step; lags outside the window of
    their step are never valid.  Adds flat arrays ``forward`` and ``backward`` (cumulative) and ``smoothed``
    (after ``passes``), null where no path leads, and ``path`` (lag per step), null where there is none.
    """
    import pyarrow as pa

    from ridgeline.operators.paths import lag_bounds_2d

    steps, lags = 2 * rv + 1, 2 * ru + 1

    def listed(a: np.ndarray) -> pa.Array:
        flat = a.reshape(-1).astype(_F)
        offsets = np.arange(0, flat.size + 1, flat.size // len(a), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=~np.isfinite(flat)))

    def run(batches):
        window = np.abs(np.arange(-ru, ru + 1))[None, :] <= lag_bounds_2d(ru, rv)[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.array(batch.column(1).to_pylist(), _F).reshape(-1, steps, lags)
            ok = np.array(batch.column(2).to_pylist(), bool).reshape(-1, steps, lags) & window[None]
            smoothed = c
            for _ in range(passes):
                smoothed = smooth_costs(smoothed, ok, stride)
            path, found = best_path(smoothed, ok & np.isfinite(smoothed), stride, -ru)
            lines = pa.array([p if f else None for p, f in zip(path.tolist(), found, strict=True)], pa.list_(pa.float32()))
            arrays = [listed(a) for a in (accumulate(c, ok, stride), accumulate(c, ok, stride, False), np.where(ok, smoothed, _INF))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, lines], ["_key", "forward", "backward", "smoothed", "path"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.selectExpr(f"`{key}` AS _key", f"`{cost}` AS _cost", f"`{valid}` AS _valid").mapInArrow(
        run, f"_key {kind}, " + ", ".join(f"{n} array<float>" for n in ("forward", "backward", "smoothed", "path"))
    )
    return rows.withColumnRenamed("_key", key)
