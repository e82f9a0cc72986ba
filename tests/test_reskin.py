import math

import numpy as np
from helpers import gauss_axis

from ridgeline.functions.kernels import gaussian_weights
from ridgeline.operators.reskin import reskin
from ridgeline.operators.topology import link_topology


def frame(p, t):
    p, t = math.radians(p), math.radians(t)
    f32 = lambda *x: np.float32(x).astype(float)
    n = f32(-math.cos(t), math.sin(t) * math.cos(p), -math.sin(t) * math.sin(p))
    d = f32(math.sin(t), math.cos(t) * math.cos(p), -math.cos(t) * math.sin(p))
    return n, d, f32(0.0, math.sin(p), math.cos(p))


def test_reskin_equals_dense_smoothing(spark):
    rng = np.random.default_rng(3)
    n, d, s = frame(30.0, 70.0)
    rows = []
    for k, (v, w) in enumerate((v, w) for v in range(-3, 4) for w in range(-2, 3) if rng.random() < 0.8 or (v, w) == (0, 0)):
        u = 0.4 * rng.standard_normal() if (v, w) != (0, 0) else 0.0
        x = np.float32(np.array([20.0, 20.0, 20.0]) + u * n + v * d + w * s)
        fl = 0.99 if (v, w) == (0, 0) else 0.2 + 0.5 * rng.random()
        rows.append((1, k, *map(float, x), float(np.float32(fl)), 30.0, 70.0))
    df = spark.createDataFrame(rows, "skin_id int, cell_id long, x1 float, x2 float, x3 float, fl float, fp float, ft float")
    got = {r["cell_id"]: r for r in reskin(df).collect()}

    best = max(rows, key=lambda r: r[5])
    entries = {}
    for r in rows:
        off = np.array(r[2:5]) - np.array(best[2:5])
        key = math.floor(off @ d + 0.5), math.floor(off @ s + 0.5)
        if key not in entries or r[5] > entries[key][1]:
            entries[key] = (off @ n, r[5], r[1])
    v0, w0 = min(k[0] for k in entries), min(k[1] for k in entries)
    shape = max(k[0] for k in entries) - v0 + 1, max(k[1] for k in entries) - w0 + 1
    z, q = np.zeros(shape), np.zeros(shape)
    for (v, w), (u, fl, _) in entries.items():
        z[v - v0, w - w0], q[v - v0, w - w0] = u, fl
    g = gaussian_weights(1.0)
    smooth = lambda a: gauss_axis(gauss_axis(a, g, 0), g, 1)
    want = smooth(z * q) / smooth(q)
    assert set(got) == {e[2] for e in entries.values()}
    for (v, w), (_, _, cell) in entries.items():
        pos = np.array(best[2:5]) + want[v - v0, w - w0] * n + v * d + w * s
        assert np.allclose([got[cell][c] for c in ("x1", "x2", "x3")], pos, atol=1e-4)
        dv, dw = (np.gradient(want, axis=a)[v - v0, w - w0] for a in (0, 1))
        m = n - dv * d - dw * s
        m = m / np.linalg.norm(m) * (-1 if m[0] > 0 else 1)
        assert abs(got[cell]["ft"] - math.degrees(math.acos(-m[0]))) < 1e-2


def test_reskinned_links_are_reciprocal_and_single_cells_stay(spark):
    rows = [(1, k, 10.0 + (k % 3), 10.0, 10.0 + k // 3, 0.5 + k / 100, 0.0, 90.0) for k in range(9)] + [(2, 100, 1.0, 2.0, 3.0, 0.5, 10.0, 80.0)]
    df = spark.createDataFrame(rows, "skin_id int, cell_id long, x1 float, x2 float, x3 float, fl float, fp float, ft float")
    out = reskin(df).cache()
    one = out.where("skin_id = 2").first()
    assert (one["x1"], one["fp"], one["generation"]) == (1.0, 10.0, "grown")
    t = link_topology(out).first()
    assert (t["reciprocal_link_violation_count"], t["quad_closure_match_count"]) == (0, 4)
