import numpy as np
import pytest
from helpers import XYZ, gauss_axis, greedy, to_array, traces, voxels
from pyspark.sql import functions as F

from ridgeline.functions.kernels import angle_samples, dip_samples, gaussian_weights, refine_samples, strike_samples
from ridgeline.grid import Tiling, shape_of, to_traces, to_voxels, with_halo
from ridgeline.operators import components, edges, seeds, stencil, thinning
from ridgeline.operators.distance import nearest_distance
from ridgeline.operators.masks import top_k_mask
from ridgeline.operators.quantiles import grouped_quantiles

SMALL = Tiling(4, 3)


def test_halo_copies_every_row_once_as_core(spark):
    a = np.zeros((9, 7, 2), np.float32)
    h = with_halo(traces(spark, v=a), 2, 1, SMALL)
    assert h.where("_core").count() == 63
    assert h.count() > 63


def test_layouts_round_trip(spark):
    a = np.random.default_rng(1).random((3, 4, 5)).astype(np.float32)
    back = to_traces(to_voxels(traces(spark, v=a), ["v"]), ["v"])
    assert np.array_equal(to_array(back, "v", a.shape), a)
    assert tuple(shape_of(back).first()) == (3, 4, 5)


@pytest.mark.parametrize("tiling", [SMALL, Tiling(64, 64)])
def test_smoothing_is_independent_of_tiles(spark, tiling):
    a = np.random.default_rng(2).random((11, 10, 9)).astype(np.float32)
    want = a
    for axis in range(3):
        want = gauss_axis(want, gaussian_weights(1.0), axis)
    got = to_array(stencil.smooth(traces(spark, v=a), "v", "s", 1.0, tiling), "s", a.shape)
    assert np.allclose(got, want, atol=2e-6)


def test_derivative_of_a_ramp(spark):
    a = np.tile(np.arange(20, dtype=np.float32) * 0.5, (6, 6, 1))
    d = to_array(stencil.gaussian_derivatives(traces(spark, v=a), "v", 1.0, tiling=SMALL), "d1", a.shape)
    assert np.allclose(d[:, :, 6:14], 0.5, atol=1e-3)


def test_samplings():
    assert strike_samples(0, 340) == [20.0 * k for k in range(18)]
    assert len(refine_samples(strike_samples(0, 340), 2)) == 35
    assert len(refine_samples(dip_samples(65, 80), 2)) == 7
    assert angle_samples(30, 30, 4.0) == [30.0]


def test_binned_maxima_along_a_plane(spark):
    a = np.zeros((7, 9, 3), np.float32)
    a[:, 4] = 1.0
    strike = np.zeros_like(a)
    got = thinning.thin_reference(traces(spark, v=a, s=strike), "v", "s", sigma=0.0, tiling=SMALL)
    assert np.array_equal(to_array(got, "thin", a.shape), a)


def test_plateau_keeps_the_middle_of_a_run(spark):
    cells = spark.createDataFrame([(0, k, 0, 1.0, 1) for k in (2, 3, 4, 5, 9)], "i3 int, i2 int, i1 int, v float, axis int")
    kept = {r["i2"] for r in thinning.collapse_runs(cells, "axis", "v").collect()}
    assert kept == {3, 9}


def test_plateau_runs_cross_tiles(spark):
    cells = spark.createDataFrame([(0, k, 0, 1.0 if k != 70 else 2.0, 1) for k in range(50, 90)], "i3 int, i2 int, i1 int, v float, axis int")
    assert [r["i2"] for r in thinning.collapse_runs(cells, "axis", "v").collect()] == [70]


@pytest.mark.parametrize("d", [1, 2, 4])
@pytest.mark.parametrize("late", [True, False])
def test_seeds_equal_sequential_greedy(spark, d, late):
    rng = np.random.default_rng(10 * d + late)
    score = np.round(rng.random((12, 11, 10)), 1).astype(np.float32)
    keep = rng.random(score.shape) < 0.4
    flat = np.arange(score.size).reshape(score.shape)
    rows = [(*map(int, i), int(flat[tuple(i)]), float(score[tuple(i)])) for i in np.argwhere(keep)]
    df = spark.createDataFrame(rows, "i3 int, i2 int, i1 int, flat long, score float")
    got = {tuple(r) for r in seeds.pick_seeds(df, d, late, SMALL).select(*XYZ).collect()}
    assert got == greedy(score, keep, d, late)


def test_boundary_seeds_use_the_second_score(spark):
    rng = np.random.default_rng(5)
    ft = rng.random((6, 6, 6)).astype(np.float32)
    target = np.round(rng.random(ft.shape), 1).astype(np.float32)
    df = voxels(spark, ft=ft, pt=ft, tt=ft, target=target).withColumns({n: F.lit(6) for n in ("n3", "n2", "n1")})
    df = df.withColumn("flat", (F.col("i3") * 36 + F.col("i2") * 6 + F.col("i1")).cast("bigint"))
    out = seeds.retain_boundary_seeds(df, 2, 0.7, 2, SMALL)
    base = greedy(ft, ft > np.float32(0.7), 2, True)
    i = np.indices(ft.shape)
    shell = np.minimum(i, 5 - i).min(0) < 2
    pool = shell & (target > 1e-6) & (ft > min(0.7, 0.5 * float(ft[shell].max())))
    for p in base:
        pool[p] = False
    got = {(tuple(r[c] for c in XYZ), r["added"]) for r in out.collect()}
    assert got == {(p, False) for p in base} | {(p, True) for p in greedy(target, pool, 2, False, ft)}


@pytest.mark.parametrize("connectivity,steps", [("face", 1), ("edge", 2), ("corner", 3)])
def test_components_equal_flood_fill(spark, connectivity, steps):
    mask = np.random.default_rng(7).random((7, 8, 40)) < 0.25
    label = -np.ones(mask.shape, int)
    flat = np.arange(mask.size).reshape(mask.shape)
    offs = [o for o in np.ndindex(3, 3, 3) if 0 < sum(abs(x - 1) for x in o) <= steps]
    for start in map(tuple, np.argwhere(mask)):
        if label[start] >= 0:
            continue
        label[start], todo = flat[start], [start]
        while todo:
            p = todo.pop()
            for o in offs:
                q = tuple(a + b - 1 for a, b in zip(p, o))
                if all(0 <= a < n for a, n in zip(q, mask.shape)) and mask[q] and label[q] < 0:
                    label[q] = flat[start]
                    todo.append(q)
    rows = [(*map(int, i), int(flat[tuple(i)])) for i in np.argwhere(mask)]
    df = spark.createDataFrame(rows, "i3 int, i2 int, i1 int, flat long")
    got = components.connected_components(df, connectivity).collect()
    assert len(got) == len(rows)
    assert all(label[r["i3"], r["i2"], r["i1"]] == r["component"] for r in got)


def test_nearest_distance_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    shape = (9, 12, 40)
    p = np.argwhere(rng.random(shape) < 0.05)
    t = np.argwhere(rng.random(shape) < 0.01)
    mk = lambda a: spark.createDataFrame([tuple(map(int, x)) for x in a], "i3 int, i2 int, i1 int")
    got = {tuple(r[c] for c in XYZ): r["d2"] for r in nearest_distance(mk(p), mk(t), 12, chunk=16).collect()}
    want = {tuple(map(int, x)): int(((t - x) ** 2).sum(1).min()) for x in p}
    assert got == want


def test_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=500), np.zeros(700), -rng.random(50) * 1e-9])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 3.0)], "k string, v double")
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", {"q1": 0.25, "q5": 0.5, "q9": 0.95}).collect()}
    assert np.allclose([got["a"][c] for c in ("q1", "q5", "q9")], np.quantile(x, [0.25, 0.5, 0.95]), atol=1e-15)
    assert got["b"]["q5"] == 3.0


@pytest.mark.parametrize("k", [0, 1, 7, 100, 500])
def test_top_k_cuts_ties_by_flat_index(spark, k):
    v = np.round(np.random.default_rng(3).random(100), 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "flat long, v double")
    got = {r["flat"] for r in top_k_mask(df, "v", k).where("mask").collect()}
    assert got == set(np.lexsort((np.arange(100), -v))[:k].tolist())


def test_recenter_moves_only_to_a_stronger_target(spark):
    cells = spark.createDataFrame(
        [(5, 1, 5, 11, 11, 11, 1.0, 0.0, 90.0), (5, 5, 5, 11, 11, 11, 1.0, 0.0, 90.0)],
        "i3 int, i2 int, i1 int, n3 int, n2 int, n1 int, fvt float, vp float, vt float",
    )
    t = np.zeros((11, 11, 11), np.float32)
    t[5, 3, 5], t[5, 7, 5] = 0.5, 0.9
    got = {tuple(r[c] for c in XYZ) for r in edges.recenter(cells, voxels(spark, target=t), 2).collect()}
    assert got == {(5, 3, 5), (5, 5, 5)}


def test_edge_lines_take_the_better_candidate(spark):
    shape = (6, 9, 6)
    z = np.zeros(shape, np.float32)
    fvt, fv, vt, target = z.copy(), z.copy(), z + 90, z.copy()
    fvt[3, 0, 3], fv[3, 0, 3], fv[3, 1, 3] = 0.4, 0.4, 0.7
    target[3, 0, 3], target[3, 1, 3] = 0.2, 0.8
    cells = voxels(spark, fvt=fvt, fv=fv, vp=z, vt=vt, target=target).withColumns({"n3": F.lit(6), "n2": F.lit(9), "n1": F.lit(6)})
    plateau = spark.createDataFrame([(3, 1, 3)], "i3 int, i2 int, i1 int")
    got = {(r["i3"], r["i2"], r["i1"], round(r["fvt"], 3)) for r in edges.thin_edge_lines(cells, plateau, 2).collect()}
    assert got == {(3, 1, 3, 0.7)}


def test_quantiles_refuse_what_is_not_finite(spark):
    from ridgeline.operators.quantiles import grouped_quantiles

    ok = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "v double")
    assert grouped_quantiles(ok, [], "v", {"m": 0.5}).first()["m"] == 2.0
    for bad in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(Exception, match="finite"):
            grouped_quantiles(ok.union(spark.createDataFrame([(bad,)], "v double")), [], "v", {"m": 0.5}).collect()


def test_adaptive_threshold(spark):
    from ridgeline.operators.masks import adaptive_threshold

    one = lambda values: adaptive_threshold(spark.createDataFrame([(float(v),) for v in values], "v float"), "v").first()["threshold"]
    assert one([]) == 1.0 and one([0.0, -1.0]) == 1.0
    assert one([0.1, 0.1, -5.0]) == 0.25 and one([0.9, 0.9]) == 0.75
    assert one([0.2, 0.4, 0.6]) == pytest.approx(np.percentile(np.float32([0.2, 0.4, 0.6]), 70))
    with pytest.raises(Exception, match="finite"):
        one([0.5, float("nan")])


def test_centres_come_from_the_top_percentile_and_inside_the_margins(spark):
    from ridgeline.operators.seeds import center_margins, pick_centers

    rng = np.random.default_rng(5)
    a = rng.permutation(6 * 8 * 10).reshape(6, 8, 10).astype(np.float32)
    rows = [(*map(int, i), 6, 8, 10, float(a[i])) for i in np.ndindex(a.shape)]
    df = spark.createDataFrame(rows, "i3 int, i2 int, i1 int, n3 int, n2 int, n1 int, v float")

    def brute(count, sep, percentile, m):
        inside = [i for i in np.ndindex(a.shape) if all(k <= x < n - k for x, n, k in zip(i, a.shape, m))]
        cut = np.percentile([a[i] for i in inside], percentile)
        picks = []
        for i in sorted((i for i in inside if a[i] >= cut), key=lambda i: (-a[i], i)):
            if all(sum((x - y) ** 2 for x, y in zip(i, p)) >= sep * sep for p in picks):
                picks.append(i)
        return picks[:count]

    assert pick_centers(df, "v", 5, 3.0, 90.0) == brute(5, 3.0, 90.0, (0, 0, 0))
    assert pick_centers(df, "v", 5, 3.0, 90.0, (1, 2, 2)) == brute(5, 3.0, 90.0, (1, 2, 2))
    assert pick_centers(df, "v", 9, 9.0, 99.0) == brute(9, 9.0, 99.0, (0, 0, 0))
    assert center_margins((6, 8, 10), (6, 4, 5)) == (0, 2, 2)
    with pytest.raises(ValueError, match="eligible"):
        pick_centers(df, "v", 1, 1.0, 50.0, (3, 0, 0))


@pytest.mark.parametrize("slices", [16, 64])
def test_a_plateau_settles_in_few_exchanges(spark, slices, monkeypatch):
    from ridgeline.operators import seeds as S

    calls = []
    halo = S.with_halo
    monkeypatch.setattr(S, "with_halo", lambda *a, **k: (calls.append(1), halo(*a, **k))[1])
    score = np.ones((slices, 6, 5), np.float32)
    rows = [(*map(int, i), int(np.ravel_multi_index(i, score.shape)), 1.0) for i in np.ndindex(score.shape)]
    got = S.pick_seeds(spark.createDataFrame(rows, "i3 int, i2 int, i1 int, flat long, score double"), 2, True, Tiling(16, 16)).select(*XYZ).collect()
    assert {tuple(r) for r in got} == greedy(score, score > 0, 2, True)
    assert len(calls) <= 1 + slices // 16


@pytest.mark.parametrize("few", [64, 0])
def test_distances_by_lines_and_by_spreading(spark, few, monkeypatch):
    from ridgeline.operators import distance as D

    monkeypatch.setattr(D, "_FEW", few)
    rng = np.random.default_rng(few)
    f = np.where(rng.random((30, 4)) < 0.2, rng.integers(0, 50, (30, 4)), D._FAR)
    f[3] = 7
    i = np.arange(30)
    want = (f[None, :, :] + ((i[:, None] - i[None, :]) ** 2)[:, :, None]).min(1)
    assert np.array_equal(D._spread(f), want)
    i3, i1 = rng.integers(-5, 45, 200), rng.integers(0, 4, 200)
    assert np.array_equal(D._reach(f, 0, i3, i1), (f[:, i1] + (i3[None, :] - i[:, None]) ** 2).min(0))
    pts = {tuple(x) for x in rng.integers(0, 40, (60, 3)).tolist()}
    tgt = {tuple(x) for x in rng.integers(0, 40, (25, 3)).tolist()}
    mk = lambda s: spark.createDataFrame(sorted(s), "i3 int, i2 int, i1 int")
    got = {(r["i3"], r["i2"], r["i1"]): r["d2"] for r in nearest_distance(mk(pts), mk(tgt), 40).collect()}
    assert got == {p: min(sum((a - b) ** 2 for a, b in zip(p, t)) for t in tgt) for p in pts}
