import itertools
import math

import numpy as np
import pytest
from helpers import gauss_axis, to_array, traces, voxels
from pyspark.sql import functions as F

from ridgeline.functions.kernels import angle_samples, gaussian_weights
from ridgeline.grid import Tiling, flat_index, to_traces, to_voxels, with_shape
from ridgeline.operators import masked, metrics, paths, scan_sweep, voting
from ridgeline.operators.seeds import pick_seeds
from ridgeline.plans import workflow
from ridgeline.sources.cases import case_columns, range_grid

SMALL = Tiling(5, 6)


def lin(a, y, x, fill):
    """Linear samples on the first two axes; nearest edges when fill is None."""
    ny, nx = a.shape[:2]
    ok = (y >= -1e-4) & (y <= ny - 1 + 1e-4) & (x >= -1e-4) & (x <= nx - 1 + 1e-4)
    y, x = np.clip(y, 0, ny - 1), np.clip(x, 0, nx - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    fy, fx = y - y0, x - x0
    if a.ndim == 3:
        fy, fx, ok = fy[..., None], fx[..., None], ok[..., None]
    v = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    return v if fill is None else np.where(ok, v, fill)


def whole_volume_sweep(v, phis, thetas, sigma):
    n3, n2, n1 = v.shape
    best, code, k = np.zeros(v.shape), np.zeros(v.shape, int), 0
    c2, c3 = (n2 - 1) / 2, (n3 - 1) / 2
    for phi in phis:
        c, s = math.cos(math.radians(phi)), math.sin(math.radians(phi))
        e2, e3 = abs(c2 * c) + abs(c3 * s), abs(c2 * s) + abs(c3 * c)
        m2, m3 = 2 * math.ceil(e2 - 1e-6) + 1, 2 * math.ceil(e3 - 1e-6) + 1
        d3, d2 = np.meshgrid(np.arange(m3) - e3, np.arange(m2) - e2, indexing="ij")
        rot = lin(v, c3 - d2 * s + d3 * c, c2 + d2 * c + d3 * s, 1.0)
        rot = np.transpose(gauss_axis(rot, gaussian_weights(sigma), 0), (1, 2, 0))
        jj, ii = np.meshgrid(np.arange(m2, dtype=float), np.arange(n1, dtype=float), indexing="ij")
        for th in thetas:
            h = -math.cos(math.radians(th)) / math.sin(math.radians(th))
            sh = lin(rot, jj - h * (ii - (n1 - 1) / 2), ii, 1.0)
            sm = gauss_axis(sh, gaussian_weights(sigma * math.sin(math.radians(th))), 1)
            un = np.clip(lin(sm, jj + h * (ii - (n1 - 1) / 2), ii, 1.0), 0, 1)
            i3, i2 = np.meshgrid(np.arange(n3), np.arange(n2), indexing="ij")
            like = np.transpose(1 - un**4, (2, 0, 1))
            sc = lin(like, (i2 - c2) * s + (i3 - c3) * c + e3, (i2 - c2) * c - (i3 - c3) * s + e2, 0.0)
            up = sc > best
            best[up], code[up] = sc[up], k
            k += 1
    return best, code


def test_sweep_on_tiles_equals_whole_volume(spark):
    v = np.random.default_rng(0).random((12, 13, 16)).astype(np.float32)
    phis, thetas = [0.0, 20.0, 60.0, 120.0], [65.0, 75.0, 85.0]
    s = scan_sweep.scan_sweep_3d(traces(spark, g=v), "g", phis, thetas, 1.0, tiling=SMALL).cache()
    best, code = whole_volume_sweep(v, phis, thetas, 1.0)
    assert np.allclose(to_array(s, "ft", v.shape), best, atol=1e-5)
    pt = to_array(s, "pt", v.shape)
    assert (pt != np.asarray(phis)[code // 3]).mean() < 1e-3


def test_sweep_of_a_constant_volume(spark):
    v = np.full((4, 4, 4), 0.3, np.float32)
    s = scan_sweep.scan_sweep_3d(traces(spark, g=v), "g", [20.0, 40.0], [65.0], 1.0, tiling=SMALL)
    assert to_array(s, "ft", v.shape).max() == 0
    assert (to_array(s, "pt", v.shape) == 20.0).all()


def test_directional_sweep_is_independent_of_tiles(spark):
    v = np.random.default_rng(4).random((9, 10, 8)).astype(np.float32)
    a, b = (
        to_array(scan_sweep.scan_sweep_3d(traces(spark, g=v), "g", [0.0, 40.0], [70.0], 1.0, "directional", t), "ft", v.shape)
        for t in (Tiling(3, 4), Tiling(64, 64))
    )
    assert np.allclose(a, b, atol=1e-6)


def test_image_sweep_equals_whole_image(spark):
    img = np.random.default_rng(5).random((23, 18)).astype(np.float32)
    n2, n1 = img.shape
    g = ((img - img.min()) / (img.max() - img.min())).astype(np.float32)
    h1, h2 = n1 // 2, n2 // 2
    best, code = np.zeros(img.shape), np.zeros(img.shape, int)
    thetas = angle_samples(40.0, 140.0, 1.5)
    for k, th in enumerate(thetas):
        c, s = math.cos(math.radians(-th)), math.sin(math.radians(-th))
        m2 = max(abs(round(h2 * c + h1 * s)), abs(round(h2 * c - h1 * s)))
        m1 = max(abs(round(h1 * c - h2 * s)), abs(round(h1 * c + h2 * s)))
        k2, k1 = np.meshgrid(np.arange(-m2, m2 + 1), np.arange(-m1, m1 + 1), indexing="ij")
        rot = lin(g, k2 * c - k1 * s + h2, k1 * c + k2 * s + h1, None)
        rot = gauss_axis(gauss_axis(rot, gaussian_weights(1.0), 0), gaussian_weights(1.5), 1)
        i2, i1 = np.meshgrid(np.arange(n2) - h2, np.arange(n1) - h1, indexing="ij")
        u = lin(rot, s * i1 + c * i2 + m2, c * i1 - s * i2 + m1, None)
        sc = 1 - u**4
        up = sc > best
        best[up], code[up] = sc[up], k
    out = scan_sweep.scan_reference_2d(traces(spark, v=img[None]), "v", 40.0, 140.0, 1.5, tiling=SMALL)
    assert np.allclose(to_array(out, "ft", (1, n2, n1))[0], np.clip(best, 0, 1), atol=1e-5)


def cheapest(cost, stride):
    """Smallest total cost over all admissible paths, by enumeration over (step, lag)."""
    n, m = cost.shape
    acc = np.full((n, m), np.inf)
    acc[0] = cost[0]
    for i in range(1, n):
        j = max(i - stride, 0)
        for k in range(m):
            options = [acc[i - 1, k]]
            for side in (max(k - 1, 0), min(k + 1, m - 1)):
                options.append(acc[j, side] + sum(cost[b, side] for b in range(j + 1, i)))
            acc[i, k] = min(options) + cost[i, k]
    return acc


@pytest.mark.parametrize("stride", [1, 2, 4])
def test_accumulation_equals_enumeration(stride):
    c = np.random.default_rng(stride).random((3, 11, 7)).astype(np.float32)
    got = paths.accumulate(c, stride)
    for a, b in zip(c, got):
        assert np.allclose(cheapest(a.astype(float), stride), b, atol=1e-5)


@pytest.mark.parametrize("stride", [1, 3, 4])
def test_paths_respect_the_strain_bound_and_find_a_valley(stride):
    c = np.ones((1, 21, 9), np.float32)
    for i in range(21):
        c[0, i, 2 + i // 5] = 0.0
    p = paths.best_path(c, stride, -4)
    assert np.abs(np.diff(p)).max() <= 1.0 / stride + 1e-6
    if stride < 5:
        assert np.abs(p[0, -1] - 2.0) <= 1.0


def test_flat_costs_keep_the_seed_plane():
    s = paths.find_surfaces(np.ones((2, 5, 7, 5), np.float32), 4, 4, -2, 1, 2.0, 2.0)
    assert np.allclose(s, 0.0)


def test_center_slopes_of_a_tilted_surface():
    w, v = np.mgrid[-4:5, -6:7]
    dv, dw = paths.center_slopes((0.25 * v - 0.1 * w)[None].astype(np.float32), 0.0)
    assert np.allclose([dv[0], dw[0]], [0.25, -0.1], atol=1e-6)


@pytest.mark.parametrize("case", ["single_vertical_plane", "single_dipping_plane"])
def test_votes_reproduce_the_plane(spark, case):
    grid = case_columns(range_grid(spark, (17, 17, 17)), case)
    votes = workflow.vote_stage(grid, workflow.Profile(voter=voting.Voter(2, 3, 3), seed_distance=3, seed_threshold=0.5), SMALL)
    thin = workflow.thin_votes(votes, "normal", SMALL).where("thin > 0.3").select("i3", "i2", "i1")
    inner = "i3 between 2 and 14 and i2 between 2 and 14 and i1 between 2 and 14"
    o = metrics.buffered_overlap(thin.where(inner), grid.where("truth_mask").where(inner).select("i3", "i2", "i1"), 2.0).first()
    assert o["buffered_precision"] > 0.95 and o["buffered_recall"] > 0.9


def test_votes_are_independent_of_tiles(spark):
    grid = case_columns(range_grid(spark, (13, 14, 12)), "single_dipping_plane")
    vols = []
    for t in (Tiling(4, 5), Tiling(64, 64)):
        c = with_shape(grid.select("i3", "i2", "i1", "ft", "pt", "tt")).withColumn("flat", flat_index()).where("ft > 0.5")
        s = pick_seeds(c.select("i3", "i2", "i1", "flat", F.col("ft").alias("score"), "pt", "tt"), 2, True, t)
        out = voting.surface_voting(to_traces(grid, ["ft"]), s, voting.Voter(2, 3, 3), t)
        vols.append({c: to_array(out, c, (13, 14, 12)) for c in ("fv", "vp", "vt")})
    assert np.allclose(vols[0]["fv"], vols[1]["fv"], atol=1e-5)
    assert np.allclose(vols[0]["vp"], vols[1]["vp"], atol=1e-4)


def test_no_seeds_give_no_votes(spark):
    v = np.full((5, 5, 5), 0.2, np.float32)
    seeds = spark.createDataFrame([], "i3 int, i2 int, i1 int, flat long, score float, pt float, tt float")
    out = voting.surface_voting(traces(spark, ft=v), seeds, voting.Voter(1, 2, 2), SMALL)
    assert to_array(out, "fv", v.shape).max() == 0
    assert voting.voting_summary(voting.seed_surfaces(traces(spark, ft=v), "ft", seeds, voting.Voter(1, 2, 2), SMALL, votes=False)).first()["support_fraction_min"] == 1.0


def test_path_votes_follow_a_line(spark):
    img = np.zeros((1, 25, 20), np.float32)
    img[0, :, 9] = 1.0
    pts = np.full_like(img, 90.0)
    vox = with_shape(to_voxels(traces(spark, ft=img, pt=pts), ["ft", "pt"])).withColumn("flat", flat_index()).where("ft > 0.5")
    s = pick_seeds(vox.select("i3", "i2", "i1", "flat", F.col("ft").alias("score"), "pt"), 3, True, SMALL)
    out = voting.path_voting(traces(spark, ft=img), s, voting.Voter(3, 4), SMALL)
    fv = to_array(out, "fv", img.shape)[0]
    assert (fv[3:-3].argmax(1) == 9).all()


def test_voxel_helper(spark):
    assert voxels(spark, v=np.zeros((2, 2, 2), np.float32)).count() == 8


def test_quality_profile_has_245_orientations():
    strikes, dips = workflow.orientations(workflow.QUALITY)
    assert (len(strikes), len(dips)) == (35, 7)
    assert (workflow.QUALITY.sigma, workflow.QUALITY.thin, min(dips), max(dips)) == (8.0, "hybrid_v2", 65.0, 80.0)


@pytest.mark.parametrize("normalize", [True, False])
def test_constant_image_has_no_likelihood(spark, normalize):
    img = traces(spark, g=np.full((1, 12, 10), 0.3, np.float32))
    out = scan_sweep.scan_reference_2d(img, "g", 30.0, 80.0, 2.0, normalize=normalize, tiling=SMALL).collect()
    assert len(out) == 12 and all(v == 0.0 for r in out for v in r["ft"])
    assert {v for r in out for v in r["pt"]} == {150.0}


def test_variants_share_votes_and_apply_their_policies(spark):
    from ridgeline.plans import variants

    assert len(variants.VARIANTS) == 18 and len(variants.preset("quality-matrix")) == 13
    assert [v for v in variants.VARIANTS if not variants.offered(v)] == ["quality_skinner_v2", "quality_boundary_skinner_fallback_v5"]
    grid = case_columns(range_grid(spark, (12, 12, 12)), "single_vertical_plane").select("i3", "i2", "i1", "ft", F.col("truth_strike").alias("pt"), F.col("truth_dip").alias("tt"))
    profile = workflow.Profile(voter=voting.Voter(2, 3, 3), seed_distance=3, seed_threshold=0.5)
    names = ["current_default", "boundary_edge_thin_v1", "quality_boundary_skinner_fallback_v4"]
    out = variants.run_variants(grid, profile, names, SMALL, min_likelihood=0.3, min_size=5).toPandas()
    assert set(out["variant"]) == set(names)
    plane = out[out["variant"] == "current_default"]
    assert len(plane) >= 60 and not plane["replaced"].any() and plane["i2"].between(5, 6).mean() > 0.9
    with pytest.raises(ValueError, match="not offered"):
        variants.run_variants(grid, profile, ["quality_skinner_v2"], SMALL)


def test_seeds_without_a_score_are_refused(spark):
    seeds = spark.createDataFrame([], "i3 int, i2 int, i1 int, flat long, pt float, tt float")
    with pytest.raises(ValueError, match="score"):
        voting.seed_surfaces(traces(spark, ft=np.zeros((3, 3, 3), np.float32)), "ft", seeds, voting.Voter(1, 1, 1), SMALL)
    with pytest.raises(ValueError, match="boundary policy"):
        voting.Voter(1, 1, 1, boundary="open")


def _cheapest_masked(cost, valid, stride):
    """Least cost over all lag paths inside the mask (stride 1: every step moves by at most one lag)."""
    n, m = cost.shape
    best = np.inf
    for path in itertools.product(range(m), repeat=n):
        p = np.array(path)
        if (np.abs(np.diff(p)) <= 1).all() and valid[np.arange(n), p].all():
            best = min(best, float(cost[np.arange(n), p].sum()))
    return best


def test_masked_paths_are_the_cheapest_inside_the_mask():
    rng = np.random.default_rng(5)
    cost, valid = rng.random((40, 5, 4)).astype(np.float32), rng.random((40, 5, 4)) < 0.7
    acc = masked.accumulate(cost, valid, 1)
    path, found = masked.best_path(cost, valid, 1, -2)
    seen = 0
    for k in range(40):
        want = _cheapest_masked(cost[k], valid[k], 1)
        assert found[k] == np.isfinite(want)
        assert np.isclose(acc[k, -1].min(), want, rtol=1e-5) or not np.isfinite(want)
        if found[k]:
            p = masked.cells_of(path[k], -2)
            assert valid[k, np.arange(5), p].all() and np.isclose(cost[k, np.arange(5), p].sum(), want, rtol=1e-5)
            seen += 1
    assert 5 < seen < 40


def test_an_open_mask_changes_no_path():
    cost = np.random.default_rng(6).random((30, 9, 7)).astype(np.float32)
    assert np.allclose(masked.accumulate(cost, np.ones(cost.shape, bool), 3), paths.accumulate(cost, 3), rtol=1e-5)
    path, found = masked.best_path(cost, np.ones(cost.shape, bool), 3, -3)
    assert found.all() and np.allclose(path, paths.best_path(cost, 3, -3), atol=1e-6)


def test_masked_surfaces_keep_to_mask_and_strain():
    rng = np.random.default_rng(7)
    cost, valid = rng.random((25, 5, 7, 7)).astype(np.float32), rng.random((25, 5, 7, 7)) < 0.85
    surface, ok, moved = masked.find_surfaces(cost, valid, 2, 2, -3, 1, 2.0, 2.0)
    assert ok.any() and (moved[~ok] == 0).all()
    assert masked.respects(surface[ok], valid[ok], 2, 2, -3).all()
    closed = np.zeros_like(valid)
    assert not masked.find_surfaces(cost, closed, 2, 2, -3, 1, 2.0, 2.0)[1].any()


def test_largest_rectangle_around_the_origin():
    rng = np.random.default_rng(8)
    for _ in range(60):
        free = rng.random((5, 6)) < 0.75
        got, best = masked.origin_rectangle(free, 2, 3), 0
        for a, b, c, d in itertools.product(range(3), range(3, 6), range(4), range(4, 7)):
            if free[a:b, c:d].all():
                best = max(best, (b - a) * (d - c))
        assert (got is None) == (best == 0)
        if got is not None:
            a, c, b, d = got
            assert free[a:b, c:d].all() and (b - a) * (d - c) == best


def _votes_of(spark, boundary, tiling=SMALL):
    grid = case_columns(range_grid(spark, (13, 14, 12)), "boundary_plane")
    c = with_shape(grid.select("i3", "i2", "i1", "ft", "pt", "tt")).withColumn("flat", flat_index()).where("ft > 0.5")
    s = pick_seeds(c.select("i3", "i2", "i1", "flat", F.col("ft").alias("score"), "pt", "tt"), 2, True, tiling)
    v = voting.Voter(2, 3, 3, boundary=boundary)
    return (
        to_array(voting.surface_voting(to_traces(grid, ["ft"]), s, v, tiling), "fv", (13, 14, 12)),
        voting.seed_surfaces(to_traces(grid, ["ft"]), "ft", s, v, tiling, votes=False).toPandas(), grid,
    )


def test_masked_votes_reach_the_faces(spark):
    """On a plane beside a face the masked policy votes on the face, where the other one may not."""
    open_, plain, grid = _votes_of(spark, "reference")
    shut, report, _ = _votes_of(spark, "masked_in_bounds")
    truth = np.zeros((13, 14, 12), bool)
    for r in grid.where("truth_mask").select("i3", "i2", "i1").collect():
        truth[tuple(r)] = True
    rim = np.ones_like(truth)
    rim[1:-1, 1:-1, 1:-1] = False
    assert truth[rim].any() and (shut[truth & rim] > 0.1).mean() > (open_[truth & rim] > 0.1).mean()
    assert (report["invalid_samples"] == 0).all() and (report["face_votes"] > 0).any()
    cropped = report[(report["columns"] < 49) & (report["skip_reason"] == "")]
    assert len(cropped) and (cropped["orientation"] == "seed_boundary_fallback").all()
    assert (report.loc[report["columns"] == 49, "orientation"] == "surface").all()
    assert set(plain["orientation"]) <= {"surface", ""}
    assert np.allclose(shut, _votes_of(spark, "masked_in_bounds", Tiling(64, 64))[0], atol=1e-5)


def test_every_offered_variant_runs(spark):
    from ridgeline.plans import variants

    grid = case_columns(range_grid(spark, (10, 11, 10)), "single_vertical_plane").select("i3", "i2", "i1", "ft", F.col("truth_strike").alias("pt"), F.col("truth_dip").alias("tt"))
    profile = workflow.Profile(voter=voting.Voter(1, 2, 2), seed_distance=3, seed_threshold=0.5)
    names = [v for v in variants.VARIANTS if variants.offered(v)]
    assert len(names) == 16
    falls = [v for v in names if variants.VARIANTS[v].fallback]
    # no primary surface reaches that likelihood: only the fallbacks give surfaces, and all of theirs are replacements
    out = variants.run_variants(grid, profile, ["current_default", *falls], SMALL, min_likelihood=2.0, min_size=5).toPandas()
    assert set(out["variant"]) == set(falls) and out["replaced"].all()
    out = variants.run_variants(grid, profile, names, SMALL, min_likelihood=0.2, min_size=5).toPandas()
    assert set(out["variant"]) == set(names) and not out.duplicated(["variant", "i3", "i2", "i1"]).any()
    assert out["i3"].between(0, 9).all() and (out["component"] >= 0).all() and (out["component"] < 1100).all()
    sizes = out.groupby(["variant", "component"]).size()
    assert (sizes == out.groupby(["variant", "component"])["skin_size"].first()).all()
