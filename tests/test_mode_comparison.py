"""The comparison's steps on traces: what is shuffled, shared and stored, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import to_array, traces
from ridgeline.grid import Tiling, to_voxels
from ridgeline.operators import distance as D
from ridgeline.operators import quantiles as Q
from ridgeline.operators import thinning
from ridgeline.operators.masks import top_k_by_key
from ridgeline.plans import mode_comparison as M

SHAPE = (9, 14, 11)
KEYED = Tiling(5, 6, ("trial",))


def _fields(spark):
    """Two volumes side by side: votes with zeros and plateaus, strikes and dips."""
    rng = np.random.default_rng(3)
    parts = []
    for name in "ab":
        v = np.where(rng.random(SHAPE) < 0.4, 0.0, np.round(rng.random(SHAPE), 1)).astype(np.float32)
        strike, dip = rng.choice([0.0, 20.0, 90.0, 160.0], SHAPE), rng.choice([5.0, 65.0, 85.0], SHAPE)
        parts.append(traces(spark, fv=v, vp=strike, vt=dip).withColumn("trial", F.lit(name)))
    return parts[0].unionByName(parts[1])


def _cells(df, cols):
    return {tuple(r[c] for c in ("trial", "i3", "i2", "i1")): tuple(r[c] for c in cols) for r in df.collect()}


def test_only_rows_near_the_cut_are_stored_for_ranks(spark, monkeypatch):
    stored = []
    cut = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda d: (out := cut(d), stored.append(out.count()))[0])
    n = 40_000  # half of them equal, the others all distinct
    df = spark.range(n).select(
        (F.col("id") % 2).cast("string").alias("g"), F.col("id").alias("flat"), F.lit(12_000).cast("bigint").alias("k"),
        F.when(F.col("id") < n // 2, 0.0).otherwise(F.sqrt("id")).alias("x"),
    )
    got = {(r.g, r.flat) for r in top_k_by_key(df, "x", "k", ["g"]).where("mask").collect()}
    rows = [(str(i % 2), i, 0.0 if i < n // 2 else i**0.5) for i in range(n)]
    want = {(g, i) for key in "01" for g, i, x in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))[:12_000]}
    assert got == want
    assert len(stored) == 4 and max(stored) < n // 10


@pytest.mark.parametrize("stored", [False, True])
def test_quantiles_of_stored_rows_are_the_same(spark, stored):
    rng = np.random.default_rng(8)
    rows = [(k, float(x)) for k, n in (("a", 1), ("b", 40), ("c", 500)) for x in np.round(rng.normal(size=n), 2)]
    rows += [("a", None), ("b", -0.0), ("b", 0.0)]
    q = Q.grouped_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"lo": 0.1, "hi": 0.95}, stored=stored)
    for r in q.collect():
        mine = [x for k, x in rows if k == r.g and x is not None]
        assert (r.lo, r.hi) == pytest.approx((np.quantile(mine, 0.1), np.quantile(mine, 0.95)))
    with pytest.raises(Exception, match="finite"):
        Q.grouped_quantiles(spark.createDataFrame([("a", float("nan"))], "g string, x double"), ["g"], "x", {"m": 0.5}, stored=stored).collect()


@pytest.mark.parametrize("shared", [1, 1 << 18])
def test_slabs_and_lines_share_groups(spark, monkeypatch, shared):
    monkeypatch.setattr(D, "_SHARED_VALUES", shared)
    rng = np.random.default_rng(4)
    mk = lambda s: spark.createDataFrame(sorted(s), "g string, i3 int, i2 int, i1 int")
    pts = {(g, *x) for g in "abc" for x in map(tuple, rng.integers(0, (30, 7, 40), (40, 3)).tolist())}
    tgt = {(g, *x) for g in "ab" for x in map(tuple, rng.integers(0, (30, 7, 40), (60, 3)).tolist())} | {("d", 1, 1, 1)}
    got = {(r.g, r.i3, r.i2, r.i1): r.d2 for r in D.nearest_distance(mk(pts), mk(tgt), 7, 16, ("g",)).collect()}
    assert got == {p: min(sum((a - b) ** 2 for a, b in zip(p[1:], t[1:])) for t in tgt if t[0] == p[0]) for p in pts if p[0] in "ab"}


def test_hybrid_thinning_keeps_whole_traces_and_their_angles(spark):
    df = _fields(spark).cache()
    got = thinning.hybrid_v2_traces(df, "fv", "vp", "vt", threshold=25.0, tiling=KEYED).cache()
    plateau = _cells(thinning.thin_plateau(df, "fv", "vp", "vt", tiling=KEYED), ["thin"])
    used = 0
    for name in "ab":
        mine = got.where(f"trial = '{name}'")
        v, strike, dip = (to_array(df.where(f"trial = '{name}'"), c, SHAPE) for c in ("fv", "vp", "vt"))
        assert np.array_equal(to_array(mine, "vp", SHAPE), strike) and np.array_equal(to_array(mine, "vt", SHAPE), dip)
        whole = traces(spark, fv=v, vp=strike, vt=dip)
        base = to_array(thinning.thin_reference(whole, "fv", "vp"), "thin", SHAPE)
        nrm = to_array(thinning.thin_normal(whole, "fv", "vp", "vt"), "thin", SHAPE)
        rough = thinning.T.roughness(strike, dip, v > 1e-6) > 25.0
        want = np.where(rough & (nrm > 0), nrm, base)
        free = (nrm <= 0) | (thinning.T.count27(nrm > 0) <= 1)
        for at in np.ndindex(SHAPE):
            edge = min(min(i, n - 1 - i) for i, n in zip(at, SHAPE)) < 2
            if edge and free[at] and plateau.get((name, *at), (0.0,))[0] > 0:
                want[at] = plateau[(name, *at)][0]
                used += 1
        assert np.array_equal(to_array(mine, "thin", SHAPE), want)
    assert used > 0
    voxels = thinning.thin_hybrid_v2(df, "fv", "vp", "vt", threshold=25.0, tiling=KEYED)
    assert _cells(voxels, ["thin"]) == _cells(to_voxels(got, ["thin"], ["trial"]), ["thin"])


def test_scanner_thinning_in_traces_equals_voxels(spark):
    df = _fields(spark).cache()
    named = df.select("trial", "i3", "i2", F.col("fv").alias("ft"), F.col("vp").alias("pt"), F.col("vt").alias("tt"))
    want = _cells(thinning.scanner_thin_reference(named, tiling=KEYED), ["ft", "pt", "tt"])
    whole = thinning.scanner_thin_reference(named, tiling=KEYED, remove_edges=False)
    assert want != _cells(whole, ["ft", "pt", "tt"])  # some are removed
    for shape in (None, SHAPE):
        got = thinning.scanner_thin_traces(named, tiling=KEYED, shape=shape)
        assert _cells(to_voxels(got, ["ft", "pt", "tt"], ["trial"]), ["ft", "pt", "tt"]) == want


def test_positive_candidates_are_among_the_strongest(spark):
    rng = np.random.default_rng(6)
    rows, k = [], {"s": 12, "t": 5}
    for trial in k:
        for block, share in (("q/fv", 0.2), ("q/reference/fvt", 0.9), ("q/scanner_raw", 0.9)):
            x = np.where(rng.random(40) < share, np.round(rng.random(40), 1) + 0.1, 0.0)
            rows += [(trial, block, i // 10, i % 10, 0, i, float(v), 0.0, 0.0) for i, v in enumerate(x)]
    ddl = "trial_id string, block string, i3 int, i2 int, i1 int, flat long, value double, strike double, dip double"
    truth = spark.createDataFrame([(t, 0, 0, i) for t, n in k.items() for i in range(n)], "trial_id string, i3 int, i2 int, i1 int")
    out = M.select_candidates(spark.createDataFrame(rows, ddl), truth).collect()
    got = {(r.trial_id, r.block, r.selection, r.flat) for r in out}
    want = set()
    for t, n in k.items():
        for block in {r[1] for r in rows}:
            for sel in (M.TOP, M.POSITIVE_TOP):
                if sel == M.POSITIVE_TOP and block.endswith("raw"):
                    continue
                pool = sorted((-r[6], r[5]) for r in rows if r[:2] == (t, block) and (sel == M.TOP or r[6] > 1e-6))
                want |= {(t, block, sel, flat) for _, flat in pool[:n]}
    assert got == want and len(out) == len(got)


def test_contrasts_of_a_run_that_stores_no_volume_of_voxels(spark, monkeypatch):
    from driver_queries.workflows import workflow
    from ridgeline.operators.voting import Voter
    from ridgeline.plans.contrasts import CONTRASTS, paired_contrasts
    from ridgeline.sources.cases import case_columns, range_grid, scanner_input

    shape = (8, 12, 16)
    c = case_columns(range_grid(spark, shape), "single_dipping_plane").withColumn("g", scanner_input(F.col("ft")))
    c = c.withColumns({"case_id": F.lit("one"), "trial_id": F.lit("one"), "seed": F.lit(None).cast("bigint")})
    stored = []
    cut = M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda d: (out := cut(d), stored.append((out.columns, out.count())))[0])
    p = workflow.Profile(strikes=(0.0, 80.0), dips=(65.0, 75.0), voter=Voter(2, 3, 3), seed_distance=3, seed_threshold=0.3)
    rows = cut(M.compare_modes(c, p, Tiling(8, 8)))
    truth = c.where("truth_mask").count()
    sizes = [n for columns, n in stored if "i1" not in columns]
    assert max(sizes) == 3 * shape[0] * shape[1]  # traces of three sources
    # what is stored by voxel follows the truth: candidates of 22 groups, and the truth for each
    assert max(n for columns, n in stored if "i1" in columns) <= 22 * truth < 13 * 8 * 12 * 16
    value = {(r.stage, r.selection, r.metric, r.cell_label): r.value for r in rows.where("contrast_eligible").collect()}
    got = {(r.stage, r.selection, r.metric, r.contrast_name): r.raw_value for r in paired_contrasts(rows).collect()}
    want = {}
    for stage, selection, metric in {k[:3] for k in value}:
        for name, terms in CONTRASTS.items():
            if all((stage, selection, metric, cell) in value for cell in terms):
                want[stage, selection, metric, name] = sum(x * value[stage, selection, metric, cell] for cell, x in terms.items())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert value["scanner_raw", M.TOP, "candidate_count", "Q-SCAN"] == truth
