"""Orientation scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import IMAGE_TILING, IMG, TILING, VOX, case_voxels, image, query, s6, sql_pass, volume
from ridgeline.functions.kernels import angle_samples, dip_samples, gaussian_weights, refine_samples, strike_samples
from ridgeline.grid import to_traces, to_voxels
from ridgeline.operators import scan_bank, scan_sweep, stencil, thinning
from ridgeline.session import cut_lineage
from ridgeline.sources.cases import scanner_input

ID3 = ["i3", "i2", "i1"]
_W = {s: [gaussian_weights(s, o) for o in range(3)] for s in (1.0, 2.0)}


def _ders(which, sigma, src, dims):
    n = {"i3": f"(SELECT max(i3)+1 FROM {src})", "i2": f"(SELECT max(i2)+1 FROM {src})", "i1": f"(SELECT max(i1)+1 FROM {src})"}
    w, parts = _W[sigma], []
    for a in sorted({o[0] for o in which.values()}):
        parts.append(sql_pass(f"g{a}", src, "v", "i3", w[a], n["i3"]) if dims == 3 else f"g{a} AS (SELECT * FROM {src})")
    for a, b in sorted({o[:2] for o in which.values()}):
        parts.append(sql_pass(f"g{a}{b}", f"g{a}", "v", "i2", w[b], n["i2"]))
    for name, (a, b, c) in which.items():
        parts.append(sql_pass(name, f"g{a}{b}", "v", "i1", w[c], n["i1"]))
    names = list(which)
    sel = ", ".join(f"{d}.v AS {d}" for d in names)
    joins = " ".join(f"JOIN {d} USING (i3, i2, i1)" for d in names[1:])
    return ",\n".join(parts) + f",\ndd AS (SELECT i3, i2, i1, {sel} FROM {names[0]} {joins})"


_TH2 = angle_samples(30.0, 150.0, 4.0)
_B2 = ", ".join(f"({k}, {b['n1']!r}, {b['n2']!r}, {b['pt']!r})" for k, b in enumerate(scan_bank.bank_2d(_TH2)))
_PICK = """bs AS (SELECT *, row_number() OVER (PARTITION BY i3, i2, i1 ORDER BY score DESC, k) AS rn FROM sc),
b1 AS (SELECT * FROM bs WHERE rn = 1), hi AS (SELECT CAST(quantile_cont(CAST(score AS DOUBLE), 0.995) AS FLOAT) AS hi FROM b1)"""


@query("scan_fast_2d", f"""WITH {IMG}, {_ders(stencil.DERIVATIVES_2D, 2.0, 'img', 2)},
sc AS (SELECT i3, i2, i1, k, pt, CAST(abs(n1*d1 + n2*d2) + 2.0*abs(n1*n1*d11 + 2.0*n1*n2*d12 + n2*n2*d22) AS FLOAT) AS score
 FROM (SELECT i3, i2, i1, {', '.join(f'CAST({d} AS DOUBLE) AS {d}' for d in stencil.DERIVATIVES_2D)} FROM dd) CROSS JOIN (VALUES {_B2}) b(k, n1, n2, pt)), {_PICK}
SELECT i2, i1, round(CAST(pt AS DOUBLE), 3) AS pt, round(CAST(CAST(greatest(0.0, least(1.0, CAST(CAST(score AS DOUBLE)/hi AS FLOAT))) AS FLOAT) AS DOUBLE), 4) AS ft FROM b1, hi""")
def q_fast2(spark, sf):
    s = scan_bank.scan_fast_2d(image(spark, sf), "v", 30.0, 150.0, 4.0, IMAGE_TILING)
    return s.select("i2", "i1", F.round(F.col("pt").cast("double"), 3).alias("pt"), F.round(F.col("ft").cast("double"), 4).alias("ft"))


_PH3, _TH3 = strike_samples(0.0, 80.0), dip_samples(65.0, 80.0)
_B3 = ", ".join(
    f"({k}, {b['w1']!r}, {b['w2']!r}, {b['w3']!r}, {b['pt']!r}, {b['tt']!r})" for k, b in enumerate(scan_bank.bank_3d(_PH3, _TH3))
)


@query("scan_fast_3d", f"""WITH {VOX}, {_ders(stencil.DERIVATIVES_3D, 1.0, 'vox', 3)},
sc AS (SELECT i3, i2, i1, k, pt, tt, CAST(abs(w1*d1 + w2*d2 + w3*d3) + abs(w1*w1*d11 + w2*w2*d22 + w3*w3*d33 + 2.0*w1*w2*d12 + 2.0*w1*w3*d13 + 2.0*w2*w3*d23) AS FLOAT) AS score
 FROM (SELECT i3, i2, i1, {', '.join(f'CAST({d} AS DOUBLE) AS {d}' for d in stencil.DERIVATIVES_3D)} FROM dd)
 CROSS JOIN (SELECT k, CAST(w1 AS DOUBLE) AS w1, CAST(w2 AS DOUBLE) AS w2, CAST(w3 AS DOUBLE) AS w3, pt, tt FROM (VALUES {_B3}) b(k, w1, w2, w3, pt, tt))), {_PICK}
SELECT i3, i2, i1, CAST(pt AS DOUBLE) AS pt, CAST(tt AS DOUBLE) AS tt, round(CAST(CAST(greatest(0.0, least(1.0, CAST(CAST(score AS DOUBLE)/hi AS FLOAT))) AS FLOAT) AS DOUBLE), 4) AS ft FROM b1, hi""")
def q_fast3(spark, sf):
    s = scan_bank.scan_fast_3d(volume(spark, sf), "v", _PH3, _TH3, 2.0, 2.0, TILING)
    return s.select(
        *ID3, F.col("pt").cast("double").alias("pt"), F.col("tt").cast("double").alias("tt"), F.round(F.col("ft").cast("double"), 4).alias("ft")
    )


@query("orientation_argmax", f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b, l_quantity/500.0 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(a, b, c) AS best, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS code,
 a + b + c - greatest(a, b, c) - least(a, b, c) AS second FROM q""" .replace("a + b + c - greatest(a, b, c) - least(a, b, c)", "list_sort([a, b, c])[2]"))
def q_argmax(spark, sf):
    """Best score with the first code on ties, and the runner-up, over three columns."""
    from driver_queries.base import table

    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array("l_discount", "l_tax", F.col("l_quantity") / 500.0).alias("s")
    )
    best = F.array_max(F.transform("s", lambda x, i: F.struct(x.alias("x"), (-i).alias("k"))))
    return li.select(
        "l_orderkey", "l_linenumber", best["x"].alias("best"), (-best["k"]).alias("code"), F.element_at(F.array_sort("s"), 2).alias("second")
    )


def planarity(spark, sf, case="single_dipping_plane"):
    """Low-on-fault input with the stored values as noise; trace layout."""
    c = case_voxels(spark, sf, case)
    g = scanner_input(F.col("ft"), 0.1 * F.col("v").cast("double"))
    return to_traces(c.select(*ID3, g.alias("g")), ["g"])


# The sweeps resample rotated lattices; SQL twins are impractical, tests compare with whole-volume brute force.
@query("scan_reference_2d")
def q_ref2(spark, sf):
    return to_voxels(scan_sweep.scan_reference_2d(image(spark, sf), "v", 30.0, 150.0, 4.0, tiling=IMAGE_TILING), ["ft", "pt"])


@query("scan_dip_2d")
def q_dip2(spark, sf):
    return to_voxels(scan_sweep.scan_dip_2d(image(spark, sf), "v", 65.0, 85.0, 4.0, IMAGE_TILING), ["ft", "pt"])


@query("scan_reference_3d")
def q_ref3(spark, sf):
    s = scan_sweep.scan_sweep_3d(planarity(spark, sf), "g", strike_samples(0, 340), dip_samples(65, 85), 1.0, tiling=TILING)
    return to_voxels(s, ["ft", "pt", "tt"])


@query("scan_directional_3d")
def q_dir3(spark, sf):
    s = scan_sweep.scan_sweep_3d(planarity(spark, sf), "g", [0.0, 40.0, 80.0], [65.0, 85.0], 1.0, "directional", TILING)
    return to_voxels(s, ["ft", "pt", "tt"])


@query("scan_quality_3d")
def q_quality(spark, sf):
    """Refined angle grid, with the confidence of the choice."""
    phis, thetas = refine_samples(strike_samples(0, 80), 2), refine_samples(dip_samples(65, 75), 2)
    s = scan_sweep.scan_sweep_3d(planarity(spark, sf), "g", phis, thetas, 1.0, tiling=TILING)
    return scan_sweep.confidence(to_voxels(s, ["ft", "pt", "tt", "gap"])).drop("gap")


@query("scan_and_thin_3d")
def q_scan_thin(spark, sf):
    """Sweep, then reference thinning with edge clean-up."""
    s = scan_sweep.scan_sweep_3d(planarity(spark, sf), "g", strike_samples(0, 160), dip_samples(65, 85), 1.0, tiling=TILING)
    return thinning.scanner_thin_reference(s, tiling=TILING).where("ft <> 0")


# ---------------------------------------------------------------- voting


def seeds_2d(spark, sf):
    """Positive scan ridges as 2-D seeds."""
    from ridgeline.grid import flat_index, with_shape
    from ridgeline.operators.seeds import pick_seeds

    s = cut_lineage(scan_sweep.scan_reference_2d(image(spark, sf), "v", 30.0, 150.0, 4.0, tiling=IMAGE_TILING))  # read by seeds and votes
    vox = with_shape(to_voxels(s, ["ft", "pt"])).withColumn("flat", flat_index())
    c = vox.where(F.col("ft") > F.lit(0.9).cast("float")).select(*ID3, "flat", F.col("ft").alias("score"), "pt")
    return s, pick_seeds(c, 4, True, IMAGE_TILING)


@query("vote_2d")
def q_vote2(spark, sf):
    """Scan, pick seeds, vote along optimal paths."""
    from ridgeline.operators.voting import Voter, path_voting

    s, picked = seeds_2d(spark, sf)
    return to_voxels(path_voting(s, picked, Voter(5, 8), IMAGE_TILING), ["fv", "w1", "w2"])


@query("thin_votes_2d")
def q_thin2(spark, sf):
    """2-D votes thinned along their vector field."""
    from ridgeline.operators.voting import Voter, path_voting

    s, picked = seeds_2d(spark, sf)
    v = path_voting(s, picked, Voter(5, 8), IMAGE_TILING)
    t = thinning.thin_2d(v, "fv", "w1", "w2", False, IMAGE_TILING)
    return to_voxels(t, ["fv", "keep"]).where("keep and fv > 0")


def seeds_3d(spark, sf, case="single_dipping_plane"):
    """Oracle attributes and their seeds."""
    from ridgeline.grid import flat_index
    from ridgeline.operators.seeds import pick_seeds

    c = case_voxels(spark, sf, case)
    traces = cut_lineage(to_traces(c, ["ft", "pt", "tt"]))
    cand = c.withColumn("flat", flat_index()).where(F.col("ft") > F.lit(0.5).cast("float"))
    return traces, pick_seeds(cand.select(*ID3, "flat", F.col("ft").alias("score"), "pt", "tt"), 3, True, TILING)


@query("vote_3d")
def q_vote3(spark, sf):
    """Surface voting from the oracle attributes of a dipping plane."""
    from ridgeline.operators.voting import Voter, surface_voting

    traces, picked = seeds_3d(spark, sf)
    return to_voxels(surface_voting(traces, picked, Voter(3, 5, 5), TILING), ["fv", "vp", "vt"])


@query("voting_diagnostics")
def q_diag(spark, sf):
    from ridgeline.operators.voting import Voter, seed_surfaces, voting_summary

    traces, picked = seeds_3d(spark, sf)
    return voting_summary(seed_surfaces(traces, "ft", picked, Voter(3, 5, 5), TILING, votes=False))


@query("vote_accumulate", """WITH v AS (SELECT CAST(l_suppkey % 50 AS INTEGER) AS i3, CAST(l_quantity AS INTEGER) AS i2, CAST(l_linenumber AS INTEGER) AS i1, CAST(l_discount AS FLOAT) AS fa, l_extendedprice AS sc, l_orderkey*10+l_linenumber AS fl, CAST(l_tax*360 AS FLOAT) AS vp FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY i3, i2, i1 ORDER BY fa DESC, sc DESC, fl DESC, vp DESC) AS rn FROM v)
SELECT i3, i2, i1, round(sum(CAST(fa AS DOUBLE)), 4) AS fe, round(max(CASE WHEN rn = 1 THEN CAST(vp AS DOUBLE) END), 4) AS vp FROM r GROUP BY i3, i2, i1""")
def q_accumulate(spark, sf):
    """Votes (order lines) summed per voxel, orientation of the strongest."""
    from driver_queries.base import table
    from ridgeline.operators.voting import accumulate_votes

    li = table(spark, sf, "lineitem").select(
        F.pmod("l_suppkey", F.lit(50)).cast("int").alias("i3"), F.col("l_quantity").cast("int").alias("i2"), F.col("l_linenumber").alias("i1"),
        F.col("l_discount").cast("float").alias("fa"), F.col("l_extendedprice").alias("rank_score"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank_flat"), (F.col("l_tax") * 360).cast("float").alias("vp"),
    ).withColumn("fe", F.col("fa").cast("double"))
    a = accumulate_votes(li, ["vp"])
    return a.select(*ID3, F.round(F.col("fe").cast("double"), 4).alias("fe"), F.round(F.col("vp").cast("double"), 4).alias("vp"))
