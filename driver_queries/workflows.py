"""End-to-end runs, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import TILING, attribute_traces, attributes, case_voxels, query, sql_attributes, sql_normal, table, volume, voxels
from driver_queries.scans import planarity
from driver_queries.scoring import rnd
from driver_queries.stencils import _SM2, _THIN_REF, _sql_nms
from ridgeline.functions.kernels import gaussian_weights
from ridgeline.grid import flat_index, shape_of, to_traces, to_voxels, with_shape
from ridgeline.operators import metrics
from ridgeline.operators.masks import top_truth_count_mask
from ridgeline.operators.thinning import thin_reference
from ridgeline.operators.voting import Voter
from ridgeline.plans import workflow
from ridgeline.session import cut_lineage, new_folder
from ridgeline.sources import dat, tables

ID3 = ["i3", "i2", "i1"]


def _thin_and_score(spark, sf, case):
    # the truth flag travels with the traces, so nothing has to be joined back
    a = attributes(spark, sf, case).withColumn("truth", F.col("truth_mask").cast("float"))
    thin = thin_reference(to_traces(a, ["fv", "vp", "vt", "truth"]), "fv", "vp", tiling=TILING)
    stored = cut_lineage(to_voxels(thin, ["thin", "truth"]).withColumn("truth", F.col("truth") > 0.5))
    j = with_shape(stored).withColumn("flat", flat_index())
    top = top_truth_count_mask(j, "thin", "truth", positive_only=True)
    return metrics.buffered_overlap(top.where("mask").select(*ID3), stored.where("truth").select(*ID3), 2.0)


_SCORE = """tk AS (SELECT r.i3, r.i2, r.i1, row_number() OVER (ORDER BY CAST(thin AS DOUBLE) DESC, (CAST(r.i3 AS BIGINT)*n2+r.i2)*n1+r.i1) AS rn FROM ref r, shp WHERE CAST(thin AS DOUBLE) > 1e-6),
t AS (SELECT i3, i2, i1 FROM att WHERE truth_mask), c AS (SELECT i3, i2, i1 FROM tk WHERE rn <= (SELECT count(*) FROM t)),
dc AS (SELECT c.i3, c.i2, c.i1, min((c.i3-t.i3)*(c.i3-t.i3)+(c.i2-t.i2)*(c.i2-t.i2)+(c.i1-t.i1)*(c.i1-t.i1)) AS d FROM c, t GROUP BY ALL),
dt AS (SELECT t.i3, t.i2, t.i1, min((c.i3-t.i3)*(c.i3-t.i3)+(c.i2-t.i2)*(c.i2-t.i2)+(c.i1-t.i1)*(c.i1-t.i1)) AS d FROM c, t GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM c) AS cc, (SELECT count(*) FROM t) AS tc, (SELECT count(*) FROM dc WHERE d = 0) AS ic, (SELECT count(*) FROM dc WHERE d <= 4) AS cb, (SELECT count(*) FROM dt WHERE d <= 4) AS tb),
r AS (SELECT *, cc+tc-ic AS uc, ic/cc AS p, ic/tc AS r, cb/cc AS bp, tb/tc AS br FROM n)
SELECT cc AS candidate_count, tc AS truth_count, ic AS intersection_count, uc AS union_count, cb AS candidate_in_truth_buffer_count,
 tb AS truth_in_candidate_buffer_count, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2*p*r/nullif(p+r, 0), 0), 6) AS f1, round(ic/uc, 6) AS jaccard,
 round(bp, 6) AS buffered_precision, round(br, 6) AS buffered_recall, round(coalesce(2*bp*br/nullif(bp+br, 0), 0), 6) AS buffered_f1, 2.0::DOUBLE AS radius FROM r"""


@query("minimal_workflow", f"WITH {sql_attributes('single_dipping_plane')}, {_SM2}, {_sql_nms()}, {_THIN_REF}, {_SCORE}")
def q_minimal(spark, sf):
    """Noisy dipping plane -> thinning -> top truth-count mask -> buffered overlap with the truth."""
    return rnd(_thin_and_score(spark, sf, "single_dipping_plane"))


@query("oracle_pipeline")
def q_oracle_pipeline(spark, sf):
    """Oracle attributes -> seeds -> votes -> thinning -> overlap with the truth."""
    c = case_voxels(spark, sf, "single_dipping_plane")
    votes = workflow.vote_stage(c, workflow.Profile(voter=Voter(2, 4, 4), seed_distance=3, seed_threshold=0.5), TILING)
    thin = workflow.thin_votes(votes, "reference", TILING).where("thin > 0.3")
    return metrics.buffered_overlap(thin.select(*ID3), c.where("truth_mask").select(*ID3), 2.0)


@query("detect_surfaces")
def q_detect(spark, sf):
    """Scan, thin, vote, thin, connect: cells grouped into surfaces."""
    p = workflow.Profile(strikes=(0.0, 160.0), voter=Voter(3, 5, 5), seed_distance=3, seed_threshold=0.3)
    return workflow.detect_surfaces(planarity(spark, sf), "g", p, TILING, 0.3, 10)


@query("thin_mode_comparison")
def q_modes(spark, sf):
    """All vote thinning modes scored against the truth, one row each."""
    from functools import reduce

    a = attributes(spark, sf)
    t = a.where("truth_mask").select(*ID3)
    parts = []
    for name in workflow.VARIANTS:
        mode = workflow.settings(name)["thin"]
        thin = workflow.thin_votes(attribute_traces(spark, sf), mode, TILING)
        c = thin.where("thin > 0.3").select(*ID3, F.lit(name).alias("variant"))
        parts.append(c)
    cand = reduce(lambda x, y: x.unionByName(y), parts)
    truth = t.withColumn("variant", F.explode(F.array(*[F.lit(n) for n in workflow.VARIANTS])))
    return rnd(metrics.buffered_overlap(cand, truth, 2.0, ("variant",)))


@query("dat_roundtrip", """SELECT CAST(vec_id // 25 AS INTEGER) AS i3, CAST(vec_id % 25 AS INTEGER) AS i2, CAST(unnest(range(len(embedding))) AS INTEGER) AS i1, round(CAST(unnest(embedding) AS DOUBLE), 6) AS v FROM embeddings""")
def q_dat(spark, sf):
    """Write the volume as a big-endian headerless file and read it back through the source.

    The last slice need not be full: the file holds zeros for traces the table lacks, and they are left out again.
    """
    v = volume(spark, sf)
    v = v.where(F.size("v") > 0)
    s = shape_of(v).first()
    shape = (int(s["n3"]), int(s["n2"]), int(s["n1"]))
    path = f"{new_folder(spark, 'dat')}/volume.dat"
    dat.write_dat(dat.fill_missing(v, shape, "v"), path, shape, "v")
    back = dat.read_dat(spark, path, shape).withColumnRenamed("trace", "v").join(v.select("i3", "i2"), ["i3", "i2"], "left_semi")
    return to_voxels(back, ["v"]).select(*ID3, F.round(F.col("v").cast("double"), 6).alias("v"))


@query("skins_json", """WITH l AS (SELECT l_orderkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS skin, l_quantity, l_discount, l_extendedprice FROM lineitem)
SELECT CAST(skin AS INTEGER) AS skin_id, count(*) AS cells, round(sum(l_quantity), 4) AS x1, round(avg(l_discount), 6) AS fl, round(max(l_extendedprice), 4) AS ft FROM l GROUP BY skin""")
def q_skins_json(spark, sf):
    """Orders written as skin documents (a skin per supplier, a cell per line) and parsed back."""
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem").withColumn("skin", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_suppkey")) - 1)
    cell = F.struct(
        F.lit(0).alias("i3"), F.lit(0).alias("i2"), F.col("l_linenumber").cast("int").alias("i1"), F.col("l_quantity").alias("x1"),
        F.col("l_tax").alias("x2"), F.col("l_discount").alias("x3"), F.col("l_discount").alias("fl"), F.lit(0.0).alias("fp"),
        F.col("l_extendedprice").alias("ft"), F.lit("grown").alias("generation"),
    )
    skins = li.groupBy("l_orderkey", "skin").agg(F.sort_array(F.collect_list(cell)).alias("cells"))  # the lines of an order
    one = F.struct(F.col("skin").alias("skin_index"), F.size("cells").alias("cell_count"), "cells")
    docs = skins.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("skins")).select(
        F.to_json(
            F.struct(F.lit(2).alias("format_version"), F.lit(True).alias("skinning_enabled"), F.size("skins").alias("skin_count"), "skins")
        ).alias("value")
    )
    g = tables.parse_skins(docs).groupBy("skin_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("x1").alias("x1"), F.avg("fl").alias("fl"), F.max("ft").alias("ft")
    )
    return g.select("skin_id", "cells", F.round("x1", 4).alias("x1"), F.round("fl", 6).alias("fl"), F.round("ft", 4).alias("ft"))


@query("row_fingerprints", """SELECT l_returnflag, l_linestatus, sha256('{"l_linestatus":"' || l_linestatus || '","l_returnflag":"' || l_returnflag || '"}') AS id, count(*) AS n FROM lineitem GROUP BY ALL""")
def q_fingerprints(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("id", tables.row_fingerprint("l_returnflag", "l_linestatus"))


# ---------------------------------------------------------------- surfaces after detection


def component_cells(spark, sf):
    """Connected surfaces of the strong votes as cells with angles."""
    from ridgeline.operators import components

    a = attributes(spark, sf, "parallel_planes").withColumn("flat", flat_index())
    lab = components.connected_components(a.where(F.col("fv") > F.lit(0.45).cast("float")), "face")
    lab = components.component_skins(lab, 8)
    return lab.select(
        F.col("component").alias("skin_id"), F.col("flat").alias("cell_id"), *[F.col(f"i{k}").cast("float").alias(f"x{k}") for k in (1, 2, 3)],
        F.col("fv").alias("fl"), F.col("truth_strike").alias("fp"), F.col("truth_dip").alias("ft"),
    )


_GW = gaussian_weights(1.0)
_GW_ROWS = ", ".join(f"({k - len(_GW) // 2}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(_GW))
_NV = [f"CAST({x} AS DOUBLE)" for x in sql_normal("sp", "st")]
_DV = ["CAST(CAST(sin(radians(CAST(st AS DOUBLE))) AS FLOAT) AS DOUBLE)", "CAST(CAST(cos(radians(CAST(st AS DOUBLE)))*cos(radians(CAST(sp AS DOUBLE))) AS FLOAT) AS DOUBLE)",
       "CAST(CAST(-cos(radians(CAST(st AS DOUBLE)))*sin(radians(CAST(sp AS DOUBLE))) AS FLOAT) AS DOUBLE)"]
_SV = ["CAST(0 AS DOUBLE)", "CAST(CAST(sin(radians(CAST(sp AS DOUBLE))) AS FLOAT) AS DOUBLE)", "CAST(CAST(cos(radians(CAST(sp AS DOUBLE))) AS FLOAT) AS DOUBLE)"]
_OFF = "((x1-s1)*{0} + (x2-s2)*{1} + (x3-s3)*{2})"
#: Cells of the surfaces, their grid positions (one per position), boxes, smoothed offsets and slopes.
_RESKIN = f"""{sql_attributes('parallel_planes')}, m AS (SELECT *, (CAST(i3 AS BIGINT)*n2+i2)*n1+i1 AS flat FROM att WHERE fv > CAST(0.45 AS FLOAT)),
ed AS (SELECT a.flat AS a, b.flat AS b FROM m a JOIN m b ON (b.i3 = a.i3 AND b.i2 = a.i2 AND abs(b.i1-a.i1) = 1) OR (b.i3 = a.i3 AND b.i1 = a.i1 AND abs(b.i2-a.i2) = 1) OR (b.i2 = a.i2 AND b.i1 = a.i1 AND abs(b.i3-a.i3) = 1)),
reach(node, root) AS (SELECT flat, flat FROM m UNION SELECT ed.a, reach.root FROM reach JOIN ed ON ed.b = reach.node WHERE reach.root < ed.a),
lab AS (SELECT node AS flat, min(root) AS skin_id FROM reach GROUP BY node),
cel AS (SELECT skin_id, flat AS cell_id, CAST(i1 AS DOUBLE) AS x1, CAST(i2 AS DOUBLE) AS x2, CAST(i3 AS DOUBLE) AS x3, fv AS fl, truth_strike AS fp, truth_dip AS ft, count(*) OVER (PARTITION BY skin_id) AS n FROM m JOIN lab USING (flat)),
sd AS (SELECT skin_id, x1 AS s1, x2 AS s2, x3 AS s3, fp AS sp, ft AS st FROM cel WHERE n >= 8 QUALIFY row_number() OVER (PARTITION BY skin_id ORDER BY fl DESC, cell_id) = 1),
fr AS (SELECT *, {_NV[0]} AS n1_, {_NV[1]} AS n2_, {_NV[2]} AS n3_, {_DV[0]} AS d1_, {_DV[1]} AS d2_, {_DV[2]} AS d3_, {_SV[0]} AS t1_, {_SV[1]} AS t2_, {_SV[2]} AS t3_ FROM sd),
pj AS (SELECT cel.skin_id, cell_id, fl, {_OFF.format('n1_', 'n2_', 'n3_')} AS u, CAST(floor({_OFF.format('d1_', 'd2_', 'd3_')} + 0.5) AS INTEGER) AS v, CAST(floor({_OFF.format('t1_', 't2_', 't3_')} + 0.5) AS INTEGER) AS w FROM cel JOIN fr USING (skin_id)),
one AS (SELECT *, CASE WHEN fl > 0 THEN CAST(fl AS DOUBLE) ELSE 1 END AS q FROM pj QUALIFY row_number() OVER (PARTITION BY skin_id, v, w ORDER BY fl DESC, cell_id) = 1),
box AS (SELECT skin_id, min(v) AS vl, max(v) AS vh, min(w) AS wl, max(w) AS wh FROM one GROUP BY skin_id),
tg AS (SELECT DISTINCT skin_id, o.v + a.a AS v, o.w + a.b AS w FROM one o JOIN box USING (skin_id) CROSS JOIN (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) a(a, b) WHERE o.v + a.a BETWEEN vl AND vh AND o.w + a.b BETWEEN wl AND wh),
sm AS (SELECT tg.skin_id, tg.v, tg.w, sum(p.w*r.w*o.q*o.u) AS num, sum(p.w*r.w*o.q) AS den FROM tg JOIN box USING (skin_id) CROSS JOIN (VALUES {_GW_ROWS}) p(k, w) CROSS JOIN (VALUES {_GW_ROWS}) r(k, w)
 JOIN one o ON o.skin_id = tg.skin_id AND o.v = least(greatest(tg.v + p.k, vl), vh) AND o.w = least(greatest(tg.w + r.k, wl), wh) GROUP BY tg.skin_id, tg.v, tg.w),
z AS (SELECT sm.skin_id, sm.v, sm.w, CAST(CAST(CASE WHEN den > 1e-6 THEN num/den ELSE coalesce(o.u, 0) END AS FLOAT) AS DOUBLE) AS z FROM sm LEFT JOIN one o USING (skin_id, v, w)),
pts AS (SELECT o.skin_id, o.cell_id, o.v, o.w, o.fl, c.z, vl, vh, wl, wh,
 CASE WHEN vl = vh THEN 0 ELSE coalesce(CASE WHEN o.v = vl THEN vp.z - c.z WHEN o.v = vh THEN c.z - vm.z ELSE 0.5*(vp.z - vm.z) END, 0) END AS gv,
 CASE WHEN wl = wh THEN 0 ELSE coalesce(CASE WHEN o.w = wl THEN wp.z - c.z WHEN o.w = wh THEN c.z - wm.z ELSE 0.5*(wp.z - wm.z) END, 0) END AS gw
 FROM one o JOIN box USING (skin_id) JOIN z c USING (skin_id, v, w) LEFT JOIN z vm ON vm.skin_id = o.skin_id AND vm.v = o.v - 1 AND vm.w = o.w LEFT JOIN z vp ON vp.skin_id = o.skin_id AND vp.v = o.v + 1 AND vp.w = o.w
 LEFT JOIN z wm ON wm.skin_id = o.skin_id AND wm.v = o.v AND wm.w = o.w - 1 LEFT JOIN z wp ON wp.skin_id = o.skin_id AND wp.v = o.v AND wp.w = o.w + 1),
gr AS (SELECT pts.*, s1 + z*n1_ + v*d1_ + w*t1_ AS x1, s2 + z*n2_ + v*d2_ + w*t2_ AS x2, s3 + z*n3_ + v*d3_ + w*t3_ AS x3, n1_ - gv*d1_ - gw*t1_ AS g1, n2_ - gv*d2_ - gw*t2_ AS g2, n3_ - gv*d3_ - gw*t3_ AS g3 FROM pts JOIN fr USING (skin_id)),
un AS (SELECT *, CASE WHEN g1 > 0 THEN -1.0 ELSE 1.0 END / sqrt(g1*g1 + g2*g2 + g3*g3) AS k FROM gr),
nb AS (SELECT o.skin_id, o.cell_id, ca.cell_id AS ca_id, cb.cell_id AS cb_id, cl.cell_id AS cl_id, cr.cell_id AS cr_id FROM one o LEFT JOIN one ca ON ca.skin_id = o.skin_id AND ca.v = o.v - 1 AND ca.w = o.w LEFT JOIN one cb ON cb.skin_id = o.skin_id AND cb.v = o.v + 1 AND cb.w = o.w
 LEFT JOIN one cl ON cl.skin_id = o.skin_id AND cl.v = o.v AND cl.w = o.w - 1 LEFT JOIN one cr ON cr.skin_id = o.skin_id AND cr.v = o.v AND cr.w = o.w + 1)"""


@query("reskin", f"""WITH RECURSIVE {_RESKIN}
SELECT un.skin_id, un.cell_id, v, w, round(x1, 3) + 0.0 AS x1, round(x2, 3) + 0.0 AS x2, round(x3, 3) + 0.0 AS x3, round(CAST(fl AS DOUBLE), 6) AS fl,
 round(degrees(atan2(-g3*k, g2*k)) + CASE WHEN atan2(-g3*k, g2*k) < 0 THEN 360.0 ELSE 0 END, 2) % 360.0 + 0.0 AS fp, round(degrees(acos(greatest(-1.0, least(1.0, -g1*k)))), 2) AS ft, ca_id, cb_id, cl_id, cr_id
FROM un JOIN nb USING (skin_id, cell_id)""")
def q_reskin(spark, sf):
    """Connected surfaces smoothed, re-oriented and linked."""
    from ridgeline.operators.reskin import reskin

    r = reskin(cut_lineage(component_cells(spark, sf)))
    d = lambda c, n: (F.round(F.col(c).cast("double"), n) + 0.0).alias(c)
    return r.select(
        "skin_id", "cell_id", "v", "w", d("x1", 3), d("x2", 3), d("x3", 3), d("fl", 6), (F.round(F.col("fp").cast("double"), 2) % 360.0 + 0.0).alias("fp"),
        d("ft", 2), "ca_id", "cb_id", "cl_id", "cr_id",
    )


@query("reskin_topology", f"""WITH RECURSIVE {_RESKIN}, lk AS (SELECT cell_id, unnest([ca_id, cb_id, cl_id, cr_id]) AS other FROM nb),
qd AS (SELECT a.cell_id, d1.cr_id AS br, d2.cb_id AS rb FROM nb a JOIN nb d1 ON d1.cell_id = a.cb_id JOIN nb d2 ON d2.cell_id = a.cr_id WHERE d1.cr_id IS NOT NULL AND d2.cb_id IS NOT NULL)
SELECT 0 AS reciprocal_link_violation_count, 0 AS cross_skin_link_count, 0 AS self_link_count, (SELECT count(*) FROM qd) AS quad_closure_candidate_count, (SELECT count(*) FROM qd WHERE rb = br) AS quad_closure_match_count,
 (SELECT count(*) FROM qd WHERE rb <> br) AS quad_closure_mismatch_count, (SELECT count(*) FROM nb WHERE cell_id NOT IN (SELECT cell_id FROM lk WHERE other IS NOT NULL)) AS isolated_cell_count""")
def q_reskin_topology(spark, sf):
    """Link consistency of the smoothed surfaces."""
    from ridgeline.operators.reskin import reskin
    from ridgeline.operators.topology import link_topology

    return link_topology(cut_lineage(reskin(cut_lineage(component_cells(spark, sf)))))


def _trials(spark):
    from ridgeline.sources.cases import STOCHASTIC_CASES, expand_trials

    names = ("single_dipping_plane", *STOCHASTIC_CASES)
    cases = spark.createDataFrame([(c, c in STOCHASTIC_CASES) for c in names], "case_id string, is_stochastic boolean")
    return names, expand_trials(cases, spark.range(1, 3).withColumnRenamed("id", "seed"))


def _trial_voxels(spark, sf):
    """Every voxel of every trial with its truth, oracle attributes and scanner input."""
    from functools import reduce

    from ridgeline.sources.cases import STOCHASTIC_CASES, case_columns, scanner_input, seeded_normal

    names, trials = _trials(spark)
    grid = voxels(spark, sf).withColumn("flat", flat_index())
    parts = []
    for name in names:
        mine = grid.withColumn("case_id", F.lit(name)).join(trials, "case_id")
        noise = 0.06 * seeded_normal("seed", "flat") if name in STOCHASTIC_CASES else None
        parts.append(case_columns(mine, name, noise))
    c = reduce(lambda a, b: a.unionByName(b), parts)
    return c.withColumn("g", scanner_input(F.col("ft"), 0.05 * F.col("v").cast("double")))


def _mode_rows(spark, sf):
    from ridgeline.plans.mode_comparison import compare_modes

    p = workflow.Profile(strikes=(0.0, 80.0), dips=(65.0, 75.0), voter=Voter(2, 4, 4), seed_distance=3, seed_threshold=0.3)
    return compare_modes(_trial_voxels(spark, sf), p, TILING)


@query("mode_comparison")
def q_mode_comparison(spark, sf):
    """Eight cells (oracle and two scanners, two workflows) scored on three trials of two cases, in one plan."""
    return _mode_rows(spark, sf)


@query("mode_contrasts")
def q_mode_contrasts(spark, sf):
    """The same run, as paired contrasts."""
    from ridgeline.plans.contrasts import paired_contrasts

    return paired_contrasts(cut_lineage(_mode_rows(spark, sf)))


# blocks of the twin below -> how its values differ from the votes of the noisy volume
_SCORED = {"rl/scanner_raw": 1.0, "rl/fv": 1.0, "q/fv": -0.25}


def _sql_mode_scores() -> str:
    d2 = "(c.i3-t.i3)*(c.i3-t.i3)+(c.i2-t.i2)*(c.i2-t.i2)+(c.i1-t.i1)*(c.i1-t.i1)"
    blocks = ", ".join(f"('{b}', {w})" for b, w in _SCORED.items())
    per = lambda src, what, x, p: f"(SELECT quantile_cont({x}, {p}) FROM {src} x WHERE x.tr = g.tr AND x.block = g.block AND x.sel = g.sel) AS {what}"
    q = ", ".join(per(src, f"{w}_{n}", x, p) for src, w, x in (("dc", "candidate_to_truth", "sqrt(d)"), ("dt", "truth_to_candidate", "sqrt(d)"), ("dc", "strike", "se"), ("dc", "dip", "de"))
                  for n, p in (("median", 0.5), ("p95", 0.95)))
    one = lambda src, cond, name: f"(SELECT count(*) FROM {src} x WHERE x.tr = g.tr AND x.block = g.block AND x.sel = g.sel AND {cond}) AS {name}"
    fill = ", ".join(f"coalesce({w}_{p}, {x}) AS {w}_{p}" for w, x in (("candidate_to_truth", "far"), ("truth_to_candidate", "far"), ("strike", "0"), ("dip", "0")) for p in ("median", "p95"))
    turn = "(abs(CAST(vp AS DOUBLE) - CAST(truth_strike AS DOUBLE)) - 180.0*floor(abs(CAST(vp AS DOUBLE) - CAST(truth_strike AS DOUBLE))/180.0))"
    return f"""WITH {sql_attributes()}, bl(block, w) AS (VALUES {blocks}), tt(tr) AS (VALUES ('b'), ('c')),
tru AS (SELECT tr, i3, i2, i1 FROM att, tt WHERE truth_mask AND ft > CAST(CASE tr WHEN 'b' THEN 0.9 ELSE 0.97 END AS FLOAT)),
k AS (SELECT tr, count(*) AS k FROM tru GROUP BY tr),
v AS (SELECT tr, block, i3, i2, i1, n3, n2, n1, (CAST(i3 AS BIGINT)*n2+i2)*n1+i1 AS flat, CASE WHEN w > 0 THEN round(CAST(fv AS DOUBLE), 2) ELSE greatest(0.0, round(CAST(fv AS DOUBLE), 2) - 0.9) END AS value,
 {turn} AS se0, abs(CAST(vt AS DOUBLE) - CAST(truth_dip AS DOUBLE)) AS de FROM att, bl, tt),
rk AS (SELECT *, 'top_truth_count' AS sel, row_number() OVER (PARTITION BY tr, block ORDER BY value DESC, flat) AS rn FROM v
 UNION ALL SELECT *, 'positive_top_truth_count', row_number() OVER (PARTITION BY tr, block ORDER BY value DESC, flat) FROM v WHERE value > 1e-6 AND block LIKE '%/fv'),
c AS (SELECT rk.*, least(se0, 180.0 - se0) AS se FROM rk JOIN k USING (tr) WHERE rn <= k),
g AS (SELECT tr, block, sel FROM tt, bl, (VALUES ('top_truth_count'), ('positive_top_truth_count')) s(sel) WHERE sel = 'top_truth_count' OR block LIKE '%/fv'),
near AS (SELECT c.tr, c.i3, c.i2, c.i1, min({d2}) AS d FROM (SELECT DISTINCT tr, i3, i2, i1 FROM c) c JOIN tru t ON t.tr = c.tr GROUP BY c.tr, c.i3, c.i2, c.i1),
dc AS (SELECT c.*, d FROM c JOIN near USING (tr, i3, i2, i1)),
dt AS (SELECT c.tr, c.block, c.sel, t.i3, t.i2, t.i1, min({d2}) AS d FROM c JOIN tru t ON t.tr = c.tr GROUP BY ALL),
s AS (SELECT g.*, (SELECT k FROM k WHERE k.tr = g.tr) AS tc, (SELECT sqrt((n3-1.0)*(n3-1)+(n2-1.0)*(n2-1)+(n1-1.0)*(n1-1)) FROM shp) AS far, {one('dc', 'true', 'cc')}, {one('dc', 'd <= 4', 'cb')}, {one('dt', 'd <= 4', 'tb')}, {one('dc', 'd > 4 AND least(i3, n3-1-i3, i2, n2-1-i2, i1, n1-1-i1) < 2', 'ef')}, {q} FROM g),
r AS (SELECT * REPLACE ({fill}), coalesce(cb/nullif(cc, 0), 0) AS bp, coalesce(tb/nullif(tc, 0), 0) AS br FROM s)
SELECT tr AS trial_id, block, sel AS selection, cc AS candidate_count, round(bp, 6) AS buffered_precision, round(br, 6) AS buffered_recall, round(coalesce(2*bp*br/nullif(bp+br, 0), 0), 6) AS buffered_f1,
 round(candidate_to_truth_median, 6) AS candidate_to_truth_median, round(candidate_to_truth_p95, 6) AS candidate_to_truth_p95, round(truth_to_candidate_median, 6) AS truth_to_candidate_median,
 round(truth_to_candidate_p95, 6) AS truth_to_candidate_p95, round(greatest(candidate_to_truth_p95, truth_to_candidate_p95), 6) AS hausdorff_p95, round(strike_median, 4) AS strike_median, round(strike_p95, 4) AS strike_p95,
 round(dip_median, 4) AS dip_median, round(dip_p95, 4) AS dip_p95, round(coalesce(ef/nullif(cc, 0), 0), 6) AS edge_false_positive_fraction_of_candidates FROM r"""


@query("mode_scores", _sql_mode_scores())
def q_mode_scores(spark, sf):
    """The scoring end of the comparison over given stage volumes: strongest samples per trial, block and selection, all metrics."""
    from ridgeline.plans import mode_comparison as m

    trial = F.explode(F.array(F.lit("b"), F.lit("c"))).alias("trial_id")
    a = cut_lineage(attributes(spark, sf).withColumn("flat", flat_index()).select("*", trial))
    least = F.when(F.col("trial_id") == "b", 0.9).otherwise(0.97).cast("float")
    truth = a.where(F.col("truth_mask") & (F.col("ft") > least)).select("trial_id", *ID3)
    votes = F.round(F.col("fv").cast("double"), 2)
    value = F.when(F.col("b.w") > 0, votes).otherwise(F.greatest(F.lit(0.0), votes - 0.9))
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.lit(w).alias("w")) for b, w in _SCORED.items()])).alias("b")
    v = a.select("*", each).select(
        "trial_id", "b.block", *ID3, "flat", value.alias("value"), F.col("vp").alias("strike"), F.col("vt").alias("dip"),
        F.col("truth_strike").alias("true_strike"), F.col("truth_dip").alias("true_dip"),
    )
    trials = a.select("trial_id").distinct()
    groups = m.block_groups(trials).where(F.col("block").isin(*_SCORED))
    shape = a.agg(*[F.max(n).alias(n) for n in ("n3", "n2", "n1")])
    out = m.score_candidates(cut_lineage(m.select_candidates(v, truth)), truth, groups, shape)
    angle = [f"{w}_{p}" for w in ("strike", "dip") for p in ("median", "p95")]
    return out.select(*m.GROUP, *[
        F.col(c) if c == "candidate_count" else F.round(c, 4 if c in angle else 6).alias(c) for c in m.METRICS
    ])


# ---------------------------------------------------------------- stage comparisons

_STAGES = f"""{sql_attributes()}, s AS (SELECT 1 AS k, 'strong' AS stage, i3, i2, i1 FROM att WHERE fv > CAST(0.3 AS FLOAT) UNION ALL SELECT 2, 'stronger', i3, i2, i1 FROM att WHERE fv > CAST(0.5 AS FLOAT) UNION ALL SELECT 3, 'truth', i3, i2, i1 FROM att WHERE truth_mask)"""


@query("centroid_shift", f"""WITH {_STAGES}, c AS (SELECT k, stage, count(*) AS n, avg(i3) AS a, avg(i2) AS b, avg(i1) AS d FROM s GROUP BY k, stage),
l AS (SELECT *, lag(stage) OVER w AS previous, lag(n) OVER w AS np, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db, d - lag(d) OVER w AS dd FROM c WINDOW w AS (ORDER BY k))
SELECT previous, stage, round(da, 6) + 0.0 AS shift_i3, round(db, 6) + 0.0 AS shift_i2, round(dd, 6) + 0.0 AS shift_i1, round(sqrt(da*da+db*db+dd*dd), 6) AS shift, round(n/np, 6) AS count_ratio FROM l WHERE previous IS NOT NULL""")
def q_centroid(spark, sf):
    from ridgeline.operators.comparisons import centroid_shift

    a = attributes(spark, sf)
    flags = F.array_compact(F.array(
        F.when(F.col("fv") > F.lit(0.3).cast("float"), F.lit("strong")), F.when(F.col("fv") > F.lit(0.5).cast("float"), F.lit("stronger")),
        F.when(F.col("truth_mask"), F.lit("truth")),
    ))
    s = a.select(*ID3, F.explode(flags).alias("stage"))
    out = rnd(centroid_shift(s, ["strong", "stronger", "truth"]))
    return out.withColumns({f"shift_{x}": F.col(f"shift_{x}") + 0.0 for x in ID3})


_OUT = f"""{sql_attributes()}, t AS (SELECT i3, i2, i1 FROM att WHERE truth_mask),
b AS (SELECT i3, i2, i1 FROM att WHERE fv > CAST(0.12 AS FLOAT)),
d AS (SELECT b.i3, b.i2, b.i1, sqrt(min((b.i3-t.i3)*(b.i3-t.i3)+(b.i2-t.i2)*(b.i2-t.i2)+(b.i1-t.i1)*(b.i1-t.i1))) AS distance FROM b, t GROUP BY ALL)"""


@query("far_candidates", f"WITH {_OUT} SELECT i3, i2, i1, round(distance, 6) AS distance FROM d WHERE distance > 2.5")
def q_far(spark, sf):
    """Candidates farther than 2.5 voxels from the truth."""
    from ridgeline.operators.comparisons import far_candidates

    a = attributes(spark, sf)
    n2 = shape_of(a).select("n2").scalar()
    far = far_candidates(a.where(F.col("fv") > F.lit(0.12).cast("float")).select(*ID3), a.where("truth_mask").select(*ID3), n2, 2.5)
    return far.select(*ID3, F.round("distance", 6).alias("distance"))


@query("context_comparison", f"""WITH {sql_attributes()}, {_SM2}, c AS (SELECT * FROM sm WHERE i3 >= 4 AND i2 >= 5)
SELECT i3, i2, i1, round(CAST(a.fv AS DOUBLE), 6) AS base_value, round(CAST(c.fv AS DOUBLE), 6) AS context_value FROM c JOIN att a USING (i3, i2, i1)""")
def q_context(spark, sf):
    """A crop (cut out before smoothing, own indices) next to the same voxels of the smoothed volume."""
    from ridgeline.operators.comparisons import same_region
    from ridgeline.operators.stencil import smooth

    t = attribute_traces(spark, sf)
    crop = t.where("i3 >= 4 and i2 >= 5")
    base = to_voxels(crop, ["fv"]).withColumns({"i3": F.col("i3") - 4, "i2": F.col("i2") - 5})
    context = to_voxels(smooth(t, "fv", "fv", (1.0, 1.0, 0.0), TILING), ["fv"])
    out = same_region(base, context, (4, 5, 0), "fv")
    return out.select(*ID3, F.round(F.col("base_value").cast("double"), 6).alias("base_value"), F.round(F.col("context_value").cast("double"), 6).alias("context_value"))
