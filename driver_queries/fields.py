"""Sampling, ensembles, regional diagnostics, fallback decisions, graph contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import IMG, TILING, VOX, attribute_traces, attributes, image, query, r6, s6, sql_attributes, table, voxels
from driver_queries.scoring import _CELLS, _cells, rnd
from driver_queries.stencils import _PLATEAU, _SM2, _THIN_NRM, _THIN_REF, _sql_nms
from ridgeline.functions.scores import near_edge, ratio, unit_range
from ridgeline.grid import flat_index, to_voxels, with_shape
from ridgeline.operators import components, edges, metrics, sampling, scan_bank, seeds, thinning, topology
from ridgeline.plans import surface_graph

ID3 = ["i3", "i2", "i1"]
A = sql_attributes()


def image_voxels(spark, sf):
    return with_shape(to_voxels(image(spark, sf), ["v"]))


@query("sample_points", f"""WITH {VOX}, p AS (SELECT event_id AS point_id, greatest(0.0, least(n3-1.0, CAST(CAST(value/9.7 - 1.0 AS FLOAT) AS DOUBLE))) AS x3,
 greatest(0.0, least(n2-1.0, CAST(CAST(event_id*0.37 % 30.0 - 2.0 AS FLOAT) AS DOUBLE))) AS x2, greatest(0.0, least(n1-1.0, CAST(CAST(user_id*0.61 % 70.0 AS FLOAT) AS DOUBLE))) AS x1 FROM events, shp),
c AS (SELECT p.point_id, CAST(floor(x3) AS INTEGER)+a.k AS i3, CAST(floor(x2) AS INTEGER)+b.k AS i2, CAST(floor(x1) AS INTEGER)+d.k AS i1,
 (CASE a.k WHEN 1 THEN x3-floor(x3) ELSE 1-(x3-floor(x3)) END)*(CASE b.k WHEN 1 THEN x2-floor(x2) ELSE 1-(x2-floor(x2)) END)*(CASE d.k WHEN 1 THEN x1-floor(x1) ELSE 1-(x1-floor(x1)) END) AS w
 FROM p CROSS JOIN (VALUES (0), (1)) a(k) CROSS JOIN (VALUES (0), (1)) b(k) CROSS JOIN (VALUES (0), (1)) d(k))
SELECT point_id, round(CAST(CAST(sum(w*CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE), 5) AS v FROM c JOIN vox USING (i3, i2, i1) WHERE w > 0 GROUP BY point_id""")
def q_sample(spark, sf):
    """Trilinear samples at one position per event, some of them off the grid."""
    s = voxels(spark, sf).select("n3", "n2", "n1").limit(1)
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("point_id"), (F.col("value") / 9.7 - 1.0).alias("x3"), (F.col("event_id") * 0.37 % 30.0 - 2.0).alias("x2"),
        (F.col("user_id") * 0.61 % 70.0).alias("x1"), *[s.select(n).scalar().alias(n) for n in ("n3", "n2", "n1")],
    )
    return sampling.sample(voxels(spark, sf), e, "v").select("point_id", F.round(F.col("v").cast("double"), 5).alias("v"))


@query("rotate_image", f"""WITH {IMG}, s AS (SELECT max(i2)+1 AS n2, max(i1)+1 AS n1 FROM img),
p AS (SELECT i2, i1, greatest(0.0, least(n2-1.0, CAST(CAST(cos(radians(20.0))*(i2-(n2-1)/2.0) + sin(radians(20.0))*(i1-(n1-1)/2.0) + (n2-1)/2.0 AS FLOAT) AS DOUBLE))) AS x2,
 greatest(0.0, least(n1-1.0, CAST(CAST(-sin(radians(20.0))*(i2-(n2-1)/2.0) + cos(radians(20.0))*(i1-(n1-1)/2.0) + (n1-1)/2.0 AS FLOAT) AS DOUBLE))) AS x1 FROM img, s),
c AS (SELECT p.i2 AS q2, p.i1 AS q1, CAST(floor(x2) AS INTEGER)+b.k AS i2, CAST(floor(x1) AS INTEGER)+d.k AS i1,
 (CASE b.k WHEN 1 THEN x2-floor(x2) ELSE 1-(x2-floor(x2)) END)*(CASE d.k WHEN 1 THEN x1-floor(x1) ELSE 1-(x1-floor(x1)) END) AS w FROM p CROSS JOIN (VALUES (0), (1)) b(k) CROSS JOIN (VALUES (0), (1)) d(k))
SELECT q2 AS i2, q1 AS i1, round(CAST(CAST(sum(w*CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE), 4) AS v FROM c JOIN img USING (i2, i1) WHERE w > 0 GROUP BY q2, q1""")
def q_rotate(spark, sf):
    r = sampling.rotate_image(image_voxels(spark, sf), "v", 20.0)
    return r.select("i2", "i1", F.round(F.col("v").cast("double"), 4).alias("v"))


@query("seeds_to_image", f"""WITH {A} SELECT i3, i2, i1, round(CAST(CASE WHEN truth_mask AND fv > CAST(0.6 AS FLOAT) THEN fv ELSE 0 END AS DOUBLE), 6) AS seed_value FROM att""")
def q_seed_image(spark, sf):
    a = attributes(spark, sf)
    s = sampling.seeds_to_image(a, a.where("truth_mask"), "fv", 0.6)
    return s.select(*ID3, r6("seed_value"))


@query("richest_sections", f"""WITH {A}, r AS (SELECT * FROM att WHERE fv > CAST(0.5 AS FLOAT)),
l AS (SELECT 'i3' AS axis, i3 AS idx, n3 AS n FROM r UNION ALL SELECT 'i2', i2, n2 FROM r UNION ALL SELECT 'i1', i1, n1 FROM r),
c AS (SELECT axis, idx, CAST(floor(idx*4/n) AS INTEGER) AS bin, count(*) AS samples FROM l GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY axis, bin ORDER BY samples DESC, idx) AS rn FROM c)
SELECT axis, bin, samples, idx FROM k WHERE rn = 1""")
def q_sections(spark, sf):
    return sampling.richest_sections(attributes(spark, sf).where(F.col("fv") > F.lit(0.5).cast("float")))


@query("regional_correlation", f"""WITH {A}, g AS (SELECT *, CASE WHEN least(i3, n3-1-i3, i2, n2-1-i2, i1, n1-1-i1) < 4 THEN 'boundary' ELSE 'interior' END AS region FROM att)
SELECT region, round(coalesce(covar_pop(CAST(fv AS DOUBLE), CAST(ft AS DOUBLE))/nullif(stddev_pop(CAST(fv AS DOUBLE))*stddev_pop(CAST(ft AS DOUBLE)), 0), 0), 6) AS correlation,
 round(avg(abs(CAST(fv AS DOUBLE)-CAST(ft AS DOUBLE))), 6) AS mean_abs_difference, round(count(*) FILTER (WHERE abs(fv) > CAST(1e-6 AS FLOAT))/nullif(count(*) FILTER (WHERE abs(ft) > CAST(1e-6 AS FLOAT)), 0), 6) AS nonzero_ratio FROM g GROUP BY region""")
def q_regional(spark, sf):
    """Candidate against reference volume inside and in the boundary shell."""
    a = attributes(spark, sf).withColumn("region", F.when(near_edge(4), "boundary").otherwise("interior"))
    d = a.groupBy("region").agg(
        F.avg(F.abs(F.col("fv").cast("double") - F.col("ft").cast("double"))).alias("mean_abs_difference"),
        ratio(F.count_if(F.abs("fv") > F.lit(1e-6).cast("float")), F.count_if(F.abs("ft") > F.lit(1e-6).cast("float"))).alias("nonzero_ratio"),
    )
    return rnd(metrics.normalized_correlation(a, "fv", "ft", ("region",)).join(d, "region"))


@query("scan_ensemble", f"""WITH {A}, b AS (SELECT i3, i2, i1, CAST(fv*CAST(0.9 AS FLOAT) AS FLOAT) AS s0, CAST(ft*CAST(1.0 AS FLOAT) AS FLOAT) AS s1, CAST(CAST(v+CAST(0.5 AS FLOAT) AS FLOAT)*CAST(0.7 AS FLOAT) AS FLOAT) AS s2, fv, ft, v, vp, truth_strike FROM att)
SELECT i3, i2, i1, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 'a' WHEN s1 >= s2 THEN 'b' ELSE 'c' END AS backend,
 round(CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN vp WHEN s1 >= s2 THEN truth_strike ELSE 0 END AS DOUBLE), 3) AS pt FROM b""")
def q_ensemble(spark, sf):
    """Prior-weighted choice between three attribute volumes."""
    a = attributes(spark, sf)
    zero = F.lit(0.0).cast("float")
    w = a.select(
        *ID3, F.col("fv").alias("ft_a"), F.col("vp").alias("pt_a"), F.col("vt").alias("tt_a"), F.col("ft").alias("ft_b"),
        F.col("truth_strike").alias("pt_b"), F.col("truth_dip").alias("tt_b"), (F.col("v") + F.lit(0.5).cast("float")).cast("float").alias("ft_c"),
        zero.alias("pt_c"), zero.alias("tt_c"),
    )
    e = scan_bank.argmax_of_backends(w, [("a", 0.9), ("b", 1.0), ("c", 0.7)])
    return e.select(*ID3, F.col("_best.backend").alias("backend"), F.round(F.col("_best.pt").cast("double"), 3).alias("pt"))


@query("axial_normal_angle", f"""WITH {A}, n AS (SELECT i3, i2, i1, -cos(radians(CAST(vt AS DOUBLE))) AS a1, sin(radians(CAST(vt AS DOUBLE)))*cos(radians(CAST(vp AS DOUBLE))) AS a2, -sin(radians(CAST(vt AS DOUBLE)))*sin(radians(CAST(vp AS DOUBLE))) AS a3,
 -cos(radians(CAST(truth_dip AS DOUBLE))) AS b1, sin(radians(CAST(truth_dip AS DOUBLE)))*cos(radians(CAST(truth_strike AS DOUBLE))) AS b2, -sin(radians(CAST(truth_dip AS DOUBLE)))*sin(radians(CAST(truth_strike AS DOUBLE))) AS b3 FROM att)
SELECT i3, i2, i1, round(degrees(acos(least(1.0, abs(CAST(CAST(a1 AS FLOAT) AS DOUBLE)*CAST(CAST(b1 AS FLOAT) AS DOUBLE)+CAST(CAST(a2 AS FLOAT) AS DOUBLE)*CAST(CAST(b2 AS FLOAT) AS DOUBLE)+CAST(CAST(a3 AS FLOAT) AS DOUBLE)*CAST(CAST(b3 AS FLOAT) AS DOUBLE))))), 2) AS angle FROM n WHERE i1 >= 0""")
def q_axial(spark, sf):
    from ridgeline.functions.angles import axial_normal_angle, normal_vector

    a = attributes(spark, sf)
    l = [x.cast("double") for x in normal_vector("vp", "vt")]
    r = [x.cast("double") for x in normal_vector("truth_strike", "truth_dip")]
    return a.select(*ID3, F.round(axial_normal_angle(l, r), 2).alias("angle"))


@query("primary_degraded", f"""WITH {_CELLS}, s AS (SELECT skin_id, count(*) AS n FROM cells GROUP BY skin_id), q AS (SELECT count(*) AS sc, sum(n) AS cc, max(n) AS mx, coalesce(sum(n) FILTER (WHERE n < 600), 0) AS sm FROM s),
u AS (SELECT count(*) AS u FROM (SELECT DISTINCT i3, i2, i1 FROM cells)), r AS (SELECT *, u/3000.0 AS cov FROM q, u)
SELECT round(cov, 6) AS cell_coverage, array_to_string(list_filter([CASE WHEN sc = 0 THEN 'empty_primary_skin' END, CASE WHEN cov < 0.5 THEN 'low_fvt_positive_coverage' END,
 CASE WHEN sc > 0 AND (sc >= 8 OR mx/cc < 0.75) THEN 'fragmented_primary_skins' END, CASE WHEN sm/cc > 0.25 THEN 'high_small_skin_cell_fraction' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def q_degraded(spark, sf):
    t = topology.skin_topology(_cells(spark, sf)[0], 600)
    d = components.primary_degraded(t, 3000)
    return d.select(F.round("cell_coverage", 6).alias("cell_coverage"), F.array_join("reasons", ",").alias("reasons"))


@query("fallback_guardrail", f"""WITH {_CELLS}, s AS (SELECT skin_id, count(*) AS n FROM cells GROUP BY skin_id), q AS (SELECT count(*) AS sc, sum(n) AS cc, max(n) AS mx, coalesce(sum(n) FILTER (WHERE n < 600), 0) AS sm FROM s),
u AS (SELECT count(*) AS u FROM (SELECT DISTINCT i3, i2, i1 FROM cells)), r AS (SELECT *, u/800.0 AS cov FROM q, u)
SELECT round(cov, 6) AS coverage, array_to_string(list_filter([CASE WHEN sc > 3 THEN 'fallback_skin_count_exceeds_max' END, CASE WHEN cov < 0.75 THEN 'coverage_of_fvt_positive_below_min' END, CASE WHEN cov > 1.25 THEN 'coverage_of_fvt_positive_above_max' END,
 CASE WHEN sm/cc > 0.2 THEN 'small_skin_cell_fraction_exceeds_max' END, CASE WHEN mx/cc < 0.5 THEN 'largest_skin_fraction_below_min' END], lambda x: x IS NOT NULL), ',') AS reasons, false AS passed FROM r""")
def q_guardrail(spark, sf):
    t = topology.skin_topology(_cells(spark, sf)[0], 600)
    g = components.fallback_guardrail(t, F.lit(800.0), F.lit(0.1))
    return g.select(F.round("coverage_of_fvt_positive", 6).alias("coverage"), F.array_join("reasons", ",").alias("reasons"), "passed")


@query("generation_counts", """SELECT l_linestatus AS generation, count(*) AS cell_count, round(avg(l_discount), 6) AS mean_support FROM lineitem GROUP BY 1""")
def q_generation(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("generation"), F.col("l_discount").alias("reskin_support"))
    return rnd(topology.generation_counts(li))


_NODES = """nodes AS (SELECT l_orderkey*10+l_linenumber AS node_id, min(l_quantity) AS x1, min(l_tax) AS x2, min(l_discount) AS x3, min(l_extendedprice)/290.0 AS strike_deg, min(l_quantity)*2.0-3.0 AS dip_deg, min(l_discount)*12.0 AS cell_support_weight,
 CASE WHEN l_linenumber > 1 THEN l_orderkey*10+l_linenumber-1 ELSE -1 END AS ca_index, CASE WHEN l_linenumber < 7 THEN l_orderkey*10+l_linenumber+1 ELSE -1 END AS cb_index, CASE WHEN min(l_partkey) % 11 = 0 THEN -1 ELSE (l_orderkey-1)*10+l_linenumber END AS cl_index, (l_orderkey+1)*10+l_linenumber AS cr_index FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def graph_nodes(spark, sf):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_quantity").alias("q"), F.min("l_tax").alias("t"), F.min("l_discount").alias("d"), F.min("l_extendedprice").alias("p"), F.min("l_partkey").alias("pk"),
    )
    return g.select(
        (k * 10 + n).alias("node_id"), F.col("q").alias("x1"), F.col("t").alias("x2"), F.col("d").alias("x3"), (F.col("p") / 290.0).alias("strike_deg"),
        (F.col("q") * 2.0 - 3.0).alias("dip_deg"), (F.col("d") * 12.0).alias("cell_support_weight"),
        F.when(n > 1, k * 10 + n - 1).otherwise(-1).alias("ca_index"), F.when(n < 7, k * 10 + n + 1).otherwise(-1).alias("cb_index"),
        F.when(F.pmod("pk", F.lit(11)) == 0, -1).otherwise((k - 1) * 10 + n).alias("cl_index"), ((k + 1) * 10 + n).alias("cr_index"),
    )


@query("graph_node_checks", f"""WITH {_NODES} SELECT node_id, 'strike_range' AS rule FROM nodes WHERE NOT (strike_deg >= 0 AND strike_deg < 360) UNION ALL SELECT node_id, 'dip_range' FROM nodes WHERE NOT (dip_deg > 0 AND dip_deg <= 90)
 UNION ALL SELECT node_id, 'support_range' FROM nodes WHERE NOT cell_support_weight BETWEEN 0 AND 1""")
def q_graph_nodes(spark, sf):
    return surface_graph.node_violations(graph_nodes(spark, sf))


_LINK_ROWS = " UNION ALL ".join(f"SELECT node_id, '{a}_index' AS link, '{b}_index' AS back, {a}_index AS other FROM nodes WHERE {a}_index <> -1" for a, b in (("ca", "cb"), ("cb", "ca"), ("cl", "cr"), ("cr", "cl")))


@query("graph_link_checks", f"""WITH {_NODES.replace('nodes AS', 'nodes AS MATERIALIZED')}, e AS MATERIALIZED ({_LINK_ROWS}),
a AS (SELECT other AS node_id, back AS link, node_id AS other, true AS answered FROM e),
k AS (SELECT node_id AS other, true AS known FROM nodes)
SELECT node_id, link, CASE WHEN known IS NULL THEN 'dangling_link' ELSE 'one_way_link' END AS rule FROM e LEFT JOIN k USING (other) LEFT JOIN a USING (node_id, link, other) WHERE known IS NULL OR answered IS NULL""")
def q_graph_links(spark, sf):
    return surface_graph.link_violations(graph_nodes(spark, sf))


_AX = """CASE WHEN a3 >= a2 AND a3 >= a1 THEN 0 WHEN a2 >= a1 THEN 1 ELSE 2 END"""
_EDGE_LINES = f"""ec AS (SELECT a.i3, a.i2, a.i1, a.fv, a.ft AS target, ref.thin AS fvt, (CAST(a.i3 AS BIGINT)*n2+a.i2)*n1+a.i1 AS flat, least(a.i3, n3-1-a.i3, a.i2, n2-1-a.i2, a.i1, n1-1-a.i1) < 4 AS edge,
 abs(CAST(-sin(radians(CAST(vt AS DOUBLE)))*sin(radians(CAST(vp AS DOUBLE))) AS FLOAT)) AS a3, abs(CAST(sin(radians(CAST(vt AS DOUBLE)))*cos(radians(CAST(vp AS DOUBLE))) AS FLOAT)) AS a2, abs(CAST(-cos(radians(CAST(vt AS DOUBLE))) AS FLOAT)) AS a1
 FROM att a JOIN ref USING (i3, i2, i1)),
cd AS (SELECT ec.*, {_AX} AS ax FROM ec SEMI JOIN pt ON pt.i3 = ec.i3 AND pt.i2 = ec.i2 AND pt.i1 = ec.i1 WHERE edge AND target > CAST(1e-6 AS FLOAT)),
ck AS (SELECT *, CASE ax WHEN 0 THEN i2 ELSE i3 END AS la, CASE ax WHEN 2 THEN i2 ELSE i1 END AS lb FROM cd),
cb AS (SELECT *, row_number() OVER (PARTITION BY ax, la, lb ORDER BY target DESC, fv DESC, flat) AS rn, min(flat) OVER (PARTITION BY ax, la, lb) AS turn FROM ck),
bl AS (SELECT ec.*, x.ax, CASE x.ax WHEN 0 THEN i2 ELSE i3 END AS la, CASE x.ax WHEN 2 THEN i2 ELSE i1 END AS lb FROM ec CROSS JOIN (VALUES (0), (1), (2)) x(ax) WHERE edge AND fvt > CAST(1e-6 AS FLOAT)),
bb AS (SELECT *, row_number() OVER (PARTITION BY ax, la, lb ORDER BY target DESC, fv DESC, flat) AS rn FROM bl),
wn AS (SELECT cb.* FROM cb LEFT JOIN (SELECT * FROM bb WHERE rn = 1) b ON b.ax = cb.ax AND b.la = cb.la AND b.lb = cb.lb WHERE cb.rn = 1 AND (b.flat IS NULL OR cb.target > b.target
 OR (cb.target = b.target AND (cb.fv > b.fv OR (cb.fv = b.fv AND cb.flat < b.flat))))),
cl AS (SELECT bl.flat, max(wn.turn) AS cleared_at FROM bl JOIN wn ON wn.ax = bl.ax AND wn.la = bl.la AND wn.lb = bl.lb GROUP BY bl.flat),
pp AS (SELECT flat, any_value(i3) AS i3, any_value(i2) AS i2, any_value(i1) AS i1, any_value(fv) AS fv, max(turn) AS turn FROM wn GROUP BY flat)"""


@query("thin_edge_lines", f"""WITH {A}, {_SM2}, {_sql_nms()}, {_THIN_REF}, {_THIN_NRM}, {_PLATEAU}, {_EDGE_LINES}
SELECT i3, i2, i1, round(CAST(fvt AS DOUBLE), 6) AS fvt FROM ec WHERE fvt > CAST(1e-6 AS FLOAT) AND flat NOT IN (SELECT flat FROM cl) AND flat NOT IN (SELECT flat FROM pp)
UNION ALL SELECT pp.i3, pp.i2, pp.i1, round(CAST(fv AS DOUBLE), 6) FROM pp LEFT JOIN cl USING (flat) WHERE cleared_at IS NULL OR cleared_at <= turn""")
def q_edge_lines(spark, sf):
    t = attribute_traces(spark, sf)
    fvt = to_voxels(thinning.thin_reference(t, "fv", "vp", tiling=TILING), ["thin"]).withColumnRenamed("thin", "fvt")
    cells = attributes(spark, sf).select(*ID3, "n3", "n2", "n1", "fv", "vp", "vt", F.col("ft").alias("target")).join(fvt, ID3)
    plateau = thinning.thin_plateau(t, "fv", "vp", "vt", tiling=TILING)
    return edges.thin_edge_lines(cells, plateau, 4).select(*ID3, r6("fvt"))


@query("pick_centers", f"""WITH RECURSIVE {A}, e AS (SELECT * FROM att WHERE i3 >= 1 AND i3 < n3-1 AND i2 >= 4 AND i2 < n2-4 AND i1 >= 4 AND i1 < n1-4),
b AS (SELECT i3, i2, i1, fv FROM e WHERE fv >= (SELECT quantile_cont(CAST(fv AS DOUBLE), 0.99) FROM e)),
p1 AS (SELECT * FROM b ORDER BY fv DESC, i3, i2, i1 LIMIT 1),
p2 AS (SELECT b.* FROM b, p1 WHERE (b.i3-p1.i3)*(b.i3-p1.i3)+(b.i2-p1.i2)*(b.i2-p1.i2)+(b.i1-p1.i1)*(b.i1-p1.i1) >= 144 ORDER BY b.fv DESC, b.i3, b.i2, b.i1 LIMIT 1),
p3 AS (SELECT b.* FROM b, p1, p2 WHERE (b.i3-p1.i3)*(b.i3-p1.i3)+(b.i2-p1.i2)*(b.i2-p1.i2)+(b.i1-p1.i1)*(b.i1-p1.i1) >= 144 AND (b.i3-p2.i3)*(b.i3-p2.i3)+(b.i2-p2.i2)*(b.i2-p2.i2)+(b.i1-p2.i1)*(b.i1-p2.i1) >= 144 ORDER BY b.fv DESC, b.i3, b.i2, b.i1 LIMIT 1)
SELECT 1 AS pick, i3, i2, i1 FROM p1 UNION ALL SELECT 2, i3, i2, i1 FROM p2 UNION ALL SELECT 3, i3, i2, i1 FROM p3""")
def q_centers(spark, sf):
    """Three strongest voxels of the top hundredth, inside margins and at least 12 apart (a short report)."""
    a = attributes(spark, sf).select(*ID3, "n3", "n2", "n1", "fv")
    picks = seeds.pick_centers(a, "fv", 3, 12.0, 99.0, (1, 4, 4))
    return spark.createDataFrame([(k, *p) for k, p in enumerate(picks, 1)], "pick int, i3 int, i2 int, i1 int")

