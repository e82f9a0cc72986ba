"""Reports, overlap, distances, orientation errors, topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import attributes, query, s6, sql_attributes, sql_normal, table
from ridgeline.functions.angles import nearest_index
from ridgeline.operators import metrics, topology
from ridgeline.grid import flat_index, shape_of
from ridgeline.operators.masks import percentile_mask

ID3 = ["i3", "i2", "i1"]
A = sql_attributes()


def rnd(df, *skip, digits=6):
    """Round every double column."""
    return df.select(
        *[
            F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
            for c, t in df.dtypes
        ]
    )


@query("finite_report", """WITH q AS (SELECT event_type, CASE WHEN value > 150 THEN CAST('inf' AS DOUBLE) WHEN value < 3 THEN CAST('nan' AS DOUBLE) WHEN value < 6 THEN CAST('-inf' AS DOUBLE) ELSE value END AS x FROM events)
SELECT event_type, count(*) AS size, count(*) FILTER (WHERE isfinite(x)) AS finite_count, count(*) FILTER (WHERE isnan(x)) AS nan_count,
 count(*) FILTER (WHERE x = CAST('inf' AS DOUBLE)) AS posinf_count, count(*) FILTER (WHERE x = CAST('-inf' AS DOUBLE)) AS neginf_count,
 round(count(*) FILTER (WHERE isfinite(x)) / count(*), 6) AS finite_fraction, round(min(x) FILTER (WHERE isfinite(x)), 6) AS finite_min,
 round(max(x) FILTER (WHERE isfinite(x)), 6) AS finite_max, round(avg(x) FILTER (WHERE isfinite(x)), 6) AS finite_mean FROM q GROUP BY event_type""")
def q_finite(spark, sf):
    """Event values with the extremes turned into non-finite samples."""
    v = F.col("value")
    x = (
        F.when(v > 150, F.lit(float("inf"))).when(v < 3, F.lit(float("nan"))).when(v < 6, F.lit(float("-inf"))).otherwise(v)
    )
    e = table(spark, sf, "events").select("event_type", x.alias("x"))
    return rnd(metrics.finite_report(e, "x", ("event_type",)))


@query("normalized_correlation", """SELECT l_returnflag, round(coalesce(covar_pop(l_quantity, l_extendedprice) /
 nullif(stddev_pop(l_quantity)*stddev_pop(l_extendedprice), 0), 0), 6) AS correlation FROM lineitem GROUP BY l_returnflag""")
def q_corr(spark, sf):
    return rnd(metrics.normalized_correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ("l_returnflag",)))


@query("distribution_summary", """WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, count(*) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std,
 round(any_value(med), 4) AS median, round(median(abs(l_extendedprice - med)), 4) AS median_absolute_deviation
FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag""")
def q_distribution(spark, sf):
    return rnd(metrics.distribution_summary(table(spark, sf, "lineitem"), "l_extendedprice", ("l_returnflag",)), digits=4)


@query("unit_range", f"""WITH {A}, s AS (SELECT min(fv) AS lo, max(fv) AS hi FROM att)
SELECT i3, i2, i1, round(CAST(CAST(greatest(0.0, least(1.0, CAST(fv - lo AS DOUBLE)/CAST(hi - lo AS DOUBLE))) AS FLOAT) AS DOUBLE), 5) AS u FROM att, s""")
def q_unit(spark, sf):
    u = metrics.normalize_unit(attributes(spark, sf), "fv", "u")
    return u.select(*ID3, F.round(F.col("u").cast("double"), 5).alias("u"))


@query("percentile_overlap", f"""WITH {A}, t AS (SELECT quantile_cont(CAST(fv AS DOUBLE), 0.9) AS a, quantile_cont(CAST(ft AS DOUBLE), 0.9) AS b FROM att),
n AS (SELECT count(*) AS size, count(*) FILTER (WHERE CAST(fv AS DOUBLE) >= a) AS ac, count(*) FILTER (WHERE CAST(ft AS DOUBLE) >= b) AS bc,
 count(*) FILTER (WHERE CAST(fv AS DOUBLE) >= a AND CAST(ft AS DOUBLE) >= b) AS oc, count(*) FILTER (WHERE CAST(fv AS DOUBLE) >= a OR CAST(ft AS DOUBLE) >= b) AS uc FROM att, t)
SELECT ac AS a_count, bc AS b_count, oc AS overlap_count, uc AS union_count, round(ac/size, 6) AS a_fraction, round(bc/size, 6) AS b_fraction,
 round(oc/size, 6) AS overlap_fraction, round(oc/ac, 6) AS overlap_over_a, round(oc/bc, 6) AS overlap_over_b, round(oc/uc, 6) AS jaccard FROM n""")
def q_percentile_overlap(spark, sf):
    return rnd(metrics.percentile_overlap(attributes(spark, sf), "fv", "ft", 90.0))


def _masks(spark, sf):
    a = attributes(spark, sf)
    cand = a.where(F.col("fv") > F.lit(0.5).cast("float")).select(*ID3, "n3", "n2", "n1")
    return a, cand, a.where("truth_mask").select(*ID3)


_CT = f"""{A}, c AS (SELECT i3, i2, i1, n3, n2, n1 FROM att WHERE fv > CAST(0.5 AS FLOAT)), t AS (SELECT i3, i2, i1 FROM att WHERE truth_mask)"""
_NEAR = """dc AS (SELECT c.i3, c.i2, c.i1, any_value(c.n3) AS n3, any_value(c.n2) AS n2, any_value(c.n1) AS n1, sqrt(min((c.i3-t.i3)*(c.i3-t.i3)+(c.i2-t.i2)*(c.i2-t.i2)+(c.i1-t.i1)*(c.i1-t.i1))) AS d FROM c, t GROUP BY c.i3, c.i2, c.i1),
dt AS (SELECT t.i3, t.i2, t.i1, sqrt(min((c.i3-t.i3)*(c.i3-t.i3)+(c.i2-t.i2)*(c.i2-t.i2)+(c.i1-t.i1)*(c.i1-t.i1))) AS d FROM c, t GROUP BY t.i3, t.i2, t.i1)"""


@query("buffered_overlap", f"""WITH {_CT}, {_NEAR},
n AS (SELECT (SELECT count(*) FROM c) AS cc, (SELECT count(*) FROM t) AS tc, (SELECT count(*) FROM dc WHERE d = 0) AS ic,
 (SELECT count(*) FROM dc WHERE d <= 2) AS cb, (SELECT count(*) FROM dt WHERE d <= 2) AS tb),
r AS (SELECT *, cc+tc-ic AS uc, ic/cc AS p, ic/tc AS r, cb/cc AS bp, tb/tc AS br FROM n)
SELECT cc AS candidate_count, tc AS truth_count, ic AS intersection_count, uc AS union_count, cb AS candidate_in_truth_buffer_count,
 tb AS truth_in_candidate_buffer_count, round(p, 6) AS precision, round(r, 6) AS recall, round(2*p*r/(p+r), 6) AS f1, round(ic/uc, 6) AS jaccard,
 round(bp, 6) AS buffered_precision, round(br, 6) AS buffered_recall, round(2*bp*br/(bp+br), 6) AS buffered_f1, 2.0::DOUBLE AS radius FROM r""")
def q_overlap(spark, sf):
    _, c, t = _masks(spark, sf)
    return rnd(metrics.buffered_overlap(c, t, 2.0))


def _dist_cols(src, prefix):
    return ", ".join(
        [f"(SELECT round(avg(d), 6) FROM {src}) AS {prefix}_mean"]
        + [f"(SELECT round(quantile_cont(d, {p}), 6) FROM {src}) AS {prefix}_{n}" for n, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))]
    )


@query("surface_distance", f"""WITH {_CT}, {_NEAR},
s AS (SELECT {_dist_cols('dc', 'candidate_to_truth')}, {_dist_cols('dt', 'truth_to_candidate')}, (SELECT count(*) FROM c) AS candidate_count, (SELECT count(*) FROM t) AS truth_count,
 (SELECT avg(d) FROM dc) AS ma, (SELECT avg(d) FROM dt) AS mb)
SELECT * EXCLUDE (ma, mb), round(0.5*(ma+mb), 6) AS symmetric_chamfer_mean, greatest(candidate_to_truth_p95, truth_to_candidate_p95) AS hausdorff_p95 FROM s""")
def q_distance(spark, sf):
    a, c, t = _masks(spark, sf)
    return rnd(metrics.surface_distance(c, t, shape_of(a)))


@query("edge_false_positives", f"""WITH {_CT}, {_NEAR},
n AS (SELECT count(*) AS cc, count(*) FILTER (WHERE least(i3, n3-1-i3, i2, n2-1-i2, i1, n1-1-i1) < 3) AS ec,
 count(*) FILTER (WHERE least(i3, n3-1-i3, i2, n2-1-i2, i1, n1-1-i1) < 3 AND d > 1) AS ef FROM dc)
SELECT cc AS candidate_count, ec AS edge_candidate_count, ef AS edge_false_positive_count, round(ec/cc, 6) AS edge_candidate_fraction,
 round(ef/cc, 6) AS edge_false_positive_fraction_of_candidates, round(coalesce(ef/nullif(ec, 0), 0), 6) AS edge_false_positive_fraction_of_edge_candidates FROM n""")
def q_edge_fp(spark, sf):
    _, c, t = _masks(spark, sf)
    return rnd(metrics.edge_false_positives(c, t, 3, 1.0))


_ERR = """e AS (SELECT truth_id, abs((CAST(vp AS DOUBLE)-CAST(truth_strike AS DOUBLE)+90.0) - 180.0*floor((CAST(vp AS DOUBLE)-CAST(truth_strike AS DOUBLE)+90.0)/180.0) - 90.0) AS s,
 abs(CAST(vt AS DOUBLE)-CAST(truth_dip AS DOUBLE)) AS d FROM att)"""


@query("orientation_error", f"""WITH {A}, {_ERR}
SELECT truth_id, count(*) AS count, {', '.join(f'round(avg({c}), 6) AS {n}_mean, round(quantile_cont({c}, 0.5), 6) AS {n}_median, round(quantile_cont({c}, 0.9), 6) AS {n}_p90, round(quantile_cont({c}, 0.95), 6) AS {n}_p95' for c, n in (('s', 'strike'), ('d', 'dip')))}
FROM e GROUP BY truth_id""")
def q_orientation(spark, sf):
    a = attributes(spark, sf)
    return rnd(metrics.orientation_error(a, "vp", "vt", "truth_strike", "truth_dip", ("truth_id",)))


def _dot(p, t, q, e) -> str:
    """Dot product of two normals whose components are float32."""
    return " + ".join(f"CAST({a} AS DOUBLE)*CAST({b} AS DOUBLE)" for a, b in zip(sql_normal(p, t), sql_normal(q, e)))


@query("orientation_pair", f"""WITH {A}, t AS (SELECT quantile_cont(CAST(fv AS DOUBLE), 0.9) FILTER (WHERE fv > 0) AS a, quantile_cont(CAST(ft AS DOUBLE), 0.9) FILTER (WHERE ft > 0) AS b FROM att),
m AS (SELECT CAST(vp AS DOUBLE) AS p, CAST(vt AS DOUBLE) AS d, CAST(truth_strike AS DOUBLE) AS q, CAST(truth_dip AS DOUBLE) AS e, {_dot('vp', 'vt', 'truth_strike', 'truth_dip')} AS c FROM att, t
 WHERE fv > 0 AND ft > 0 AND CAST(fv AS DOUBLE) >= a AND CAST(ft AS DOUBLE) >= b),
x AS (SELECT 'strike' AS what, abs((p-q+180.0) - 360.0*floor((p-q+180.0)/360.0) - 180.0) AS d FROM m UNION ALL SELECT 'dip', abs(d-e) FROM m UNION ALL SELECT 'normal', degrees(acos(least(1.0, abs(c)))) FROM m)
SELECT what, count(*) AS support, round(avg(d), 3) AS mean, round(max(d), 3) AS max, round(quantile_cont(d, 0.5), 3) AS median, round(quantile_cont(d, 0.95), 3) AS p95 FROM x GROUP BY what""")
def q_pair(spark, sf):
    p = metrics.orientation_pair(attributes(spark, sf), ("fv", "vp", "vt"), ("ft", "truth_strike", "truth_dip"), 90.0)
    return rnd(p, digits=3)


@query("orientation_report", f"""WITH {A}, t AS (SELECT quantile_cont(CAST(fv AS DOUBLE), 0.9) FILTER (WHERE fv > 0) AS a FROM att),
x AS (SELECT 'strike' AS what, CAST(vp AS DOUBLE) AS x FROM att, t WHERE fv > 0 AND CAST(fv AS DOUBLE) >= a UNION ALL SELECT 'dip', CAST(vt AS DOUBLE) FROM att, t WHERE fv > 0 AND CAST(fv AS DOUBLE) >= a),
m AS (SELECT what, median(x) AS med FROM x GROUP BY what)
SELECT what, count(*) AS count, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(any_value(med), 5) AS median, round(median(abs(x-med)), 5) AS median_absolute_deviation
FROM x JOIN m USING (what) GROUP BY what""")
def q_orientation_report(spark, sf):
    return rnd(metrics.orientation_report(attributes(spark, sf), "fv", "vp", "vt", 90.0), digits=5)


@query("input_association", f"""WITH {A}, s AS (SELECT coalesce(avg(CAST(fv AS DOUBLE)) FILTER (WHERE abs(truth_distance) <= 0.5), 0) AS a,
 coalesce(avg(CAST(fv AS DOUBLE)) FILTER (WHERE abs(truth_distance) >= 3.0), 0) AS b FROM att)
SELECT round(a, 6) AS truth_surface_mean, round(b, 6) AS far_from_truth_mean, round(b - a, 6) AS contrast FROM s""")
def q_association(spark, sf):
    return rnd(metrics.input_association(attributes(spark, sf), "fv", "truth_distance"))


@query("stage_profiles", f"""WITH {A}, s AS (SELECT 'fv' AS stage, * FROM att WHERE fv > 0.3 UNION ALL SELECT 'truth', * FROM att WHERE truth_mask UNION ALL SELECT 'ft', * FROM att WHERE ft > 0.5)
SELECT stage, count(*) AS candidate_count, round(count(*) FILTER (WHERE least(i3, n3-1-i3, i2, n2-1-i2, i1, n1-1-i1) < 4)/count(*), 6) AS edge_shell_fraction,
 round(avg(i3), 6) AS centroid_i3, round(avg(i2), 6) AS centroid_i2, round(avg(i1), 6) AS centroid_i1 FROM s GROUP BY stage""")
def q_profiles(spark, sf):
    a = attributes(spark, sf)
    flags = F.array_compact(F.array(
        F.when(F.col("fv") > F.lit(0.3), F.lit("fv")), F.when(F.col("truth_mask"), F.lit("truth")), F.when(F.col("ft") > F.lit(0.5), F.lit("ft")),
    ))
    stages = a.select(*ID3, "n3", "n2", "n1", F.explode(flags).alias("stage"))
    return rnd(metrics.stage_profiles(stages, 4))


@query("mip", f"WITH {A} SELECT i2, i1, {s6('max(fv)', 'mip')} FROM att GROUP BY i2, i1")
def q_mip(spark, sf):
    return metrics.projection(attributes(spark, sf), "fv", ("i2", "i1")).select("i2", "i1", F.round(F.col("mip").cast("double"), 6).alias("mip"))


@query("histogram", f"""WITH {A}, l AS (SELECT 'fv' AS series, CAST(fv AS DOUBLE) AS x FROM att UNION ALL SELECT 'ft', CAST(ft AS DOUBLE) FROM att), r AS (SELECT min(x) AS lo, max(x) AS hi FROM l)
SELECT series, CAST(least(19, floor((x-lo)/(hi-lo)*20)) AS INTEGER) AS bin, count(*) AS n FROM l, r GROUP BY 1, 2""")
def q_histogram(spark, sf):
    return metrics.histogram(attributes(spark, sf), ["fv", "ft"], 20)


# ---------------------------------------------------------------- topology over lineitem cells

_CELLS = """cells AS (SELECT l_suppkey AS skin_id, CAST(floor(l_quantity/5.0 + 0.5) AS INTEGER) AS i3, CAST(floor(l_discount*100 + 0.5) AS INTEGER) AS i2, CAST(floor(l_tax*100 + 0.5) AS INTEGER) AS i1 FROM lineitem),
truth AS (SELECT DISTINCT i3, i2, i1, CASE WHEN i1 < 3 THEN 1 WHEN i2 < 4 THEN 2 WHEN i3 < 4 THEN 3 ELSE 0 END AS truth_id FROM cells)"""


def _cells(spark, sf):
    """Order lines as surface cells: suppliers are skins, three measures give the position."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("skin_id"), (F.col("l_quantity") / 5.0).alias("x3"),
        (F.col("l_discount") * 100).alias("x2"), (F.col("l_tax") * 100).alias("x1"),
    )
    cells = topology.rounded(li).select("skin_id", *ID3)
    t = F.when(F.col("i1") < 3, 1).when(F.col("i2") < 4, 2).when(F.col("i3") < 4, 3).otherwise(0)
    return cells, cells.select(*ID3).distinct().withColumn("truth_id", t)


@query("skin_topology", f"""WITH {_CELLS}, s AS (SELECT skin_id, count(*) AS n FROM cells GROUP BY skin_id), u AS (SELECT count(*) AS u FROM (SELECT DISTINCT i3, i2, i1 FROM cells))
SELECT count(*) AS skin_count, CAST(sum(n) AS BIGINT) AS cell_count, max(n) AS largest_skin_size, count(*) FILTER (WHERE n < 600) AS small_skin_count,
 CAST(coalesce(sum(n) FILTER (WHERE n < 600), 0) AS BIGINT) AS small_skin_cell_count, any_value(u) AS unique_cell_count, CAST(sum(n) - any_value(u) AS BIGINT) AS duplicate_cell_count,
 round(max(n)/sum(n), 6) AS largest_skin_fraction, round(coalesce(sum(n) FILTER (WHERE n < 600), 0)/sum(n), 6) AS small_skin_cell_fraction FROM s, u""")
def q_skin_topology(spark, sf):
    return rnd(topology.skin_topology(_cells(spark, sf)[0], 600))


_PAIR = """p AS (SELECT skin_id, coalesce(t.truth_id, 0) AS truth_id, count(*) AS cells, count(DISTINCT (c.i3, c.i2, c.i1)) AS voxels FROM cells c LEFT JOIN truth t ON t.i3 = c.i3 AND t.i2 = c.i2 AND t.i1 = c.i1 AND t.truth_id > 0 GROUP BY 1, 2),
tot AS (SELECT skin_id, sum(cells) AS total FROM p GROUP BY skin_id),
sk AS (SELECT p.skin_id, any_value(total) AS total, coalesce(sum(cells) FILTER (WHERE truth_id > 0), 0) AS tc, count(*) FILTER (WHERE truth_id > 0) AS touching,
 coalesce(max(cells) FILTER (WHERE truth_id > 0), 0) AS dom, count(*) FILTER (WHERE truth_id > 0 AND cells/total >= 0.05) AS q FROM p JOIN tot USING (skin_id) GROUP BY p.skin_id),
tz AS (SELECT truth_id, count(*) AS size FROM truth WHERE truth_id > 0 GROUP BY truth_id),
tv AS (SELECT t.truth_id, count(*) AS covered FROM truth t SEMI JOIN cells c ON t.i3 = c.i3 AND t.i2 = c.i2 AND t.i1 = c.i1 WHERE truth_id > 0 GROUP BY t.truth_id),
tq AS (SELECT truth_id, count(*) AS touching, count(*) FILTER (WHERE voxels/size >= 0.05) AS q FROM p JOIN tz USING (truth_id) GROUP BY truth_id),
tr AS (SELECT tz.truth_id, size, coalesce(covered, 0) AS covered, coalesce(touching, 0) AS touching, coalesce(q, 0) AS q FROM tz LEFT JOIN tv USING (truth_id) LEFT JOIN tq USING (truth_id))"""


@query("component_topology", f"""WITH {_CELLS}, {_PAIR}
SELECT * FROM (SELECT count(*) AS skin_count, count(*) FILTER (WHERE tc > 0) AS skin_with_truth_count, count(*) FILTER (WHERE q >= 2) AS over_merge_skin_count, max(touching) AS max_truth_components_per_skin,
 round(avg(dom/total), 6) AS mean_skin_purity, round(min(dom/total), 6) AS min_skin_purity FROM sk),
(SELECT count(*) AS truth_component_count, count(*) FILTER (WHERE covered > 0) AS covered_truth_component_count, count(*) FILTER (WHERE q >= 2) AS over_split_truth_component_count,
 max(touching) AS max_skins_per_truth_component, round(avg(covered/size), 6) AS mean_truth_component_recall, round(min(covered/size), 6) AS min_truth_component_recall FROM tr)""")
def q_component_topology(spark, sf):
    c, t = _cells(spark, sf)
    return rnd(topology.component_topology(c, t))


@query("skin_components", f"""WITH {_CELLS}, {_PAIR}
SELECT skin_id, CAST(total AS BIGINT) AS cell_count, CAST(tc AS BIGINT) AS truth_cell_count, touching AS truth_components_touching, dom AS dominant_truth_cell_count,
 round(dom/total, 6) AS purity, q AS qualifying_truth_components,
 (SELECT min(truth_id) FROM p WHERE p.skin_id = sk.skin_id AND p.truth_id > 0 AND p.cells = sk.dom) AS dominant_truth_id FROM sk""")
def q_skin_components(spark, sf):
    c, t = _cells(spark, sf)
    return rnd(topology.skin_components(c, t))


@query("rasterize_cells", f"WITH {_CELLS} SELECT DISTINCT i3, i2, i1 FROM cells")
def q_rasterize(spark, sf):
    return topology.rasterize(_cells(spark, sf)[0])


_LINKS = """g AS (SELECT l_orderkey*10 + l_linenumber AS cell_id, l_suppkey AS skin_id, l_orderkey AS w, l_linenumber AS v, count(*) AS lines FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey),
lk AS (SELECT a.cell_id, a.skin_id, a.lines, u.cell_id AS ca_id, d.cell_id AS cb_id, l.cell_id AS cl_id, r.cell_id AS cr_id FROM g a
 LEFT JOIN g u ON u.skin_id = a.skin_id AND u.w = a.w AND u.v = a.v - 1 LEFT JOIN g d ON d.skin_id = a.skin_id AND d.w = a.w AND d.v = a.v + 1
 LEFT JOIN g l ON l.skin_id = a.skin_id AND l.v = a.v AND l.w = a.w - 1 LEFT JOIN g r ON r.skin_id = a.skin_id AND r.v = a.v AND r.w = a.w + 1)"""


@query("slab_summary", """WITH v AS (SELECT CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS stage, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT stage, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std, round(max(abs(x)), 6) AS max_absolute, round(count(*) FILTER (WHERE abs(x) > 1e-6)/count(*), 6) AS epsilon_nonzero_fraction FROM v GROUP BY stage""")
def q_slabs(spark, sf):
    """The slab summary as a batch: traces reduced before the shuffle."""
    from ridgeline.streaming.slabs import slab_summary

    e = table(spark, sf, "embeddings").select(
        F.when(F.pmod("label", F.lit(2)) == 0, "even").otherwise("odd").alias("stage"), F.col("embedding").alias("trace")
    )
    return rnd(slab_summary(e)).withColumn("mean", F.col("mean") + 0.0)
