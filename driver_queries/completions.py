"""Angle expressions, ridge and stage comparisons, image warps and table sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import IMG, TILING, attribute_traces, attributes, image, query, r6, s6, sql_attributes, sql_normal, table
from driver_queries.scoring import rnd
from driver_queries.stencils import _sql_sides
from ridgeline.functions import angles
from ridgeline.functions.kernels import gaussian_weights
from ridgeline.functions.scores import planarity_likelihood
from ridgeline.grid import to_voxels, with_shape
from ridgeline.operators import comparisons, components, masked, metrics, paths, sampling, thinning
from ridgeline.session import cut_lineage, new_folder
from ridgeline.sources import tables

ID3 = ["i3", "i2", "i1"]
A = sql_attributes()

# ---------------------------------------------------------------- angle expressions

_ANG = """q AS (SELECT l_orderkey, l_linenumber, l_quantity * 7.0 AS strike, 5.0 + 80.0 * l_discount * 10.0 AS dip, l_tax * 12.5 AS s FROM lineitem),
r AS (SELECT *, radians(CAST(strike AS DOUBLE)) AS p, radians(CAST(dip AS DOUBLE)) AS t FROM q),
w AS (SELECT *, CAST(CAST(sin(t) AS FLOAT) AS DOUBLE) AS u1, CAST(CAST(cos(t)*cos(p) AS FLOAT) AS DOUBLE) AS u2, CAST(CAST(-cos(t)*sin(p) AS FLOAT) AS DOUBLE) AS u3,
 CAST(CAST(sin(p) AS FLOAT) AS DOUBLE) AS v2, CAST(CAST(cos(p) AS FLOAT) AS DOUBLE) AS v3 FROM r)"""
_TURN = "(CASE WHEN {x} < 0 THEN {x} + 360.0 ELSE {x} END)"


@query("angle_expressions", f"""WITH {_ANG} SELECT l_orderkey, l_linenumber, round(degrees(asin(u1)), 2) AS dip_of_dip,
 round({_TURN.format(x='degrees(atan2(-u3, u2))')}, 2) % 360.0 AS strike_of_dip, round({_TURN.format(x='degrees(atan2(v2, v3))')}, 2) % 360.0 AS strike_of_strike,
 round(sin(p), 5) + 0.0 AS n2, round(cos(p), 5) + 0.0 AS n1, round(-cos(p), 5) + 0.0 AS s2, round(sin(p), 5) + 0.0 AS s1,
 round(180.0 - strike - 180.0*floor((180.0 - strike)/180.0), 3) AS cell_angle, round(greatest(0.0, least(1.0, 1.0 - pow(greatest(0.0, least(1.0, s)), 4.0))), 5) AS likelihood,
 round(-cos(t)/sin(t), 4) + 0.0 AS shear FROM w""")
def q_angle_expressions(spark, sf):
    """Vectors of order lines' angles and back, 2-D normals, likelihood and shear."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 7.0).alias("strike"), (5.0 + 80.0 * F.col("l_discount") * 10.0).alias("dip"),
        (F.col("l_tax") * 12.5).alias("s"),
    )
    u1, u2, u3 = angles.dip_vector("strike", "dip")
    _, v2, v3 = angles.strike_vector("strike")
    n2, n1 = angles.normal_vector_2d("strike")
    s2, s1 = angles.strike_vector_2d("strike")
    d = lambda c: c.cast("double")
    turn = lambda c: F.round(d(c), 2) % 360.0
    five = lambda c: F.round(d(c), 5) + 0.0
    return li.select(
        "l_orderkey", "l_linenumber", F.round(angles.dip_of_dip_vector(d(u1)), 2).alias("dip_of_dip"),
        turn(angles.strike_of_dip_vector(d(u2), d(u3))).alias("strike_of_dip"), turn(angles.strike_of_strike_vector(d(v2), d(v3))).alias("strike_of_strike"),
        five(n2).alias("n2"), five(n1).alias("n1"), five(s2).alias("s2"), five(s1).alias("s1"),
        F.round(d(angles.feature_to_cell_angle("strike")), 3).alias("cell_angle"), F.round(d(planarity_likelihood("s")), 5).alias("likelihood"),
        (F.round(d(angles.dip_shear("dip")), 4) + 0.0).alias("shear"),
    )


# ---------------------------------------------------------------- ridges and stages

_OFFSETS = ", ".join(str((a, b, c)) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if a * a + b * b + c * c <= 4)


def _sql_buffered(c: str, t: str) -> str:
    """CTE r: counts, exact and buffered (radius 2) shares of the voxel sets named c and t."""
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}/{b} ELSE 0 END"
    return f"""off(a, b, d) AS (VALUES {_OFFSETS}), tx AS (SELECT DISTINCT i3+a AS i3, i2+b AS i2, i1+d AS i1 FROM {t}, off),
cx AS (SELECT DISTINCT i3+a AS i3, i2+b AS i2, i1+d AS i1 FROM {c}, off),
n AS (SELECT (SELECT count(*) FROM {c}) AS cc, (SELECT count(*) FROM {t}) AS tc, (SELECT count(*) FROM {c} JOIN {t} USING (i3, i2, i1)) AS ic,
 (SELECT count(*) FROM {c} JOIN tx USING (i3, i2, i1)) AS cb, (SELECT count(*) FROM cx JOIN {t} USING (i3, i2, i1)) AS tb),
r AS (SELECT *, cc+tc-ic AS uc, {share('ic', 'cc')} AS p, {share('ic', 'tc')} AS r, {share('cb', 'cc')} AS bp, {share('tb', 'tc')} AS br FROM n)"""


_F1 = "CASE WHEN {a}+{b} > 0 THEN 2*{a}*{b}/({a}+{b}) ELSE 0 END"


@query("ridge_overlap", f"""WITH {A}, th AS (SELECT quantile_cont(CAST(fv AS DOUBLE), 0.95) FILTER (WHERE fv > 0) AS a, quantile_cont(CAST(ft AS DOUBLE), 0.95) FILTER (WHERE ft > 0) AS b FROM att),
c AS (SELECT i3, i2, i1 FROM att, th WHERE fv > 0 AND CAST(fv AS DOUBLE) >= a), t AS (SELECT i3, i2, i1 FROM att, th WHERE ft > 0 AND CAST(ft AS DOUBLE) >= b), {_sql_buffered('c', 't')}
SELECT cc AS candidate_count, tc AS truth_count, ic AS intersection_count, uc AS union_count, cb AS candidate_in_truth_buffer_count, tb AS truth_in_candidate_buffer_count,
 round(p, 6) AS precision, round(r, 6) AS recall, round({_F1.format(a='p', b='r')}, 6) AS f1, round(CASE WHEN uc > 0 THEN ic/uc ELSE 0 END, 6) AS jaccard, round(bp, 6) AS buffered_precision,
 round(br, 6) AS buffered_recall, round({_F1.format(a='bp', b='br')}, 6) AS buffered_f1, 2.0::DOUBLE AS radius FROM r""")
def q_ridge_overlap(spark, sf):
    """Top ridges of the noisy votes against those of the clean volume."""
    return rnd(metrics.ridge_overlap(attributes(spark, sf), "ft", "fv", 95.0))


@query("stage_transition", f"""WITH {A}, t AS (SELECT i3, i2, i1 FROM att WHERE fv > CAST(0.35 AS FLOAT)), c AS (SELECT i3, i2, i1 FROM att WHERE fv > CAST(0.55 AS FLOAT)), {_sql_buffered('c', 't')}
SELECT tc AS source_count, cc AS target_count, round(cc/tc, 6) AS target_to_source_count_ratio, round({_F1.format(a='bp', b='br')}, 6) AS buffered_f1_r2 FROM r""")
def q_stage_transition(spark, sf):
    """From a loose to a strict threshold of the votes."""
    a = attributes(spark, sf)
    over = lambda x: a.where(F.col("fv") > F.lit(x).cast("float")).select(*ID3)
    return rnd(metrics.stage_transition(over(0.35), over(0.55), 2.0))


@query("outlier_persistence", f"""WITH {A}, b AS (SELECT i3, i2, i1, CAST(fv AS DOUBLE) AS d FROM att WHERE fv > CAST(0.7 AS FLOAT) AND i3 >= 2 AND i2 >= 5 AND i1 >= 8),
c AS (SELECT i3, i2, i1, CAST(fv AS DOUBLE)*2 AS d FROM att WHERE fv > CAST(0.75 AS FLOAT) AND vt > CAST(60 AS FLOAT))
SELECT i3, i2, i1, round(b.d, 6) AS base_distance, round(c.d, 6) AS context_distance, c.d IS NOT NULL AS persists FROM b LEFT JOIN c USING (i3, i2, i1)""")
def q_outlier_persistence(spark, sf):
    """Outliers of a crop looked up among the stronger and steeper ones of the whole volume."""
    a = attributes(spark, sf)
    v = F.col("fv").cast("double")
    crop = a.where((F.col("fv") > F.lit(0.7).cast("float")) & (F.col("i3") >= 2) & (F.col("i2") >= 5) & (F.col("i1") >= 8))
    base = crop.select((F.col("i3") - 2).alias("i3"), (F.col("i2") - 5).alias("i2"), (F.col("i1") - 8).alias("i1"), v.alias("distance"))
    context = a.where((F.col("fv") > F.lit(0.75).cast("float")) & (F.col("vt") > 60)).select(*ID3, (v * 2).alias("distance"))
    return rnd(comparisons.outlier_persistence(base, context, (2, 5, 8)))


@query("boundary_degraded", f"""WITH {A}, p AS (SELECT count(*) AS n, count(*) FILTER (WHERE least(i3, n3-1-i3, i2, n2-1-i2, i1, n1-1-i1) < 2) AS e FROM att WHERE fv > CAST(0.45 AS FLOAT)),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE least(i3, n3-1-i3, i2, n2-1-i2, i1, n1-1-i1) < 2) AS e FROM att WHERE fv > CAST(0.6 AS FLOAT)),
q AS (SELECT s.n/p.n AS cov, p.e/p.n AS pe, s.e/s.n AS se FROM p, s)
SELECT round(cov, 6) AS cell_coverage, array_to_string(list_filter([CASE WHEN pe >= 0.25 THEN 'fvt_positive_edge_shell' END, 'fvt_far_from_scanner_target',
 CASE WHEN cov < 0.5 AND pe >= 0.15 AND se >= 0.05 THEN 'low_primary_coverage_with_edge_local_candidates' END], lambda x: x IS NOT NULL), ',') AS boundary_reasons FROM q""")
def q_boundary_degraded(spark, sf):
    """Boundary reasons of a strict vote mask measured against a loose one."""
    from ridgeline.functions.scores import near_edge

    a = attributes(spark, sf)
    over = lambda x: F.col("fv") > F.lit(x).cast("float")
    n = a.agg(
        F.count_if(over(0.45)).alias("pn"), F.count_if(over(0.45) & near_edge(2)).alias("pe"), F.count_if(over(0.6)).alias("sn"),
        F.count_if(over(0.6) & near_edge(2)).alias("se"),
    )
    row = n.withColumns({"cell_coverage": F.col("sn") / F.col("pn"), "reasons": F.array(F.lit("low_fvt_positive_coverage"))})
    out = components.boundary_degraded(row, F.col("pn"), F.col("pe") / F.col("pn"), F.col("se") / F.col("sn"), F.lit(2.5))
    return out.select(F.round("cell_coverage", 6).alias("cell_coverage"), F.array_join("boundary_reasons", ",").alias("boundary_reasons"))


@query("minimum_component_size", """WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, n, CAST(greatest(8, ceil(0.05*n)) AS BIGINT) AS least FROM c""")
def q_minimum_size(spark, sf):
    """Smallest component that a group of candidates lets stand."""
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return g.select("l_returnflag", "n", components.minimum_component_size(F.col("n")).alias("least"))


# ---------------------------------------------------------------- thinning and warping


def _sql_scanner_normal() -> str:
    w2, w3 = sql_normal("vp", "vt")[1:]
    return f"""s0 AS (SELECT i3, i2, i1, fv FROM att), {_sql_sides('s0')},
nrm AS (SELECT a.i3, a.i2, a.i1, a.vp, a.vt, CASE WHEN fp < a.fv AND fm < a.fv THEN a.fv ELSE 0.0 END AS thin FROM att a JOIN sid USING (i3, i2, i1))"""


@query("scanner_thin_normal", f"""WITH {A}, {_sql_scanner_normal()} SELECT i3, i2, i1, {s6('thin', 'ft')}, {s6('CASE WHEN thin > 0 THEN vp ELSE 0 END', 'pt', 3)}, {s6('CASE WHEN thin > 0 THEN vt ELSE 0 END', 'tt', 3)} FROM nrm""")
def q_scanner_normal(spark, sf):
    """Positive maxima of the votes along their normal."""
    t = attribute_traces(spark, sf).select("i3", "i2", F.col("fv").alias("ft"), F.col("vp").alias("pt"), F.col("vt").alias("tt"))
    v = thinning.scanner_thin_normal(t, tiling=TILING)
    return v.select(*ID3, r6("ft"), F.round(F.col("pt").cast("double"), 3).alias("pt"), F.round(F.col("tt").cast("double"), 3).alias("tt"))


@query("warp_image", f"""WITH {IMG}, s AS (SELECT max(i2)+1 AS n2, max(i1)+1 AS n1 FROM img),
p AS (SELECT i2, i1, greatest(0.0, least(n2-1.0, CAST(CAST(i2 + 3.0*CAST(v AS DOUBLE) AS FLOAT) AS DOUBLE))) AS x2, greatest(0.0, least(n1-1.0, CAST(CAST(i1 - 2.0*CAST(v AS DOUBLE) AS FLOAT) AS DOUBLE))) AS x1 FROM img, s),
c AS (SELECT p.i2 AS q2, p.i1 AS q1, CAST(floor(x2) AS INTEGER)+b.k AS i2, CAST(floor(x1) AS INTEGER)+d.k AS i1,
 (CASE b.k WHEN 1 THEN x2-floor(x2) ELSE 1-(x2-floor(x2)) END)*(CASE d.k WHEN 1 THEN x1-floor(x1) ELSE 1-(x1-floor(x1)) END) AS w FROM p CROSS JOIN (VALUES (0), (1)) b(k) CROSS JOIN (VALUES (0), (1)) d(k))
SELECT q2 AS i2, q1 AS i1, round(CAST(CAST(sum(w*CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE), 4) + 0.0 AS v FROM c JOIN img USING (i2, i1) WHERE w > 0 GROUP BY q2, q1""")
def q_warp(spark, sf):
    """An image sampled where its own values push each pixel."""
    v = with_shape(to_voxels(image(spark, sf), ["v"]))
    d = F.col("v").cast("double")
    w = v.withColumns({"x2": (F.col("i2") + 3.0 * d).cast("float"), "x1": (F.col("i1") - 2.0 * d).cast("float")})
    return sampling.warp_image(w, "v", "x2", "x1").select("i2", "i1", (F.round(F.col("v").cast("double"), 4) + 0.0).alias("v"))


# ---------------------------------------------------------------- path costs, paths and their smoothing

# costs are whole numbers, so sums are exact and ties are real: 9 steps of 7 lags from each vector
_RU, _RV = 3, 4
_BOUND = "CASE WHEN abs(pos // 7 - 4) > 2 THEN least(abs(pos // 7 - 4), 3) ELSE 0 END"
_COST = f"""c AS (SELECT vec_id, list_transform(range(63), lambda pos: CASE WHEN abs(pos % 7 - 3) > {_BOUND} THEN 1000 ELSE CAST(floor(abs(embedding[pos + 1]) * 64) AS BIGINT) END) AS cost FROM embeddings)"""


def _cumulative(name: str, source: str, forward: bool = True) -> str:
    """Recursive CTE name(vec_id, i, acc): cumulative costs of step i."""
    at = "(i + 1) * 7" if forward else "(i - 1) * 7"
    start, stop, step = ("0", "i < 8", "i + 1") if forward else ("8", "i > 0", "i - 1")
    near = "least(acc[greatest(l, 1)], acc[l + 1], acc[least(l + 2, 7)])"
    return f"""{name}(vec_id, i, acc) AS (SELECT vec_id, {start}, list_transform(range(7), lambda l: cost[{start} * 7 + l + 1]) FROM {source}
 UNION ALL SELECT vec_id, {step}, list_transform(range(7), lambda l: {near} + cost[{at} + l + 1]) FROM {name} JOIN {source} USING (vec_id) WHERE {stop})"""


_SMOOTHED = f"""{_cumulative('f', 'c')}, {_cumulative('b', 'c', False)},
s AS (SELECT vec_id, flatten(list(list_transform(range(7), lambda l: f.acc[l + 1] + b.acc[l + 1] - cost[i * 7 + l + 1]) ORDER BY i)) AS cost FROM f JOIN b USING (vec_id, i) JOIN c USING (vec_id) GROUP BY vec_id)"""
_PATH = f"""{_SMOOTHED}, {_cumulative('a', 's')},
p(vec_id, i, lag) AS (SELECT vec_id, 8, CASE WHEN list_min(acc) < acc[4] THEN list_position(acc, list_min(acc)) - 1 ELSE 3 END FROM a WHERE i = 8
 UNION ALL SELECT vec_id, p.i - 1, CASE WHEN least(acc[greatest(lag, 1)], acc[least(lag + 2, 7)]) < acc[lag + 1]
   THEN CASE WHEN acc[greatest(lag, 1)] <= acc[least(lag + 2, 7)] THEN greatest(lag - 1, 0) ELSE least(lag + 1, 6) END ELSE lag END
  FROM p JOIN a USING (vec_id) WHERE a.i = p.i - 1 AND p.i > 0)"""


def _path_rows(spark, sf, **options):
    e = table(spark, sf, "embeddings")
    cost = F.transform(F.slice("embedding", 1, 63), lambda x: F.floor(F.abs(x) * 64).cast("float"))
    return paths.line_paths(e.select("vec_id", cost.alias("cost")), "vec_id", "cost", _RU, _RV, **options)


@query("path_cumulative_costs", f"""WITH RECURSIVE {_COST}, {_cumulative('f', 'c')}, {_cumulative('b', 'c', False)}
SELECT vec_id, i AS step, l AS lag, CAST(f.acc[l + 1] AS DOUBLE) AS forward, CAST(b.acc[l + 1] AS DOUBLE) AS backward FROM f JOIN b USING (vec_id, i) CROSS JOIN range(7) t(l)""")
def q_path_costs(spark, sf):
    """Cumulative costs of every step and lag, from both ends."""
    z = F.posexplode(F.arrays_zip("forward", "backward")).alias("at", "z")
    d = lambda c: F.col(c).cast("double")
    return _path_rows(spark, sf).select("vec_id", z).select(
        "vec_id", F.floor(F.col("at") / 7).alias("step"), (F.col("at") % 7).cast("bigint").alias("lag"), d("z.forward").alias("forward"), d("z.backward").alias("backward")
    )


@query("path_smoothed_costs", f"""WITH RECURSIVE {_COST}, {_SMOOTHED}
SELECT vec_id, i AS step, l AS lag, CAST(cost[i * 7 + l + 1] AS DOUBLE) AS cost FROM s CROSS JOIN range(9) u(i) CROSS JOIN range(7) t(l)""")
def q_path_smoothed(spark, sf):
    """Cost of the best path through each step and lag."""
    return _path_rows(spark, sf).select("vec_id", F.posexplode("smoothed").alias("at", "c")).select(
        "vec_id", F.floor(F.col("at") / 7).alias("step"), (F.col("at") % 7).cast("bigint").alias("lag"), F.col("c").cast("double").alias("cost")
    )


@query("path_backtrack", f"WITH RECURSIVE {_COST}, {_PATH} SELECT vec_id, CAST(i AS INTEGER) AS step, CAST(lag - 3 AS DOUBLE) AS lag FROM p")
def q_path_backtrack(spark, sf):
    """The cheapest path after one smoothing pass, traced back with ties kept straight."""
    return _path_rows(spark, sf).select("vec_id", F.posexplode("path").alias("step", "l")).select("vec_id", "step", F.col("l").cast("double").alias("lag"))


# masked lines: a lag may be taken where the vector's value there is above -0.2; infinity stands for "no path"
_OPEN = f"abs(pos % 7 - 3) <= {_BOUND} AND embedding[pos + 1] > CAST(-0.2 AS FLOAT)"
_MASKED = f"""c AS (SELECT vec_id, list_transform(range(63), lambda pos: CASE WHEN {_OPEN} THEN floor(abs(embedding[pos + 1]) * 64)::DOUBLE ELSE 'infinity'::DOUBLE END) AS cost FROM embeddings)"""
_MASKED_SMOOTHED = f"""{_cumulative('f', 'c')}, {_cumulative('b', 'c', False)},
s AS (SELECT vec_id, flatten(list(list_transform(range(7), lambda l: CASE WHEN isinf(f.acc[l + 1]) OR isinf(b.acc[l + 1]) THEN 'infinity'::DOUBLE ELSE f.acc[l + 1] + b.acc[l + 1] - cost[i * 7 + l + 1] END) ORDER BY i)) AS cost FROM f JOIN b USING (vec_id, i) JOIN c USING (vec_id) GROUP BY vec_id)"""


def _masked_rows(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 63).alias("v"))
    lines = e.select(
        "vec_id", F.transform("v", lambda x: F.floor(F.abs(x) * 64).cast("float")).alias("cost"),
        F.transform("v", lambda x: x > F.lit(-0.2).cast("float")).alias("valid"),
    )
    return masked.line_paths(lines, "vec_id", "cost", "valid", _RU, _RV)


@query("path_masked_costs", f"""WITH RECURSIVE {_MASKED}, {_MASKED_SMOOTHED},
r AS (SELECT vec_id, i AS step, l AS lag, f.acc[l + 1] AS x, b.acc[l + 1] AS y, s.cost[i * 7 + l + 1] AS z FROM f JOIN b USING (vec_id, i) JOIN s USING (vec_id) CROSS JOIN range(7) t(l))
SELECT vec_id, step, lag, CASE WHEN NOT isinf(x) THEN x END AS forward, CASE WHEN NOT isinf(y) THEN y END AS backward, CASE WHEN NOT isinf(z) THEN z END AS smoothed FROM r""")
def q_masked_costs(spark, sf):
    """Cumulative and smoothed costs inside a mask of lags; null where no path leads."""
    z = F.posexplode(F.arrays_zip("forward", "backward", "smoothed")).alias("at", "z")
    return _masked_rows(spark, sf).select("vec_id", z).select(
        "vec_id", F.floor(F.col("at") / 7).alias("step"), (F.col("at") % 7).cast("bigint").alias("lag"),
        *[F.col(f"z.{n}").cast("double").alias(n) for n in ("forward", "backward", "smoothed")],
    )


@query("path_masked", f"""WITH RECURSIVE {_MASKED}, {_MASKED_SMOOTHED}, {_cumulative('a', 's')},
p(vec_id, i, lag) AS (SELECT vec_id, 8, CASE WHEN list_min(acc) < acc[4] THEN list_position(acc, list_min(acc)) - 1 ELSE 3 END FROM a WHERE i = 8 AND NOT isinf(list_min(acc))
 UNION ALL SELECT vec_id, p.i - 1, CASE WHEN least(acc[greatest(lag, 1)], acc[least(lag + 2, 7)]) < acc[lag + 1]
   THEN CASE WHEN acc[greatest(lag, 1)] <= acc[least(lag + 2, 7)] THEN greatest(lag - 1, 0) ELSE least(lag + 1, 6) END ELSE lag END
  FROM p JOIN a USING (vec_id) WHERE a.i = p.i - 1 AND p.i > 0)
SELECT vec_id, CAST(i AS INTEGER) AS step, CAST(lag - 3 AS DOUBLE) AS lag, true AS found FROM p UNION ALL SELECT vec_id, -1, 0.0::DOUBLE, false FROM a WHERE i = 8 AND isinf(list_min(acc))""")
def q_masked_path(spark, sf):
    """The cheapest path inside the mask; vectors without one have a single row (step -1, not found)."""
    r = _masked_rows(spark, sf).select("vec_id", F.posexplode_outer("path").alias("step", "l"))
    return r.select(
        "vec_id", F.coalesce("step", F.lit(-1)).alias("step"), F.coalesce(F.col("l").cast("double"), F.lit(0.0)).alias("lag"), F.col("l").isNotNull().alias("found")
    )


_W = ", ".join(f"({k - len(gaussian_weights(1.5)) // 2}, {w!r})" for k, w in enumerate(gaussian_weights(1.5)))


@query("path_smoothing", f"""WITH RECURSIVE {_COST}, {_PATH}
SELECT x.vec_id, CAST(x.i AS INTEGER) AS step, round(sum(w.w * (y.lag - 3)), 4) + 0.0 AS lag FROM p x CROSS JOIN (VALUES {_W}) w(k, w) JOIN p y ON y.vec_id = x.vec_id AND y.i = least(greatest(x.i + w.k, 0), 8) GROUP BY x.vec_id, x.i""")
def q_path_smoothing(spark, sf):
    """The path smoothed along its steps, ends repeated."""
    r = _path_rows(spark, sf, sigma=1.5).select("vec_id", F.posexplode("path").alias("step", "l"))
    return r.select("vec_id", "step", (F.round(F.col("l").cast("double"), 4) + 0.0).alias("lag"))


# ---------------------------------------------------------------- workflow variants


@query("boundary_policies")
def q_boundary_policies(spark, sf):
    """Both boundary policies on a plane beside a face: what became of the seeds, and votes on the faces."""
    from driver_queries.scans import seeds_3d
    from ridgeline.operators.voting import BOUNDARY_POLICIES, Voter, seed_surfaces, voting_summary

    traces, picked = seeds_3d(spark, sf, "boundary_plane")
    picked = cut_lineage(picked)
    runs = [
        voting_summary(seed_surfaces(traces, "ft", picked, Voter(3, 5, 5, boundary=p), TILING, votes=False)).select(F.lit(p).alias("policy"), "*")
        for p in BOUNDARY_POLICIES
    ]
    return runs[0].unionByName(runs[1])


@query("variant_surfaces")
def q_variants(spark, sf):
    """Surfaces of variants that differ in voter, boundary policy, seeds, thinning, clean-up and fallback."""
    from driver_queries.base import case_voxels
    from ridgeline.operators.voting import Voter
    from ridgeline.plans.variants import run_variants
    from ridgeline.plans.workflow import Profile

    case = case_voxels(spark, sf, "single_dipping_plane").select(*ID3, "ft", F.col("truth_strike").alias("pt"), F.col("truth_dip").alias("tt"))
    names = [
        "current_default", "boundary_aware_voter_v1", "voter_thin_hybrid_v2_recenter_scanner_target", "boundary_seed_retention_v1",
        "quality_boundary_skinner_fallback_v3",
    ]
    cells = run_variants(case, Profile(voter=Voter(2, 4, 4), seed_distance=3, seed_threshold=0.5), names, TILING)
    found = cells.groupBy("variant").agg(
        F.count(F.lit(1)).alias("cells"), F.count_distinct("component").alias("surfaces"), F.max("skin_size").alias("largest"), F.max("replaced").alias("replaced")
    )
    asked = spark.range(len(names)).select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("id").cast("int") + 1).alias("variant"))
    return asked.join(found, "variant", "left").na.fill(0, ["cells", "surfaces", "largest"]).na.fill(False, ["replaced"])


# ---------------------------------------------------------------- tables as files


@query("summary_csv", """SELECT l_returnflag AS variant, l_linestatus AS case_id, count(*) AS rows, round(avg(l_quantity), 6) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL""")
def q_summary_csv(spark, sf):
    """Summary rows written as CSV and one variant read back."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("case_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("l_quantity"), 6).alias("quantity")
    )
    folder = new_folder(spark, "summary")
    tables.write_metrics(g, folder)
    return tables.read_summary(spark, folder, "R", "variant string, case_id string, rows bigint, quantity double")


@query("bundle_check", """WITH v AS (SELECT vec_id // 25 AS i3, vec_id % 25 AS i2, embedding FROM embeddings), s AS (SELECT l_suppkey AS skin_id, l_orderkey, l_linenumber FROM lineitem)
SELECT 'cells' AS name, (SELECT count(*) FROM s) AS rows UNION ALL SELECT 'votes', (SELECT count(*) FROM v)""")
def q_bundle(spark, sf):
    """A bundle of two tables written with its manifest, then checked against it; only sound tables are listed."""
    e = table(spark, sf, "embeddings")
    votes = e.select(F.floor(F.col("vec_id") / 25).alias("i3"), F.pmod("vec_id", F.lit(25)).alias("i2"), F.col("embedding").alias("fv"))
    cells = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("skin_id"), "l_orderkey", "l_linenumber")
    folder = new_folder(spark, "bundle")
    tables.write_bundle(spark, folder, {"votes": votes, "cells": cells}, {"source": "given tables"})
    return tables.check_bundle(spark, folder).where("sound").select("name", "rows")
