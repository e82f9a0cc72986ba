"""Generators, masks, stencils and thinning."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import (
    IMG, N2, TILING, VOX, attribute_traces, attributes, case_voxels, image, query, r6, s6, sql_attributes, sql_case,
    sql_normal, sql_pass, table, volume, voxels,
)
from ridgeline.functions.angles import (
    cross, dip_of_normal, dip_vector, nearest_index, normal_vector, periodic_error, range180, range360,
    strike_dip_of_normal, strike_of_normal, strike_vector,
)
from ridgeline.functions.kernels import gaussian_weights
from ridgeline.functions.scores import edge_distance
from ridgeline.grid import flat_index, region, to_voxels, with_shape
from ridgeline.operators import masks, stencil, thinning
from ridgeline.sources.cases import CASES, expand_trials, scanner_input

ID3 = ["i3", "i2", "i1"]


# ---------------------------------------------------------------- generators


def _register_case(case: str) -> None:
    sql = f"""WITH {sql_case(case)}
SELECT i3, i2, i1, truth_mask, truth_id, {s6('truth_distance', 'truth_distance', 5)},
 {s6('truth_strike', 'truth_strike', 3)}, {s6('truth_dip', 'truth_dip', 3)}, {s6('ft', 'ft', 5)} FROM cas"""

    @query(f"case_{case}", sql)
    def run(spark, sf):
        """Analytic case on the grid of the embeddings volume."""
        c = case_voxels(spark, sf, case)
        return c.select(
            *ID3, "truth_mask", "truth_id", F.round(F.col("truth_distance").cast("double"), 5).alias("truth_distance"),
            F.round(F.col("truth_strike").cast("double"), 3).alias("truth_strike"),
            F.round(F.col("truth_dip").cast("double"), 3).alias("truth_dip"),
            F.round(F.col("ft").cast("double"), 5).alias("ft"),
        )


for _case in CASES:
    _register_case(_case)


@query("scanner_input", f"""WITH {sql_case('single_dipping_plane')}
SELECT i3, i2, i1, round(CAST(CAST(greatest(0.0, least(1.0, 1.0 - 0.85*CAST(ft AS DOUBLE) + 0.1*CAST(v AS DOUBLE))) AS FLOAT) AS DOUBLE), 5) AS g
FROM cas""")
def q_scanner_input(spark, sf):
    c = case_voxels(spark, sf, "single_dipping_plane")
    g = scanner_input(F.col("ft"), 0.1 * F.col("v").cast("double"))
    return c.select(*ID3, F.round(g.cast("double"), 5).alias("g"))


@query("expand_trials", """WITH c AS (SELECT DISTINCT event_type AS case_id, event_type = 'click' AS s FROM events),
u AS (SELECT DISTINCT user_id AS seed FROM events)
SELECT c.case_id, CASE WHEN u.seed IS NULL THEN c.case_id ELSE c.case_id || '__seed_' || CAST(u.seed AS VARCHAR) END AS trial_id, u.seed
FROM c LEFT JOIN u ON c.s""")
def q_expand_trials(spark, sf):
    """Event types as cases; clicks are stochastic, one trial per user id as seed."""
    e = table(spark, sf, "events")
    cases = e.select(F.col("event_type").alias("case_id")).distinct().withColumn(
        "is_stochastic", F.col("case_id") == "click"
    )
    return expand_trials(cases, e.select(F.col("user_id").alias("seed")).distinct())


# ---------------------------------------------------------------- scalar functions


@query("strike_dip_vectors", f"""WITH {sql_attributes()}, q AS (SELECT i3, i2, i1, vp, vt,
 CAST(sin(radians(CAST(vt AS DOUBLE))) AS FLOAT) AS d1,
 CAST(cos(radians(CAST(vt AS DOUBLE)))*cos(radians(CAST(vp AS DOUBLE))) AS FLOAT) AS d2,
 CAST(-cos(radians(CAST(vt AS DOUBLE)))*sin(radians(CAST(vp AS DOUBLE))) AS FLOAT) AS d3,
 CAST(sin(radians(CAST(vp AS DOUBLE))) AS FLOAT) AS s2, CAST(cos(radians(CAST(vp AS DOUBLE))) AS FLOAT) AS s3,
 {sql_normal('vp', 'vt')[0]} AS n1, {sql_normal('vp', 'vt')[1]} AS n2, {sql_normal('vp', 'vt')[2]} AS n3 FROM att)
SELECT i3, i2, i1, {s6('d1','d1',5)}, {s6('d2','d2',5)}, {s6('d3','d3',5)}, {s6('s2','s2',5)}, {s6('s3','s3',5)},
 {s6('n1','n1',5)}, {s6('n2','n2',5)}, {s6('n3','n3',5)},
 round(CAST(d3*s2 - d2*s3 AS DOUBLE) + 0.0, 4) + 0.0 AS c1,
 round(degrees(acos(-CAST(n1 AS DOUBLE))), 2) AS dip_back FROM q""")
def q_vectors(spark, sf):
    a = attributes(spark, sf)
    d, n, s = dip_vector("vp", "vt"), normal_vector("vp", "vt"), strike_vector("vp")
    r5 = lambda c, name: F.round(c.cast("double"), 5).alias(name)
    c1 = cross(d, s)[0]
    return a.select(
        *ID3, r5(d[0], "d1"), r5(d[1], "d2"), r5(d[2], "d3"), r5(s[1], "s2"), r5(s[2], "s3"),
        r5(n[0], "n1"), r5(n[1], "n2"), r5(n[2], "n3"),
        (F.round(c1.cast("double"), 4) + 0.0).alias("c1"), F.round(dip_of_normal(n[0].cast("double")), 2).alias("dip_back"),
    )


@query("strike_dip_from_normal", f"""WITH {sql_attributes()},
q AS (SELECT i3, i2, i1, {sql_normal('vp','vt')[0]} AS w1, {sql_normal('vp','vt')[1]} AS w2, {sql_normal('vp','vt')[2]} AS w3 FROM att WHERE vt > 1),
a AS (SELECT *, degrees(atan2(-CAST(w3 AS DOUBLE), CAST(w2 AS DOUBLE))) AS s FROM q)
SELECT i3, i2, i1, round(CAST(CAST(CASE WHEN s < 0 THEN s + 360.0 ELSE s END AS FLOAT) AS DOUBLE), 2) % 360.0 AS strike, round(CAST(CAST(degrees(acos(-CAST(w1 AS DOUBLE))) AS FLOAT) AS DOUBLE), 2) AS dip FROM a""")
def q_from_normal(spark, sf):
    """Angles recovered from the flipped normals (the sign convention is undone)."""
    a = attributes(spark, sf).where(F.col("vt") > 1)
    n = [-x.cast("double") for x in normal_vector("vp", "vt")]
    strike, dip = strike_dip_of_normal(*n)
    return a.select(
        *ID3, (F.round(strike.cast("double"), 2) % 360.0).alias("strike"), F.round(dip.cast("double"), 2).alias("dip")
    )


@query("angle_wrapping", """WITH q AS (SELECT l_orderkey, l_linenumber, (l_extendedprice - 40000.0)/37.0 AS a, l_quantity*15.0 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a - 360.0*floor(a/360.0), 6) AS a360,
 round(CASE WHEN a - 360.0*floor(a/360.0) > 180.0 THEN a - 360.0*floor(a/360.0) - 360.0 ELSE a - 360.0*floor(a/360.0) END, 6) AS a180,
 round(abs((a-b+90.0) - 180.0*floor((a-b+90.0)/180.0) - 90.0), 6) AS err180,
 CAST(floor(a + 0.5) AS INTEGER) AS nearest FROM q""")
def q_angles(spark, sf):
    t = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", ((F.col("l_extendedprice") - 40000.0) / 37.0).alias("a"),
        (F.col("l_quantity") * 15.0).alias("b"),
    )
    return t.select(
        "l_orderkey", "l_linenumber", F.round(range360("a"), 6).alias("a360"), F.round(range180("a"), 6).alias("a180"),
        F.round(periodic_error("a", "b"), 6).alias("err180"), nearest_index("a").alias("nearest"),
    )


# ---------------------------------------------------------------- masks and projections


@query("nonzero_fraction", f"""WITH {sql_attributes()} SELECT truth_id, count(*) AS size,
 count(*) FILTER (WHERE abs(fv) > CAST(1e-6 AS FLOAT)) AS nonzero_count,
 count(*) FILTER (WHERE fv > CAST(1e-6 AS FLOAT)) AS positive_count,
 round(count(*) FILTER (WHERE abs(fv) > CAST(1e-6 AS FLOAT)) / count(*), 6) AS nonzero_fraction FROM att GROUP BY truth_id""")
def q_nonzero(spark, sf):
    out = masks.nonzero_report(attributes(spark, sf), "fv", ("truth_id",))
    return out.withColumn("nonzero_fraction", F.round("nonzero_fraction", 6))


@query("top_percentile_mask", f"""WITH {sql_attributes()},
t AS (SELECT quantile_cont(CAST(fv AS DOUBLE), 0.97) AS t FROM att WHERE fv > 0)
SELECT i3, i2, i1, {s6('fv','fv')} FROM att, t WHERE fv > 0 AND CAST(fv AS DOUBLE) >= t.t""")
def q_percentile_mask(spark, sf):
    a = masks.percentile_mask(attributes(spark, sf), "fv", 97.0)
    return a.where("mask").select(*ID3, r6("fv"))


@query("top_k_mask", f"""WITH {sql_attributes()},
q AS (SELECT i3, i2, i1, round(CAST(fv AS DOUBLE), 2) AS f2, (CAST(i3 AS BIGINT)*n2 + i2)*n1 + i1 AS flat FROM att),
k AS (SELECT *, row_number() OVER (ORDER BY f2 DESC, flat) AS rn FROM q)
SELECT i3, i2, i1, f2 FROM k WHERE rn <= 777""")
def q_top_k(spark, sf):
    """Many ties (two decimals), cut in ascending flat order."""
    a = attributes(spark, sf).withColumn("f2", F.round(F.col("fv").cast("double"), 2)).withColumn("flat", flat_index())
    return masks.top_k_mask(a, "f2", 777).where("mask").select(*ID3, "f2")


@query("top_truth_count_mask", f"""WITH {sql_attributes()},
c AS (SELECT count(*) AS k FROM att WHERE truth_mask),
k AS (SELECT i3, i2, i1, truth_mask, row_number() OVER (ORDER BY fv DESC, (CAST(i3 AS BIGINT)*n2 + i2)*n1 + i1) AS rn FROM att WHERE CAST(fv AS DOUBLE) > 1e-6)
SELECT i3, i2, i1, truth_mask FROM k, c WHERE rn <= k""")
def q_top_truth(spark, sf):
    a = attributes(spark, sf).withColumn("flat", flat_index())
    return masks.top_truth_count_mask(a, "fv", "truth_mask", positive_only=True).where("mask").select(*ID3, "truth_mask")


@query("edge_shell", f"""WITH {VOX}, d AS (SELECT i3, i2, i1, least(i3, n3-1-i3, i2, n2-1-i2, i1, n1-1-i1) AS edge_distance FROM vox, shp)
SELECT i3, i2, i1, edge_distance, edge_distance < 4 AS is_edge, edge_distance >= 4 AS is_interior FROM d""")
def q_edge(spark, sf):
    return masks.region_columns(voxels(spark, sf), 4).select(*ID3, "edge_distance", "is_edge", "is_interior")


@query("region_scan", f"""WITH {VOX} SELECT i3, i2, i1 - 10 AS i1, {s6('v','v')} FROM vox WHERE i3 >= 4 AND i3 < 12 AND i2 >= 5 AND i2 < 20 AND i1 >= 10 AND i1 < 40""")
def q_region(spark, sf):
    """Sub-cube read; the trace is sliced before it is exploded."""
    return to_voxels(region(volume(spark, sf), (4, 12), (5, 20), (10, 40)), ["v"]).select(*ID3, r6("v"))


# ---------------------------------------------------------------- stencils


@query("gaussian_1d", f"""WITH {VOX}, {sql_pass('s', 'vox', 'v', 'i1', gaussian_weights(2.0), '(SELECT n1 FROM shp)')}
SELECT i3, i2, i1, {s6('v','v')} FROM s""")
def q_gauss1(spark, sf):
    t = volume(spark, sf).withColumn("v", stencil.along_trace("v", gaussian_weights(2.0)))
    return to_voxels(t, ["v"]).select(*ID3, r6("v"))


@query("gaussian_2d", f"""WITH {IMG}, {sql_pass('a', 'img', 'v', 'i2', gaussian_weights(1.0), '(SELECT max(i2)+1 FROM img)')},
{sql_pass('b', 'a', 'v', 'i1', gaussian_weights(1.0), '(SELECT max(i1)+1 FROM img)')} SELECT i2, i1, {s6('v','v')} FROM b""")
def q_gauss2(spark, sf):
    t = stencil.smooth(image(spark, sf), "v", "s", (0.0, 1.0, 1.0), TILING)
    return to_voxels(t, ["s"]).select("i2", "i1", F.round(F.col("s").cast("double"), 6).alias("v"))


_G3 = f"""{sql_pass('s3', 'att', 'fv', 'i3', gaussian_weights(1.0), '(SELECT n3 FROM shp)')},
{sql_pass('s2', 's3', 'fv', 'i2', gaussian_weights(1.0), '(SELECT n2 FROM shp)')},
{sql_pass('s1', 's2', 'fv', 'i1', gaussian_weights(1.0), '(SELECT n1 FROM shp)')}"""


@query("gaussian_3d", f"WITH {sql_attributes()}, {_G3} SELECT i3, i2, i1, {s6('fv','fv')} FROM s1")
def q_gauss3(spark, sf):
    t = stencil.smooth(attribute_traces(spark, sf), "fv", "s", 1.0, TILING)
    return to_voxels(t, ["s"]).select(*ID3, F.round(F.col("s").cast("double"), 6).alias("fv"))


def _sql_derivatives() -> str:
    w = [gaussian_weights(1.0, o) for o in range(3)]
    n = {"i3": "(SELECT n3 FROM shp)", "i2": "(SELECT n2 FROM shp)", "i1": "(SELECT n1 FROM shp)"}
    parts = []
    for a in (0, 1, 2):
        parts.append(sql_pass(f"g{a}", "vox", "v", "i3", w[a], n["i3"]))
    for a, b in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)):
        parts.append(sql_pass(f"g{a}{b}", f"g{a}", "v", "i2", w[b], n["i2"]))
    for name, (a, b, c) in stencil.DERIVATIVES_3D.items():
        parts.append(sql_pass(name, f"g{a}{b}", "v", "i1", w[c], n["i1"]))
    return ",\n".join(parts)


_DERS = list(stencil.DERIVATIVES_3D)
_DER_JOIN = "d1 " + " ".join(f"JOIN {d} USING (i3, i2, i1)" for d in _DERS[1:])


@query("gaussian_derivatives", f"""WITH {VOX}, {_sql_derivatives()}
SELECT i3, i2, i1, {', '.join(s6(f'{d}.v', d) for d in _DERS)} FROM {_DER_JOIN}""")
def q_derivatives(spark, sf):
    g = stencil.gaussian_derivatives(volume(spark, sf), "v", 1.0, tiling=TILING)
    return to_voxels(g, _DERS).select(*ID3, *[r6(d) for d in _DERS])


# ---------------------------------------------------------------- thinning

_SM2 = f"""{sql_pass('m3', 'att', 'fv', 'i3', gaussian_weights(1.0), '(SELECT n3 FROM shp)')},
{sql_pass('sm', 'm3', 'fv', 'i2', gaussian_weights(1.0), '(SELECT n2 FROM shp)')}"""


def _sql_nms(strict: bool = True) -> str:
    op = ">" if strict else ">="

    def pair(d3, d2):
        return f"coalesce(s.fv {op} p{d3}{d2}.fv AND s.fv {op} q{d3}{d2}.fv, false)".replace("-", "m")

    joins = []
    for d3, d2 in ((0, 1), (1, -1), (1, 0), (1, 1)):
        tag = f"{d3}{d2}".replace("-", "m")
        joins.append(
            f"LEFT JOIN sm p{tag} ON p{tag}.i3 = s.i3+({d3}) AND p{tag}.i2 = s.i2+({d2}) AND p{tag}.i1 = s.i1 "
            f"LEFT JOIN sm q{tag} ON q{tag}.i3 = s.i3-({d3}) AND q{tag}.i2 = s.i2-({d2}) AND q{tag}.i1 = s.i1"
        )
    s180 = "(a.vp - 180.0*floor(a.vp/180.0))"
    return f"""nms AS (SELECT s.i3, s.i2, s.i1, s.fv, a.vp, CASE WHEN {s180} < 22.5 OR {s180} >= 157.5 THEN {pair(0, 1)}
  WHEN {s180} < 67.5 THEN {pair(1, -1)} WHEN {s180} < 112.5 THEN {pair(1, 0)} ELSE {pair(1, 1)} END AS keep
  FROM sm s JOIN att a ON a.i3 = s.i3 AND a.i2 = s.i2 AND a.i1 = s.i1 {' '.join(joins)})"""


@query("nms_strike_binned", f"WITH {sql_attributes()}, {_SM2}, {_sql_nms()} SELECT i3, i2, i1 FROM nms WHERE keep")
def q_nms(spark, sf):
    t = thinning.binned_maxima(attribute_traces(spark, sf), "fv", "vp", 1.0, True, TILING)
    return to_voxels(t, ["keep"]).where("keep").select(*ID3)


_THIN_REF = """fold AS (SELECT *, CASE WHEN vp > 180.0 THEN 360.0 - vp ELSE vp END AS f FROM nms),
ref AS (SELECT a.i3, a.i2, a.i1, coalesce(b.fv, CASE WHEN a.keep THEN a.fv ELSE 0.0 END) AS thin
 FROM fold a LEFT JOIN (SELECT * FROM fold WHERE keep AND f > 60.0 AND f < 120.0) b ON b.i3 = a.i3 + 1 AND b.i2 = a.i2 AND b.i1 = a.i1)"""


@query("thin_reference", f"WITH {sql_attributes()}, {_SM2}, {_sql_nms()}, {_THIN_REF} SELECT i3, i2, i1, {s6('thin','thin')} FROM ref")
def q_thin_reference(spark, sf):
    t = thinning.thin_reference(attribute_traces(spark, sf), "fv", "vp", tiling=TILING)
    return to_voxels(t, ["thin"]).select(*ID3, r6("thin"))


def _sql_sides(src: str = "s1") -> str:
    """CTE sid(i3,i2,i1,fs,fp,fm): trilinear samples one step along +-normal of att's angles."""
    w1, w2, w3 = sql_normal("vp", "vt")

    def disp(i, w, sign):
        return f"(CAST(CAST(a.{i} + {sign}*CAST({w} AS DOUBLE) AS FLOAT) AS DOUBLE) - a.{i})"

    def weight(sign):
        hats = [f"greatest(0.0, 1.0 - abs(x{ax}{'p' if sign > 0 else 'm'} - k{ax}.k))" for ax in (3, 2, 1)]
        return "*".join(hats)

    cols = ", ".join(
        f"{disp(f'i{ax}', w, s)} AS x{ax}{t}" for ax, w in ((3, "w3"), (2, "w2"), (1, "w1")) for s, t in ((1, "p"), (-1, "m"))
    )
    k = "(VALUES (-1), (0), (1))"
    return f"""nv AS (SELECT *, {w1} AS w1, {w2} AS w2, {w3} AS w3 FROM att),
dp AS (SELECT a.i3, a.i2, a.i1, a.n3, a.n2, a.n1, {cols} FROM nv a),
ex AS (SELECT d.i3, d.i2, d.i1, {weight(1)} AS hp, {weight(-1)} AS hm, least(greatest(d.i3 + k3.k, 0), n3-1) AS j3,
 least(greatest(d.i2 + k2.k, 0), n2-1) AS j2, least(greatest(d.i1 + k1.k, 0), n1-1) AS j1
 FROM dp d CROSS JOIN {k} k3(k) CROSS JOIN {k} k2(k) CROSS JOIN {k} k1(k)),
sid AS (SELECT e.i3, e.i2, e.i1, CAST(sum(hp*CAST(f.fv AS DOUBLE)) AS FLOAT) AS fp, CAST(sum(hm*CAST(f.fv AS DOUBLE)) AS FLOAT) AS fm
 FROM ex e JOIN {src} f ON f.i3 = j3 AND f.i2 = j2 AND f.i1 = j1 GROUP BY e.i3, e.i2, e.i1)"""


_THIN_NRM = f"""{_G3}, {_sql_sides()},
nrm AS (SELECT a.i3, a.i2, a.i1, a.vp, a.vt, a.fv, s1.fv AS fs, fp, fm, CASE WHEN fp < s1.fv AND fm < s1.fv THEN a.fv ELSE 0.0 END AS thin
 FROM att a JOIN s1 USING (i3, i2, i1) JOIN sid USING (i3, i2, i1))"""


@query("thin_normal", f"WITH {sql_attributes()}, {_THIN_NRM} SELECT i3, i2, i1, {s6('thin','thin')} FROM nrm")
def q_thin_normal(spark, sf):
    t = thinning.thin_normal(attribute_traces(spark, sf), "fv", "vp", "vt", tiling=TILING)
    return to_voxels(t, ["thin"]).select(*ID3, r6("thin"))


_PLATEAU = f"""pc AS (SELECT *, CASE WHEN abs(w1) >= abs(w2) AND abs(w1) >= abs(w3) THEN 2 WHEN abs(w2) >= abs(w3) THEN 1 ELSE 0 END AS ax FROM
  (SELECT *, {sql_normal('vp','vt')[0]} AS w1, {sql_normal('vp','vt')[1]} AS w2, {sql_normal('vp','vt')[2]} AS w3 FROM nrm)
  WHERE fv > CAST(1e-6 AS FLOAT) AND fs >= CAST(fp - CAST(1e-6 AS FLOAT) AS FLOAT) AND fs >= CAST(fm - CAST(1e-6 AS FLOAT) AS FLOAT)),
pl AS (SELECT *, CASE ax WHEN 0 THEN i3 WHEN 1 THEN i2 ELSE i1 END AS pos, CASE ax WHEN 0 THEN i2 ELSE i3 END AS la, CASE ax WHEN 2 THEN i2 ELSE i1 END AS lb FROM pc),
pr AS (SELECT *, pos - row_number() OVER (PARTITION BY ax, la, lb ORDER BY pos) AS run FROM pl),
pw AS (SELECT ax, la, lb, run, min(fv) AS lo, max(fv) AS hi, (min(pos)+max(pos))//2 AS mid FROM pr GROUP BY ax, la, lb, run),
px AS (SELECT p.ax, p.la, p.lb, p.run, min(p.pos) AS first FROM pr p JOIN pw USING (ax, la, lb, run) WHERE p.fv = pw.hi GROUP BY p.ax, p.la, p.lb, p.run),
pt AS (SELECT p.i3, p.i2, p.i1, p.fv AS thin FROM pr p JOIN pw USING (ax, la, lb, run) JOIN px USING (ax, la, lb, run)
  WHERE p.pos = CASE WHEN pw.lo = pw.hi THEN pw.mid ELSE px.first END)"""


@query("thin_plateau", f"WITH {sql_attributes()}, {_THIN_NRM}, {_PLATEAU} SELECT i3, i2, i1, {s6('thin','thin')} FROM pt")
def q_thin_plateau(spark, sf):
    return thinning.thin_plateau(attribute_traces(spark, sf), "fv", "vp", "vt", tiling=TILING).select(*ID3, r6("thin"))


def _sql_rough(support: str) -> str:
    pairs = []
    for ax in ("i3", "i2", "i1"):
        for k in (-1, 1):
            pairs.append((ax, k))
    on = " OR ".join(
        "(" + " AND ".join(f"b.{a} = a.{a}" + (f"+({k})" if a == ax else "") for a in ("i3", "i2", "i1")) + ")"
        for ax, k in pairs
    )
    values = ", ".join(
        "(" + ", ".join(str(k) if a == ax else "0" for a in ("i3", "i2", "i1")) + ")" for ax, k in pairs
    )
    del on
    gap = "abs((b.vp0-a.vp0+90.0) - 180.0*floor((b.vp0-a.vp0+90.0)/180.0) - 90.0)"
    return f"""ra AS (SELECT i3, i2, i1, CAST(vp AS DOUBLE) AS vp0, CAST(vt AS DOUBLE) AS vt0, {support} AS ok FROM att),
rough AS (SELECT a.i3, a.i2, a.i1, CAST(sqrt(coalesce(max(CASE WHEN a.ok AND b.ok THEN {gap}*{gap} + (b.vt0-a.vt0)*(b.vt0-a.vt0) ELSE 0.0 END), 0.0)) AS FLOAT) AS rough
 FROM ra a CROSS JOIN (VALUES {values}) o(d3, d2, d1) LEFT JOIN ra b ON b.i3 = a.i3+o.d3 AND b.i2 = a.i2+o.d2 AND b.i1 = a.i1+o.d1
 GROUP BY a.i3, a.i2, a.i1)"""


@query("orientation_roughness", f"WITH {sql_attributes()}, {_sql_rough('fv > 0.1')} SELECT i3, i2, i1, {s6('rough','roughness',4)} FROM rough")
def q_rough(spark, sf):
    t = attribute_traces(spark, sf).withColumn("ok", F.transform("fv", lambda x: x > F.lit(0.1)))
    t = thinning.orientation_roughness(t, "vp", "vt", "ok", TILING)
    return to_voxels(t, ["roughness"]).select(*ID3, F.round(F.col("roughness").cast("double"), 4).alias("roughness"))


_K3 = "(VALUES (-1), (0), (1))"


@query("local_count_27", f"""WITH {sql_attributes()}, p AS (SELECT i3, i2, i1, fv > 0.2 AS m FROM att),
c AS (SELECT a.i3 + k3.k AS i3, a.i2 + k2.k AS i2, a.i1 + k1.k AS i1, count(*) AS c FROM p a CROSS JOIN {_K3} k3(k) CROSS JOIN {_K3} k2(k) CROSS JOIN {_K3} k1(k)
 WHERE a.m GROUP BY 1, 2, 3)
SELECT p.i3, p.i2, p.i1, CAST(coalesce(c, 0) AS INTEGER) AS count27 FROM p LEFT JOIN c USING (i3, i2, i1)""")
def q_count27(spark, sf):
    t = attribute_traces(spark, sf).withColumn("m", F.transform("fv", lambda x: x > F.lit(0.2)))
    return to_voxels(thinning.local_count(t, "m", TILING), ["count27"])


@query("thin_hybrid", f"""WITH {sql_attributes()}, {_SM2}, {_sql_nms()}, {_THIN_REF}, {_THIN_NRM}, {_sql_rough('fv > 0.0')}
SELECT i3, i2, i1, round(CAST(CASE WHEN rough <= 25.0 THEN ref.thin ELSE nrm.thin END AS DOUBLE), 6) AS thin
FROM ref JOIN nrm USING (i3, i2, i1) JOIN rough USING (i3, i2, i1)""")
def q_hybrid(spark, sf):
    t = thinning.thin_hybrid(attribute_traces(spark, sf), "fv", "vp", "vt", threshold=25.0, tiling=TILING)
    return to_voxels(t, ["thin"]).select(*ID3, r6("thin"))


@query("thin_hybrid_v2", f"""WITH {sql_attributes()}, {_SM2}, {_sql_nms()}, {_THIN_REF}, {_THIN_NRM}, {_sql_rough('fv > CAST(1e-6 AS FLOAT)')}, {_PLATEAU},
c AS (SELECT a.i3 + k3.k AS i3, a.i2 + k2.k AS i2, a.i1 + k1.k AS i1, count(*) AS c FROM nrm a CROSS JOIN {_K3} k3(k) CROSS JOIN {_K3} k2(k) CROSS JOIN {_K3} k1(k)
 WHERE a.thin > 0 GROUP BY 1, 2, 3)
SELECT i3, i2, i1, round(CAST(CASE WHEN least(i3, n3-1-i3, i2, n2-1-i2, i1, n1-1-i1) < 2 AND coalesce(pt.thin, 0) > 0 AND (nrm.thin <= 0 OR coalesce(c, 0) <= 1) THEN pt.thin
 WHEN rough > 25.0 AND nrm.thin > 0 THEN nrm.thin ELSE ref.thin END AS DOUBLE), 6) AS thin
FROM ref JOIN nrm USING (i3, i2, i1) JOIN rough USING (i3, i2, i1) LEFT JOIN pt USING (i3, i2, i1) LEFT JOIN c USING (i3, i2, i1), shp""")
def q_hybrid2(spark, sf):
    t = thinning.thin_hybrid_v2(attribute_traces(spark, sf), "fv", "vp", "vt", threshold=25.0, tiling=TILING)
    return t.select(*ID3, r6("thin"))


@query("edge_cleanup", f"""WITH {sql_attributes()}, w AS (SELECT *, {sql_normal('vp','vt')[1]} AS w2, {sql_normal('vp','vt')[2]} AS w3 FROM att),
k AS (SELECT *, fv <> 0 AND NOT (((i3 < 5 OR i3 >= greatest(n3-5, 0)) AND CAST(w3*w3 AS FLOAT) > CAST(0.75 AS FLOAT)) OR
 ((i2 < 5 OR i2 >= greatest(n2-5, 0)) AND CAST(w2*w2 AS FLOAT) > CAST(0.75 AS FLOAT))) AS keep FROM w)
SELECT i3, i2, i1, keep, round(CAST(CASE WHEN keep THEN fv ELSE 0 END AS DOUBLE), 6) AS fv, round(CAST(CASE WHEN keep THEN vp ELSE 0 END AS DOUBLE), 4) AS vp FROM k""")
def q_edge_cleanup(spark, sf):
    a = thinning.remove_edge_effects(attributes(spark, sf), "fv", "vp", "vt")
    return a.select(*ID3, "keep", r6("fv"), F.round(F.col("vp").cast("double"), 4).alias("vp"))


@query("scanner_thin_reference", f"""WITH {sql_attributes()}, {_SM2}, {_sql_nms()},
w AS (SELECT n.i3, n.i2, n.i1, n3, n2, CASE WHEN n.keep THEN n.fv ELSE 0 END AS fv, a.vp, a.vt, {sql_normal('a.vp','a.vt')[1]} AS w2, {sql_normal('a.vp','a.vt')[2]} AS w3
 FROM nms n JOIN att a USING (i3, i2, i1)),
k AS (SELECT *, fv <> 0 AND NOT (((i3 < 5 OR i3 >= greatest(n3-5, 0)) AND CAST(w3*w3 AS FLOAT) > CAST(0.75 AS FLOAT)) OR
 ((i2 < 5 OR i2 >= greatest(n2-5, 0)) AND CAST(w2*w2 AS FLOAT) > CAST(0.75 AS FLOAT))) AS keep FROM w)
SELECT i3, i2, i1, {s6('fv','fv')}, {s6('vp','vp',4)}, {s6('vt','vt',4)} FROM k WHERE keep""")
def q_scanner_thin(spark, sf):
    t = thinning.scanner_thin_reference(attribute_traces(spark, sf), "fv", "vp", "vt", tiling=TILING)
    return t.where(F.col("fv") != 0).select(
        *ID3, r6("fv"), F.round(F.col("vp").cast("double"), 4).alias("vp"), F.round(F.col("vt").cast("double"), 4).alias("vt")
    )
