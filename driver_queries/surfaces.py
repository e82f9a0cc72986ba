"""Components, links, boundary clean-up, seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import TILING, attributes, query, r6, s6, sql_attributes, table
from driver_queries.scoring import _LINKS, rnd
from ridgeline.grid import flat_index
from ridgeline.operators import components, edges, masks, seeds, topology

ID3 = ["i3", "i2", "i1"]
A = sql_attributes()


def strong_cells(spark, sf, limit=0.45):
    a = attributes(spark, sf).withColumn("flat", flat_index())
    return a.where(F.col("fv") > F.lit(limit).cast("float"))


_STRONG = f"""{A}, m AS (SELECT i3, i2, i1, n3, n2, n1, fv, vp, vt, (CAST(i3 AS BIGINT)*n2+i2)*n1+i1 AS flat FROM att WHERE fv > CAST(0.45 AS FLOAT))"""
_STEPS = {"face": 1, "edge": 2, "corner": 3}


def _labels(connectivity: str) -> str:
    return f"""WITH RECURSIVE {_STRONG},
ed AS (SELECT a.flat AS a, b.flat AS b FROM m a JOIN (SELECT *, unnest([-1, 0, 1]) AS d3 FROM m) b ON b.i3 + b.d3 = a.i3 AND abs(a.i2-b.i2) <= 1 AND abs(a.i1-b.i1) <= 1
  AND abs(a.i3-b.i3)+abs(a.i2-b.i2)+abs(a.i1-b.i1) BETWEEN 1 AND {_STEPS[connectivity]}),
reach(node, root) AS (SELECT flat, flat FROM m UNION SELECT ed.a, reach.root FROM reach JOIN ed ON ed.b = reach.node WHERE reach.root < ed.a),
lab AS (SELECT node AS flat, min(root) AS component FROM reach GROUP BY node)"""


def _register_components(connectivity: str) -> None:
    @query(f"components_{connectivity}", f"{_labels(connectivity)} SELECT i3, i2, i1, component FROM m JOIN lab USING (flat)")
    def run(spark, sf):
        """Connected components of the strong votes."""
        return components.connected_components(strong_cells(spark, sf), connectivity).select(*ID3, "component")


for _c in _STEPS:
    _register_components(_c)


@query("component_filter", f"""{_labels('edge')}, sz AS (SELECT component, count(*) AS size FROM lab GROUP BY component),
ok AS (SELECT *, size >= greatest(8, ceil(0.05*(SELECT sum(size) FROM sz))) AND size >= 0.1*(SELECT max(size) FROM sz) AS ok FROM sz),
rk AS (SELECT *, row_number() OVER (ORDER BY ok DESC, size DESC, component) AS r FROM ok)
SELECT component, size FROM rk WHERE (ok AND r <= 3) OR r = 1""")
def q_filter(spark, sf):
    lab = components.connected_components(strong_cells(spark, sf), "edge")
    return components.main_components(components.component_sizes(lab))


@query("fallback_components", f"""{_labels('edge')}, sz AS (SELECT component, count(*) AS size FROM lab GROUP BY component),
ok AS (SELECT *, size >= greatest(8, ceil(0.05*(SELECT sum(size) FROM sz))) AND size >= 0.1*(SELECT max(size) FROM sz) AS ok FROM sz),
rk AS (SELECT *, row_number() OVER (ORDER BY ok DESC, size DESC, component) AS r FROM ok), ac AS (SELECT size FROM rk WHERE (ok AND r <= 3) OR r = 1),
n AS (SELECT count(*) AS c, sum(size) AS t, max(size) AS m, count(*) FILTER (WHERE size < 20) AS s FROM sz), t3 AS (SELECT sum(size) AS t FROM (SELECT size FROM sz ORDER BY size DESC LIMIT 3))
SELECT c AS component_count, CAST(n.t AS BIGINT) AS candidate_cell_count, s AS small_component_count, m AS largest_component_size, CAST(t3.t AS BIGINT) AS top3_component_cell_count,
 (SELECT count(*) FROM ac) AS accepted_component_count, CAST((SELECT sum(size) FROM ac) AS BIGINT) AS accepted_component_cell_count, round(m/n.t, 6) AS largest_component_fraction,
 round(t3.t/n.t, 6) AS top3_component_fraction, c - (SELECT count(*) FROM ac) AS discarded_component_count FROM n, t3""")
def q_fallback_components(spark, sf):
    """What a component fallback would keep of the strong votes."""
    return rnd(components.fallback_components(components.connected_components(strong_cells(spark, sf), "edge"), 20))


@query("choose_skins", f"""{_labels('edge')}, sz AS (SELECT component, count(*) AS size FROM lab GROUP BY component), fr AS (SELECT max(size)/sum(size) AS f FROM sz)
SELECT i3, i2, i1, component, fv_ AS fv, replaced FROM (SELECT i3, i2, i1, component, round(CAST(fv AS DOUBLE), 6) AS fv_, size, (SELECT f FROM fr) < 0.75 AS replaced FROM m JOIN lab USING (flat) JOIN sz USING (component)) WHERE replaced OR size >= 40""")
def q_choose_skins(spark, sf):
    """Large surfaces only, or all of them where the largest holds less than three quarters of the cells."""
    from ridgeline.session import cut_lineage

    lab = cut_lineage(components.connected_components(strong_cells(spark, sf), "edge"))
    degraded = components.component_sizes(lab).agg((F.max("size") / F.sum("size")).alias("f")).select(F.col("f") < 0.75).scalar()
    out = components.choose_skins(components.component_skins(lab, 40), components.component_skins(lab), degraded)
    return out.select(*ID3, "component", r6("fv"), "replaced")


@query("component_skins", f"""{_labels('corner')}, sz AS (SELECT component, count(*) AS skin_size FROM lab GROUP BY component)
SELECT i3, i2, i1, {s6('fv', 'fl')}, component, skin_size FROM m JOIN lab USING (flat) JOIN sz USING (component) WHERE skin_size >= 10""")
def q_skins(spark, sf):
    """Threshold, group into connected surfaces, drop small ones."""
    lab = components.connected_components(strong_cells(spark, sf), "corner")
    s = components.component_skins(lab, 10)
    return s.select(*ID3, F.round(F.col("fv").cast("double"), 6).alias("fl"), "component", "skin_size")


@query("skeletonize", f"""{_labels('edge')}, w AS (SELECT *, component, fv > CAST(0.6 AS FLOAT) AS tg,
 abs(CAST(-sin(radians(CAST(vt AS DOUBLE)))*sin(radians(CAST(vp AS DOUBLE))) AS FLOAT)) AS a3, abs(CAST(sin(radians(CAST(vt AS DOUBLE)))*cos(radians(CAST(vp AS DOUBLE))) AS FLOAT)) AS a2, abs(CAST(-cos(radians(CAST(vt AS DOUBLE))) AS FLOAT)) AS a1 FROM m JOIN lab USING (flat)),
x AS (SELECT *, CASE WHEN a3 >= a2 AND a3 >= a1 THEN 0 WHEN a2 >= a1 THEN 1 ELSE 2 END AS ax FROM w),
p AS (SELECT *, CASE ax WHEN 0 THEN i3 WHEN 1 THEN i2 ELSE i1 END AS pos, CASE ax WHEN 0 THEN i2 ELSE i3 END AS la, CASE ax WHEN 2 THEN i2 ELSE i1 END AS lb FROM x),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY component, ax, la, lb ORDER BY pos) AS run FROM p),
q AS (SELECT *, (min(pos) OVER g + max(pos) OVER g)/2.0 AS mid FROM r WINDOW g AS (PARTITION BY component, ax, la, lb, run)),
k AS (SELECT *, row_number() OVER (PARTITION BY component, ax, la, lb, run ORDER BY fv DESC, CASE WHEN tg THEN 0 ELSE 1 END, abs(pos-mid), pos) AS rn FROM q)
SELECT i3, i2, i1, component FROM k WHERE rn = 1""")
def q_skeleton(spark, sf):
    lab = components.connected_components(strong_cells(spark, sf), "edge")
    s = edges.skeletonize(lab.withColumn("target", F.col("fv") > F.lit(0.6).cast("float")), "fv")
    return s.select(*ID3, "component")


@query("adaptive_threshold", f"WITH {A} SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE round(greatest(0.25, least(0.75, quantile_cont(CAST(fv AS DOUBLE), 0.7))), 6) END AS threshold FROM att WHERE fv > 0")
def q_adaptive(spark, sf):
    """70th percentile of positive votes kept within [0.25, 0.75]."""
    return masks.adaptive_threshold(attributes(spark, sf), "fv").select(F.round("threshold", 6).alias("threshold"))


@query("recenter", f"""WITH {A}, c AS (SELECT *, (CAST(i3 AS BIGINT)*n2+i2)*n1+i1 AS flat, least(i3, n3-1-i3, i2, n2-1-i2, i1, n1-1-i1) < 4 AS edge,
 abs(CAST(-sin(radians(CAST(vt AS DOUBLE)))*sin(radians(CAST(vp AS DOUBLE))) AS FLOAT)) AS a3, abs(CAST(sin(radians(CAST(vt AS DOUBLE)))*cos(radians(CAST(vp AS DOUBLE))) AS FLOAT)) AS a2, abs(CAST(-cos(radians(CAST(vt AS DOUBLE))) AS FLOAT)) AS a1
 FROM att WHERE fv > CAST(0.4 AS FLOAT)),
p AS (SELECT flat, fv, s.k AS shift, i3 + CASE WHEN a3 >= a2 AND a3 >= a1 THEN s.k ELSE 0 END AS i3, i2 + CASE WHEN NOT (a3 >= a2 AND a3 >= a1) AND a2 >= a1 THEN s.k ELSE 0 END AS i2,
 i1 + CASE WHEN NOT (a3 >= a2 AND a3 >= a1) AND NOT a2 >= a1 THEN s.k ELSE 0 END AS i1 FROM c JOIN (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) s(k) ON edge OR s.k = 0),
j AS (SELECT p.*, att.ft AS target FROM p JOIN att USING (i3, i2, i1)),
o AS (SELECT *, max(CASE WHEN shift = 0 THEN target END) OVER (PARTITION BY flat) AS own, row_number() OVER (PARTITION BY flat ORDER BY target DESC, abs(shift), shift) AS rn FROM j),
d AS (SELECT * FROM o WHERE (rn = 1 AND target > own) OR (shift = 0 AND own >= (SELECT max(o2.target) FROM o o2 WHERE o2.flat = o.flat))),
k AS (SELECT *, row_number() OVER (PARTITION BY i3, i2, i1 ORDER BY fv DESC, flat) AS w FROM d)
SELECT i3, i2, i1, {s6('fv', 'fvt')} FROM k WHERE w = 1""")
def q_recenter(spark, sf):
    a = attributes(spark, sf)
    cells = a.where(F.col("fv") > F.lit(0.4).cast("float")).withColumn("fvt", F.col("fv"))
    return edges.recenter(cells, a.select(*ID3, F.col("ft").alias("target")), 4).select(*ID3, r6("fvt"))


def linked_lines(spark, sf):
    """Order lines of one supplier as a surface: v = line number, w = order key."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    return topology.link_by_position(g.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell_id"), F.col("l_suppkey").alias("skin_id"),
        F.col("l_orderkey").alias("w"), F.col("l_linenumber").alias("v"), "lines",
    ))


@query("link_neighbours", f"WITH {_LINKS} SELECT cell_id, skin_id, lines, ca_id, cb_id, cl_id, cr_id FROM lk")
def q_links(spark, sf):
    return linked_lines(spark, sf).select("cell_id", "skin_id", "lines", "ca_id", "cb_id", "cl_id", "cr_id")


_LT = """lk AS (SELECT l_orderkey*10 + l_linenumber AS cell_id, min(l_suppkey) % 20 AS skin_id, nullif(min(l_partkey) % 5, 0) * 10 + l_orderkey * 10 - 20 AS ca_id,
 l_orderkey*10 + l_linenumber + 1 AS cb_id, CASE WHEN min(l_partkey) % 3 = 0 THEN l_orderkey*10 + l_linenumber ELSE (l_orderkey-1)*10 + l_linenumber END AS cl_id, (l_orderkey+1)*10 + l_linenumber AS cr_id FROM lineitem GROUP BY l_orderkey, l_linenumber),
e AS (SELECT cell_id, skin_id, 'ca' AS link, 'cb' AS rev, ca_id AS other FROM lk WHERE ca_id IS NOT NULL UNION ALL SELECT cell_id, skin_id, 'cb', 'ca', cb_id FROM lk UNION ALL SELECT cell_id, skin_id, 'cl', 'cr', cl_id FROM lk UNION ALL SELECT cell_id, skin_id, 'cr', 'cl', cr_id FROM lk),
j AS (SELECT e.*, o.skin_id AS os, b.cell_id AS back FROM e LEFT JOIN lk o ON o.cell_id = e.other LEFT JOIN e b ON b.cell_id = e.other AND b.link = e.rev AND b.other = e.cell_id),
q AS (SELECT rb.cb_id AS rb, br.cr_id AS br FROM lk c JOIN lk rb ON rb.cell_id = c.cr_id JOIN lk br ON br.cell_id = c.cb_id WHERE rb.cb_id IS NOT NULL AND br.cr_id IS NOT NULL),
t AS (SELECT cell_id FROM j WHERE os IS NOT NULL UNION SELECT other FROM j WHERE os IS NOT NULL)"""


@query("link_topology", f"""WITH {_LT} SELECT count(*) FILTER (WHERE back IS NULL) AS reciprocal_link_violation_count, count(*) FILTER (WHERE os IS NULL OR os <> skin_id) AS cross_skin_link_count,
 count(*) FILTER (WHERE cell_id = other) AS self_link_count, (SELECT count(*) FROM q) AS quad_closure_candidate_count, (SELECT count(*) FROM q WHERE rb = br) AS quad_closure_match_count,
 (SELECT count(*) FROM q WHERE rb <> br) AS quad_closure_mismatch_count, (SELECT count(*) FROM lk WHERE cell_id NOT IN (SELECT cell_id FROM t)) AS isolated_cell_count FROM j""")
def q_link_topology(spark, sf):
    """Links with planted faults (wrong, self and cross-surface links) over all order lines."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    cells = li.select(
        (k * 10 + n).alias("cell_id"), F.pmod("s", F.lit(20)).alias("skin_id"),
        (F.nullif(F.pmod("p", F.lit(5)), F.lit(0)) * 10 + k * 10 - 20).alias("ca_id"), (k * 10 + n + 1).alias("cb_id"),
        F.when(F.pmod("p", F.lit(3)) == 0, k * 10 + n).otherwise((k - 1) * 10 + n).alias("cl_id"), ((k + 1) * 10 + n).alias("cr_id"),
    )
    return topology.link_topology(cells)


@query("link_components", f"""WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, min(l_suppkey % 20) AS skin_id FROM lineitem GROUP BY l_orderkey, l_linenumber),
c AS (SELECT l_orderkey*10+l_linenumber AS cell_id, skin_id, l_orderkey AS w, l_linenumber AS v FROM l),
k AS (SELECT *, unnest([1, -1, 0, 0]) AS dv, unnest([0, 0, 1, -1]) AS dw FROM c),
e AS (SELECT a.cell_id AS a, b.cell_id AS b FROM k a JOIN c b ON b.skin_id = a.skin_id AND b.w = a.w + a.dw AND b.v = a.v + a.dv),
reach(node, root) AS (SELECT cell_id, cell_id FROM c UNION SELECT e.a, reach.root FROM reach JOIN e ON e.b = reach.node WHERE reach.root < e.a),
lab AS (SELECT node, min(root) AS label FROM reach GROUP BY node), n AS (SELECT skin_id, label, count(*) AS cells FROM lab JOIN c ON c.cell_id = node GROUP BY ALL)
SELECT skin_id, count(*) AS component_count, max(cells) AS largest_component, count(*) FILTER (WHERE cells = 1) AS singleton_count FROM n GROUP BY skin_id""")
def q_link_components(spark, sf):
    """Groups of linked cells in each surface of order lines (links run along an order and to the next order)."""
    c = linked_lines(spark, sf).select(F.col("cell_id"), (F.pmod("skin_id", F.lit(20))).alias("skin_id"), "v", "w")
    one = c.groupBy("cell_id", "v", "w").agg(F.min("skin_id").alias("skin_id"))
    return topology.link_components(topology.link_by_position(one))


def _greedy_ctes(name: str, candidates: str, d: int, order: str) -> str:
    """Rounds of: accept what is best in its box, drop what an accepted one covers.

    ``candidates`` selects i3, i2, i1, flat and what ``order`` needs.  Rows of ``name`` with st = 1 are accepted.
    """
    span = ", ".join(str(k) for k in range(-d, d + 1))
    box = f"b.i3 + b.d3 = a.i3 AND abs(a.i2-b.i2) <= {d} AND abs(a.i1-b.i1) <= {d}"
    return f"""{name}_c AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rk FROM ({candidates})),
{name}(n, i3, i2, i1, flat, rk, st) AS (SELECT 0, i3, i2, i1, flat, rk, 0 FROM {name}_c
 UNION ALL
 SELECT * FROM (WITH al AS (SELECT * FROM {name} WHERE st = 0), ax AS (SELECT *, unnest([{span}]) AS d3 FROM al),
  best AS (SELECT a.flat, min(b.rk) AS m FROM al a JOIN ax b ON {box} GROUP BY a.flat),
  won AS (SELECT al.* FROM al JOIN best USING (flat) WHERE m = rk), wx AS (SELECT *, unnest([{span}]) AS d3 FROM won),
  hit AS (SELECT DISTINCT a.flat FROM al a JOIN wx b ON {box})
  SELECT n + 1, i3, i2, i1, flat, rk, 1 FROM won UNION ALL SELECT n + 1, i3, i2, i1, flat, rk, 0 FROM al WHERE flat NOT IN (SELECT flat FROM hit)))"""


def _sql_greedy(candidates: str, d: int, order: str) -> str:
    return f"""WITH RECURSIVE {A}, {_greedy_ctes('r', candidates, d, order)}
SELECT i3, i2, i1, flat, score FROM r JOIN (SELECT flat, score FROM r_c) USING (flat) WHERE st = 1"""


_FLAT = "(CAST(i3 AS BIGINT)*n2+i2)*n1+i1 AS flat"


@query("boundary_seeds", f"""WITH RECURSIVE {A}, {_greedy_ctes('own', f'SELECT i3, i2, i1, {_FLAT}, fv FROM att WHERE fv > CAST(0.4 AS FLOAT)', 3, 'fv DESC, flat DESC')},
shell AS (SELECT i3, i2, i1, {_FLAT}, fv, ft FROM att WHERE least(i3, n3-1-i3, i2, n2-1-i2, i1, n1-1-i1) < 4),
lim AS (SELECT CAST(least(0.4, 0.5*CAST(max(fv) AS DOUBLE)) AS FLOAT) AS t FROM shell),
{_greedy_ctes('more', 'SELECT * FROM shell, lim WHERE ft > CAST(1e-6 AS FLOAT) AND fv > t AND flat NOT IN (SELECT flat FROM own WHERE st = 1)', 3, 'ft DESC, fv DESC, flat')}
SELECT i3, i2, i1, flat, false AS added FROM own WHERE st = 1 UNION ALL SELECT i3, i2, i1, flat, true FROM more WHERE st = 1""")
def q_boundary_seeds(spark, sf):
    """Default seeds plus spaced edge-shell seeds backed by a target."""
    a = attributes(spark, sf).withColumn("flat", flat_index())
    return seeds.retain_boundary_seeds(
        a.select(*ID3, "n3", "n2", "n1", "flat", F.col("fv").alias("ft"), F.col("vp").alias("pt"), F.col("vt").alias("tt"), F.col("ft").alias("target")),
        3, 0.4, 4, TILING,
    ).select(*ID3, "flat", "added")


@query("pick_seeds", _sql_greedy(
    "SELECT i3, i2, i1, (CAST(i3 AS BIGINT)*n2+i2)*n1+i1 AS flat, round(CAST(fv AS DOUBLE), 6) AS score, fv FROM att WHERE fv > CAST(0.3 AS FLOAT)",
    2, "fv DESC, flat DESC"))
def q_seeds(spark, sf):
    a = attributes(spark, sf).withColumn("flat", flat_index())
    c = a.where(F.col("fv") > F.lit(0.3).cast("float")).withColumn("score", F.col("fv"))
    s = seeds.pick_seeds(c.select(*ID3, "flat", "score"), 2, True, TILING)
    return s.withColumn("score", F.round(F.col("score").cast("double"), 6))


@query("pick_skin_seeds", _sql_greedy(
    "SELECT i3, i2, i1, (CAST(i3 AS BIGINT)*n2+i2)*n1+i1 AS flat, round(CAST(fv AS DOUBLE), 1) AS score FROM att WHERE fv > CAST(0.3 AS FLOAT) AND ft > 0.8",
    3, "score DESC, flat"))
def q_skin_seeds(spark, sf):
    a = attributes(spark, sf).withColumn("flat", flat_index())
    c = a.where((F.col("fv") > F.lit(0.3).cast("float")) & (F.col("ft") > F.lit(0.8))).withColumn("score", F.round(F.col("fv").cast("double"), 1))
    return seeds.pick_seeds(c.select(*ID3, "flat", "score"), 3, False, TILING)
