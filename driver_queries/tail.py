"""Relational tail over the star-schema tables, used as metric and summary rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import attributes, query, sql_attributes, table
from driver_queries.scoring import rnd
from ridgeline.plans import contrasts as C
from ridgeline.plans import gates as G

_LABELS = list(C.CELLS)


def metric_rows(spark, sf):
    """Order lines averaged per (return flag, supplier, cell): long-format metric rows."""
    li = table(spark, sf, "lineitem")
    cell = F.element_at(F.array(*[F.lit(c) for c in _LABELS]), (F.pmod("l_orderkey", F.lit(8)) + 1).cast("int"))
    g = li.groupBy("l_returnflag", "l_suppkey", cell.alias("cell_label")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")
    )
    long = F.explode(
        F.array(
            F.struct(F.lit("quantity").alias("metric"), F.lit("count").alias("unit"), F.lit("higher").alias("direction"), F.col("quantity").alias("value")),
            F.struct(F.lit("discount").alias("metric"), F.lit("ratio").alias("unit"), F.lit("lower").alias("direction"), F.col("discount").alias("value")),
            F.struct(F.lit("tax").alias("metric"), F.lit("ratio").alias("unit"), F.lit("neutral").alias("direction"), F.col("tax").alias("value")),
        )
    )
    return g.select("l_returnflag", "l_suppkey", "cell_label", long.alias("m")).select(
        F.col("l_returnflag").alias("case_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("trial_id"),
        F.col("l_suppkey").alias("seed"), F.lit("skin").alias("stage"), F.lit("all").alias("selection"), "m.metric",
        "cell_label", "m.unit", "m.direction", "m.value",
    )


_ROWS = f"""g AS (SELECT l_returnflag AS case_id, 's' || CAST(l_suppkey AS VARCHAR) AS trial_id, l_suppkey AS seed,
  ({_LABELS!r})[CAST(l_orderkey % 8 AS INTEGER) + 1] AS cell_label, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY ALL),
rows_ AS (SELECT case_id, trial_id, seed, 'skin' AS stage, 'all' AS selection, 'quantity' AS metric, cell_label, 'count' AS unit, 'higher' AS direction, q AS value FROM g
 UNION ALL SELECT case_id, trial_id, seed, 'skin', 'all', 'discount', cell_label, 'ratio', 'lower', d FROM g
 UNION ALL SELECT case_id, trial_id, seed, 'skin', 'all', 'tax', cell_label, 'ratio', 'neutral', t FROM g)"""
_TERMS = ", ".join(f"('{n}', '{c}', {v})" for n, t in C.CONTRASTS.items() for c, v in t.items())
_CON = f"""con AS (SELECT k.name AS contrast_name, case_id, trial_id, seed, stage, selection, metric, unit, direction, sum(k.coef*value) AS raw_value
 FROM rows_ r JOIN (VALUES {_TERMS}) k(name, cell, coef) ON k.cell = r.cell_label GROUP BY ALL)"""


@query("contrast_10", f"""WITH {_ROWS}, {_CON} SELECT contrast_name, case_id, trial_id, seed, stage, selection, metric, unit, direction, round(raw_value, 6) + 0.0 AS raw_value,
 CASE direction WHEN 'higher' THEN round(raw_value, 6) + 0.0 WHEN 'lower' THEN round(-raw_value, 6) + 0.0 END AS improvement_value FROM con""")
def q_contrast(spark, sf):
    c = rnd(C.paired_contrasts(metric_rows(spark, sf)))
    return c.withColumns({x: F.col(x) + 0.0 for x in ("raw_value", "improvement_value")})


_REGION_ROWS = """g AS (SELECT l_returnflag AS dataset_id, l_linestatus AS region, CASE WHEN l_linenumber <= 2 THEN 'first' WHEN l_linenumber <= 4 THEN 'middle' ELSE 'last' END AS selection, (['RL-REF', 'RL-QUAL', 'Q-REF', 'Q-QUAL'])[CAST(l_suppkey % 4 AS INTEGER) + 1] AS cell_label,
  avg(l_quantity) AS value FROM lineitem GROUP BY ALL)"""
_SCANNED = ", ".join(f"('{n}', '{c}', {v})" for n, t in C.SCANNED_CONTRASTS.items() for c, v in t.items())


@query("contrast_8", f"""WITH {_REGION_ROWS} SELECT k.name AS contrast_name, dataset_id, region, selection, round(sum(k.coef*value), 6) + 0.0 AS raw_value
FROM g JOIN (VALUES {_SCANNED}) k(name, cell, coef) ON k.cell = g.cell_label GROUP BY ALL""")
def q_contrast_8(spark, sf):
    """The eight contrasts of scanned cells, per dataset, region and selection."""
    cell = F.element_at(F.array(*[F.lit(c) for c in ("RL-REF", "RL-QUAL", "Q-REF", "Q-QUAL")]), (F.pmod("l_suppkey", F.lit(4)) + 1).cast("int"))
    n = F.col("l_linenumber")
    g = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("dataset_id"), F.col("l_linestatus").alias("region"),
        F.when(n <= 2, "first").when(n <= 4, "middle").otherwise("last").alias("selection"), cell.alias("cell_label"),
    ).agg(F.avg("l_quantity").alias("value"))
    fixed = {"stage": "skin", "reference_file": "", "metric": "quantity", "unit": "count", "direction": "higher"}
    rows = g.withColumns({k: F.lit(v) for k, v in fixed.items()})
    c = C.paired_contrasts(rows, C.SCANNED_CONTRASTS, C.REGION_PAIR)
    return c.select("contrast_name", "dataset_id", "region", "selection", (F.round("raw_value", 6) + 0.0).alias("raw_value"))


_STATS = """count(*) AS n, round(avg({v}), 6) + 0.0 AS mean, round(median({v}), 6) + 0.0 AS median, round(coalesce(stddev_samp({v}), 0), 6) AS std, round(min({v}), 6) AS min, round(max({v}), 6) AS max,
 round(quantile_cont({v}, 0.25), 6) + 0.0 AS q25, round(quantile_cont({v}, 0.75), 6) + 0.0 AS q75"""


@query("metric_aggregate", f"""WITH {_ROWS} SELECT 'metric' AS source, case_id, cell_label, stage, selection, metric, unit, direction, {_STATS.format(v='value')} FROM rows_ GROUP BY case_id, cell_label, stage, selection, metric, unit, direction""")
def q_metric_aggregate(spark, sf):
    return rnd(C.aggregate_metrics(metric_rows(spark, sf)))


@query("contrast_aggregate", f"""WITH {_ROWS}, {_CON} SELECT 'contrast' AS source, case_id, contrast_name, stage, selection, metric, unit, direction, {_STATS.format(v='raw_value')} FROM con GROUP BY case_id, contrast_name, stage, selection, metric, unit, direction""")
def q_contrast_aggregate(spark, sf):
    c = rnd(C.aggregate_contrasts(C.paired_contrasts(metric_rows(spark, sf))))
    return c.withColumns({x: F.col(x) + 0.0 for x in ("mean", "median", "q25", "q75")})


@query("incomplete_groups", """WITH r AS (SELECT event_type AS cell_label, user_id % 7 AS case_id, user_id AS seed FROM events),
e AS (SELECT case_id, count(DISTINCT seed) AS expected FROM r GROUP BY case_id), g AS (SELECT case_id, cell_label, count(*) AS n, count(DISTINCT seed) AS trials FROM r GROUP BY ALL)
SELECT case_id, cell_label, n, trials, expected FROM g JOIN e USING (case_id) WHERE trials <> expected OR n <> trials""")
def q_incomplete(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("cell_label"), F.pmod("user_id", F.lit(7)).alias("case_id"), F.col("user_id").alias("seed"),
        F.col("user_id").cast("string").alias("trial_id"),
    )
    return C.incomplete_groups(e, ["case_id", "cell_label"])


@query("line_statistics", """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median,
 round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS std, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max,
 round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75 FROM lineitem GROUP BY ALL""")
def q_line_statistics(spark, sf):
    """Grouped statistics straight over all order lines (hot groups: few keys, many rows)."""
    return rnd(C.describe(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice"), digits=4)


_VOX_CELLS = {"RL-REF": "fv", "Q-REF": "ft", "RL-QUAL": "fv*fv", "Q-QUAL": "fv*ft"}
_VOX_CONTRASTS = {k: v for k, v in C.CONTRASTS.items() if set(v) <= set(_VOX_CELLS)}
_VC = " UNION ALL ".join(
    f"SELECT '{n}' AS contrast_name, " + " + ".join(f"({c})*CAST({_VOX_CELLS[cell]} AS DOUBLE)" for cell, c in t.items()) + " AS x FROM d"
    for n, t in _VOX_CONTRASTS.items()
)


@query("voxelwise_contrast", f"""WITH {sql_attributes()}, d AS (SELECT CAST(fv AS DOUBLE) AS fv, CAST(ft AS DOUBLE) AS ft FROM att), l AS ({_VC})
SELECT contrast_name, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std, round(avg(abs(x)), 6) AS mean_absolute, round(max(abs(x)), 6) AS max_absolute,
 round(count(*) FILTER (WHERE abs(x) > 1e-6)/count(*), 6) AS epsilon_nonzero_fraction, round(quantile_cont(abs(x), 0.95), 6) AS p95_absolute FROM l GROUP BY contrast_name""")
def q_voxelwise(spark, sf):
    a = attributes(spark, sf).select(F.col("fv").cast("double").alias("fv"), F.col("ft").cast("double").alias("ft"))
    wide = a.select(*[F.expr(e).alias(n) for n, e in _VOX_CELLS.items()])
    return rnd(C.voxelwise_contrasts(wide, _VOX_CONTRASTS)).withColumn("mean", F.col("mean") + 0.0)


@query("variant_delta", """WITH r AS (SELECT user_id, event_type AS variant, avg(value) AS score, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id, score AS s0, n AS n0 FROM r WHERE variant = 'click')
SELECT user_id, variant, round(score - s0, 6) + 0.0 AS score_delta, n - n0 AS n_delta FROM r LEFT JOIN b USING (user_id)""")
def q_variant(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("variant")).agg(
        F.avg("value").alias("score"), F.count(F.lit(1)).alias("n")
    )
    return rnd(C.variant_deltas(e, "click", ["user_id"], ["score", "n"])).withColumn("score_delta", F.col("score_delta") + 0.0)


@query("stage_attribution", """SELECT l_partkey AS stage_key, count(DISTINCT l_returnflag) AS cells, max(l_quantity) AS seconds,
 CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'shared' ELSE min(l_returnflag) END AS owner FROM lineitem GROUP BY l_partkey""")
def q_attribution(spark, sf):
    return C.stage_attribution(
        table(spark, sf, "lineitem").select(
            F.col("l_partkey").alias("stage_key"), F.col("l_returnflag").alias("cell_label"), F.col("l_quantity").alias("seconds")
        )
    )


@query("density_variation", """SELECT l_returnflag, count(*) AS crops, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(coalesce(stddev_pop(d)/nullif(avg(d), 0), 0), 6) AS cv
FROM (SELECT l_returnflag, l_suppkey, avg(l_discount) AS d FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def q_density(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("d"))
    return rnd(C.density_variation(d, "l_returnflag", "d"))


@query("config_differences", """WITH a AS (SELECT n_name AS path, CAST(count(*) AS VARCHAR) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
b AS (SELECT n_name AS path, CAST(count(*)*10 AS VARCHAR) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
SELECT path, a.v AS "left", b.v AS "right" FROM a FULL OUTER JOIN b USING (path) WHERE a.v IS DISTINCT FROM b.v""")
def q_config(spark, sf):
    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    s = table(spark, sf, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    a = c.groupBy(F.col("n_name").alias("path")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    b = s.groupBy(F.col("n_name").alias("path")).agg((F.count(F.lit(1)) * 10).cast("string").alias("value"))
    return C.config_differences(a, b)


# ---------------------------------------------------------------- promotion

_ALL_CASES = [
    "single_vertical_plane", "single_dipping_plane", "curved_surface", "parallel_planes", "crossing_planes", "boundary_plane", "weak_noisy_plane",
]
_SEGMENTS = {
    "BUILDING": "boundary_plane", "AUTOMOBILE": "parallel_planes", "MACHINERY": "crossing_planes",
    "HOUSEHOLD": "single_vertical_plane", "FURNITURE": "curved_surface",
}
_METRICS = [
    "skin_buffered_f1_r2", "fvt_positive_buffered_f1_r2", "skin_distance_p95", "fvt_positive_distance_p95", "skin_count",
    "skin_cell_count", "fvt_positive_candidate_count", "skin_over_merge_count", "skin_over_split_count", "skin_fallback_replaced_primary",
]
_CASE_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEGMENTS.items()) + " END"
_SUMMARY = f"""sm AS (SELECT o_orderstatus AS variant, {_CASE_SQL} AS case_id, CASE WHEN o_orderpriority < '3' THEN 'scanner' ELSE 'oracle' END AS pipeline,
 o_orderpriority || CAST(c_nationkey AS VARCHAR) AS input_mode, 'quality' AS workflow_mode, 'quality' AS scanner_backend, '2' AS scanner_refinement_factor, '49' AS shape_n3, '49' AS shape_n2, '49' AS shape_n1,
 round(avg(o_totalprice)/500009.0, 6) AS skin_buffered_f1_r2, round(avg(c_acctbal)/9973.0, 6) AS fvt_positive_buffered_f1_r2,
 round(coalesce(stddev_samp(o_totalprice), 0)/20000.0, 6) AS skin_distance_p95, round(coalesce(stddev_samp(c_acctbal), 0)/500.0, 6) AS fvt_positive_distance_p95,
 count(*) AS skin_count, count(DISTINCT o_custkey) AS skin_cell_count, count(DISTINCT o_orderdate) AS fvt_positive_candidate_count,
 count(*) FILTER (WHERE o_totalprice > 300000) AS skin_over_merge_count, count(*) FILTER (WHERE o_totalprice < 50000) AS skin_over_split_count,
 max(o_totalprice) > 400000 AS skin_fallback_replaced_primary
 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""
_KEY = ", ".join(G.MATCH_KEY)
_CMP = f"""{_SUMMARY}, b AS (SELECT * FROM sm WHERE variant = 'F'), c AS (SELECT * FROM sm WHERE variant = 'O'),
cmp AS (SELECT {_KEY}, {', '.join(f'b.{m} AS {m}__b, c.{m} AS {m}__c, CAST(c.{m} AS DOUBLE) - CAST(b.{m} AS DOUBLE) AS {m}__d' for m in _METRICS)},
 CASE WHEN b.variant IS NULL THEN 'missing_baseline' WHEN c.variant IS NULL THEN 'missing_candidate' ELSE 'matched' END AS status
 FROM b FULL OUTER JOIN c USING ({_KEY}))"""


def summary_rows(spark, sf):
    """Orders per (segment, priority, nation) and status as wide summary rows.

    The prime divisors keep averages of two-decimal amounts off exact rounding ties,
    which the two engines break differently.
    """
    seg = F.create_map(*[F.lit(x) for kv in _SEGMENTS.items() for x in kv])
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    keys = {
        "variant": F.col("o_orderstatus"), "case_id": F.try_element_at(seg, F.col("c_mktsegment")),
        "pipeline": F.when(F.col("o_orderpriority") < "3", "scanner").otherwise("oracle"),
        "input_mode": F.concat("o_orderpriority", F.col("c_nationkey").cast("string")),
    }
    g = o.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.round(F.avg("o_totalprice") / 500009.0, 6).alias("skin_buffered_f1_r2"),
        F.round(F.avg("c_acctbal") / 9973.0, 6).alias("fvt_positive_buffered_f1_r2"),
        F.round(F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)) / 20000.0, 6).alias("skin_distance_p95"),
        F.round(F.coalesce(F.stddev_samp("c_acctbal"), F.lit(0.0)) / 500.0, 6).alias("fvt_positive_distance_p95"),
        F.count(F.lit(1)).alias("skin_count"), F.count_distinct("o_custkey").alias("skin_cell_count"),
        F.count_distinct("o_orderdate").alias("fvt_positive_candidate_count"),
        F.count_if(F.col("o_totalprice") > 300000).alias("skin_over_merge_count"),
        F.count_if(F.col("o_totalprice") < 50000).alias("skin_over_split_count"),
        (F.max("o_totalprice") > 400000).alias("skin_fallback_replaced_primary"),
    )
    fixed = {"workflow_mode": "quality", "scanner_backend": "quality", "scanner_refinement_factor": "2",
             "shape_n3": "49", "shape_n2": "49", "shape_n1": "49"}
    return g.withColumns({k: F.lit(v) for k, v in fixed.items()})


def compared(spark, sf):
    s = summary_rows(spark, sf)
    num = s.withColumn("skin_fallback_replaced_primary", F.col("skin_fallback_replaced_primary"))
    return G.compare(num.where("variant = 'F'"), num.where("variant = 'O'"), _METRICS)


_DELTAS = [m for m in _METRICS if m not in ("skin_fallback_replaced_primary",)]


@query("summary_comparison", f"""WITH {_CMP} SELECT case_id, pipeline, input_mode, status, {', '.join(f'round({m}__d, 6) + 0.0 AS {m}' for m in _DELTAS)},
 CAST(coalesce(skin_buffered_f1_r2__d < 0, false) AS INTEGER) + CAST(coalesce(fvt_positive_buffered_f1_r2__d < 0, false) AS INTEGER) + CAST(coalesce(skin_distance_p95__d > 0, false) AS INTEGER) + CAST(coalesce(fvt_positive_distance_p95__d > 0, false) AS INTEGER) AS regressions,
 round(skin_cell_count__c/nullif(fvt_positive_candidate_count__c, 0), 6) AS ratio_candidate FROM cmp""")
def q_comparison(spark, sf):
    c = compared(spark, sf)
    return c.select(
        "case_id", "pipeline", "input_mode", "status", *[(F.round(f"{m}__d", 6) + 0.0).alias(m) for m in _DELTAS],
        F.size("regressions").alias("regressions"), F.round("ratio__c", 6).alias("ratio_candidate"),
    )


def _sql_reasons() -> str:
    gate = "status = 'matched' AND pipeline = 'scanner'"
    chg = "(coalesce(abs(fvt_positive_buffered_f1_r2__d) > 1e-9, false) OR coalesce(abs(fvt_positive_distance_p95__d) > 1e-9, false) OR coalesce(fvt_positive_candidate_count__d <> 0, false))"
    bnd = f"{gate} AND case_id = 'boundary_plane'"
    parts = [
        (f"{bnd} AND coalesce(skin_buffered_f1_r2__c < 0.9, true)", "'skin_buffered_f1_r2 below 0.90'"),
        (f"{bnd} AND coalesce(skin_count__c > 3, true)", "'skin_count above 3'"),
        (f"{bnd} AND coalesce(NOT (skin_cell_count__c/fvt_positive_candidate_count__c BETWEEN 0.75 AND 1.25), true)", "'skin_cell_to_fvt_positive_candidate_ratio outside [0.75, 1.25]'"),
        (f"{bnd} AND {chg} AND coalesce(fvt_positive_buffered_f1_r2__c < 0.9, true)", "'fvt_positive_buffered_f1_r2 below 0.90 after FVT change'"),
        (f"{bnd} AND {chg} AND coalesce(fvt_positive_distance_p95__c > 2.0, true)", "'fvt_positive_distance_p95 above 2.0 after FVT change'"),
    ]
    for m, t in G.MATERIAL.items():
        cond = f"{m}__d {'<' if t < 0 else '>'} {t}"
        parts.append((f"{gate} AND case_id <> 'boundary_plane' AND {cond}", f"'non-boundary scanner regression: {m}'"))
        parts.append((f"status = 'matched' AND pipeline = 'oracle' AND {cond}", f"'oracle regression: {m}'"))
    better = " OR ".join(f"coalesce({m}__d {'>= 0.02' if t < 0 else '<= -2.0'}, false)" for m, t in G.MATERIAL.items())
    parts.append((f"{gate} AND case_id NOT IN ('boundary_plane', 'parallel_planes', 'crossing_planes') AND coalesce(skin_fallback_replaced_primary__c, false) AND NOT coalesce(skin_fallback_replaced_primary__b, false) AND NOT ({better})",
                  "'stable non-boundary false fallback replacement: ' || case_id"))
    for m in ("skin_over_merge_count", "skin_over_split_count"):
        parts.append((f"{gate} AND case_id IN ('parallel_planes', 'crossing_planes') AND {m}__d > 0", f"'parallel/crossing topology regression: ' || case_id || ' {m}'"))
    return " UNION ALL ".join(f"SELECT case_id, pipeline, input_mode, {r} AS reason FROM cmp WHERE {w}" for w, r in parts)


@query("promotion_gate", f"WITH {_CMP} {_sql_reasons()}")
def q_gate(spark, sf):
    return G.gate_reasons(compared(spark, sf)).select("case_id", "pipeline", "input_mode", "reason")


_NEED = ", ".join(f"('{p}', '{c}')" for p, cs in (
    ("scanner", ["boundary_plane"]), ("scanner", [c for c in _ALL_CASES if c != "boundary_plane"]), ("oracle", _ALL_CASES),
    ("scanner", ["single_vertical_plane", "single_dipping_plane", "curved_surface", "weak_noisy_plane"]), ("scanner", ["parallel_planes", "crossing_planes"]),
) for c in cs)
_MISSING = f"""need AS (SELECT * FROM (VALUES {_NEED}) n(pipeline, case_id)
 WHERE NOT EXISTS (SELECT 1 FROM cmp WHERE status = 'matched' AND cmp.pipeline = n.pipeline AND cmp.case_id = n.case_id))"""


@query("gate_coverage", f"WITH {_CMP}, {_MISSING} SELECT pipeline, case_id, count(*) AS n FROM need GROUP BY ALL")
def q_coverage(spark, sf):
    """Required rows of the gate that no comparison covers."""
    return G.coverage(compared(spark, sf)).groupBy("pipeline", "case_id").agg(F.count(F.lit(1)).alias("n"))


@query("promotion_verdict", f"""WITH {_CMP}, r AS ({_sql_reasons()}), {_MISSING}
SELECT (SELECT count(*) FROM cmp WHERE status = 'matched' AND pipeline = 'scanner' AND case_id = 'boundary_plane') AS boundary_rows,
 (SELECT count(*) FROM cmp WHERE status <> 'matched') AS unmatched_rows, (SELECT count(*) FROM r) AS reason_count, (SELECT count(*) FROM need) AS missing_count,
 (SELECT count(*) FROM r) = 0 AND (SELECT count(*) FROM need) = 0 AND EXISTS (SELECT 1 FROM cmp WHERE status = 'matched' AND pipeline = 'scanner' AND case_id = 'boundary_plane') AS passed""")
def q_verdict(spark, sf):
    return G.gate_verdict(compared(spark, sf))
