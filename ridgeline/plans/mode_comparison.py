"""Scanner and workflow modes compared on many trials at once: runs -> metric rows -> contrasts.

A cell is an attribute source (oracle, reference-like or quality scan) with a workflow
(reference or quality thinning).  All trials go through one sweep per scanner and one
vote stage for all sources: trial and source are keys of the tiles, so the number of
plans does not depend on the number of trials.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.angles import periodic_error
from ridgeline.functions.scores import NONZERO_EPSILON, f1, near_edge, ratio
from ridgeline.grid import DEFAULT_TILING, Tiling, flat_index, shape_of, to_traces, to_voxels, with_totals
from ridgeline.operators import scan_sweep, thinning
from ridgeline.operators.distance import nearest_distance
from ridgeline.operators.masks import top_k_by_key
from ridgeline.operators.quantiles import grouped_quantiles
from ridgeline.plans.workflow import Profile, orientations, thin_vote_traces, vote_traces
from ridgeline.session import cut_lineage

XYZ = ["i3", "i2", "i1"]
TRIAL = ("trial_id",)
BLOCK = ["trial_id", "block"]
GROUP = [*BLOCK, "selection"]

# Cell label -> (attribute source, thinning of the votes).
CELLS = {
    "ORACLE-REF": ("oracle", "reference"), "ORACLE-QUAL": ("oracle", "hybrid_v2"),
    "RL-REF": ("rl", "reference"), "RL-QUAL": ("rl", "hybrid_v2"),
    "Q-REF": ("q", "reference"), "Q-QUAL": ("q", "hybrid_v2"),
}
SCANS = {"RL-SCAN": "rl", "Q-SCAN": "q"}
# Metric -> (unit, direction); buffer radius and edge margin of the scores.
METRICS = {
    "candidate_count": ("count", "neutral"), "buffered_precision": ("fraction", "higher"), "buffered_recall": ("fraction", "higher"),
    "buffered_f1": ("fraction", "higher"), "candidate_to_truth_median": ("voxel", "lower"), "candidate_to_truth_p95": ("voxel", "lower"),
    "truth_to_candidate_median": ("voxel", "lower"), "truth_to_candidate_p95": ("voxel", "lower"), "hausdorff_p95": ("voxel", "lower"),
    "strike_median": ("degree", "lower"), "strike_p95": ("degree", "lower"), "dip_median": ("degree", "lower"),
    "dip_p95": ("degree", "lower"), "edge_false_positive_fraction_of_candidates": ("fraction", "lower"),
}
RADIUS, MARGIN = 2.0, 2
TOP, POSITIVE_TOP = "top_truth_count", "positive_top_truth_count"


def cells_of_blocks() -> dict[str, tuple[str, list[str]]]:
    """block -> (stage, labels of the cells it belongs to); what several cells share is scored once."""
    out: dict[str, tuple[str, list[str]]] = {}
    for cell, source in SCANS.items():
        for stage in ("scanner_raw", "scanner_thinned"):
            out.setdefault(f"{source}/{stage}", (stage, []))[1].append(cell)
    for cell, (source, thin) in CELLS.items():
        out.setdefault(f"{source}/fv", ("fv", []))[1].append(cell)
        out.setdefault(f"{source}/{thin}/fvt", ("fvt", []))[1].append(cell)
    return out


def stage_volumes(
    case: DataFrame, profile: Profile, tiling: Tiling, input_col: str, shape: tuple[int, int, int]
) -> tuple[DataFrame, DataFrame]:
    """All stages of all trials as traces (trial_id, block, i3, i2, value, strike, dip), and the quality scan's (trial_id, i3, i2, ft, gap).

    ``case``: stored traces trial_id, i3, i2, ft, pt, tt and the scanner input; all trials share one shape.
    Every stage is stored once, as traces; what is returned only reads them.
    """
    by_trial = Tiling(tiling.block3, tiling.block2, TRIAL)
    by_source = Tiling(tiling.block3, tiling.block2, (*TRIAL, "source"))
    quality = Profile(**{**profile.__dict__, "refinement": max(2, profile.refinement)})
    planarity = case.select(*TRIAL, "i3", "i2", input_col)
    raw, thinned = {}, {}
    for source, p in (("rl", profile), ("q", quality)):
        phis, thetas = orientations(p)
        raw[source] = cut_lineage(scan_sweep.scan_sweep_3d(planarity, input_col, phis, thetas, p.sigma, tiling=by_trial, shape=shape))
        thinned[source] = cut_lineage(thinning.scanner_thin_traces(raw[source], tiling=by_trial, shape=shape))
    tag = lambda df, source: df.select(*TRIAL, F.lit(source).alias("source"), "i3", "i2", "ft", "pt", "tt")
    inputs = [tag(case, "oracle"), *[tag(v, s) for s, v in thinned.items()]]
    votes = vote_traces(reduce(lambda a, b: a.unionByName(b), inputs), profile, by_source, shape)

    def part(df: DataFrame, block: Column, value: str, strike: str, dip: str) -> DataFrame:
        return df.select(
            *TRIAL, block.alias("block"), "i3", "i2", F.col(value).alias("value"), F.col(strike).alias("strike"), F.col(dip).alias("dip")
        )

    parts = [part(votes, F.concat("source", F.lit("/fv")), "fv", "vp", "vt")]
    for source in raw:
        parts.append(part(raw[source], F.lit(f"{source}/scanner_raw"), "ft", "pt", "tt"))
        parts.append(part(thinned[source], F.lit(f"{source}/scanner_thinned"), "ft", "pt", "tt"))
    for mode in dict.fromkeys(thin for _, thin in CELLS.values()):
        thin = cut_lineage(thin_vote_traces(votes, mode, by_source))
        parts.append(part(thin, F.concat("source", F.lit(f"/{mode}/fvt")), "thin", "vp", "vt"))
    return reduce(lambda a, b: a.unionByName(b), parts), raw["q"].select(*TRIAL, "i3", "i2", "ft", "gap")


def select_candidates(volumes: DataFrame, truth: DataFrame) -> DataFrame:
    """The strongest samples of every block, as many as its trial has truth voxels, under each selection.

    ``volumes``: trial_id, block, i3, i2, i1, flat, value, strike, dip; votes also get the choice among positive samples.
    """
    k = truth.groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("_truth"))
    votes = F.col("block").endswith("/fv") | F.col("block").endswith("/fvt")
    also = votes & (F.col("value") > F.lit(NONZERO_EPSILON))
    selections = F.when(also, F.array(F.lit(TOP), F.lit(POSITIVE_TOP))).otherwise(F.array(F.lit(TOP)))
    # positive samples come before all others, so the first k of them are the positive ones among the first k of all
    top = top_k_by_key(volumes.join(F.broadcast(k), list(TRIAL)), "value", "_truth", BLOCK).where("mask").drop("mask", "_truth")
    return top.withColumn("selection", F.explode(selections))


def score_candidates(candidates: DataFrame, truth: DataFrame, groups: DataFrame, shape: DataFrame) -> DataFrame:
    """All of :data:`METRICS` per group (trial_id, block, selection); ``groups`` lists them, also those without candidates.

    ``candidates``: group, i3, i2, i1, strike, dip and, from the same voxel of the truth, true_strike, true_dip.
    ``truth``: trial_id, i3, i2, i1 of the truth voxels.  One distance look-up each way gives the surface distances, the buffered overlap and the false positives of the edge: a sample is inside the buffer when
    its distance is at most the radius.  Nothing on both sides is distance 0, on one side the diagonal.
    """
    dims = shape.select("n3", "n2", "n1").first().asDict()  # three numbers
    points = candidates.select(*TRIAL, *XYZ).distinct()
    reached = nearest_distance(points, truth.select(*TRIAL, *XYZ), dims["n2"], keys=TRIAL)
    c = candidates.join(reached.hint("merge"), [*TRIAL, *XYZ], "left").withColumns({n: F.lit(v) for n, v in dims.items()})
    wanted = truth.select(*TRIAL, *XYZ).join(F.broadcast(groups.select(*GROUP)), list(TRIAL))
    t = nearest_distance(wanted, candidates.select(*GROUP, *XYZ), dims["n2"], keys=tuple(GROUP))
    c, t = cut_lineage(c), cut_lineage(t)
    inside = F.coalesce(F.col("d2") <= RADIUS * RADIUS, F.lit(False))
    flag = lambda x, name: x.cast("int").alias(name)
    marks = c.select(*GROUP, F.lit(1).alias("_own"), flag(inside, "_near"), flag(near_edge(MARGIN) & ~inside, "_edge"), F.lit(0).alias("_met"))
    marks = marks.unionByName(t.select(*GROUP, *[F.lit(0).alias(n) for n in ("_own", "_near", "_edge")], flag(inside, "_met")))
    counts = marks.groupBy(*GROUP).agg(
        F.sum("_own").alias("candidate_count"), *[F.sum(n).alias(n) for n in ("_near", "_edge", "_met")]
    )
    d = lambda x: F.col(x).cast("double")
    e = lambda what, x: F.struct(F.lit(what).alias("what"), x.alias("x"))
    errors = c.select(*GROUP, F.explode(F.array(
        e("candidate_to_truth", F.sqrt(d("d2"))), e("strike", periodic_error(d("strike"), d("true_strike"), 180.0)),
        e("dip", F.abs(d("dip") - d("true_dip"))),
    )).alias("e")).select(*GROUP, "e.what", "e.x")
    errors = errors.unionByName(t.select(*GROUP, F.lit("truth_to_candidate").alias("what"), F.sqrt(d("d2")).alias("x")))
    q = grouped_quantiles(errors, [*GROUP, "what"], "x", {"median": 0.5, "p95": 0.95})
    summaries = [f"{w}_{m}" for w in ("candidate_to_truth", "truth_to_candidate", "strike", "dip") for m in ("median", "p95")]
    wide = q.groupBy(*GROUP).agg(
        *[F.max(F.when(F.col("what") == s.rpartition("_")[0], F.col(s.rpartition("_")[2]))).alias(s) for s in summaries]
    )
    truths = truth.groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("_truth"))
    out = groups.join(truths, list(TRIAL), "left")
    for x in (counts, wide):
        out = out.join(x, GROUP, "left")
    out = out.fillna(0, ["_truth", "candidate_count", "_near", "_edge", "_met"])
    diagonal = F.sqrt(F.lit(sum((float(n) - 1) ** 2 for n in dims.values())))
    none = (F.col("_truth") == 0) & (F.col("candidate_count") == 0)
    fill = {s: F.when(none, F.lit(0.0)).otherwise(diagonal) if "truth" in s else F.lit(0.0) for s in summaries}
    out = out.withColumns({s: F.coalesce(F.col(s), fill[s]) for s in summaries})
    out = out.withColumns({
        "buffered_precision": ratio("_near", "candidate_count"), "buffered_recall": ratio("_met", "_truth"),
        "edge_false_positive_fraction_of_candidates": ratio("_edge", "candidate_count"),
        "hausdorff_p95": F.greatest("candidate_to_truth_p95", "truth_to_candidate_p95"),
    })
    return out.withColumn("buffered_f1", f1("buffered_precision", "buffered_recall")).select(*groups.columns, *METRICS)


def long_rows(wide: DataFrame, keys: list[str], items: dict[str, tuple[str, str]], eligible: bool = True) -> DataFrame:
    """Wide scores -> one row per metric with unit, direction and whether contrasts may use it."""
    each = [
        F.struct(F.lit(m).alias("metric"), F.lit(u).alias("unit"), F.lit(d).alias("direction"), F.col(m).cast("double").alias("value"))
        for m, (u, d) in items.items()
    ]
    return wide.select(*keys, F.explode(F.array(*each)).alias("m")).select(
        *keys, "m.metric", "m.unit", "m.direction", "m.value", F.lit(eligible).alias("contrast_eligible")
    )


def confidence_rows(gap: DataFrame, flat: Column, truth: DataFrame) -> DataFrame:
    """Mean, median and p95 of the quality scan's confidence, over all samples and over its strongest ones."""
    base = gap.withColumn("flat", flat)
    base = with_totals(base, gap, TRIAL, _lo=F.min("gap"), _hi=F.max("gap"))
    unit = F.when(F.col("_hi") > F.col("_lo"), (F.col("gap") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    k = truth.groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("_truth"))
    v = top_k_by_key(base.withColumn("confidence", unit.cast("double")).join(F.broadcast(k), list(TRIAL)), "ft", "_truth", list(TRIAL))
    both = v.withColumn("selection", F.explode(F.when(F.col("mask"), F.array(F.lit("finite"), F.lit("raw_top_truth_count"))).otherwise(
        F.array(F.lit("finite")))))
    keys = [*TRIAL, "selection"]
    wide = both.groupBy(*keys).agg(F.avg("confidence").alias("confidence_mean")).join(
        grouped_quantiles(both, keys, "confidence", {"confidence_median": 0.5, "confidence_p95": 0.95}, stored=True), keys
    )
    names = {f"confidence_{m}": ("score", "neutral") for m in ("mean", "median", "p95")}
    rows = long_rows(wide, keys, names, eligible=False)
    return rows.withColumns({"stage": F.lit("scanner_confidence"), "cell_label": F.lit("Q-SCAN")})


def block_groups(trials: DataFrame) -> DataFrame:
    """Every (trial_id, block, selection) that is to be scored; ``trials`` is short."""
    each = [
        F.struct(F.lit(b).alias("block"), F.lit(s).alias("selection"))
        for b, (stage, _) in cells_of_blocks().items() for s in ((TOP, POSITIVE_TOP) if stage.startswith("fv") else (TOP,))
    ]
    return trials.select(*TRIAL, F.explode(F.array(*each)).alias("g")).select(*TRIAL, "g.block", "g.selection")


def spread_to_cells(rows: DataFrame) -> DataFrame:
    """Metric rows of blocks -> the same rows for each cell a block belongs to."""
    pairs = [F.when(F.col("block") == b, F.struct(F.lit(stage).alias("stage"), F.array(*map(F.lit, cells)).alias("cells")))
             for b, (stage, cells) in cells_of_blocks().items()]
    return rows.withColumn("_c", F.coalesce(*pairs)).select(
        *[c for c in rows.columns if c != "block"], "_c.stage", F.explode("_c.cells").alias("cell_label")
    )


def score_volumes(
    volumes: DataFrame, case: DataFrame, truth: DataFrame, trials: DataFrame, shape: tuple[int, int, int]
) -> DataFrame:
    """Metric rows of all stages of all trials.

    ``volumes`` as of :func:`stage_volumes`; ``case``: traces trial_id, i3, i2, pt, tt; ``truth``: trial_id, i3, i2, i1;
    ``trials``: case_id, trial_id, seed.
    """
    samples = to_voxels(volumes, ["value", "strike", "dip"], BLOCK).withColumn("flat", flat_index(F.lit(shape[1]), F.lit(shape[2])))
    angles = case.select(*TRIAL, "i3", "i2", "pt", "tt")
    chosen = select_candidates(samples, truth).join(angles.hint("merge"), [*TRIAL, "i3", "i2"])
    chosen = cut_lineage(chosen.select(
        *GROUP, *XYZ, "strike", "dip", F.get("pt", F.col("i1")).alias("true_strike"), F.get("tt", F.col("i1")).alias("true_dip")
    ))
    dims = chosen.sparkSession.createDataFrame([shape], "n3 int, n2 int, n1 int")
    scored = score_candidates(chosen, truth, block_groups(trials), dims)
    filled = to_voxels(volumes, ["value"], BLOCK).groupBy(*BLOCK).agg(
        (F.count_if(F.abs("value") > NONZERO_EPSILON) / F.count(F.lit(1))).alias("array_nonzero_fraction")
    ).withColumn("selection", F.lit("all"))
    rows = long_rows(scored, GROUP, METRICS).unionByName(long_rows(filled, GROUP, {"array_nonzero_fraction": ("fraction", "neutral")}))
    return spread_to_cells(rows)


def compare_modes(cases: DataFrame, profile: Profile, tiling: Tiling = DEFAULT_TILING, input_col: str = "g") -> DataFrame:
    """Metric rows of all cells on all trials.

    ``cases``: case_id, trial_id, seed and, for every voxel, i3, i2, i1, ft, pt, tt, truth_mask and the scanner input.
    Trial ids are unique and not NULL, all trials share one shape.  Scores of surfaces grown from the votes are left out.
    """
    of_trial = ("case_id", *TRIAL, "seed")
    case = cut_lineage(to_traces(cases, ["ft", "pt", "tt", "truth_mask", input_col], of_trial))
    trials = cut_lineage(case.select(*of_trial).distinct())
    shape = tuple(shape_of(case).first())  # three numbers
    truth = cut_lineage(to_voxels(case, ["truth_mask"], [*TRIAL]).where("truth_mask").select(*TRIAL, *XYZ))
    volumes, gap = stage_volumes(case, profile, tiling, input_col, shape)
    flat = flat_index(F.lit(shape[1]), F.lit(shape[2]))
    rows = score_volumes(volumes, case, truth, trials, shape)
    rows = rows.unionByName(confidence_rows(to_voxels(gap, ["ft", "gap"], [*TRIAL]), flat, truth))
    return rows.join(F.broadcast(trials), list(TRIAL)).select(
        "case_id", "trial_id", "seed", "stage", "selection", "metric", "cell_label", "unit", "direction", "value", "contrast_eligible"
    )
