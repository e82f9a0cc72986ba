"""Baseline/candidate matching and promotion gates over summary rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Match key, better-direction, thresholds and gate limits.
MATCH_KEY = [
    "case_id", "pipeline", "input_mode", "workflow_mode", "scanner_backend",
    "scanner_refinement_factor", "shape_n3", "shape_n2", "shape_n1",
]
HIGHER_IS_BETTER = {
    "fv_buffered_f1_r2", "fvt_buffered_f1_r2", "fvt_positive_buffered_f1_r2", "skin_buffered_f1_r2",
    "scanner_ft_buffered_f1_r2",
}
LOWER_IS_BETTER = {
    "fv_distance_p95", "fv_edge_false_positive_fraction", "fvt_distance_p95", "fvt_positive_distance_p95",
    "fvt_positive_edge_false_positive_fraction", "skin_distance_p95", "skin_distance_candidate_to_truth_p95",
    "skin_strike_median_error", "skin_dip_median_error", "scanner_ft_distance_p95",
    "scanner_downstream_fvt_to_ft_distance_p95", "scanner_downstream_fvt_positive_edge_false_positive_fraction",
}
MATERIAL = {
    "skin_buffered_f1_r2": -0.02, "fvt_positive_buffered_f1_r2": -0.02,
    "skin_distance_p95": 2.0, "fvt_positive_distance_p95": 2.0,
}
# Every compared metric.
METRICS = [
    "fv_buffered_f1_r2", "fv_distance_p95", "fv_edge_false_positive_fraction", "fvt_buffered_f1_r2", "fvt_distance_p95",
    "fvt_positive_candidate_count", "fvt_positive_buffered_f1_r2", "fvt_positive_distance_p95",
    "fvt_positive_edge_false_positive_fraction", "skin_count", "skin_cell_count", "skin_buffered_f1_r2", "skin_distance_p95",
    "skin_distance_candidate_to_truth_p95", "skin_strike_median_error", "skin_dip_median_error", "skin_over_merge_count",
    "skin_over_split_count", "skin_mean_purity", "skin_min_purity", "skin_mean_truth_component_recall",
    "skin_min_truth_component_recall", "scanner_ft_buffered_f1_r2", "scanner_ft_distance_p95",
    "scanner_downstream_fvt_to_ft_distance_p95", "scanner_downstream_fvt_positive_edge_false_positive_fraction",
    "skin_fallback_used", "skin_fallback_replaced_primary",
]
TOPOLOGY_CASES = ("parallel_planes", "crossing_planes")
BOUNDARY_CASE = "boundary_plane"
FALSE_FALLBACK_CASES = ("single_vertical_plane", "single_dipping_plane", "curved_surface", "weak_noisy_plane")
ALL_CASES = (
    "single_vertical_plane", "single_dipping_plane", "curved_surface", "parallel_planes", "crossing_planes", "boundary_plane",
    "weak_noisy_plane",
)


@dataclass(frozen=True)
class Gate:
    shape: tuple[str, str, str] = ("49", "49", "49")
    backend: str = "quality"
    refinement: str = "2"
    skin_f1_min: float = 0.90
    skin_count_max: float = 3.0
    ratio_range: tuple[float, float] = (0.75, 1.25)
    fvt_f1_min: float = 0.90
    fvt_distance_max: float = 2.0
    always_check_fvt: bool = False
    unchanged_oracle: bool = False
    allow_improved_fallback: bool = True


SCANNER_BOUNDARY = Gate()
SCANNER_BOUNDARY_REFERENCE_LIKE = Gate(
    backend="reference-like", always_check_fvt=True, unchanged_oracle=True, allow_improved_fallback=False
)


def compare(baseline: DataFrame, candidate: DataFrame, metrics: list[str]) -> DataFrame:
    """Full outer match on the nine-column key: status, both values, deltas, regressions."""
    b = baseline.select(*MATCH_KEY, *[F.col(m).alias(f"{m}__b") for m in metrics], F.lit(True).alias("_b"))
    c = candidate.select(*MATCH_KEY, *[F.col(m).alias(f"{m}__c") for m in metrics], F.lit(True).alias("_c"))
    j = b.join(c, MATCH_KEY, "full_outer")
    status = F.when(F.col("_b").isNull(), "missing_baseline").when(F.col("_c").isNull(), "missing_candidate").otherwise("matched")
    j = j.withColumn("status", status).drop("_b", "_c")
    j = j.withColumns({f"{m}__d": F.col(f"{m}__c").cast("double") - F.col(f"{m}__b").cast("double") for m in metrics})

    def moved(better: bool) -> Column:
        hits = []
        for m in metrics:
            d = F.col(f"{m}__d")
            if m in HIGHER_IS_BETTER:
                hits.append(F.when((d > 0) if better else (d < 0), F.lit(m)))
            elif m in LOWER_IS_BETTER:
                hits.append(F.when((d < 0) if better else (d > 0), F.lit(m)))
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")

    out = {"regressions": moved(False), "improvements": moved(True)}
    if {"skin_cell_count", "fvt_positive_candidate_count"} <= set(metrics):
        for s in "bc":
            out[f"ratio__{s}"] = F.try_divide(
                F.col(f"skin_cell_count__{s}").cast("double"), F.col(f"fvt_positive_candidate_count__{s}").cast("double")
            )
    return j.withColumns(out)


def _shape(g: Gate) -> Column:
    return (F.col("shape_n3") == g.shape[0]) & (F.col("shape_n2") == g.shape[1]) & (F.col("shape_n1") == g.shape[2])


def _gate_row(g: Gate) -> Column:
    return (
        (F.col("pipeline") == "scanner") & (F.col("workflow_mode") == "quality") & (F.col("scanner_backend") == g.backend)
        & (F.col("scanner_refinement_factor") == g.refinement) & _shape(g)
    )


def _boundary_reasons(g: Gate) -> Column:
    c = lambda m: F.col(f"{m}__c").cast("double")
    bad = lambda cond: F.coalesce(cond, F.lit(True))
    changed = reduce(
        lambda a, b: a | b,
        [
            F.coalesce(F.abs(F.col("fvt_positive_buffered_f1_r2__d")) > 1e-9, F.lit(False)),
            F.coalesce(F.abs(F.col("fvt_positive_distance_p95__d")) > 1e-9, F.lit(False)),
            F.coalesce(F.col("fvt_positive_candidate_count__d") != 0, F.lit(False)),
        ],
    )
    check = F.lit(True) if g.always_check_fvt else changed
    suffix = "" if g.always_check_fvt else " after FVT change"
    lo, hi = g.ratio_range
    return F.array_compact(
        F.array(
            F.when(bad(c("skin_buffered_f1_r2") < g.skin_f1_min), "skin_buffered_f1_r2 below 0.90"),
            F.when(bad(c("skin_count") > g.skin_count_max), "skin_count above 3"),
            F.when(bad(~F.col("ratio__c").between(lo, hi)), "skin_cell_to_fvt_positive_candidate_ratio outside [0.75, 1.25]"),
            F.when(check & bad(c("fvt_positive_buffered_f1_r2") < g.fvt_f1_min), "fvt_positive_buffered_f1_r2 below 0.90" + suffix),
            F.when(check & bad(c("fvt_positive_distance_p95") > g.fvt_distance_max), "fvt_positive_distance_p95 above 2.0" + suffix),
        )
    )


def _material(prefix: str) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when((F.col(f"{m}__d") < t) if t < 0 else (F.col(f"{m}__d") > t), F.lit(prefix + m))
                for m, t in MATERIAL.items()
            ]
        )
    )


def gate_reasons(compared: DataFrame, gate: Gate = SCANNER_BOUNDARY, metrics: list[str] | None = None) -> DataFrame:
    """One row per (match key, reason) that speaks against promotion."""
    m = compared.where("status = 'matched'")
    row, case = _gate_row(gate), F.col("case_id")
    oracle_row = (F.col("pipeline") == "oracle") & _shape(gate)
    if gate.unchanged_oracle:
        oracle = F.array_compact(
            F.array(
                *[
                    F.when(~F.col(f"{x}__b").eqNullSafe(F.col(f"{x}__c")), F.lit(f"oracle regression: {x}"))
                    for x in (metrics or [m for m in METRICS if f"{m}__b" in compared.columns])
                ]
            )
        )
    else:
        oracle = _material("oracle regression: ")
    improved = reduce(
        lambda a, b: a | b,
        [
            F.coalesce((F.col(f"{x}__d") >= 0.02) if t < 0 else (F.col(f"{x}__d") <= -2.0), F.lit(False))
            for x, t in MATERIAL.items()
        ],
    )
    false_fallback = (
        row & ~case.isin(BOUNDARY_CASE, *TOPOLOGY_CASES)
        & F.coalesce(F.col("skin_fallback_replaced_primary__c"), F.lit(False))
        & ~F.coalesce(F.col("skin_fallback_replaced_primary__b"), F.lit(False))
    )
    if gate.allow_improved_fallback:
        false_fallback = false_fallback & ~improved
    topology = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"{x}__d") > 0, F.concat(F.lit("parallel/crossing topology regression: "), case, F.lit(f" {x}")))
                for x in ("skin_over_merge_count", "skin_over_split_count")
            ]
        )
    )
    none = F.array().cast("array<string>")
    reasons = F.concat(
        F.when(row & (case == BOUNDARY_CASE), _boundary_reasons(gate)).otherwise(none),
        F.when(row & (case != BOUNDARY_CASE), _material("non-boundary scanner regression: ")).otherwise(none),
        F.when(oracle_row, oracle).otherwise(none),
        F.when(false_fallback, F.array(F.concat(F.lit("stable non-boundary false fallback replacement: "), case))).otherwise(none),
        F.when(row & case.isin(*TOPOLOGY_CASES), topology).otherwise(none),
    )
    return m.select(*MATCH_KEY, F.explode(reasons).alias("reason"))


def required_rows(gate: Gate) -> list[tuple[str, str, str]]:
    """(name, pipeline, case) rows that a promotion must have compared."""
    tail = f"scanner_{gate.backend.replace('-', '_')}_ref{gate.refinement}_{gate.shape[0]}"
    parts = [
        (f"boundary_plane_{tail}", "scanner", (BOUNDARY_CASE,)),
        (f"non_boundary_{tail}", "scanner", tuple(c for c in ALL_CASES if c != BOUNDARY_CASE)),
        (f"oracle_{gate.shape[0]}", "oracle", ALL_CASES),
        (f"false_fallback_replacement_{tail}", "scanner", FALSE_FALLBACK_CASES),
        (f"topology_{tail}", "scanner", TOPOLOGY_CASES),
    ]
    return [(name, pipeline, case) for name, pipeline, cases in parts for case in cases]


def coverage(compared: DataFrame, gate: Gate = SCANNER_BOUNDARY) -> DataFrame:
    """(name, pipeline, case_id, reason) of the required rows without a matched comparison."""
    required = compared.sparkSession.createDataFrame(required_rows(gate), "name string, pipeline string, case_id string")
    counts = (F.col("workflow_mode") == "quality") & _shape(gate) & ((F.col("pipeline") != "scanner") | _gate_row(gate))
    have = compared.where("status = 'matched'").where(counts).select("pipeline", "case_id").distinct()
    reason = F.concat(F.lit("missing required gate coverage: "), "name", F.lit(" "), "case_id")
    return required.join(have, ["pipeline", "case_id"], "left_anti").select("name", "pipeline", "case_id", reason.alias("reason"))


def gate_verdict(compared: DataFrame, gate: Gate = SCANNER_BOUNDARY, metrics: list[str] | None = None) -> DataFrame:
    """One row: passed, number of reasons, of missing required rows and of unmatched rows, boundary rows seen."""
    r = gate_reasons(compared, gate, metrics).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    missing = coverage(compared, gate).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    boundary = F.count_if(_gate_row(gate) & (F.col("case_id") == BOUNDARY_CASE) & (F.col("status") == "matched"))
    gaps = F.count_if(F.col("status") != "matched")
    out = compared.agg(boundary.alias("boundary_rows"), gaps.alias("unmatched_rows")).withColumns({"reason_count": r, "missing_count": missing})
    ok = (F.col("boundary_rows") > 0) & (F.col("reason_count") == 0) & (F.col("missing_count") == 0)
    if gate.unchanged_oracle:
        ok = ok & (F.col("unmatched_rows") == 0)
    return out.withColumn("passed", ok)
