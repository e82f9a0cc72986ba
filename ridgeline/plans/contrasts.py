"""Long-format metric rows: paired contrasts, grouped statistics, variant deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.scores import improvement
from ridgeline.operators.quantiles import grouped_quantiles

# Contrast -> cell coefficients.
CONTRASTS = {
    "scanner_only_effect": {"Q-SCAN": 1.0, "RL-SCAN": -1.0},
    "oracle_workflow_effect": {"ORACLE-QUAL": 1.0, "ORACLE-REF": -1.0},
    "scanner_effect_ref": {"Q-REF": 1.0, "RL-REF": -1.0},
    "scanner_effect_qual": {"Q-QUAL": 1.0, "RL-QUAL": -1.0},
    "workflow_effect_rl": {"RL-QUAL": 1.0, "RL-REF": -1.0},
    "workflow_effect_q": {"Q-QUAL": 1.0, "Q-REF": -1.0},
    "end_to_end_delta": {"Q-QUAL": 1.0, "RL-REF": -1.0},
    "scanner_main_effect": {"Q-REF": 0.5, "RL-REF": -0.5, "Q-QUAL": 0.5, "RL-QUAL": -0.5},
    "workflow_main_effect": {"RL-QUAL": 0.5, "RL-REF": -0.5, "Q-QUAL": 0.5, "Q-REF": -0.5},
    "scanner_workflow_interaction": {"Q-QUAL": 1.0, "Q-REF": -1.0, "RL-QUAL": -1.0, "RL-REF": 1.0},
}
CELLS = ("RL-SCAN", "Q-SCAN", "ORACLE-REF", "ORACLE-QUAL", "RL-REF", "RL-QUAL", "Q-REF", "Q-QUAL")
PAIR = ["case_id", "trial_id", "seed", "stage", "selection", "metric"]
# The set over scanned cells alone, and the key of its rows.
SCANNED_CONTRASTS = {k: v for k, v in CONTRASTS.items() if k not in ("scanner_only_effect", "oracle_workflow_effect")}
REGION_PAIR = ["dataset_id", "stage", "region", "selection", "reference_file", "metric"]


def paired_contrasts(
    rows: DataFrame, contrasts: dict[str, dict[str, float]] = CONTRASTS, keys: list[str] = PAIR
) -> DataFrame:
    """All contrasts of each exact pairing key; a partly present contrast is an error.

    Every row is fanned out to the few contrasts its cell takes part in and one
    aggregation (combined before the shuffle) forms all sums.
    """
    by_cell: dict[str, list[Column]] = {}
    for name, terms in contrasts.items():
        for cell, coef in terms.items():
            by_cell.setdefault(cell, []).append(
                F.struct(F.lit(name).alias("contrast_name"), F.lit(coef).alias("coef"), F.lit(len(terms)).alias("need"))
            )
    terms = reduce(
        lambda acc, c: acc.when(F.col("cell_label") == c, F.array(*by_cell[c])), by_cell, F.when(F.lit(False), F.lit(None))
    )
    src = rows.where("contrast_eligible") if "contrast_eligible" in rows.columns else rows
    fan = src.select(*keys, "cell_label", "unit", "direction", "value", F.explode(terms).alias("t"))
    g = fan.groupBy(*keys, "t.contrast_name").agg(
        F.sum(F.col("t.coef") * F.col("value")).alias("raw_value"),
        F.count(F.lit(1)).alias("_n"), F.max("t.need").alias("_need"),
        F.min("unit").alias("unit"), F.max("unit").alias("_unit"),
        F.min("direction").alias("direction"), F.max("direction").alias("_direction"),
    )
    problem = (
        F.when(F.col("_n") < F.col("_need"), F.lit("missing required cell(s) in contrast "))
        .when(F.col("_n") > F.col("_need"), F.lit("duplicate metric row in contrast "))
        .when(F.col("unit") != F.col("_unit"), F.lit("mixed units in contrast "))
        .when(F.col("direction") != F.col("_direction"), F.lit("mixed directions in contrast "))
    )
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.col("contrast_name"))).cast("double")).otherwise(
        F.col("raw_value")
    )
    return g.select(
        "contrast_name", *keys, "unit", "direction", checked.alias("raw_value")
    ).withColumn("improvement_value", improvement("raw_value", "direction"))


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, sample std (0 for a single row), min, max, quartiles per group."""
    v = F.col(value).cast("double")
    base = rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    )
    q = grouped_quantiles(rows, keys, value, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return base.join(q, keys)


METRIC_KEYS = ["case_id", "cell_label", "stage", "selection", "metric", "unit", "direction"]
CONTRAST_KEYS = ["case_id", "contrast_name", "stage", "selection", "metric", "unit", "direction"]


def aggregate_metrics(rows: DataFrame) -> DataFrame:
    return describe(rows, METRIC_KEYS, "value").withColumn("source", F.lit("metric"))


def aggregate_contrasts(rows: DataFrame) -> DataFrame:
    return describe(rows, CONTRAST_KEYS, "raw_value").withColumn("source", F.lit("contrast"))


def incomplete_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that miss a trial of their case, or hold one twice (a correct table gives none)."""
    trial = F.struct("trial_id", "seed")
    per_case = rows.groupBy("case_id").agg(F.count_distinct(trial).alias("expected"))
    per_group = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(trial).alias("trials"))
    j = per_group.join(per_case, "case_id")
    return j.where((F.col("trials") != F.col("expected")) | (F.col("n") != F.col("trials")))


def voxelwise_contrasts(
    cells: DataFrame, contrasts: dict[str, dict[str, float]], epsilon: float = 1.0e-6
) -> DataFrame:
    """Summary of each contrast over the voxels of a wide table (one column per cell label)."""
    exprs = [
        F.struct(
            F.lit(name).alias("contrast_name"),
            reduce(lambda a, b: a + b, [F.lit(c) * F.col(f"`{cell}`").cast("double") for cell, c in terms.items()]).alias("x"),
        )
        for name, terms in contrasts.items()
    ]
    long = cells.select(F.explode(F.array(*exprs)).alias("e")).select("e.contrast_name", "e.x")
    a = F.abs("x")
    base = long.groupBy("contrast_name").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.avg(a).alias("mean_absolute"),
        F.max(a).alias("max_absolute"),
        (F.count_if(a > epsilon) / F.count(F.lit(1))).alias("epsilon_nonzero_fraction"),
    )
    p95 = grouped_quantiles(long.withColumn("a", a), ["contrast_name"], "a", {"p95_absolute": 0.95})
    return base.join(p95, "contrast_name")


def variant_deltas(rows: DataFrame, baseline: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """Each variant's metrics minus the baseline variant's, per key (NULL where either is missing)."""
    base = rows.where(F.col("variant") == baseline).select(*keys, *[F.col(m).alias(f"_b_{m}") for m in metrics])
    return rows.join(base, keys, "left").select(
        *keys, "variant", *[(F.col(m) - F.col(f"_b_{m}")).alias(f"{m}_delta") for m in metrics]
    )


def stage_attribution(uses: DataFrame) -> DataFrame:
    """Stages (stage_key, cell_label, seconds): shared by several cells or owned by one."""
    return uses.groupBy("stage_key").agg(
        F.count_distinct("cell_label").alias("cells"), F.max("seconds").alias("seconds"),
        F.when(F.count_distinct("cell_label") > 1, F.lit("shared")).otherwise(F.min("cell_label")).alias("owner"),
    )


def density_variation(rows: DataFrame, policy: str, value: str) -> DataFrame:
    """Mean density per policy over crops and its coefficient of variation (population)."""
    v = F.col(value).cast("double")
    g = rows.groupBy(policy).agg(F.count(v).alias("crops"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return g.withColumn("cv", F.coalesce(F.try_divide("std", "mean"), F.lit(0.0)))


def config_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths whose flattened (path, value) differ between two configurations."""
    j = a.select("path", F.col("value").alias("left")).join(
        b.select("path", F.col("value").alias("right")), "path", "full_outer"
    )
    return j.where(~F.col("left").eqNullSafe(F.col("right")))


def overlap_violations(rows: DataFrame) -> DataFrame:
    """Rows whose overlap counts and ratios contradict each other."""
    ok = (
        (F.col("intersection_count") <= F.least("candidate_count", "truth_count"))
        & (F.col("union_count") == F.col("candidate_count") + F.col("truth_count") - F.col("intersection_count"))
        & (F.col("candidate_in_truth_buffer_count") >= F.col("intersection_count"))
        & (F.col("candidate_in_truth_buffer_count") <= F.col("candidate_count"))
        & (F.col("truth_in_candidate_buffer_count") >= F.col("intersection_count"))
        & (F.col("truth_in_candidate_buffer_count") <= F.col("truth_count"))
    )
    return rows.where(~ok)
