"""Declared workflow variants, and one run of each: seeds, votes, thinning, clean-up, surfaces.

A variant is a patch on the default settings.  Its policies pick among operators that exist on their
own; the votes of variants that share voter settings and seed policy are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.scores import positive, ratio
from ridgeline.grid import DEFAULT_TILING, Tiling, flat_index, shape_of, to_traces, to_voxels, with_shape
from ridgeline.operators import components, edges, thinning
from ridgeline.operators.seeds import retain_boundary_seeds
from ridgeline.operators.voting import surface_voting
from ridgeline.plans.workflow import Profile, seeds_of, thin_votes
from ridgeline.session import cut_lineage

XYZ = ["i3", "i2", "i1"]
EDGE_MARGIN = 4


@dataclass(frozen=True)
class Variant:
    """Patches: voter fields, seed policy, thinning mode, post-thinning policy, fallback policy, presets."""

    voter: dict = field(default_factory=dict)
    seeds: str = "default"
    thin: str | None = None
    post: str = "none"
    fallback: str | None = None
    skinner: str = "components"
    presets: tuple[str, ...] = ()


_MATRIX = ("quality-matrix",)
# The declared variants.
VARIANTS = {
    "current_default": Variant(presets=("default", "quality-matrix")),
    "boundary_aware_voter_v1": Variant(voter={"boundary": "masked_in_bounds"}),
    "no_surface_orientation_smoothing": Variant(voter={"orientation_sigma": 0.0}, presets=_MATRIX),
    "final_norm_smoothing_1": Variant(voter={"final_sigma": 1.0}, presets=_MATRIX),
    "voter_thin_normal": Variant(thin="normal", presets=_MATRIX),
    "voter_thin_hybrid": Variant(thin="hybrid", presets=_MATRIX),
    "voter_thin_hybrid_v2": Variant(thin="hybrid_v2", presets=_MATRIX),
    "voter_thin_hybrid_v2_recenter_scanner_target": Variant(thin="hybrid_v2", post="recenter_scanner_target"),
    "boundary_edge_thin_v1": Variant(thin="hybrid_v2", post="boundary_edge_thin_v1"),
    "boundary_seed_retention_v1": Variant(seeds="boundary_seed_retention_v1"),
    "voter_thin_normal_plateau": Variant(thin="normal_plateau", presets=_MATRIX),
    "surface_support_weighted": Variant(voter={"min_support": 0.5, "support_exponent": 1.0}, presets=_MATRIX),
    "quality_skinner_v2": Variant(skinner="queue_growth", presets=_MATRIX),
    "quality_boundary_skinner_fallback": Variant(fallback="empty_primary", presets=_MATRIX),
    "quality_boundary_skinner_fallback_v2": Variant(fallback="degraded_primary", presets=_MATRIX),
    "quality_boundary_skinner_fallback_v3": Variant(fallback="degraded_primary_filtered", presets=_MATRIX),
    "quality_boundary_skinner_fallback_v4": Variant(fallback="degraded_primary_skeletonized", presets=_MATRIX),
    "quality_boundary_skinner_fallback_v5": Variant(fallback="degraded_primary_topology_guarded", skinner="queue_growth"),
}


def preset(name: str) -> list[str]:
    return [v for v, spec in VARIANTS.items() if name in spec.presets]


def offered(name: str) -> bool:
    """Whether a variant's operators exist here (surfaces grown from a queue do not)."""
    return VARIANTS[name].skinner == "components"


def _votes(case: DataFrame, profile: Profile, variant: Variant, tiling: Tiling) -> DataFrame:
    """Vote traces of the attributes ft, pt, tt under the variant's voter and seed policy."""
    if variant.seeds == "default":
        seeds = seeds_of(case, profile.seed_distance, profile.seed_threshold, tiling)
    else:
        volume = with_shape(case).withColumn("flat", flat_index()).withColumn("target", F.col("ft"))
        seeds = retain_boundary_seeds(volume, profile.seed_distance, profile.seed_threshold, EDGE_MARGIN, tiling)
    voter = replace(profile.voter, **variant.voter)
    return cut_lineage(surface_voting(to_traces(case, ["ft"]), cut_lineage(seeds), voter, tiling))


def _thinned(case: DataFrame, votes: DataFrame, profile: Profile, variant: Variant, tiling: Tiling) -> DataFrame:
    """Positive samples (i3, i2, i1, fvt) after thinning and the variant's clean-up against the scanner target."""
    thin = thin_votes(votes, variant.thin or profile.thin, tiling).select(*XYZ, F.col("thin").alias("fvt"))
    if variant.post == "none":
        return thin.where(positive("fvt"))
    dense = with_shape(to_voxels(votes, ["fv", "vp", "vt"])).join(thin, XYZ, "left").join(case.select(*XYZ, F.col("ft").alias("target")), XYZ)
    dense = dense.withColumn("fvt", F.coalesce("fvt", F.lit(0.0).cast("float")))
    if variant.post == "recenter_scanner_target":
        return edges.recenter(dense, case.select(*XYZ, F.col("ft").alias("target")), EDGE_MARGIN)
    if variant.post == "boundary_edge_thin_v1":
        return edges.thin_edge_lines(dense, thinning.thin_plateau(votes, "fv", "vp", "vt", tiling=tiling), EDGE_MARGIN)
    raise ValueError(f"unknown post-thinning policy: {variant.post}")


def _surfaces(cells: DataFrame, names: list[str], shape: dict[str, int], min_likelihood: float, min_size: int, small: int) -> DataFrame:
    """Surfaces of all variants at once: the primary ones, or the fallback's where a policy asks for it.

    ``cells``: k (the variant's place in ``names``), i3, i2, i1, fvt, vp, vt.  Variants are laid out one after
    another along i3 with a gap between them, so one labelling serves all and no surface spans two.
    """
    gap, volume = shape["n3"] + 2, (shape["n3"] + 2) * shape["n2"] * shape["n1"]
    flat = (F.col("i3").cast("bigint") * shape["n2"] + F.col("i2")) * shape["n1"] + F.col("i1")
    cells = cut_lineage(cells.withColumn("i3", (F.col("i3") + F.col("k") * gap).cast("int")).withColumn("flat", flat))
    columns = ["k", *XYZ, "flat", "fvt", "vp", "vt"]

    def of(df: DataFrame, *policies: str | None) -> DataFrame:
        return df.where(F.col("k").isin([k for k, n in enumerate(names) if VARIANTS[n].fallback in policies]))

    primary = cut_lineage(components.component_skins(components.connected_components(cells.where(F.col("fvt") >= min_likelihood).select(*columns)), min_size))
    out = ["k", *XYZ, "fvt", "component", "skin_size"]
    policies = {VARIANTS[n].fallback for n in names} - {None}
    if not policies:
        chosen = primary.select(*out, F.lit(False).alias("replaced"))
    else:
        labelled = cut_lineage(components.connected_components(of(cells, *policies).select(*columns), "edge"))
        sizes = labelled.groupBy("k", "component").agg(F.count(F.lit(1)).alias("size"))
        parts = [components.component_skins(of(labelled, "empty_primary", "degraded_primary"), min_size)]
        kept = components.main_components_by(sizes, "k").select("component")
        main = components.component_skins(of(labelled, "degraded_primary_filtered", "degraded_primary_skeletonized").join(kept, "component", "left_semi"))
        parts.append(of(main, "degraded_primary_filtered"))
        ridges = edges.skeletonize(of(main, "degraded_primary_skeletonized").drop("skin_size").withColumn("target", F.lit(False)))
        parts.append(components.component_skins(ridges))
        fallback = reduce(lambda a, b: a.unionByName(b), [p.select(*out) for p in parts])
        replace_ = _replaced(of(cells, *policies), of(primary, *policies), names, small)
        at = replace_.where("replaced").select("k")
        chosen = primary.join(at, "k", "left_anti").select(*out, F.lit(False).alias("replaced")).unionByName(
            fallback.join(at, "k", "left_semi").select(*out, F.lit(True).alias("replaced"))
        )
    k = F.col("k")
    return chosen.select("k", (F.col("i3") - k * gap).cast("int").alias("i3"), "i2", "i1", "fvt", (F.col("component") - k * volume).alias("component"), "skin_size", "replaced")


def _replaced(cells: DataFrame, primary: DataFrame, names: list[str], small: int) -> DataFrame:
    """(k, replaced): whether the policy of each variant turns to its fallback."""
    sizes = primary.groupBy("k", "component").agg(F.count(F.lit(1)).alias("n"))
    few = F.coalesce(F.sum(F.when(F.col("n") < small, F.col("n"))), F.lit(0))
    topology = sizes.groupBy("k").agg(
        F.count(F.lit(1)).alias("skin_count"), F.sum("n").alias("unique_cell_count"),
        ratio(F.max("n"), F.sum("n")).alias("largest_skin_fraction"), ratio(few, F.sum("n")).alias("small_skin_cell_fraction"),
    )
    counts = cells.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("positives")).join(topology, "k", "left")
    degraded = components.primary_degraded(counts.na.fill(0), F.col("positives"))
    only_empty = F.col("k").isin([k for k, n in enumerate(names) if VARIANTS[n].fallback == "empty_primary"])
    return degraded.select("k", F.when(only_empty, F.col("skin_count") == 0).otherwise(F.size("reasons") > 0).alias("replaced"))


def run_variants(
    case: DataFrame, profile: Profile, names: list[str], tiling: Tiling = DEFAULT_TILING, min_likelihood: float = 0.3, min_size: int = 10, small: int = 10
) -> DataFrame:
    """Surface cells of each variant on one case (voxels with ft, pt, tt): variant, i3, i2, i1, fvt, component, skin_size, replaced.

    Votes are computed once per seed policy and voter, thinned votes once per clean-up; all variants are labelled together.
    """
    for name in names:
        if not offered(name):
            raise ValueError(f"{name} needs an operator that is not offered")
    case = cut_lineage(case.select(*XYZ, "ft", "pt", "tt"))
    shape = {n: int(v) for n, v in shape_of(case).first().asDict().items()}  # three numbers
    votes: dict[tuple, DataFrame] = {}
    thinned: dict[tuple, DataFrame] = {}
    parts = []
    for k, name in enumerate(names):
        v = VARIANTS[name]
        key = (v.seeds, *sorted(v.voter.items()))
        if key not in votes:
            votes[key] = _votes(case, profile, v, tiling)
        clean = (*key, v.thin or profile.thin, v.post)
        if clean not in thinned:
            thin = _thinned(case, votes[key], profile, v, tiling)
            thinned[clean] = cut_lineage(thin.select(*XYZ, "fvt").join(to_voxels(votes[key], ["vp", "vt"]), XYZ))
        parts.append(thinned[clean].select(F.lit(k).alias("k"), *XYZ, "fvt", "vp", "vt"))
    chosen = _surfaces(reduce(lambda a, b: a.unionByName(b), parts), names, shape, min_likelihood, min_size, small)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1)
    return chosen.select(label.alias("variant"), *XYZ, "fvt", "component", "skin_size", "replaced")
