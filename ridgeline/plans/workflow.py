"""Whole workflows: scan -> thin -> seeds -> vote -> thin -> surfaces -> score.

Every expensive result is a stage: stored once in the shared checkpoint folder (or a
named stage folder) and read by all that follow.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.kernels import dip_samples, refine_samples, strike_samples
from ridgeline.functions.scores import positive
from ridgeline.grid import DEFAULT_TILING, Tiling, flat_index, to_traces, to_voxels, with_shape
from ridgeline.operators import components, scan_sweep, thinning
from ridgeline.operators.seeds import pick_seeds
from ridgeline.operators.voting import Voter, surface_voting
from ridgeline.session import cut_lineage

XYZ = ["i3", "i2", "i1"]

# Declarative variants as patches on the default settings.
DEFAULTS = {"thin": "reference"}
VARIANTS = {
    "current_default": {},
    "voter_thin_normal": {"thin": "normal"},
    "voter_thin_hybrid": {"thin": "hybrid"},
    "voter_thin_hybrid_v2": {"thin": "hybrid_v2"},
    "voter_thin_plateau": {"thin": "normal_plateau"},
}


@dataclass(frozen=True)
class Profile:
    """Scan ranges, search radii and thresholds of a run."""

    strikes: tuple[float, float] = (0.0, 340.0)
    dips: tuple[float, float] = (65.0, 85.0)
    refinement: int = 1
    sigma: float = 1.0
    voter: Voter = field(default_factory=lambda: Voter(10, 20, 30))
    seed_distance: int = 4
    seed_threshold: float = 0.3
    thin: str = "reference"


# The full quality profile; refined, its ranges give 35 strikes x 7 dips.
QUALITY = Profile(strikes=(0.0, 360.0), dips=(65.0, 80.0), refinement=2, sigma=8.0, thin="hybrid_v2")


def orientations(profile: Profile) -> tuple[list[float], list[float]]:
    """Sampled strikes and dips of a profile."""
    return (
        refine_samples(strike_samples(*profile.strikes), profile.refinement),
        refine_samples(dip_samples(*profile.dips), profile.refinement),
    )


def settings(variant: str) -> dict:
    """Defaults with the variant's patch applied."""
    return {**DEFAULTS, **VARIANTS[variant]}


def thin_vote_traces(traces: DataFrame, mode: str, tiling: Tiling = DEFAULT_TILING) -> DataFrame:
    """The thinned vote volume as traces ``thin`` with their angles vp, vt; for modes that keep every trace."""
    if mode == "reference":
        out = thinning.thin_reference(traces, "fv", "vp", tiling=tiling)
    elif mode == "normal":
        out = thinning.thin_normal(traces, "fv", "vp", "vt", tiling=tiling)
    elif mode == "hybrid":
        out = thinning.thin_hybrid(traces, "fv", "vp", "vt", tiling=tiling)
    elif mode == "hybrid_v2":
        out = thinning.hybrid_v2_traces(traces, "fv", "vp", "vt", tiling=tiling)
    else:
        raise ValueError(f"unknown thinning mode: {mode}")
    return out.select(*tiling.keys, "i3", "i2", "thin", "vp", "vt")


def thin_votes(traces: DataFrame, mode: str, tiling: Tiling = DEFAULT_TILING) -> DataFrame:
    """Voxels of the thinned vote volume (fv, vp, vt in trace layout)."""
    if mode == "normal_plateau":
        return thinning.thin_plateau(traces, "fv", "vp", "vt", tiling=tiling)
    return to_voxels(thin_vote_traces(traces, mode, tiling), ["thin"], list(tiling.keys))


def seeds_of(
    attributes: DataFrame, distance: int, threshold: float, tiling: Tiling = DEFAULT_TILING, shape: tuple[int, int, int] | None = None
) -> DataFrame:
    """Seeds of an attribute volume in voxel layout (ft, pt, tt)."""
    flat = flat_index(F.lit(shape[1]), F.lit(shape[2])) if shape else flat_index()
    c = (attributes if shape else with_shape(attributes)).withColumn("flat", flat).where(F.col("ft") > F.lit(threshold).cast("float"))
    return pick_seeds(c.select(*tiling.keys, *XYZ, "flat", F.col("ft").alias("score"), "pt", "tt"), distance, True, tiling)


def vote_stage(attributes: DataFrame, profile: Profile, tiling: Tiling = DEFAULT_TILING) -> DataFrame:
    """Attributes (voxels ft, pt, tt) -> vote traces fv, vp, vt."""
    at = cut_lineage(attributes.select(*tiling.keys, *XYZ, "ft", "pt", "tt"))
    seeds = seeds_of(at, profile.seed_distance, profile.seed_threshold, tiling)
    return cut_lineage(surface_voting(to_traces(at, ["ft"], tiling.keys), seeds, profile.voter, tiling))


def vote_traces(attributes: DataFrame, profile: Profile, tiling: Tiling, shape: tuple[int, int, int]) -> DataFrame:
    """:func:`vote_stage` of stored attributes in trace layout (ft, pt, tt) whose shape is known."""
    voxels = to_voxels(attributes, ["ft", "pt", "tt"], list(tiling.keys))
    seeds = seeds_of(voxels, profile.seed_distance, profile.seed_threshold, tiling, shape)
    return cut_lineage(surface_voting(attributes.select(*tiling.keys, "i3", "i2", "ft"), seeds, profile.voter, tiling, shape))


def run_scan(planarity: DataFrame, col: str, profile: Profile, tiling: Tiling = DEFAULT_TILING) -> DataFrame:
    """Sweep and scanner thinning; dense voxels ft, pt, tt (zeros where nothing is kept)."""
    phis, thetas = orientations(profile)
    scan = cut_lineage(scan_sweep.scan_sweep_3d(planarity, col, phis, thetas, profile.sigma, tiling=tiling))
    return thinning.scanner_thin_reference(scan, tiling=tiling)


def detect_surfaces(planarity: DataFrame, col: str, profile: Profile, tiling: Tiling = DEFAULT_TILING,
                    min_likelihood: float = 0.3, min_size: int = 10) -> DataFrame:
    """The whole run: planarity traces -> cells grouped into surfaces."""
    votes = vote_stage(run_scan(planarity, col, profile, tiling), profile, tiling)
    thin = thin_votes(votes, profile.thin, tiling)
    angles = to_voxels(votes, ["vp", "vt"])
    cells = with_shape(thin.join(angles, XYZ)).withColumn("flat", flat_index())
    cells = cells.where(positive("thin") & (F.col("thin") >= min_likelihood))
    labelled = components.connected_components(cells.select(*XYZ, "flat", F.col("thin").alias("fl"), "vp", "vt"))
    return components.component_skins(labelled, min_size)
