"""Coordinates, calibrations and checks of provenance as column expressions. Constants are fixed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a mapping may rest on to count.
BASES = ("acquisition_metadata", "processing_stages", "radar_registration")
#: States of an interface at a place.
VISIBILITY = ("visible", "uncertain", "not_visible", "absent")
#: Evidence of a pick by name, and what stands for missing or non-finite numbers.
EVIDENCE = dict.fromkeys(
    """hybrid_backend hybrid_accepted hybrid_correspondence hybrid_path_margin signal_score absolute_strength seed_correlation phase_score coherence_score candidate_margin
    forward_backward_agreement perturbation_stability design_score local_snr ensemble_agreement preprocessing_agreement measurement_support measurement_support_gate design_tiebreak
    hypothesis_agreement neighborhood_support residual_improvement waveform_similarity reflectivity_strength phase_cycle_agreement path_margin edge_condition selected_lobe_code
    alternative_cycle_margin seed_distance_support drop_seed_stability joint_hypothesis_support tracklet_support cycle_slip_risk branch_multimodality radar_only_confidence
    pre_gate_confidence seed_reachable lineage_break seed_position_conflict absolute_seed_guide_uncertainty absolute_seed_guide_ambiguous absolute_seed_guide_extrapolated
    absolute_seed_guide_active seed_gap_guide_uncertainty seed_gap_guide_ambiguous seed_gap_guide_extrapolated seed_guide_conflict direct_seed_family_support deep_identity_support
    seed_gap_support""".split(),
    0.0,
) | dict.fromkeys(
    """canonical_event_sample event_family_index regime_index graph_selected_sample guided_graph_selected_sample unguided_graph_selected_sample spatial_lineage_index
    absolute_seed_guide_sample absolute_seed_guide_lower_bound absolute_seed_guide_upper_bound absolute_seed_guide_deviation seed_gap_guide_sample seed_gap_guide_lower_bound
    seed_gap_guide_upper_bound seed_gap_guide_deviation""".split(),
    -1.0,
)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def evidence_of(known: Column) -> Column:
    """A struct of all EVIDENCE from a map of name to number."""
    at = lambda name: F.element_at(known, F.lit(name))
    return F.struct(*[F.when(finite(at(name)), at(name)).otherwise(default).alias(name) for name, default in EVIDENCE.items()])


def aligned_sample(sample: Column, surface: Column, reference: Column, inverse: bool = False) -> Column:
    """Between a trace's own sample and that on the road's flattened surface."""
    return sample - reference + surface if inverse else sample + reference - surface


def forward(trace: Column, sample: Column, t_scale: Column, t_offset: Column, s_scale: Column, s_offset: Column) -> tuple[Column, Column]:
    return trace * t_scale + t_offset, sample * s_scale + s_offset


def inverse(trace: Column, sample: Column, t_scale: Column, t_offset: Column, s_scale: Column, s_offset: Column) -> tuple[Column, Column]:
    return (trace - t_offset) / t_scale, (sample - s_offset) / s_scale


def may_score(verified: Column, basis: Column, same_files: Column, off_samples: Column, off_traces: Column, tolerance: float) -> Column:
    """Whether a mapping is good enough for accuracy to be scored through it."""
    return verified & basis.isin(*BASES) & same_files & (off_samples <= tolerance / 2) & (off_traces <= 0.5)


def first_difference(got: Sequence[tuple[str, Column, Column]]) -> Column:
    """The first name whose two values differ, null where none does; nulls are equal to each other."""
    return F.coalesce(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, a, b in got])


def is_sha256(x: Column) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit("^[0-9a-f]{64}$")), F.lit(False))


def plotted(sample: Column, lobe: Column, status: Column, shown: Sequence[str], anomaly: Column, visibility: Column) -> Column:
    """What a profile draws: NaN keeps the gap of a pick that is missing, of another status, anomalous or not visible."""
    use = (sample >= 0) & status.isin(*shown) & ~anomaly & ~visibility.isin("absent", "not_visible")
    return F.when(use, F.coalesce(lobe, sample)).otherwise(F.lit(float("nan")))


def probability(p: Column, total: Column) -> Column:
    return F.when(total > 0, p / total).otherwise(0.0)


def layer_target(sample: Column, k: Column, visibility: Column, pulse: Column) -> Column:
    """A Gaussian of a quarter pulse around a visible label, 0 where the layer is absent; null where nothing is known of its depth."""
    width = F.greatest(F.lit(1.0), pulse / 4)
    return F.when(visibility == "visible", F.exp(-0.5 * F.pow((k - sample) / width, F.lit(2)))).when(visibility == "absent", 0.0)
