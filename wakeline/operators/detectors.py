"""The five detectors of entities, and their ensemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import clamp
from ..sources.staging import staged
from . import iforest
from .neighbors import lof
from .scaling import min_max, robust_scale

# Thresholds, weights and the columns that each learnt detector looks at.
SOFT_SPEED_KT, HARD_SPEED_KT, SURE_PINGS, UNSURE = 35.0, 50.0, 2, 0.45
SILENCE_H, LONG_SILENCE_H, FAR_NM, SILENCE_SHARE, FAR_SHARE = 4.0, 48.0, 300.0, 0.6, 0.4
WEIGHTS = {"score_teleport": 1.05, "score_blackout": 1.2, "score_slow_stratum": 1.0, "score_colocation": 1.0, "score_erratic_pursuit": 1.0}
BEHAVIOUR = ("score_slow_stratum", "score_colocation", "score_erratic_pursuit")
CORROBORATION, DAMPING = 0.25, 0.72
THRESHOLD = 0.50
# name: (columns, those that count backwards, share of the forest, neighbours)
LEARNT = {
    "score_slow_stratum": (["frac_slow", "frac_stopped", "hours_inside_stratum", "min_stratum_dist_nm", "straightness", "hull_area_deg2", "min_port_dist_nm"], {"min_stratum_dist_nm", "straightness", "hull_area_deg2"}, 0.55, 20),
    "score_colocation": (["co_slow_hours", "hours_within_1nm", "sustained_close_episodes", "min_port_dist_nm", "frac_stopped"], set(), 0.6, 15),
    "score_erratic_pursuit": (["heading_variance", "heading_change_rate", "hours_within_2nm", "p95_speed_kt", "std_speed_kt", "min_nn_dist_nm"], {"min_nn_dist_nm"}, 0.5, 20),
}


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def teleport() -> Column:
    """Impossible speed; less than sure with a single impossible ping."""
    base = clamp((_or_zero("max_implied_speed_kt") - SOFT_SPEED_KT) / (HARD_SPEED_KT - SOFT_SPEED_KT + 1e-6), 0.0, 1.0)
    return base * F.when(_or_zero("n_suspicious_speed_pings") >= SURE_PINGS, 1.0).otherwise(UNSURE)


def blackout() -> Column:
    """Long silence, and how far the entity was moved by it."""
    silence = clamp((_or_zero("max_gap_h") - SILENCE_H) / (LONG_SILENCE_H - SILENCE_H), 0.0, 1.0)
    return silence * SILENCE_SHARE + clamp(_or_zero("max_gap_displacement_nm") / FAR_NM, 0.0, 1.0) * FAR_SHARE


def learnt(features: DataFrame, name: str, trees: int = iforest.TREES) -> DataFrame:
    """entity_id and the detector's score: forest and LOF on robustly scaled columns, each brought to [0, 1], blended."""
    columns, backwards, share, k = LEARNT[name]
    filled = features.select("entity_id", *((-_or_zero(c) if c in backwards else _or_zero(c)).alias(c) for c in columns))
    scaled = staged(robust_scale(filled, columns), "scaled")  # one row for each entity
    # both are read twice, for the range and for the values; they have one row for each entity
    outlying = staged(iforest.score(scaled, iforest.fit(scaled, columns, "entity_id", trees), "_f").select("entity_id", "_f"), "forest")
    local = staged(lof(scaled, columns, k, "entity_id"), "lof")
    forest = min_max(outlying, "_f", "_forest").select("entity_id", "_forest")
    factor = min_max(local, "lof", "_lof").select(F.col("id").alias("entity_id"), "_lof")
    return forest.join(factor, "entity_id").select("entity_id", (F.col("_forest") * share + F.col("_lof") * (1 - share)).alias(name))


def ensemble(scores: DataFrame) -> DataFrame:
    """scores with ensemble_score and ensemble_mean.

    The score is the largest weighted one. If that is the speed rule's (which wins ties) and no behavioural score supports it,
    it is damped.
    """
    weighted = {n: F.col(n) * w for n, w in WEIGHTS.items()}
    top = F.greatest(*weighted.values())
    alone = (weighted["score_teleport"] >= top) & (F.greatest(*(F.col(c) for c in BEHAVIOUR)) <= CORROBORATION)
    mean = sum(weighted.values(), F.lit(0.0)) / len(weighted)
    return scores.withColumn("ensemble_mean", mean).withColumn("ensemble_score", F.when(alone, top * DAMPING).otherwise(top))


def flag(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores.withColumn("flagged", F.col("ensemble_score") >= threshold)


def detect(features: DataFrame, threshold: float = THRESHOLD, trees: int = iforest.TREES) -> DataFrame:
    """All scores, the flag, and the truth columns if there are any. The truth is no input of a score."""
    features = staged(features, "features")  # one row for each entity; its plan is long
    truth = [c for c in ("true_anomalous", "true_type") if c in features.columns]
    scores = features.select("entity_id", teleport().alias("score_teleport"), blackout().alias("score_blackout"), *truth)
    for name in LEARNT:
        scores = scores.join(staged(learnt(features.drop(*truth), name, trees), "score"), "entity_id")
    out = flag(ensemble(scores), threshold)
    return out.select("entity_id", *WEIGHTS, "ensemble_score", "ensemble_mean", "flagged", *truth)
