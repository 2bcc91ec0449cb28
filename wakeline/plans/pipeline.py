"""Whole analyses, from pings to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import iforest, neighbors, rules, scaling, stays
from ..operators.features import estimate_contamination, interval_of, moved, track_features
from ..operators.kinematics import ping_features
from ..operators.proximity import nearest, proximity_features
from ..sources.staging import staged

IF_COLUMNS = ["sog_knots", "time_gap_min", "speed_delta", "speed_z", "dist_from_prev_km", "bearing_delta", "dist_from_median_km", "is_stay_int", "stay_duration_min"]
KNN_COLUMNS = ["sog_knots", "time_gap_min_capped", "speed_delta", "speed_z", "dist_from_prev_km", "bearing_delta", "dist_from_median_km", "is_stay_int", "stay_duration_min"]
KNN_K, LEAST_ROWS = 10, 50


def build_feature_matrix(df: DataFrame, interval_h: float | None = None, moment: str = "timestamp") -> tuple[DataFrame, float, float]:
    """(one row of features for each entity, interval in hours, estimated contamination). A given interval is kept."""
    df = staged(moved(df), "kinematics")
    interval_h = interval_of(df) if interval_h is None else interval_h
    contamination = estimate_contamination(df, interval_h).head()[0]
    features = track_features(df, interval_h)
    slim = df.select("entity_id", "timestamp", "lat", "lon", "speed_kt", *(["event_id"] if "event_id" in df.columns else []), *([moment] if moment != "timestamp" else []))
    if moment != "timestamp":
        from ..operators.proximity import first_in_bucket

        slim = first_in_bucket(slim)
    near = nearest(slim, moment)
    return features.join(proximity_features(near, features.select("entity_id"), interval_h), "entity_id", "left"), interval_h, contamination


def run_ping_pipeline(df: DataFrame, preset: str = "iforest", trees: int = iforest.TREES) -> DataFrame:
    """Pings with stays, features, outlier scores, rules and pred_anomalous. df needs a row id column event_id.

    Presets: iforest (window stays, forest by type), knn (window stays, neighbour distance by type, its 97th percentile),
    staypoint (density stays, forest by type).
    """
    stayed = stays.detect_stays(df, "cluster" if preset == "staypoint" else "window")
    made = staged(rules.apply_rules(ping_features(stayed), preset), "ping-features")
    if preset == "knn":
        scaled = scaling.standard_scale(made.select("event_id", "vessel_type", *KNN_COLUMNS), KNN_COLUMNS, "vessel_type")
        # read for the limit and for the result
        score = staged(neighbors.knn_outlier(scaled, KNN_COLUMNS, KNN_K, "vessel_type", "event_id", LEAST_ROWS), "scores")
        made = made.join(score.withColumnRenamed("id", "event_id"), "event_id", "left")
        limit = ev.score_threshold(made, "knn_outlier_score").head()[0]
        return rules.combine(made, F.col("knn_outlier_score") >= F.lit(limit))
    scored = iforest.score_by_type(made, IF_COLUMNS, "vessel_type", "event_id", LEAST_ROWS, trees)
    return rules.combine(scored, F.col("if_anomalous"))
