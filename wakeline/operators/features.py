"""The behaviour of each entity in one row: one aggregation over its track, with exact percentiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_NM, clamp, haversine_km, inside_zone, port_distance_nm, zone_distance_nm
from .kinematics import kinematics, track

# Speeds in knots, and multiples of the interval that make a gap.
SLOW_KT, STOPPED_KT, SUSPICIOUS_KT = 2.0, 0.5, 60.0
GAP_FACTOR, BIG_GAP_FACTOR = 2.5, 10.0
BUCKETS_PER_HOUR, LONGEST_INTERVAL_H = 12, 2.0
RATE_LIMITS = (0.005, 0.15)


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull: monotone chain, then the shoelace sum. 0 for under three points or a line."""
    points = np.unique(np.column_stack([x, y]), axis=0).tolist()
    if len(points) < 3:
        return 0.0

    def chain(of):
        out: list = []
        for p in of:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(chain(points) + chain(points[::-1]))
    x0, y0 = points[0]
    a, b = ring[:, 0] - x0, ring[:, 1] - y0
    return float(abs(np.dot(a, np.roll(b, -1)) - np.dot(b, np.roll(a, -1))) / 2)


def hull_areas(lon: pd.Series, lat: pd.Series) -> pd.Series:
    return pd.Series([hull_area(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(lon, lat, strict=True)], dtype=float)


def moved(df: DataFrame) -> DataFrame:
    """df with kinematics and gap_h: what interval, contamination, features and proximity all start from, windowed once."""
    kin = kinematics(df)
    return kin.withColumn("gap_h", _lag_gap_h(kin))


def _lag_gap_h(df: DataFrame) -> Column:
    """Hours since the previous ping, with fractions of seconds."""
    if "gap_h" in df.columns:
        return F.col("gap_h")
    w = track(df)
    return (F.unix_micros("timestamp") - F.lag(F.unix_micros("timestamp")).over(w)) / 1e6 / 3600.0


def interval_candidates(df: DataFrame) -> DataFrame:
    """interval_h and how often it occurs, among gaps rounded (half to even) to five minutes and under two hours."""
    gaps = df.select(_lag_gap_h(df).alias("gap_h")).filter("gap_h is not null")
    rounded = gaps.select((F.bround(F.col("gap_h") * BUCKETS_PER_HOUR) / BUCKETS_PER_HOUR).alias("interval_h"))
    return rounded.filter(F.col("interval_h") < LONGEST_INTERVAL_H).groupBy("interval_h").agg(F.count("*").alias("n"))


def estimate_interval(df: DataFrame) -> DataFrame:
    """One row with interval_h: the most frequent gap, the smallest of equals. No row if there is none."""
    return interval_candidates(df).orderBy(F.desc("n"), "interval_h").limit(1).select("interval_h")


def interval_of(df: DataFrame) -> float:
    row = estimate_interval(df).head()
    if row is None:
        raise ValueError("no two pings of an entity are under two hours apart; give the interval")
    return row["interval_h"]


def estimate_contamination(df: DataFrame, interval_h: float) -> DataFrame:
    """One row with contamination: the share of entities with a big gap or an impossible speed, within limits."""
    w = track(df)
    km = F.col("dist_km") if "dist_km" in df.columns else haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    steps = df.select("entity_id", _lag_gap_h(df).alias("dt"), km.alias("km"))
    odd = F.coalesce(F.col("dt") > BIG_GAP_FACTOR * interval_h, F.lit(False)) | F.coalesce(F.when(F.col("dt") > 0, F.col("km") / F.col("dt") / KM_PER_NM) > SUSPICIOUS_KT, F.lit(False))
    return steps.groupBy("entity_id").agg(F.max(odd.cast("int")).alias("odd")).agg(clamp(F.avg("odd"), *RATE_LIMITS).alias("contamination"))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def motion_aggregates() -> dict[str, Column]:
    speed, dt = F.col("speed_kt"), F.col("dt_h")
    total = F.sum("dt_h")
    share = lambda limit: F.when(total > 0, _or_zero(F.sum(F.when(speed < limit, dt))) / total).otherwise(0.0)
    at = F.struct("lat", "lon")
    return {
        "mean_speed_kt": F.avg(speed), "median_speed_kt": F.percentile(speed, 0.5), "p95_speed_kt": F.percentile(speed, 0.95), "std_speed_kt": F.stddev_pop(speed),
        "frac_slow": share(SLOW_KT), "frac_stopped": share(STOPPED_KT),
        "_first": F.min_by(at, "_order"), "_last": F.max_by(at, "_order"), "_path": F.sum(F.when(speed.isNotNull(), F.col("dist_km"))),
        "heading_variance": _or_zero(F.var_pop("heading_delta")), "heading_change_rate": _or_zero(F.avg(F.abs("heading_delta"))),
        "_speeds": F.count(speed),
    }


def gap_aggregates(interval_h: float) -> dict[str, Column]:
    dt, speed = F.col("dt_h"), F.col("speed_kt")
    gap = dt > GAP_FACTOR * interval_h
    count = lambda c: F.count(F.when(c, 1))
    return {
        "max_gap_h": _or_zero(F.max(dt)), "p95_gap_h": _or_zero(F.percentile(dt, 0.95)), "gap_count": count(gap),
        "gap_frac": F.when(F.count(dt) > 0, count(gap) / F.count(dt)).otherwise(0.0),
        "max_implied_speed_kt": _or_zero(F.max(speed)), "max_gap_displacement_nm": _or_zero(F.max(F.when(gap, F.col("dist_km") / KM_PER_NM))),
        # unknown, not 0, for an entity without any time difference
        "n_suspicious_speed_pings": F.when(F.count(dt) > 0, count(speed > SUSPICIOUS_KT)),
    }


def place_aggregates() -> dict[str, Column]:
    inside = inside_zone("lat", "lon")
    return {
        "min_stratum_dist_nm": F.min(zone_distance_nm("lat", "lon")), "frac_inside_stratum": F.avg(inside.cast("double")),
        "hours_inside_stratum": _or_zero(F.sum(F.when(inside, F.col("dt_h")))), "min_port_dist_nm": F.min(port_distance_nm("lat", "lon")),
    }


def truth_aggregates(columns: list[str]) -> dict[str, Column]:
    out = {}
    if "is_anomalous" in columns:
        out["true_anomalous"] = F.max("is_anomalous").cast("int")
    if "anomaly_type" in columns:
        named = ~F.col("anomaly_type").isin("none", "", "0")
        out["true_type"] = F.coalesce(F.min_by(F.when(named, F.col("anomaly_type")), F.when(named, F.col("_order"))), F.lit("none"))
    return out


MOTION = ["mean_speed_kt", "median_speed_kt", "p95_speed_kt", "std_speed_kt", "frac_slow", "frac_stopped", "straightness", "hull_area_deg2", "heading_variance", "heading_change_rate"]
GAPS = ["max_gap_h", "p95_gap_h", "gap_count", "gap_frac", "max_implied_speed_kt", "max_gap_displacement_nm", "n_suspicious_speed_pings"]
PLACES = ["min_stratum_dist_nm", "frac_inside_stratum", "hours_inside_stratum", "min_port_dist_nm"]


def track_features(df: DataFrame, interval_h: float, hull: bool = True) -> DataFrame:
    """entity_id, motion, gap, place and (if labelled) truth features: one shuffle by entity for windows and aggregation. df may be moved() before."""
    order = F.struct(*(c for c in ("timestamp", "event_id") if c in df.columns)) if "event_id" in df.columns else F.struct("timestamp", "lat", "lon")
    kin = (df if "dist_km" in df.columns else kinematics(df)).withColumn("_order", order)
    aggs = motion_aggregates() | gap_aggregates(interval_h) | place_aggregates() | truth_aggregates(df.columns)
    if hull:
        aggs |= {"_lons": F.collect_list("lon"), "_lats": F.collect_list("lat")}
    rows = kin.groupBy("entity_id").agg(*(c.alias(n) for n, c in aggs.items()))
    net = haversine_km(F.col("_first.lat"), F.col("_first.lon"), F.col("_last.lat"), F.col("_last.lon"))
    rows = rows.withColumn("straightness", F.when(F.col("_path") > 0, net / F.col("_path")).otherwise(1.0))
    rows = rows.withColumn("hull_area_deg2", F.pandas_udf(hull_areas, "double")("_lons", "_lats") if hull else F.lit(None).cast("double"))
    moving = [F.when(F.col("_speeds") > 0, F.col(c)).otherwise(0.0).alias(c) for c in MOTION]
    truth = [c for c in ("true_anomalous", "true_type") if c in rows.columns]
    return rows.select("entity_id", *moving, *GAPS, *PLACES, *truth)
