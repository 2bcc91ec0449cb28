"""Windows over each entity's track. All of them share one partitioning and one order, so one shuffle and one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM_COARSE, KM_PER_NM, bearing_deg, haversine_km, wrap_deg

#: Gap cap in minutes, of the nearest-neighbour preset.
GAP_CAP_MIN = 240.0


def track(df: DataFrame) -> WindowSpec:
    """Rows of an entity in time order, with whatever else orders them fully."""
    ties = [c for c in ("event_id", "lat", "lon") if c in df.columns]
    return Window.partitionBy("entity_id").orderBy("timestamp", *(ties[:1] if "event_id" in ties else ties))


def kinematics(df: DataFrame) -> DataFrame:
    """df with dt_h, dist_km, speed_kt, heading_deg, heading_delta against the previous ping; NULL where there is none.

    Time differences are of whole seconds. Without time passing a segment has a distance but no speed.
    """
    w = track(df)
    lat, lon = F.lag("lat").over(w), F.lag("lon").over(w)
    moved = df.select(
        "*",
        ((F.unix_seconds("timestamp") - F.lag(F.unix_seconds("timestamp")).over(w)) / 3600.0).alias("dt_h"),
        haversine_km(lat, lon, "lat", "lon").alias("dist_km"),
        bearing_deg(lat, lon, "lat", "lon").alias("heading_deg"),
    )
    speed = F.when(F.col("dt_h") > 0, F.col("dist_km") / F.col("dt_h") / KM_PER_NM)
    return moved.select(*df.columns, "dt_h", "dist_km", speed.alias("speed_kt"), "heading_deg", wrap_deg(F.col("heading_deg") - F.lag("heading_deg").over(w)).alias("heading_delta"))


def emitted_speed(df: DataFrame, interval_h: float) -> DataFrame:
    """df with sog_knots from positions at a fixed cadence's actual time steps: 0 for the first ping and without time passing."""
    w = track(df)
    dt = (F.unix_seconds("timestamp") - F.lag(F.unix_seconds("timestamp")).over(w)) / 3600.0
    km = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    return df.withColumn("sog_emitted", F.coalesce(F.when(dt > 0, km / dt / KM_PER_NM), F.lit(0.0)))


def median_position(df: DataFrame) -> DataFrame:
    return df.groupBy("entity_id").agg(F.percentile("lat", 0.5).alias("median_lat"), F.percentile("lon", 0.5).alias("median_lon"))


def ping_features(df: DataFrame) -> DataFrame:
    """df with the features of single pings, 0 where there is no previous one.

    time_gap_min (and capped), speed_delta, speed_z, dist_from_prev_km, bearing, bearing_delta, dist_from_median_km, is_stay_int,
    stay_duration_min, hour_of_day, day_of_week (Monday is 0).
    """
    w, all_of = track(df), Window.partitionBy("entity_id")
    r = EARTH_RADIUS_KM_COARSE
    lat, lon = F.lag("lat").over(w), F.lag("lon").over(w)
    spread = F.stddev_samp("sog_knots").over(all_of)
    gap = (F.unix_micros("timestamp") - F.lag(F.unix_micros("timestamp")).over(w)) / 1e6 / 60.0
    zero = F.lit(0.0)
    first = df.select(
        "*",
        F.coalesce(gap, zero).alias("time_gap_min"),
        F.coalesce(F.col("sog_knots") - F.lag("sog_knots").over(w), zero).alias("speed_delta"),
        F.when(spread > 0, (F.col("sog_knots") - F.avg("sog_knots").over(all_of)) / spread).otherwise(zero).alias("speed_z"),
        F.coalesce(haversine_km(lat, lon, "lat", "lon", r, clip=False), zero).alias("dist_from_prev_km"),
        F.coalesce(bearing_deg(lat, lon, "lat", "lon"), zero).alias("bearing"),
        F.percentile("lat", 0.5).over(all_of).alias("_mlat"),
        F.percentile("lon", 0.5).over(all_of).alias("_mlon"),
    )
    stay = "is_stay" in df.columns
    drop = ["stay_duration_min"] if stay else []
    return first.select(
        *(c for c in df.columns if c not in drop),
        "time_gap_min", F.least("time_gap_min", F.lit(GAP_CAP_MIN)).alias("time_gap_min_capped"), "speed_delta", "speed_z", "dist_from_prev_km", "bearing",
        wrap_deg(F.col("bearing") - F.coalesce(F.lag("bearing").over(w), zero)).alias("bearing_delta"),
        haversine_km("lat", "lon", "_mlat", "_mlon", r, clip=False).alias("dist_from_median_km"),
        (F.col("is_stay").cast("int") if stay else F.lit(0)).alias("is_stay_int"),
        (F.coalesce("stay_duration_min", zero) if stay else zero).alias("stay_duration_min"),
        F.hour("timestamp").alias("hour_of_day"), F.weekday("timestamp").alias("day_of_week"),
    )


def rolling_slow(df: DataFrame, rows: int = 4, knots: float = 1.0) -> DataFrame:
    """df with rolling_slow: the fastest of the last `rows` pings is under `knots`; false before there are so many."""
    last = track(df).rowsBetween(1 - rows, 0)
    return df.withColumn("rolling_slow", (F.count("sog_knots").over(last) == rows) & (F.max("sog_knots").over(last) < knots))


def gap_segments(df: DataFrame, minutes: float = 60.0) -> DataFrame:
    """df with segment: it counts on where more than `minutes` passed since the previous ping."""
    w = track(df)
    gap = (F.unix_micros("timestamp") - F.lag(F.unix_micros("timestamp")).over(w)) / 1e6 / 60.0
    cut = df.withColumn("_cut", F.coalesce(gap > minutes, F.lit(False)).cast("long"))
    return cut.withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")
