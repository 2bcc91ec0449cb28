"""Where results go: CSV, the feature cache, and trip segments as GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.kinematics import track


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_pings_csv(df: DataFrame, path: str, decimals: int = 5) -> None:
    """Positions to `decimals` places and speeds to two."""
    rounded = {c: F.round(c, d) for c, d in (("lat", decimals), ("lon", decimals), ("sog_knots", 2)) if c in df.columns}
    write_csv(df.withColumns(rounded).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")), path)


def cached_features(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at path; made and written first if it isn't there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _runs(df: DataFrame, by: str) -> DataFrame:
    w = track(df)
    before = F.lag(by).over(w)
    new = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(by).eqNullSafe(before)).cast("long"))
    marked = df.withColumn("_new", new).withColumn("_next", F.lead(F.struct("lon", "lat", "timestamp")).over(w))
    return marked.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def trip_segments(df: DataFrame, by: str = "anomaly_type") -> DataFrame:
    """entity_id, segment, anomaly_type, vessel_type, n_vertices, sog_knots_mean, first_epoch, last_epoch, coordinates.

    A segment is an unbroken run of one label and the vertex that follows it, which the next segment begins with. Segments of
    under two vertices are left out. The mean speed is of the run alone.
    """
    r = _runs(df, by)
    ends = [F.struct("timestamp", "event_id")] if "event_id" in df.columns else [F.struct("timestamp", "lat", "lon")]
    vertex = F.struct(F.col("timestamp").alias("t"), F.col("lon").alias("lon"), F.col("lat").alias("lat"))
    g = r.groupBy("entity_id", "segment", F.col(by).alias("anomaly_type")).agg(
        F.min_by("vessel_type", ends[0]).alias("vessel_type") if "vessel_type" in df.columns else F.lit(None).cast("string").alias("vessel_type"),
        F.count("*").alias("n"), F.max_by("_next", ends[0]).alias("next"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
        (F.avg("sog_knots") if "sog_knots" in df.columns else F.lit(None).cast("double")).alias("sog_knots_mean"), F.sort_array(F.collect_list(vertex)).alias("vertices"),
    )
    has_next = F.col("next").isNotNull()
    point = lambda lon, lat, t: F.array(lon, lat, F.lit(0.0), F.unix_seconds(t).cast("double"))
    own = F.transform("vertices", lambda v: point(v["lon"], v["lat"], v["t"]))
    coordinates = F.when(has_next, F.concat(own, F.array(point(F.col("next.lon"), F.col("next.lat"), F.col("next.timestamp"))))).otherwise(own)
    out = g.select(
        "entity_id", "segment", "anomaly_type", "vessel_type", (F.col("n") + has_next.cast("long")).alias("n_vertices"), "sog_knots_mean",
        F.unix_seconds("lo").alias("first_epoch"), F.unix_seconds(F.when(has_next, F.col("next.timestamp")).otherwise(F.col("hi"))).alias("last_epoch"), coordinates.alias("coordinates"),
    )
    return out.filter("n_vertices >= 2")


def trip_features(segments: DataFrame) -> DataFrame:
    """value: each segment as a GeoJSON feature, one LineString."""
    properties = F.struct(
        "entity_id", "anomaly_type", F.when(F.col("anomaly_type") == "none", 0).otherwise(1).alias("is_anomalous"), "vessel_type", F.round("sog_knots_mean", 2).alias("sog_knots_mean")
    )
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("coordinates"))
    return segments.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_trips(df: DataFrame, path: str) -> None:
    """A folder of newline-delimited GeoJSON features; every task writes its own file."""
    trip_features(trip_segments(df)).write.mode("overwrite").text(path)


def both_paths(path: str) -> tuple[str, str]:
    """The CSV and the GeoJSON path that belong to an output path."""
    for end in (".csv.gz", ".csv", ".geojson"):
        if path.endswith(end):
            stem = path[: -len(end)]
            return f"{stem}{end if end != '.geojson' else '.csv'}", f"{stem}.geojson"
    return f"{path}.csv", f"{path}.geojson"


def write_stay_points(stays: DataFrame, path: str) -> None:
    """The centres of distinct stays as GeoJSON points, for any map."""
    properties = F.struct("entity_id", "stay_id", "stay_duration_min")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("stay_center_lon", "stay_center_lat").alias("coordinates"))
    stays.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value")).write.mode("overwrite").text(path)
