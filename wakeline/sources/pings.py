"""Ping tables: position reports of moving entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PING_SCHEMA = T.StructType(
    [
        T.StructField("entity_id", T.IntegerType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("timestamp", T.TimestampType()),
        T.StructField("vessel_type", T.StringType()), T.StructField("sog_knots", T.DoubleType()), T.StructField("is_anomalous", T.ByteType()), T.StructField("anomaly_type", T.StringType()),
    ]
)
LABELS = ("is_anomalous", "anomaly_type")


def read_csv(spark: SparkSession, path: str, labels: bool = True, chunk_rows: int | None = None) -> DataFrame:
    """A ping CSV with a header, plain or gzip. Columns may be missing or in any order.

    Files are split by Spark, so chunk_rows has no effect. A gzip file is one task's to read and is dealt by entity
    at once, so that only the read is not parallel.
    """
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in PING_SCHEMA}
    schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    df = spark.read.schema(schema).option("header", True).csv(path)
    if path.endswith(".gz"):
        df = df.repartition("entity_id")
    return df if labels else drop_labels(df)


def drop_labels(df: DataFrame) -> DataFrame:
    return df.drop(*LABELS)


def load_summary(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_entities, columns."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct("entity_id").alias("n_entities")).withColumn("columns", F.lit(",".join(df.columns)))


#: Pings derived from the events table by integer arithmetic, so that any engine has the same.
_EVENT_PINGS = {
    "entity_id": "user_id",
    "timestamp": "{ts}",
    "bucket": "date_trunc('hour', {ts})",
    "event_id": "event_id",
    "vessel_type": "CASE WHEN event_type = 'purchase' THEN 'fishing' ELSE event_type END",
    "sog_knots": "value",
    "is_anomalous": "CAST(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS INT)",
    "anomaly_type": "CASE WHEN event_id % 291 = 0 THEN 'ais_spoofing' WHEN event_id % 194 = 0 THEN 'dark_activity' WHEN event_id % 97 = 0 THEN 'illegal_fishing' ELSE 'none' END",
    "lat": "(CASE WHEN user_id % 2 = 0 THEN 17.45{d} ELSE 24.0{d} END) + ((event_id*event_id*131 + user_id*17) % 1000 - 500) / 4000.0{d} + (CASE WHEN event_id % 97 = 0 THEN 3.0{d} ELSE 0.0{d} END)",
    "lon": "(CASE WHEN user_id % 2 = 0 THEN -78.2{d} ELSE -80.5{d} END) + ((event_id*event_id*177 + event_id*53) % 997 - 498) / 4000.0{d}",
}


def event_columns(ts: str, suffix: str) -> list[str]:
    """The view's columns as SQL; ts is the engine's timestamp, suffix what marks a double literal."""
    return [f"{x.format(ts=ts, d=suffix)} AS {name}" for name, x in _EVENT_PINGS.items()]


def event_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*event_columns("cast(ts as timestamp)", "D"))
