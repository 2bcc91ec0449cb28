"""The nearest other entity at every moment, and what it tells about an entity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, KM_PER_NM, haversine_km

# Distances in nautical miles, and the sentinel of entities that never had company.
CLOSE_NM, SHADOW_NM, SLOW_KT, EPISODE_H, NEVER_NM = 1.0, 2.0, 1.0, 1.0, 9999.0
#: Moments that are searched in one group: few enough for memory, enough to keep groups from being tiny.
MOMENTS = 16


def first_in_bucket(df: DataFrame) -> DataFrame:
    """The first ping of each entity in each bucket (a column), as its position at that moment."""
    w = Window.partitionBy("entity_id", "bucket").orderBy("timestamp", *(["event_id"] if "event_id" in df.columns else ["lat", "lon"]))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def nearest_by_join(df: DataFrame, moment: str = "timestamp") -> DataFrame:
    """The plain form, quadratic in the entities of a moment: for checks and small fleets."""
    a = df.select(F.col(moment).alias("moment"), "entity_id", "lat", "lon", "speed_kt")
    b = df.select(F.col(moment).alias("moment"), F.col("entity_id").alias("nn_id"), F.col("lat").alias("la"), F.col("lon").alias("lo"), F.col("speed_kt").alias("nn_speed_kt"))
    pairs = a.join(b, "moment").filter("entity_id <> nn_id").withColumn("d", haversine_km("lat", "lon", "la", "lo"))
    best = F.min(F.struct("d", "nn_id", "nn_speed_kt")).alias("m")
    return pairs.groupBy("moment", "entity_id", "speed_kt").agg(best).select("moment", "entity_id", "speed_kt", (F.col("m.d") / KM_PER_NM).alias("nn_dist_nm"), F.col("m.nn_id").alias("nn_id"), F.col("m.nn_speed_kt").alias("nn_speed_kt"))


def scalar_km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """The great-circle distance in the order of operations of the SQL and by the C library, so that it is the same to the last bit."""
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.pow(math.sin((p2 - p1) / 2), 2.0) + math.cos(p1) * math.cos(p2) * math.pow(math.sin(math.radians(lon2 - lon1) / 2), 2.0)
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(a, 1.0)))


def sweep(ids: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distance in km to the nearest other point and its index, the smaller id among equals.

    Points in latitude order are compared with those 1, 2, ... places away, for all points at once, until the latitude alone
    is farther than the best so far. numpy's last bits are not the SQL's, so points that are nearest but for rounding (mirror
    images on a grid, mostly) are remembered and told apart by scalar_km.
    """
    order = np.lexsort((ids, lat))
    p, q, i = np.radians(lat[order]), np.radians(lon[order]), ids[order]
    n = len(p)
    best, who, least = np.full(n, np.inf), np.full(n, -1), np.full(n, np.inf)
    cos, seen = np.cos(p), []
    for up in (1, -1):
        live = np.arange(n)
        for k in range(1, n):
            other = live + up * k
            ok = (other >= 0) & (other < n)
            live, other = live[ok], other[ok]
            ok = np.abs(p[other] - p[live]) * EARTH_RADIUS_KM <= best[live] * (1 + 1e-9) + 1e-9
            live, other = live[ok], other[ok]
            if not len(live):
                break
            a = np.sin((p[other] - p[live]) / 2) ** 2 + cos[live] * cos[other] * np.sin((q[other] - q[live]) / 2) ** 2
            d = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))
            near = a <= least[live]
            seen.append((live[near], other[near], a[near]))
            nearer = (d < best[live]) | ((d == best[live]) & (i[other] < i[who[live]]))
            best[live[nearer]], who[live[nearer]] = d[nearer], other[nearer]
            # beyond what rounding may do to a, near 0 as well
            least[live[nearer]] = a[nearer] * (1 + 1e-13) + 1e-14 * np.sqrt(a[nearer])
    if seen:
        one, two, a = map(np.concatenate, zip(*seen))
        even = a <= least[one]
        one, two = one[even], two[even]
        tied = np.bincount(one, minlength=n)[one] > 1
        first: dict[int, tuple[float, int, int]] = {}
        y, x = lat[order].tolist(), lon[order].tolist()
        for u, v in zip(one[tied].tolist(), two[tied].tolist()):
            found = (scalar_km(y[u], x[u], y[v], x[v]), int(i[v]), v)
            if u not in first or found < first[u]:
                first[u] = found
        for u, (d, _, v) in first.items():
            best[u], who[u] = d, v
    out, index = np.empty(n), np.empty(n, np.int64)
    out[order], index[order] = best, order[who]
    return out, index


_NEAREST = "moment timestamp, entity_id long, speed_kt double, nn_dist_nm double, nn_id long, nn_speed_kt double"


def _nearest_of(pdf: pd.DataFrame) -> pd.DataFrame:
    found = []
    for _, at in pdf.groupby("moment", sort=False):
        if len(at) < 2:
            continue
        ids, speed = at["entity_id"].to_numpy(), at["speed_kt"].to_numpy(float)
        d, j = sweep(ids, at["lat"].to_numpy(float), at["lon"].to_numpy(float))
        found.append(pd.DataFrame({"moment": at["moment"].to_numpy(), "entity_id": ids, "speed_kt": speed, "nn_dist_nm": d / KM_PER_NM, "nn_id": ids[j], "nn_speed_kt": speed[j]}))
    if not found:
        return pd.DataFrame({"moment": pd.Series([], dtype="datetime64[ns]"), **{c: pd.Series([], dtype=float) for c in ("entity_id", "speed_kt", "nn_dist_nm", "nn_id", "nn_speed_kt")}})
    return pd.concat(found, ignore_index=True)


def nearest(df: DataFrame, moment: str = "timestamp", moments: int | None = None) -> DataFrame:
    """moment, entity_id, speed_kt, nn_dist_nm, nn_id, nn_speed_kt for moments of two entities or more.

    df has one row for each entity and moment, with speed_kt. Moments are dealt into groups by hash; a group holds about
    MOMENTS of them, and one moment holds no more than the fleet. NULL speeds come back as NULL.
    """
    rows = df.select(F.col(moment).alias("moment"), F.col("entity_id").cast("long").alias("entity_id"), "lat", "lon", "speed_kt")
    if moments is None:
        moments = rows.agg(F.approx_count_distinct("moment")).head()[0]
    groups = max(1, moments // MOMENTS)
    found = rows.withColumn("_g", F.pmod(F.xxhash64("moment"), F.lit(groups))).groupBy("_g").applyInPandas(lambda pdf: _nearest_of(pdf), _NEAREST)
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select("moment", "entity_id", known("speed_kt"), "nn_dist_nm", "nn_id", known("nn_speed_kt"))


def close_runs(near: DataFrame) -> DataFrame:
    """entity_id, run, n, begin, end: unbroken runs of close moments. Moments without company are no rows, so they break no run."""
    w = Window.partitionBy("entity_id").orderBy("moment").rowsBetween(Window.unboundedPreceding, 0)
    close = F.col("nn_dist_nm") < CLOSE_NM
    runs = near.withColumn("_close", close).withColumn("run", F.sum((~close).cast("long")).over(w))
    return runs.filter("_close").groupBy("entity_id", "run").agg(F.count("*").alias("n"), F.min("moment").alias("begin"), F.max("moment").alias("end"))


def proximity_features(near: DataFrame, entities: DataFrame, interval_h: float) -> DataFrame:
    """min_nn_dist_nm, mean_nn_dist_nm, hours_within_1nm, hours_within_2nm, sustained_close_episodes, co_slow_hours for all entities."""
    close = F.col("nn_dist_nm") < CLOSE_NM
    w = Window.partitionBy("entity_id").orderBy("moment").rowsBetween(Window.unboundedPreceding, 0)
    # partial sums of each run first, then the entity: the same partitioning serves window and both aggregations
    runs = near.withColumn("_run", F.sum((~close).cast("long")).over(w)).groupBy("entity_id", "_run").agg(
        F.min("nn_dist_nm").alias("lo"), F.sum("nn_dist_nm").alias("total"), F.count("*").alias("n"), F.count(F.when(close, 1)).alias("c1"),
        F.count(F.when(F.col("nn_dist_nm") < SHADOW_NM, 1)).alias("c2"), F.count(F.when(close & (F.col("speed_kt") < SLOW_KT) & (F.col("nn_speed_kt") < SLOW_KT), 1)).alias("slow"),
    )
    made = runs.groupBy("entity_id").agg(
        F.min("lo").alias("lo"), (F.sum("total") / F.sum("n")).alias("mean"), F.sum("c1").alias("c1"), F.sum("c2").alias("c2"), F.sum("slow").alias("slow"),
        F.count(F.when(F.col("c1") * interval_h >= EPISODE_H, 1)).alias("episodes"),
    )
    zero = lambda c: F.coalesce(F.col(c) * interval_h, F.lit(0.0))
    return entities.select("entity_id").join(made, "entity_id", "left").select(
        "entity_id", F.coalesce("lo", F.lit(NEVER_NM)).alias("min_nn_dist_nm"), F.coalesce("mean", F.lit(NEVER_NM)).alias("mean_nn_dist_nm"), zero("c1").alias("hours_within_1nm"),
        zero("c2").alias("hours_within_2nm"), F.coalesce("episodes", F.lit(0)).alias("sustained_close_episodes"), zero("slow").alias("co_slow_hours"),
    )
