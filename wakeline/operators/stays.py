"""Stays of single tracks. Both detectors are sequential by nature, so each track is walked by one task, many tracks in a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import EARTH_RADIUS_KM_COARSE

# Fixed values of the two presets.
WINDOW_RADIUS_KM, WINDOW_MINUTES, LOW_SPEED_KT = 0.5, 30.0, 1.0
CLUSTER_RADIUS_KM, CLUSTER_MINUTES = 1.0, 60.0


def _km(lat1, lon1, lat2, lon2):
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(np.asarray(lon2) - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM_COARSE * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def window_stays(lat: np.ndarray, lon: np.ndarray, minutes: np.ndarray, radius: float = WINDOW_RADIUS_KM, least: float = WINDOW_MINUTES) -> np.ndarray:
    """Stay number of each point in time order, -1 outside.

    From a point, the window grows while all its points are within the radius of its mean. The longest such window that lasts
    long enough is a stay, and the search goes on behind it; else it goes on at the next point.
    """
    n, out, number, i = len(lat), np.full(len(lat), -1), 0, 0
    # places from which already the next point is too far, for certain; the others are walked
    mean_lat, mean_lon = (lat[:-1] + lat[1:]) / 2, (lon[:-1] + lon[1:]) / 2
    apart = np.maximum(_km(lat[:-1], lon[:-1], mean_lat, mean_lon), _km(lat[1:], lon[1:], mean_lat, mean_lon)) > radius * (1 + 1e-9)
    while i < n:
        if i == n - 1 or apart[i]:
            i += 1
            continue
        total_lat, total_lon, last = lat[i], lon[i], -1
        for j in range(i + 1, n):
            total_lat, total_lon = total_lat + lat[j], total_lon + lon[j]
            size = j - i + 1
            if _km(lat[i : j + 1], lon[i : j + 1], total_lat / size, total_lon / size).max() > radius:
                break
            if minutes[j] - minutes[i] >= least:
                last = j
        if last < 0:
            i += 1
        else:
            out[i : last + 1] = number
            number, i = number + 1, last + 1
    return out


def linked_groups(lat: np.ndarray, lon: np.ndarray, radius: float = CLUSTER_RADIUS_KM) -> np.ndarray:
    """Component of each point in the graph of points at most the radius apart, by first point; -1 for points alone.

    A density clustering with a least size of two is this graph's components, as any point with a neighbour is a core point.
    """
    n = len(lat)
    root = np.arange(n)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = np.argsort(lat, kind="stable")
    p = np.radians(lat[order])
    reach = np.searchsorted(p, p + radius / EARTH_RADIUS_KM_COARSE + 1e-12, side="right")
    for at in range(n):
        near = order[at + 1 : reach[at]]
        if len(near):
            for other in near[_km(lat[order[at]], lon[order[at]], lat[near], lon[near]) <= radius]:
                a, b = find(order[at]), find(other)
                root[max(a, b)] = min(a, b)
    roots = np.array([find(i) for i in range(n)], np.int64)
    size = np.bincount(roots, minlength=n)
    firsts = np.flatnonzero(size > 1)
    number = np.full(n, -1)
    number[firsts] = np.arange(len(firsts))
    return number[roots]


def cluster_stays(lat: np.ndarray, lon: np.ndarray, minutes: np.ndarray, radius: float = CLUSTER_RADIUS_KM, least: float = CLUSTER_MINUTES) -> np.ndarray:
    """Stay number of each point in time order: linked groups, cut where more than `least` minutes pass, that last as long."""
    groups, out, number = linked_groups(lat, lon, radius), np.full(len(lat), -1), 0
    for g in range(groups.max() + 1 if len(groups) else 0):
        at = np.flatnonzero(groups == g)
        for part in np.split(at, np.flatnonzero(np.diff(minutes[at]) > least) + 1):
            if minutes[part[-1]] - minutes[part[0]] >= least:
                out[part] = number
                number += 1
    return out


def _same(a, b) -> bool:
    """Missing values are one track."""
    return a == b or (pd.isna(a) and pd.isna(b))


def _firsts(entities: pd.Series) -> np.ndarray:
    """Places where a track begins, in rows that are ordered by entity."""
    codes = pd.factorize(entities, use_na_sentinel=False)[0]
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def detect_stays(df: DataFrame, method: str = "window") -> DataFrame:
    """df with is_stay, stay_id (-1 outside), stay_center_lat, stay_center_lon, stay_duration_min; with method "window" also low_speed_flag.

    method "cluster" is the density preset. A track is one task's, in memory.
    """
    extra = [("is_stay", T.BooleanType()), ("stay_id", T.IntegerType()), ("stay_center_lat", T.DoubleType()), ("stay_center_lon", T.DoubleType()), ("stay_duration_min", T.DoubleType())]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in extra)])
    find = {"window": window_stays, "cluster": cluster_stays}[method]
    ties = [c for c in ("event_id", "lat", "lon") if c in df.columns]

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole tracks, one after the other."""
        seconds = pdf["timestamp"].to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6
        if method == "window":
            seconds = np.floor(seconds)
        lat, lon, first = pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float), _firsts(pdf["entity_id"])
        ids = np.concatenate([find(lat[a:b], lon[a:b], seconds[a:b] / 60.0) for a, b in zip(first, [*first[1:], len(pdf)], strict=True)])
        stayed = np.flatnonzero(ids >= 0)
        track = np.searchsorted(first, stayed, side="right")
        stays = pd.DataFrame({"track": track, "stay_id": ids[stayed], "lat": lat[stayed], "lon": lon[stayed], "t": seconds[stayed]}).groupby(["track", "stay_id"])
        values = {f"stay_center_{c}": stays[c].transform("mean") for c in ("lat", "lon")} | {"stay_duration_min": (stays["t"].transform("max") - stays["t"].transform("min")) / 60.0}
        out = {name: np.full(len(pdf), np.nan) for name in values}
        for name, value in values.items():
            out[name][stayed] = value
        return pdf.assign(is_stay=ids >= 0, stay_id=ids.astype("int32"), **out)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the last track of a batch may go on in the next ones
        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = _firsts(pdf["entity_id"])[-1]
            if held and (last or not _same(held[-1]["entity_id"].iloc[-1], pdf["entity_id"].iloc[0])):
                whole = pd.concat([*held, pdf.iloc[:last]], ignore_index=True)
                held = []
            else:
                whole = pdf.iloc[:last] if not held else pdf.iloc[:0]
            if len(whole):
                yield of(whole.reset_index(drop=True))
            held.append(pdf.iloc[last:])
        if held:
            yield of(pd.concat(held, ignore_index=True))

    inside = [F.col(c).asc_nulls_last() for c in ("timestamp", *ties)]
    out = df.repartition("entity_id").sortWithinPartitions("entity_id", *inside).mapInPandas(walk, schema)
    for c in ("stay_center_lat", "stay_center_lon", "stay_duration_min"):
        out = out.withColumn(c, F.when(F.col("is_stay"), F.col(c)))
    return low_speed(out) if method == "window" else out


def low_speed(df: DataFrame) -> DataFrame:
    return df.withColumn("low_speed_flag", F.col("sog_knots") < LOW_SPEED_KT)


def distinct_stays(df: DataFrame) -> DataFrame:
    """One row for each stay of each entity."""
    return df.filter("is_stay").select("entity_id", "stay_id", "stay_center_lat", "stay_center_lon", "stay_duration_min").dropDuplicates(["entity_id", "stay_id"])


def stay_summary(df: DataFrame) -> DataFrame:
    """Centre, length and pings of each stay, from its pings."""
    minutes = (F.max(F.unix_micros("timestamp")) - F.min(F.unix_micros("timestamp"))) / 6e7
    return df.filter("is_stay").groupBy("entity_id", "stay_id").agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"), minutes.alias("duration_min"), F.count("*").alias("n_pings"))
