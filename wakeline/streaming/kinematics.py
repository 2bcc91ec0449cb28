"""Kinematics of a ping stream: the batch operator's columns, continued over micro-batches.

State is the last ping of each entity and its heading. Within a micro-batch pings are put in order of time (in microseconds), then of
place; one that is earlier than what was already emitted for its entity is late, and is dropped. Pings of equal times all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.geo import EARTH_RADIUS_KM, KM_PER_NM

_OUT = "entity_id long, timestamp timestamp, lat double, lon double, dt_h double, dist_km double, speed_kt double, heading_deg double, heading_delta double"
_STATE = "micros long, lat double, lon double, heading double"


def _continued(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(batches), ignore_index=True).sort_values(["timestamp", "lat", "lon"], kind="stable")
    micros = pdf["timestamp"].to_numpy().astype("datetime64[us]").astype(np.int64)
    last = state.get if state.exists else None
    if last is not None:
        keep = micros >= last[0]
        pdf, micros = pdf[keep], micros[keep]
    if not len(pdf):
        return
    seconds = micros // 1_000_000
    lat, lon = pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float)
    before = (last[0] // 1_000_000, last[1], last[2]) if last is not None else (np.nan, np.nan, np.nan)
    t0, la0, lo0 = (np.concatenate([[b], x[:-1]]) for b, x in zip(before, (seconds.astype(float), lat, lon), strict=True))
    p, q, d = np.radians(la0), np.radians(lat), np.radians(lon - lo0)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(d / 2) ** 2
    km = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))
    hours = (seconds - t0) / 3600.0
    heading = np.mod(np.degrees(np.arctan2(np.sin(d) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(d))) + 360, 360)
    earlier = np.concatenate([[last[3] if last is not None and last[3] is not None else np.nan], heading[:-1]])
    with np.errstate(invalid="ignore", divide="ignore"):
        speed = np.where(hours > 0, km / hours / KM_PER_NM, np.nan)
    state.update((int(micros[-1]), float(lat[-1]), float(lon[-1]), None if np.isnan(heading[-1]) else float(heading[-1])))
    yield pd.DataFrame({
        "entity_id": key[0], "timestamp": pdf["timestamp"].to_numpy(), "lat": lat, "lon": lon, "dt_h": hours, "dist_km": km, "speed_kt": speed, "heading_deg": heading,
        "heading_delta": np.mod(heading - earlier + 180, 360) - 180,
    })


def streaming_kinematics(pings: DataFrame) -> DataFrame:
    """A streaming frame of pings with kinematics against each entity's previous ping; append output."""
    slim = pings.selectExpr("cast(entity_id as long) as entity_id", "timestamp", "lat", "lon")
    return slim.groupBy("entity_id").applyInPandasWithState(_continued, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
