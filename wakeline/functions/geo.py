"""Great-circle functions as Column expressions: no UDF, so they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_KM_COARSE = 6371.0
KM_PER_NM = 1.852
KM_PER_DEG_LAT = 110.574
KM_PER_DEG_LON = 111.320
PORTS = {  # longitude, latitude
    "Miami": (-80.19, 25.77), "Havana": (-82.38, 23.13), "Nassau": (-77.34, 25.06), "Kingston": (-76.79, 17.99),
    "Santo Domingo": (-69.93, 18.47), "San Juan": (-66.10, 18.47), "Willemstad": (-68.93, 12.11), "Port of Spain": (-61.52, 10.65),
    "Bridgetown": (-59.62, 13.10), "Cartagena": (-75.51, 10.40), "Colon": (-79.90, 9.36), "Cozumel": (-86.85, 21.16),
}
ZONES = {  # longitude, latitude, radius in km
    "Cay Sal Bank MPA": (-80.50, 23.60, 45.0), "Miskito Bank MPA": (-82.50, 15.50, 60.0),
    "Venezuela EEZ edge": (-66.50, 12.50, 70.0), "Pedro Bank fishery": (-78.20, 17.10, 40.0),
}


def _col(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM, clip: bool = True) -> Column:
    """Great-circle distance; NULL if any input is. clip keeps rounding from leaving asin's domain."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    if clip:  # least() skips NULL, so a NULL must be kept by hand
        a = F.when(a.isNotNull(), F.least(a, F.lit(1.0)))
    return F.lit(2.0 * radius) * F.asin(F.sqrt(a))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360); 0 for coincident points."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(d) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def wrap_deg(d) -> Column:
    """An angle difference in [-180, 180)."""
    return F.pmod(_col(d) + 180.0, F.lit(360.0)) - 180.0


def km_to_deg_lat(km) -> Column:
    return _col(km) / KM_PER_DEG_LAT


def km_to_deg_lon(km, lat) -> Column:
    per = F.cos(F.radians(_col(lat))) * KM_PER_DEG_LON
    return _col(km) / F.when(F.abs(per) < 1e-6, F.lit(1e-6)).otherwise(per)


def clamp(x, lo: float, hi: float) -> Column:
    """x limited to [lo, hi]; NULL stays NULL."""
    x = _col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def port_distance_nm(lat, lon) -> Column:
    """To the nearest port: distances to all ports unrolled, no join."""
    return F.least(*(haversine_km(lat, lon, p[1], p[0]) for p in PORTS.values())) / KM_PER_NM


def zone_distance_nm(lat, lon) -> Column:
    """To the nearest zone's centre."""
    return F.least(*(haversine_km(lat, lon, z[1], z[0]) for z in ZONES.values())) / KM_PER_NM


def inside_zone(lat, lon) -> Column:
    return reduce(lambda a, b: a | b, (haversine_km(lat, lon, z[1], z[0]) <= z[2] for z in ZONES.values()))


def nearest_zone(lat, lon) -> Column:
    """struct(distance_km, zone); the smaller name among equals."""
    return F.array_min(F.array(*(F.struct(haversine_km(lat, lon, z[1], z[0]).alias("distance_km"), F.lit(n).alias("zone")) for n, z in ZONES.items())))
