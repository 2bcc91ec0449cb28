"""Rules on single pings, in three presets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_NM
from .kinematics import rolling_slow

# Fixed values that all presets share.
DARK_MIN, JUMP_KM, JUMP_KT, FISHING_KT, OFFSHORE_KM = 60.0, 50.0, 60.0, 2.0, 20.0


@dataclass(frozen=True)
class Preset:
    both_jump: bool  # spoofing needs distance and speed, not one of them
    turn_kt: float
    turn_deg: float
    fishing_type: bool
    fishing_least_kt: float | None
    any_of: tuple[str, ...]
    impossible_kt: float | None = None
    rolling: bool = False


# Fixed values of the presets.
PRESETS = {
    "iforest": Preset(False, 15.0, 120.0, True, None, ("dark_ship", "spoofing", "aggression", "illegal_fish")),
    "knn": Preset(True, 20.0, 150.0, True, 0.5, ("dark_ship", "spoofing", "aggression", "illegal_fish")),
    "staypoint": Preset(False, 15.0, 120.0, False, None, ("impossible_speed", "aggression", "transshipment", "illegal_fish"), 40.0, True),
}


def _sure(c: Column) -> Column:
    """NULL says no."""
    return F.coalesce(c, F.lit(False))


def apply_rules(features: DataFrame, preset: str) -> DataFrame:
    """Ping features with implied_speed_knots, a flag rule_<name> for each rule of the preset, and any_rule_flag."""
    p = PRESETS[preset]
    df = rolling_slow(features) if p.rolling else features
    hours = F.col("time_gap_min") / 60.0
    speed = F.when(F.col("time_gap_min") > 0, F.col("dist_from_prev_km") / KM_PER_NM / hours).otherwise(0.0)
    df = df.withColumn("implied_speed_knots", speed)
    far, fast = F.col("dist_from_prev_km") > JUMP_KM, F.col("implied_speed_knots") > JUMP_KT
    fishing = (F.col("sog_knots") < FISHING_KT) & (F.col("dist_from_median_km") > OFFSHORE_KM)
    if p.fishing_type:
        fishing = fishing & (F.col("vessel_type") == "fishing")
    if p.fishing_least_kt is not None:
        fishing = fishing & (F.col("sog_knots") > p.fishing_least_kt)
    rules = {
        "dark_ship": F.col("time_gap_min") > DARK_MIN, "spoofing": far & fast if p.both_jump else far | fast,
        "aggression": (F.abs("speed_delta") > p.turn_kt) & (F.abs("bearing_delta") > p.turn_deg), "illegal_fish": fishing,
    }
    if p.impossible_kt is not None:
        rules["impossible_speed"] = F.col("sog_knots") > p.impossible_kt
    if p.rolling:
        rules["transshipment"] = F.col("rolling_slow")
    df = df.withColumns({f"rule_{n}": _sure(c) for n, c in rules.items()})
    if p.rolling:
        df = df.drop("rolling_slow")
    return df.withColumn("any_rule_flag", reduce(lambda a, b: a | b, (F.col(f"rule_{n}") for n in p.any_of)))


def combine(df: DataFrame, flag: Column) -> DataFrame:
    """df with pred_anomalous: the flag or any rule."""
    return df.withColumn("pred_anomalous", (_sure(flag) | F.col("any_rule_flag")).cast("int"))
