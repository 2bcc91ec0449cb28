"""Scalers with exact statistics: one aggregation, then arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What keeps min-max scaling from dividing by zero.
TINY = 1e-12


def _one(df: DataFrame, aggs: dict[str, Column], by: str | None) -> DataFrame:
    """Statistics joined to every row: one row for all (its size is known, so it is broadcast), or one for each value of by."""
    named = [c.alias(n) for n, c in aggs.items()]
    if by is None:
        return df.crossJoin(F.broadcast(df.agg(*named)))
    stats = df.groupBy(by).agg(*named)
    return df.join(stats, by)


def robust_scale(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(x - median) / (p75 - p25); an empty range divides by 1."""
    aggs = {}
    for c in columns:
        for name, q in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75)):
            aggs[f"_{name}_{c}"] = F.percentile(c, q)
    out = _one(df, aggs, by)
    for c in columns:
        spread = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c, (F.col(c) - F.col(f"_mid_{c}")) / F.when(spread == 0, 1.0).otherwise(spread))
    return out.select(*df.columns)


def standard_scale(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(x - mean) / population deviation, NULL counting as 0; no deviation divides by 1."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    aggs = {f"_m_{c}": F.avg(c) for c in columns} | {f"_s_{c}": F.stddev_pop(c) for c in columns}
    out = _one(filled, aggs, by)
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")))
    return out.select(*df.columns)


def min_max(df: DataFrame, column: str, to: str) -> DataFrame:
    out = _one(df, {"_lo": F.min(column), "_hi": F.max(column)}, None)
    return out.withColumn(to, (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + TINY)).drop("_lo", "_hi")
