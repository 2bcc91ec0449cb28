"""Isolation Forest (Liu, Ting and Zhou, 2008).

Trees are grown on the driver from a bounded uniform pool of rows (SUBSAMPLE rows for each tree at most), each from its own
seeded generator; scoring is a vectorised pass of all rows over the broadcast trees. Draws don't equal any library's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

SUBSAMPLE, TREES = 256, 200


def mean_path(n) -> np.ndarray:
    """The mean length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    big = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Nodes of all trees: feature (-1 in a leaf), cut, children, and a leaf's path length."""

    columns: list[str]
    feature: list[np.ndarray]
    cut: list[np.ndarray]
    child: list[np.ndarray]
    depth: list[np.ndarray]
    norm: float
    offset: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / norm), higher for outliers."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, child, depth in zip(self.feature, self.cut, self.child, self.depth, strict=True):
            at = np.zeros(len(x), np.int64)
            inner = feature[at] >= 0
            while inner.any():
                r, node = rows[inner], at[inner]
                at[inner] = child[node, (x[r, feature[node]] >= cut[node]).astype(np.int64)]
                inner = feature[at] >= 0
            total += depth[at]
        return np.exp2(-total / len(self.feature) / self.norm) if self.norm > 0 else np.full(len(x), 0.5)


def _grow(x: np.ndarray, rng: np.random.Generator):
    feature, cut, child, depth = [], [], [], []
    limit = math.ceil(math.log2(max(len(x), 2)))
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, level, parent, side = todo.pop()
        me = len(feature)
        if parent >= 0:
            child[parent][side] = me
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        child.append([0, 0])
        if level >= limit or len(rows) < 2 or not len(usable):
            feature.append(-1), cut.append(0.0), depth.append(level + float(mean_path(len(rows))))
            continue
        f = int(rng.choice(usable))
        c = float(rng.uniform(lo[f], hi[f]))
        right = x[rows, f] >= c
        if right.all() or not right.any():  # a cut on the edge of the range
            c = float(hi[f])
            right = x[rows, f] >= c
        feature.append(f), cut.append(c), depth.append(0.0)
        todo += [(rows[~right], level + 1, me, 0), (rows[right], level + 1, me, 1)]
    return np.array(feature), np.array(cut), np.array(child), np.array(depth)


def fit(df: DataFrame, columns: list[str], id_col: str, trees: int = TREES, seed: int = 0, contamination: float | None = None) -> Forest:
    """Grow a forest. With a contamination, its offset is that quantile of the (negative) scores: below it is an outlier."""
    rows = df.select(F.col(id_col).alias("_id"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    pool = rows.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(SUBSAMPLE * trees).toPandas().sort_values("_id")
    x = pool[columns].to_numpy(float)
    if not len(x):
        raise ValueError("no rows to grow a forest from")
    size = min(SUBSAMPLE, len(x))
    grown = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        grown.append(_grow(x[rng.choice(len(x), size, replace=False)], rng))
    forest = Forest(columns, *map(list, zip(*grown, strict=True)), norm=float(mean_path(size)))
    if contamination is not None:
        scored = score(rows, forest, "_s")
        forest.offset = scored.agg(F.percentile(-F.col("_s"), contamination)).head()[0]
    return forest


def score(df: DataFrame, forest: Forest, to: str) -> DataFrame:
    """df with the anomaly score in column `to`, higher for outliers; NULL inputs count as 0."""
    held = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(np.column_stack([c.to_numpy(float) for c in columns])))

    return df.withColumn(to, run(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in forest.columns)))


def score_by_type(df: DataFrame, columns: list[str], by: str, id_col: str, least: int = 50, trees: int = TREES, seed: int = 42, contamination: float = 0.02) -> DataFrame:
    """df with if_score (lower for outliers) and if_anomalous, from a forest for each type of at least `least` rows, or one of all rows.

    Types are few; rows without a type have no score and are no outliers.
    """
    rows = staged(df.select(id_col, by, *columns), "forest-rows")  # read once for each model, made once
    sizes = rows.filter(F.col(by).isNotNull()).groupBy(by).count().collect()
    everyone = fit(rows, columns, id_col, trees, seed, contamination)
    models = {r[by]: fit(rows.filter(F.col(by) == r[by]), columns, id_col, trees, seed, contamination) if r["count"] >= least else everyone for r in sizes}
    held = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("score double, outlier boolean")
    def run(kind: pd.Series, *cols: pd.Series) -> pd.DataFrame:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        out, flag = np.full(len(kind), np.nan), np.zeros(len(kind), bool)
        for name, at in kind.groupby(kind).groups.items():
            at = np.asarray(at)
            model = held.value[name]
            out[at] = -model.score(x[at])
            flag[at] = out[at] < model.offset
        return pd.DataFrame({"score": pd.Series(out).where(~np.isnan(out), None).astype(float), "outlier": flag})

    made = df.withColumn("_if", run(F.col(by), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)))
    value = F.when(~F.isnan("_if.score"), F.col("_if.score"))
    return made.withColumn("if_score", value).withColumn("if_anomalous", F.col("_if.outlier")).drop("_if")
