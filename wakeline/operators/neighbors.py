"""Exact nearest neighbours in feature space, and the detectors that rest on them.

Reference rows are cut into cells of near rows, and cells whose box is farther than the best k are not looked at. A reference of
at most BROADCAST_BYTES is sent to all tasks; its queries are shuffled by region, so that those of a search are near each other.
A larger one is cut into regions of about REGION_ROWS rows, each with the box of its rows. Queries search their own region first,
then those others whose box is not farther than their k-th best so far; a grouped step keeps the best k of all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: A reference up to so large is broadcast; beyond it, reference rows of a region, queries of one search in it, rows that its cuts are made from.
BROADCAST_BYTES, BLOCK_ROWS, CUT_ROWS = 64 << 20, 50_000, 1 << 17
#: Reference rows of a cell, queries that search together, cells that they visit at first and at most at once, reference rows of a region.
CELL, QUERIES, FIRST, MOST, REGION = 32, 32, 16, 512, 4096
_EDGES = "id long, nn_id long, dist double"


class Cells:
    """Reference rows in cells of CELL neighbouring rows, cut at medians; a short cell is filled with NaN.

    Of equal rows only the `most` smallest ids are kept, as a search for `most` rows can't return more of them.
    """

    def __init__(self, ref: np.ndarray, rid: np.ndarray, most: int):
        order = np.lexsort((rid, *ref.T))
        ref, rid = ref[order], rid[order]
        same = np.concatenate([[False], (ref[1:] == ref[:-1]).all(axis=1)]) if len(ref) else np.zeros(0, bool)
        at = np.arange(len(ref))
        if len(np.unique(rid)) == len(rid):
            kept = at - np.maximum.accumulate(np.where(same, 0, at)) < most
        else:  # rows that share an id may all be the query's own
            kept = np.ones(len(at), bool)
        ref, rid = ref[kept], rid[kept]
        cut = list(_cuts(ref, CELL))
        self.rows = np.full((len(cut), CELL, ref.shape[1]), np.nan)
        self.ids = np.full((len(cut), CELL), -1, rid.dtype if len(rid) else np.int64)
        for i, some in enumerate(cut):
            self.rows[i, : len(some)], self.ids[i, : len(some)] = ref[some], rid[some]
        self.lo, self.hi = (np.array([f(ref[some], axis=0) for some in cut]).reshape(len(cut), ref.shape[1]) for f in (np.min, np.max))


def _widest(rows: np.ndarray) -> int:
    """The column with the widest middle of some rows; rare values far off would make cuts that part nothing. Else the widest."""
    some = np.sort(rows[:: max(1, len(rows) // 256)], axis=0)
    middle = some[len(some) * 9 // 10] - some[len(some) // 10]
    return int(np.argmax(middle if middle.any() else rows.max(axis=0) - rows.min(axis=0)))


def _cuts(rows: np.ndarray, size: int):
    """Places of the rows, in pieces of size of neighbouring rows; one may be shorter."""
    left = [np.arange(len(rows))] if len(rows) else []
    while left:
        at = left.pop()
        if len(at) <= size:
            yield at
            continue
        values = rows[at]
        column = values[:, _widest(values)]
        half = size * max(1, len(at) // size // 2)
        order = np.argpartition(column, half - 1)
        left += [at[order[:half]], at[order[half:]]]


def _search(q: np.ndarray, qid: np.ndarray, cells: Cells, k: int, self_too: bool, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, id and distance of its k nearest reference rows, nearest first, ties to the smaller id; those farther than within may be left out.

    Neighbouring queries visit cells from near to far until the next cell's box is farther than the k-th best of all of them.
    A matrix product finds which rows may be near enough, with room for its rounding; the distances of these are made in full.
    """
    parts = []
    width = q.shape[1]
    for some in _cuts(q, QUERIES):
        own, ids = q[some], qid[some]
        lo, hi = own.min(axis=0), own.max(axis=0)
        away = (np.maximum(0.0, np.maximum(cells.lo - hi, lo - cells.hi)) ** 2).sum(axis=1)
        order = np.argsort(away)
        away = away[order]
        centre = (lo + hi) / 2
        mine = own - centre
        squares = (mine**2).sum(axis=1)
        limit = np.full(len(own), np.inf) if within is None else within[some]
        left = np.column_stack([-2.0 * mine, squares, np.ones(len(own))])
        row, nn, dist = np.zeros(0, np.int64), np.zeros(0, cells.ids.dtype), np.zeros(0)
        at, take = 0, FIRST
        while at < len(order):
            far = np.searchsorted(away, limit.max() ** 2 * (1 + 1e-9), side="right")
            end = min(at + take, far)
            if end <= at:
                break
            there, tid = cells.rows[order[at:end]].reshape(-1, width), cells.ids[order[at:end]].ravel()
            right = np.ones((len(there), width + 2))
            moved = np.subtract(there, centre, out=right[:, :width])
            theirs = right[:, -1] = np.einsum("ij,ij->i", moved, moved)
            d = left @ right.T
            slack = 1e-13 * (squares + np.nanmax(theirs))
            if at == 0 and d.shape[1] > k:  # a first limit
                first = np.where(np.isnan(d) | ((ids[:, None] == tid[None, :]) & (not self_too)), np.inf, d)
                limit = np.minimum(limit, np.sqrt(np.maximum(0.0, np.partition(first, k - 1, axis=1)[:, k - 1] + slack)))
            r, c = np.divmod(np.flatnonzero(d <= (limit**2 * (1 + 1e-9) + slack)[:, None]), d.shape[1])
            if not self_too:
                other = ids[r] != tid[c]
                r, c = r[other], c[other]
            at, take = end, min(MOST, take * 4)
            if not len(r):
                continue
            row, nn = np.concatenate([row, r]), np.concatenate([nn, tid[c]])
            dist = np.concatenate([dist, np.sqrt(((own[r] - there[c]) ** 2).sum(axis=1))])
            # in order of distance and id, the k best of each
            by = np.lexsort((nn, dist, row))
            rank = np.arange(len(by)) - np.searchsorted(row[by], row[by])
            by = by[rank < k]
            row, nn, dist, rank = row[by], nn[by], dist[by], rank[rank < k]
            last = rank == k - 1
            limit[row[last]] = np.minimum(limit[row[last]], dist[last])
        parts.append((some[row], nn, dist))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _best(q: np.ndarray, qid: np.ndarray, cells: Cells, k: int, self_too: bool, within: np.ndarray | None = None) -> pd.DataFrame:
    row, nn, dist = _search(q, qid, cells, k, self_too, within)
    return pd.DataFrame({"id": np.asarray(qid, np.int64)[row], "nn_id": np.asarray(nn, np.int64), "dist": dist})


class Regions:
    """Space cut at medians of the reference into regions of `most` rows or fewer, to bring rows together that are near each other."""

    def __init__(self, ref: np.ndarray, most: int = REGION):
        self.count, self.most = 0, most
        self.root = self._cut(ref)

    def _cut(self, rows: np.ndarray):
        if len(rows) > self.most:
            column = _widest(rows)
            value = float(np.median(rows[:, column]))
            below = rows[:, column] < value
            if not below.any():
                value = np.nextafter(value, np.inf)
                below = rows[:, column] < value
            if below.any() and not below.all():
                return column, value, self._cut(rows[below]), self._cut(rows[~below])
        self.count += 1
        return self.count - 1

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        left = [(self.root, np.arange(len(rows)))]
        while left:
            node, at = left.pop()
            if isinstance(node, int):
                out[at] = node
            else:
                below = rows[at, node[0]] < node[1]
                left += [(node[2], at[below]), (node[3], at[~below])]
        return out


def knn(queries: DataFrame, reference: DataFrame, columns: list[str], k: int, by: str | None = None, id_col: str = "id", self_too: bool = False) -> DataFrame:
    """id, nn_id, dist: the k nearest reference rows of each query row, of the same value of by; never the row itself, unless self_too.

    Euclidean distance; ties go to the smaller id. Missing values must be filled before.
    """
    key = F.col(by).cast("string") if by else F.lit("")
    q = queries.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), *columns)
    r = reference.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), *columns)
    n = r.count()
    if n * 8 * (len(columns) + 2) <= BROADCAST_BYTES:
        table = r.toPandas()  # bounded by the check above
        held = queries.sparkSession.sparkContext.broadcast({name: Cells(at[columns].to_numpy(float), at["id"].to_numpy(), k + 1) for name, at in table.groupby("key")})

        areas = {name: Regions(at[columns].to_numpy(float)) for name, at in table.groupby("key")}

        def placed(batches):
            for pdf in batches:
                for name, at in pdf.groupby("key"):
                    if name in areas:
                        yield at.assign(region=areas[name].of(at[columns].to_numpy(float)))

        def run(key: tuple, at: pd.DataFrame) -> pd.DataFrame:
            return _best(at[columns].to_numpy(float), at["id"].to_numpy(), held.value[key[0]], k, self_too)

        spark = queries.sparkSession
        tasks = max(1, min(sum(a.count for a in areas.values()), 8 * spark.sparkContext.defaultParallelism))
        kinds = ", ".join(f"`{c}` {q.schema[c].dataType.simpleString()}" for c in q.columns)
        return q.mapInPandas(placed, f"{kinds}, region long").repartition(tasks, "key", "region").groupBy("key", "region").applyInPandas(run, _EDGES)

    # a null key equals no other, as in a join
    r = r.filter("key is not null")
    q = r if queries is reference else q.filter("key is not null")
    return _by_region(q, r, n, columns, k, self_too)


def _by_region(q: DataFrame, r: DataFrame, n: int, columns: list[str], k: int, self_too: bool) -> DataFrame:
    """knn of a reference of n rows that is too large to be broadcast. Where regions are cut is found on CUT_ROWS rows or so; every row is in one."""
    spark = q.sparkSession
    share = min(1.0, CUT_ROWS / n)
    table = r.sample(False, share, 1).toPandas() if share < 1 else r.toPandas()  # bounded by CUT_ROWS
    areas = {name: Regions(at[columns].to_numpy(float), max(1, int(BLOCK_ROWS * share))) for name, at in table.groupby("key")}
    kinds = ", ".join(f"`{c}` {q.schema[c].dataType.simpleString()}" for c in q.columns)

    def placed(batches):
        for pdf in batches:
            for name, at in pdf.groupby("key"):
                rows = at[columns].to_numpy(float)
                yield at.assign(region=areas[name].of(rows) if name in areas else np.zeros(len(at), np.int64))

    def place(df: DataFrame) -> DataFrame:
        return staged(df.mapInPandas(placed, f"{kinds}, region long"), "regions")

    same = q is r
    r = place(r)
    q = r.select(*(F.col(c).alias(c) for c in r.columns)) if same else place(q)  # names of its own, as it meets r
    at = ["key", "region"]
    ends = [f(c).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("lo", F.min), ("hi", F.max))]
    found = r.groupBy(*at).agg(F.count("*").alias("rows"), *ends).toPandas()  # a row for each region
    boxes = {name: tuple(some[[f"{end}{i}" for i in range(len(columns))]].to_numpy(float) for end in ("lo", "hi")) + (some["region"].to_numpy(),) for name, some in found.groupby("key")}
    if (found["rows"] > 4 * BLOCK_ROWS).any():  # equal rows are not cut; a search returns of them the smallest ids
        crowded = F.broadcast(spark.createDataFrame(found.loc[found["rows"] > 4 * BLOCK_ROWS, at]))
        first = Window.partitionBy(*at, *columns).orderBy("id")
        few = r.join(crowded, at, "left_semi").withColumn("_rank", F.dense_rank().over(first)).filter(F.col("_rank") <= k + 1).drop("_rank")
        r = staged(r.join(crowded, at, "left_anti").unionByName(few.select(*r.columns)), "regions")

    def met(asked: DataFrame, run, schema: str) -> DataFrame:
        """run on queries and the reference rows of each region, BLOCK_ROWS queries or so at a time."""
        parts = F.broadcast(staged(asked.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts")), "parts"))
        here = asked.join(parts, at).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
        there = r.join(parts, at).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        tasks = max(1, min(parts.agg(F.sum("parts")).head()[0] or 1, 64 * spark.sparkContext.defaultParallelism))
        by = [*at, "part"]
        return here.repartition(tasks, *by).groupBy(*by).cogroup(there.repartition(tasks, *by).groupBy(*by)).applyInPandas(run, schema)

    def own(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """For each query its best, how far they reach, and the other regions that may hold better ones."""
        rows, qid = a[columns].to_numpy(float), a["id"].to_numpy()
        row, nn, dist = _search(rows, qid, Cells(b[columns].to_numpy(float), b["id"].to_numpy(), k + 1), k, self_too)
        order = np.argsort(row, kind="stable")
        row, nn, dist = row[order], nn[order], dist[order]
        begin, end = np.searchsorted(row, np.arange(len(a))), np.searchsorted(row, np.arange(len(a)), side="right")
        within = np.full(len(a), np.inf)
        full = end - begin == k
        within[full] = dist[end[full] - 1]
        lo, hi, regions = boxes.get(key[0], (np.zeros((0, len(columns))), np.zeros((0, len(columns))), np.zeros(0, np.int64)))
        more = [[] for _ in range(len(a))]
        for some in _cuts(rows, 256):
            mine = rows[some]
            between = (np.maximum(0.0, np.maximum(lo - mine.max(axis=0), mine.min(axis=0) - hi)) ** 2).sum(axis=1)
            for box in np.flatnonzero((regions != key[1]) & (between <= within[some].max() ** 2 * (1 + 1e-9))):
                away = (np.maximum(0.0, np.maximum(lo[box] - mine, mine - hi[box])) ** 2).sum(axis=1)
                for i in some[away <= within[some] ** 2 * (1 + 1e-9)]:
                    more[i].append(regions[box])
        return a[["id", "key", *columns]].assign(within=within, more=more, nn=[nn[i:j] for i, j in zip(begin, end, strict=True)], dist=[dist[i:j] for i, j in zip(begin, end, strict=True)])

    def others(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "nn": pd.Series([], dtype=object), "dist": pd.Series([], dtype=object)})
        qid = a["id"].to_numpy()
        row, nn, dist = _search(a[columns].to_numpy(float), qid, Cells(b[columns].to_numpy(float), b["id"].to_numpy(), k + 1), k, self_too, a["within"].to_numpy(float))
        order = np.argsort(row, kind="stable")
        row, nn, dist = row[order], nn[order], dist[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        return pd.DataFrame({"id": qid[row[first]], "nn": np.split(nn, first[1:]) if len(row) else [], "dist": np.split(dist, first[1:]) if len(row) else []})

    found_first = staged(met(q, own, f"{kinds}, within double, more array<long>, nn array<long>, dist array<double>"), "first")
    further = met(found_first.select("id", "key", *columns, "within", F.explode("more").alias("region")), others, "id long, nn array<long>, dist array<double>")
    each = found_first.select("id", "nn", "dist").unionByName(further).select("id", F.arrays_zip("dist", "nn").alias("some"))
    best = each.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, k).alias("best"))
    return best.select("id", F.explode("best").alias("x")).select("id", F.col("x.nn").alias("nn_id"), "x.dist")


def knn_outlier(df: DataFrame, columns: list[str], k: int = 10, by: str | None = None, id_col: str = "id", least: int = 0) -> DataFrame:
    """id, knn_outlier_score: the mean distance to the k nearest others, in the row's group; groups of under `least` rows use all rows."""
    if by is None or not least:
        edges = knn(df, df, columns, k, by, id_col)
    else:
        size = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
        sized = staged(df.join(F.broadcast(size), F.col(by).eqNullSafe(F.col("_by"))).drop("_by"), "sized")
        own, rest = sized.filter(F.col("_n") >= least), sized.filter(F.col("_n") < least)
        edges = knn(own, own, columns, k, by, id_col)
        if rest.limit(1).count():
            edges = edges.unionByName(knn(rest, sized, columns, k, None, id_col))
    return edges.groupBy("id").agg(F.avg("dist").alias("knn_outlier_score"))


def lof(df: DataFrame, columns: list[str], k: int = 20, id_col: str = "id") -> DataFrame:
    """id, lof: the local outlier factor, from k (at most n - 1) exact neighbours. A row without others has 1."""
    n = df.count()
    if n < 2:
        return df.select(F.col(id_col).cast("long").alias("id"), F.lit(1.0).alias("lof"))
    edges = staged(knn(df, df, columns, min(k, n - 1), None, id_col), "neighbours")
    reach = edges.groupBy("id").agg(F.max("dist").alias("k_dist"))
    density = (
        edges.join(reach.select(F.col("id").alias("nn_id"), "k_dist"), "nn_id")
        .groupBy("id").agg((1.0 / (F.avg(F.greatest("k_dist", "dist")) + 1e-10)).alias("lrd"))
    )
    near = edges.join(density.select(F.col("id").alias("nn_id"), F.col("lrd").alias("nn_lrd")), "nn_id").groupBy("id").agg(F.avg("nn_lrd").alias("nn_lrd"))
    return near.join(density, "id").select("id", (F.col("nn_lrd") / F.col("lrd")).alias("lof"))
