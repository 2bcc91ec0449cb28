"""Micro fixtures of tracks, whose results are known by hand."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions.geo import KM_PER_NM, haversine_km
from wakeline.operators import evaluate, neighbors, proximity, rules, scaling, stays
from wakeline.operators.features import estimate_contamination, hull_area, interval_of, track_features
from wakeline.operators.kinematics import kinematics, ping_features, rolling_slow
from wakeline.plans.sql import haversine
from wakeline.sources.staging import staged

T0 = datetime(2025, 1, 1)
NM_LAT = KM_PER_NM / (2 * np.pi * 6371.0088 / 360)


def pings(spark, rows):
    """rows: (entity, minutes, lat, lon[, sog])."""
    full = [(e, T0 + timedelta(minutes=m), float(la), float(lo), float(r[0]) if r else 0.0, "fishing", 0, "none") for e, m, la, lo, *r in rows]
    return spark.createDataFrame(full, "entity_id int, timestamp timestamp, lat double, lon double, sog_knots double, vessel_type string, is_anomalous int, anomaly_type string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_single_ping(spark):
    f = one(track_features(pings(spark, [(1, 0, 10, -70)]), 0.25))
    assert f.mean_speed_kt == f.straightness == f.max_gap_h == f.gap_frac == 0 and f.gap_count == 0
    assert f.n_suspicious_speed_pings is None


def test_two_pings_north(spark):
    rows = kinematics(pings(spark, [(1, 0, 10, -70), (1, 60, 10 + 10 * NM_LAT, -70)])).orderBy("timestamp").collect()
    assert rows[0].dt_h is None and rows[1].dt_h == 1
    assert rows[1].speed_kt == pytest.approx(10, rel=1e-6) and rows[1].heading_deg == pytest.approx(0, abs=1e-9) and rows[1].heading_delta is None


def test_heading_wraps(spark):
    def off(deg):
        return 0.01 * np.cos(np.radians(deg)), 0.01 * np.sin(np.radians(deg))

    a, b = off(350), off(10)
    rows = kinematics(pings(spark, [(1, 0, 0, 0), (1, 1, a[0], a[1]), (1, 2, a[0] + b[0], a[1] + b[1])])).orderBy("timestamp").collect()
    assert rows[2].heading_delta == pytest.approx(20, abs=1e-3)


def test_no_time_no_speed(spark):
    rows = [(1, 0, 10, -70), (1, 0, 10.1, -70), (1, 60, 10.2, -70)]
    k = kinematics(pings(spark, rows)).orderBy("timestamp", "lat").collect()
    assert k[1].speed_kt is None and k[1].dist_km > 0
    f = one(track_features(pings(spark, rows), 0.25))
    assert f.straightness == pytest.approx(2.0, rel=1e-3)  # the segment without time is no part of the path


def test_stationary(spark):
    f = one(track_features(pings(spark, [(1, 60 * i, 10, -70) for i in range(5)]), 1.0))
    assert f.straightness == 1 and f.frac_stopped == 1 and f.hull_area_deg2 == 0


def test_hull():
    assert hull_area(np.array([0, 1, 2, 3.0]), np.array([0, 1, 2, 3.0])) == 0
    assert hull_area(np.array([0, 1, 1, 0, 0.5]), np.array([0, 0, 1, 1, 0.5])) == 1


def test_thresholds_are_strict(spark):
    f = one(track_features(pings(spark, [(1, 0, 10, -70), (1, 60, 10, -70), (1, 210, 10, -70)]), 1.0))
    assert f.gap_count == 0  # exactly 2.5 intervals
    f = one(track_features(pings(spark, [(1, 0, 10, -70), (1, 60, 10 + 59.9999 * NM_LAT, -70)]), 1.0))
    assert f.n_suspicious_speed_pings == 0


def near_of(spark, rows):
    df = pings(spark, rows).withColumn("speed_kt", F.lit(0.5))
    return df, proximity.nearest(df)


@pytest.mark.parametrize("steps, episodes", [(12, 1), (11, 0)])
def test_episode_floor(spark, steps, episodes):
    rows = [(e, 5 * i, 10 if i < steps else 10 + e, -70) for i in range(steps + 3) for e in (1, 2)]
    df, near = near_of(spark, rows)
    f = proximity.proximity_features(near, df.select("entity_id").distinct(), 5 / 60).collect()
    assert [r.sustained_close_episodes for r in f] == [episodes] * 2


def test_absence_keeps_an_episode(spark):
    df, near = near_of(spark, [(1, 0, 10, -70), (2, 0, 10, -70), (1, 30, 10, -70), (1, 60, 10, -70), (2, 60, 10, -70)])
    assert near.count() == 4  # a moment with one entity is skipped
    f = {r.entity_id: r for r in proximity.proximity_features(near, df.select("entity_id").distinct(), 0.5).collect()}
    assert f[1].sustained_close_episodes == 1 and f[1].hours_within_1nm == 1.0 and f[1].co_slow_hours == 1.0


def test_alone_is_far(spark):
    df, near = near_of(spark, [(1, 0, 10, -70)])
    f = one(proximity.proximity_features(near, df.select("entity_id").distinct(), 0.5))
    assert f.min_nn_dist_nm == f.mean_nn_dist_nm == 9999 and f.sustained_close_episodes == 0


def test_sweep_equals_join(spark):
    rng = np.random.default_rng(3)
    rows = [(e, m, 10 + rng.normal(0, 0.3), -70 + rng.normal(0, 0.3)) for m in range(6) for e in range(40)] + [(e, 7, 10, -70) for e in range(5)]
    df = pings(spark, rows).withColumn("speed_kt", F.col("lat"))
    key = lambda d: sorted((r.moment, r.entity_id, round(r.nn_dist_nm, 9), r.nn_id, r.nn_speed_kt) for r in d.collect())
    assert key(proximity.nearest(df)) == key(proximity.nearest_by_join(df))


def test_mirror_images_are_told_apart_as_in_sql(spark):
    """Two points as far to the left as to the right, on the grid of the queries: SQL's arithmetic says which is nearer."""
    rng = np.random.default_rng(5)
    rows = []
    for m in range(300):
        y, x, k = 24 + int(rng.integers(-500, 500)) / 4000, -80.5 + int(rng.integers(-400, 400)) / 4000, int(rng.integers(1, 90)) / 4000
        rows += [(1, m, y, x), (2, m, y, x + k), (3, m, y, x - k)]
    rows += [(1, 300, 10.0, -70.0), (9, 300, 10.5, -70.0), (4, 300, 10.5, -70.0)]  # equal to the last bit: the smaller id
    near = proximity.nearest(pings(spark, rows).withColumn("speed_kt", F.when(F.col("entity_id") == 1, 0.5).when(F.col("entity_id") == 3, 2.0).otherwise(0.5)), moments=64)
    got = {r.moment: r.nn_id for r in near.filter("entity_id = 1").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE p (e INT, m INT, y DOUBLE, x DOUBLE)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?, ?)", rows)
    km = haversine("a.y", "a.x", "b.y", "b.x")
    want = {T0 + timedelta(minutes=m): e for m, e in con.sql(f"SELECT a.m, arg_min(b.e, ({km}, b.e)) FROM p a JOIN p b ON a.m = b.m AND a.e = 1 AND b.e <> 1 GROUP BY a.m").fetchall()}
    assert got == want
    # the neighbour's speed decides on hours of two slow ones
    close = near.filter("entity_id = 1").withColumn("nn_dist_nm", F.lit(0.5))
    slow = one(proximity.proximity_features(close, near.filter("entity_id = 1").select("entity_id").distinct(), 1.0)).co_slow_hours
    assert slow == sum(e != 3 for e in want.values())


def test_near_rows_are_found_by_cells():
    """Against all pairs: copies, columns of rare values far off, ids that repeat; such columns part no region."""
    rng = np.random.default_rng(7)
    rows = np.round(rng.normal(size=(1500, 4)), 1)
    rows[:, 3] = np.where(rng.random(1500) < 0.02, 50.0, 0.0)
    rows[1000:1100] = rows[0]
    for ids in (rng.permutation(1500), np.arange(1500) // 3):
        got = neighbors._best(rows, ids, neighbors.Cells(rows, ids, 6), 5, False)
        d = np.sqrt(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2))
        want = []
        for i in range(1500):
            others = np.flatnonzero(ids != ids[i])
            want += [(ids[i], ids[j], d[i, j]) for j in others[np.lexsort((ids[others], d[i, others]))[:5]]]
        assert sorted(got.itertuples(index=False, name=None)) == sorted(want)
    wide = np.vstack([np.c_[rng.normal(size=9000), np.zeros(9000)], [[0.0, 1e6]]])
    assert neighbors.Regions(wide).count > 1


def test_large_reference_is_searched_by_region(spark, monkeypatch):
    """Against all pairs: copies that no cut parts, a small group, a row without group; a query visits few of the regions."""
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 60)
    monkeypatch.setattr(neighbors, "CUT_ROWS", 1000)
    tables = {}
    monkeypatch.setattr(neighbors, "staged", lambda df, name: tables.setdefault(name + "-" * len(tables), staged(df, name)))
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1600, 3)), 2)
    x[:300] = x[0]
    ids, by = rng.permutation(1600), np.where(np.arange(1600) < 1590, "a", "b")
    df = spark.createDataFrame([(int(i), str(b), *map(float, r)) for i, b, r in zip(ids, by, x, strict=True)] + [(1600, None, 0.0, 0.0, 0.0)], "id long, b string, x double, y double, z double")
    got = {}
    for r in neighbors.knn(df, df, ["x", "y", "z"], 4, "b").collect():
        got.setdefault(r.id, []).append((r.dist, r.nn_id))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    for i in range(1600):
        others = np.flatnonzero((by == by[i]) & (ids != ids[i]))
        assert sorted(got.pop(ids[i])) == [(d[i, j], ids[j]) for j in others[np.lexsort((ids[others], d[i, others]))[:4]]]
    assert not got
    first = next(t for name, t in tables.items() if name.startswith("first"))
    # other regions that a query visits, of some 20
    assert first.agg(F.avg(F.size("more"))).head()[0] < 5


def test_stays_of_tracks_in_many_batches(spark):
    """Tracks that end inside a batch, go on over several, or have no entity; the same as each track by itself."""
    rng = np.random.default_rng(3)
    rows = []
    for entity in (None, 1, 2, 3, 4, 5):
        for i in range(int(rng.integers(1, 40))):
            rows.append((entity, 10 * i, 10 + float(rng.choice([0, 0, 0, 0, 0.5])), -70))
    df = pings(spark, rows)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = stays.detect_stays(df).orderBy("entity_id", "timestamp").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(rows) and any(r.is_stay for r in got)
    for entity in {r[0] for r in rows}:
        mine = [r for r in got if r.entity_id == entity]
        lat, minutes = np.array([r.lat for r in mine]), 10.0 * np.arange(len(mine))
        want = stays.window_stays(lat, np.full(len(mine), -70.0), minutes)
        assert [r.stay_id for r in mine] == want.tolist()
        for number in set(want) - {-1}:
            at = np.flatnonzero(want == number)
            assert {mine[i].stay_duration_min for i in at} == {minutes[at[-1]] - minutes[at[0]]}
            assert mine[at[0]].stay_center_lat == pytest.approx(lat[at].mean())


def test_interval_and_contamination(spark):
    rows = [(1, 15 * i, 10, -70) for i in range(5)] + [(2, 30 * i, 10, -70) for i in range(5)] + [(3, 0, 10, -70), (3, 600, 20, -70)]
    df = pings(spark, rows)
    assert interval_of(df) == 0.25  # as frequent as 0.5, and smaller
    assert one(estimate_contamination(df, 0.25)).contamination == 0.15  # a third, limited
    with pytest.raises(ValueError):
        interval_of(pings(spark, [(1, 0, 10, -70)]))


def test_rolling_needs_four(spark):
    r = rolling_slow(pings(spark, [(1, i, 10, -70, 0.5) for i in range(4)])).orderBy("timestamp").collect()
    assert [x.rolling_slow for x in r] == [False, False, False, True]


def test_window_stays():
    lat, lon = np.zeros(7), np.zeros(7)
    assert stays.window_stays(lat, lon, np.array([0, 5, 10, 15, 20, 25, 29.0])).tolist() == [-1] * 7
    assert stays.window_stays(lat, lon, np.array([0, 5, 10, 15, 20, 25, 30.0])).tolist() == [0] * 7
    lat[4:] = 1
    assert stays.window_stays(lat, lon, np.array([0, 10, 20, 30, 40, 50, 70.0])).tolist() == [0] * 4 + [1] * 3


def test_cluster_stays():
    lat = np.array([0.0] * 6 + [1.0] * 3)
    minutes = np.array([0, 30, 60, 121, 151, 181, 200, 230, 260.0])  # 61 minutes of nothing inside the first place
    assert stays.cluster_stays(lat, np.zeros(9), minutes).tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert stays.linked_groups(np.array([0, 5, 5.001]), np.zeros(3)).tolist() == [-1, 0, 0]


def test_detect_stays_columns(spark):
    df = stays.detect_stays(pings(spark, [(1, 10 * i, 10, -70) for i in range(4)] + [(2, 0, 0, 0)]))
    rows = {(r.entity_id, r.timestamp): r for r in df.collect()}
    assert rows[1, T0].stay_duration_min == 30 and rows[2, T0].stay_id == -1 and rows[2, T0].stay_center_lat is None
    assert one(stays.stay_summary(df)).n_pings == 4


def test_rules_differ_by_preset(spark):
    rows = [(1, 0, 10, -70, 1), (1, 10, 10.9, -70, 25), (1, 30, 10, -70, 1), (1, 95, 10, -70, 1)]
    f = ping_features(pings(spark, rows))
    at = lambda p: rules.apply_rules(f, p).orderBy("timestamp").collect()
    assert [r.rule_dark_ship for r in at("iforest")] == [False, False, False, True]
    assert at("iforest")[2].rule_aggression and at("knn")[2].rule_aggression  # 24 knots and 180 degrees
    assert at("staypoint")[2].rule_impossible_speed is False


def test_auroc_and_ap_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "ensemble_score double, true_anomalous int")
    assert one(evaluate.auroc(df)).auroc == pytest.approx(0.875)
    assert one(evaluate.average_precision(df)).average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)
    none = df.withColumn("true_anomalous", F.lit(0))
    assert one(evaluate.auroc(none)).auroc is None and one(evaluate.average_precision(none)).average_precision is None
    assert evaluate.evaluate(df.drop("true_anomalous")) is None


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(4)], "id long, x double")
    for scaled in (scaling.robust_scale(df, ["x"]), scaling.standard_scale(df, ["x"])):
        assert [r.x for r in scaled.collect()] == [0.0] * 4


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, nn, 1)[:, -1]
    lrd = 1 / (np.maximum(kd[nn], np.take_along_axis(d, nn, 1)).mean(1) + 1e-10)
    return lrd[nn].mean(1) / lrd


@pytest.mark.parametrize("limit", [1 << 26, 1])
def test_lof_blocks_and_few_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    x = np.random.default_rng(1).normal(size=(60, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = {r.id: r.lof for r in neighbors.lof(df, ["a", "b", "c"], 5).collect()}
    assert [got[i] for i in range(60)] == pytest.approx(brute_lof(x, 5).tolist())
    turned = df.withColumn("a", -F.col("a"))
    assert {r.id: r.lof for r in neighbors.lof(turned, ["a", "b", "c"], 5).collect()} == pytest.approx(got)
    few = {r.id: r.lof for r in neighbors.lof(df.filter("id < 4"), ["a", "b", "c"], 20).collect()}
    assert [few[i] for i in range(4)] == pytest.approx(brute_lof(x[:4], 3).tolist())


def test_haversine_keeps_null_and_is_symmetric(spark):
    r = spark.range(1).select(haversine_km(1.0, 2.0, 3.0, 4.0).alias("a"), haversine_km(3.0, 4.0, 1.0, 2.0).alias("b"), haversine_km(F.lit(None).cast("double"), 2.0, 3.0, 4.0).alias("n")).head()
    assert r.a == pytest.approx(r.b) and r.n is None
