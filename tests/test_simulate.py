"""The simulator, and the whole detector on what it makes."""

import argparse
import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline import cli
from wakeline.operators import evaluate
from wakeline.operators.detectors import detect
from wakeline.operators.simulate import Config, episodes, labelled, plan, simulate
from wakeline.plans.pipeline import build_feature_matrix
from wakeline.sources import sinks
from wakeline.sources.pings import load_summary, read_csv


@pytest.mark.parametrize("entities, rate, count", [(1000, 0.05, 48), (50_000, 0.02, 950)])
def test_planned_counts(entities, rate, count):
    assert labelled(plan(Config(num_entities=entities, anomaly_rate=rate))) == count


@pytest.mark.parametrize("bad", [{"num_entities": 0}, {"duration_days": 0}, {"report_interval_minutes": 0}, {"anomaly_rate": 1.5}, {"duration_days": 0.001}, {"output_format": "xml"}, {"anomaly_weights": {"dark_activity": 0.0}}, {"anomaly_weights": {"piracy": 1.0}}])
def test_validation(bad):
    with pytest.raises(ValueError):
        dataclasses.replace(Config(), **bad).validate()


SMALL = Config(num_entities=150, duration_days=4.0, report_interval_minutes=30.0, anomaly_rate=0.1, include_vessel_type=True, include_speed=True)


def test_same_for_any_partitioning(spark):
    df = simulate(spark, SMALL)
    assert df.orderBy("entity_id", "timestamp").collect() == simulate(spark, SMALL).repartition(7).orderBy("entity_id", "timestamp").collect()
    assert df.filter("lat is null or lon is null or sog_knots is null").count() == 0
    assert df.filter("is_anomalous = 1").select("entity_id").distinct().count() == labelled(plan(SMALL))


def test_detects_what_was_planted(spark):
    df = simulate(spark, SMALL).persist()
    features, interval, rate = build_feature_matrix(df)
    assert interval == 0.5 and 0.005 <= rate <= 0.15
    found = detect(features.persist(), trees=40).persist()
    m = evaluate.evaluate(found).head()
    assert m.n_contacts == 150 and m.auroc > 0.9 and m.recall > 0.6
    assert evaluate.per_type_breakdown(found).count() >= 4


def test_files(spark, tmp_path):
    df = simulate(spark, dataclasses.replace(SMALL, num_entities=20))
    sinks.write_pings_csv(df, f"{tmp_path}/p.csv")
    back = read_csv(spark, f"{tmp_path}/p.csv")
    assert load_summary(back).head().n_rows == df.count()
    assert "is_anomalous" not in read_csv(spark, f"{tmp_path}/p.csv", labels=False).columns
    sinks.write_trips(df, f"{tmp_path}/t.geojson")
    trips = spark.read.json(f"{tmp_path}/t.geojson")
    assert trips.filter(F.size("geometry.coordinates") < 2).count() == 0
    assert sinks.both_paths("a/x.geojson") == ("a/x.csv", "a/x.geojson")


def test_segments_share_a_vertex(spark):
    rows = [(1, f"2025-01-01 0{i}:00:00", 10.0 + i, -70.0, 1.0 + i, "none" if i < 2 else "dark_activity") for i in range(4)]
    df = spark.createDataFrame(rows, "entity_id int, t string, lat double, lon double, sog_knots double, anomaly_type string").withColumn("timestamp", F.to_timestamp("t"))
    s = sinks.trip_segments(df).orderBy("segment").collect()
    assert [(x.n_vertices, x.sog_knots_mean) for x in s] == [(3, 1.5), (2, 3.5)]
    assert s[0].coordinates[-1] == s[1].coordinates[0]


def test_command_line(spark, tmp_path, capsys):
    cli.run_simulate(spark, cli.parser().parse_args(["simulate", "--entities", "40", "--days", "2", "--interval", "30", "--anomaly-rate", "0.2", "--format", "both", "--speed", "--vessel-type", "--weight", "dark_activity=1", "--output", f"{tmp_path}/x.csv"]))
    cli.run_detect(spark, cli.parser().parse_args(["detect", f"{tmp_path}/x.csv", "--cache-features", f"{tmp_path}/f", "--output", f"{tmp_path}/out"]))
    assert "DETECTION RESULTS" in capsys.readouterr().out
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 40
    with pytest.raises(argparse.ArgumentTypeError):
        cli.weight("piracy=1")


@pytest.mark.parametrize("many, hours", [((1, 2), (1, 4)), ((5, 9), (3, 30)), ((2, 2), (90, 120)), ((1, 1), (500, 900))])
def test_episodes_lie_apart(many, hours):
    cfg = dataclasses.replace(SMALL, episodes_per_entity=many, episode_hours=dict.fromkeys(Config().episode_hours, hours))
    for seed in range(200):
        found = episodes(np.random.default_rng(seed), cfg, "dark_activity")
        assert 1 <= len(found) <= many[1] and found[0][0] >= 0 and found[-1][1] <= cfg.n_steps
        assert all(e - b >= 2 or cfg.n_steps <= 3 for b, e in found) and all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))


def test_units_share_no_entity():
    for seed in range(3):
        units = plan(dataclasses.replace(SMALL, num_entities=3000, seed=seed))
        every = [e for u in units for e in u.entities]
        assert len(every) == len(set(every)) and {len(u.entities) for u in units} == {1, 2}
    assert plan(SMALL) != plan(dataclasses.replace(SMALL, seed=7))
