import pytest

from wakeline.operators.kinematics import kinematics
from wakeline.streaming.kinematics import streaming_kinematics


def test_stream_continues_tracks(spark, tmp_path):
    rows = [(e, f"2025-01-01 0{h}:{10 * e:02d}:00", 10.0 + 0.1 * h * e, -70.0 + 0.05 * h * h) for h in range(6) for e in (1, 2)]
    df = spark.createDataFrame(rows, "entity_id long, t string, lat double, lon double").selectExpr("entity_id", "cast(t as timestamp) as timestamp", "lat", "lon")
    for i, part in enumerate(("timestamp < '2025-01-01 02:00'", "timestamp >= '2025-01-01 02:00' and timestamp < '2025-01-01 04:00'", "timestamp >= '2025-01-01 04:00'")):
        df.filter(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = streaming_kinematics(stream).writeStream.format("memory").queryName("kin").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = ["entity_id", "timestamp"]
    got = spark.table("kin").orderBy(key).collect()
    want = kinematics(df).orderBy(key).collect()
    assert len(got) == len(want) == 12
    for g, w in zip(got, want, strict=True):
        for c in ("dt_h", "dist_km", "speed_kt", "heading_deg", "heading_delta"):
            a, b = g[c], w[c]
            assert (b is None and (a is None or a != a)) or a == pytest.approx(b, abs=1e-9), c


def test_stream_keeps_pings_of_equal_times(spark, tmp_path):
    times = ["00:00:00.2", "00:00:00.2", "00:10:00.1", "00:10:00.4", "00:10:00.4", "00:10:00.9", "00:20:00"]
    rows = [(i // 4, f"2025-01-01 {t}", 10.0 + 0.1 * i, -70.0 + 0.05 * i * i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "part int, t string, lat double, lon double").selectExpr("part", "1L as entity_id", "cast(t as timestamp) as timestamp", "lat", "lon")
    for i in (0, 1):
        df.filter(f"part = {i}").drop("part").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = streaming_kinematics(stream).writeStream.format("memory").queryName("kin_equal").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("kin_equal").orderBy("timestamp", "lat").collect()
    want = kinematics(df.selectExpr("*", "lat as event_id")).orderBy("timestamp", "lat").collect()
    assert len(got) == len(times) and [g.lat for g in got] == [w.lat for w in want]
    for g, w in zip(got, want, strict=True):
        for c in ("dt_h", "dist_km", "speed_kt", "heading_deg"):
            a, b = g[c], w[c]
            assert (b is None and (a is None or a != a)) or a == pytest.approx(b, abs=1e-9), c
