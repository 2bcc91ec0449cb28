"""All trajectory queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import detectors, evaluate, iforest, kinematics, neighbors, proximity, rules, scaling, simulate, stays
from ..operators import features as feat
from ..sources import pings as src
from ..sources import sinks
from ..sources.staging import shared_path, staged
from . import pipeline
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Hours between reports of the derived view, for queries that need a cadence.
INTERVAL_H = 0.5


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Hulls of the view's grid have areas that are multiples of 1/32,000,000; six places would round ties.
HULL_DIGITS = 11


def six(df: DataFrame) -> DataFrame:
    """Doubles rounded, as both engines sum in orders of their own."""
    return df.select(*(F.round(c, HULL_DIGITS if c == "hull_area_deg2" else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _pings(spark, sf_dir) -> DataFrame:
    return src.event_pings(spark, sf_dir)


# sources and sinks
_SCAN = "entity_id, event_id, round(lat, 6) AS lat, round(lon, 6) AS lon, vessel_type, round(sog_knots, 6) AS sog_knots, is_anomalous, anomaly_type"


@query("scan_pings", f"WITH {S.PINGS} SELECT {_SCAN} FROM pings")
def _(spark, d):
    return six(_pings(spark, d).drop("timestamp", "bucket"))


_CSV = "entity_id::INT AS entity_id, epoch_us(timestamp) // 1000000 AS at_s, round(lat, 5) AS lat, round(lon, 5) AS lon, vessel_type, round(sog_knots, 2) AS sog_knots, is_anomalous, anomaly_type"


def _csv_query(name: str, packed: bool):
    @query(name, f"WITH {S.PINGS} SELECT {_CSV} FROM pings")
    def _(spark, d):
        """Pings written as CSV files and read by the typed reader."""
        path = shared_path(spark, name)
        out = _pings(spark, d).select(F.col("entity_id").cast("int"), F.date_format(F.date_trunc("second", "timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "vessel_type", F.round("sog_knots", 2).alias("sog_knots"), "is_anomalous", "anomaly_type")
        out.write.option("header", True).option("compression", "gzip" if packed else "none").csv(path)
        return src.read_csv(spark, path).select("entity_id", F.unix_seconds("timestamp").alias("at_s"), "lat", "lon", "vessel_type", "sog_knots", F.col("is_anomalous").cast("int"), "anomaly_type")


_csv_query("scan_csv", False)
_csv_query("scan_csv_gz", True)


@query("drop_labels", f"WITH {S.PINGS} SELECT entity_id, event_id, round(lat, 6) AS lat, round(lon, 6) AS lon, vessel_type, round(sog_knots, 6) AS sog_knots FROM pings")
def _(spark, d):
    return six(src.drop_labels(_pings(spark, d)).drop("timestamp", "bucket"))


@query("load_summary", f"WITH {S.PINGS} SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, 'entity_id,timestamp,bucket,event_id,vessel_type,sog_knots,is_anomalous,anomaly_type,lat,lon' AS columns FROM pings")
def _(spark, d):
    return src.load_summary(_pings(spark, d))


@query("feature_cache_roundtrip", f"{S.BASE} {S.group(S.gaps())}")
def _(spark, d):
    make = lambda: feat.track_features(_pings(spark, d), INTERVAL_H, hull=False).select("entity_id", *feat.GAPS)
    return six(sinks.cached_features(spark, shared_path(spark, "features"), make))


@query("trip_segments", f"""WITH {S.PINGS}, a AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN anomaly_type IS DISTINCT FROM lag(anomaly_type) OVER w THEN 1 ELSE 0 END AS new_, lead(timestamp) OVER w AS nts FROM pings WINDOW w AS (PARTITION BY entity_id ORDER BY timestamp, event_id)),
b AS (SELECT *, sum(new_) OVER (PARTITION BY entity_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM a),
c AS (SELECT entity_id, segment, anomaly_type, count(*) AS n, arg_max(nts IS NOT NULL, (timestamp, event_id)) AS more_, max(nts) AS nts, avg(sog_knots) AS m, min(timestamp) AS lo, max(timestamp) AS hi FROM b GROUP BY entity_id, segment, anomaly_type)
SELECT entity_id, segment::BIGINT AS segment, anomaly_type, n + CASE WHEN more_ THEN 1 ELSE 0 END AS n_vertices, round(m, 6) AS sog_knots_mean, epoch_us(lo) // 1000000 AS first_epoch, epoch_us(CASE WHEN more_ THEN nts ELSE hi END) // 1000000 AS last_epoch FROM c WHERE n + CASE WHEN more_ THEN 1 ELSE 0 END >= 2""")  # fmt: skip
def _(spark, d):
    return six(sinks.trip_segments(_pings(spark, d)).drop("coordinates", "vessel_type"))


# functions
_POINT = "entity_id, event_id"


@query("haversine", f"WITH {S.PINGS} SELECT {_POINT}, round({S.haversine('lat', 'lon', '20.0::DOUBLE', '(-75.0::DOUBLE)')}, 6) AS km FROM pings")
def _(spark, d):
    return six(_pings(spark, d).select("entity_id", "event_id", geo.haversine_km("lat", "lon", 20.0, -75.0).alias("km")))


@query("haversine_r6371", f"WITH {S.PINGS} SELECT {_POINT}, round({S.haversine('lat', 'lon', '20.0::DOUBLE', '(-75.0::DOUBLE)', 6371.0, False)}, 6) AS km FROM pings")
def _(spark, d):
    return six(_pings(spark, d).select("entity_id", "event_id", geo.haversine_km("lat", "lon", 20.0, -75.0, geo.EARTH_RADIUS_KM_COARSE, clip=False).alias("km")))


@query("bearing", f"WITH {S.PINGS} SELECT {_POINT}, round({S.bearing('lat', 'lon', '20.0::DOUBLE', '(-75.0::DOUBLE)')}, 6) AS deg FROM pings")
def _(spark, d):
    return six(_pings(spark, d).select("entity_id", "event_id", geo.bearing_deg("lat", "lon", 20.0, -75.0).alias("deg")))


@query("heading_delta", f"{S.BASE} SELECT {_POINT}, round(heading_deg, 6) AS heading_deg, round(heading_delta, 6) AS heading_delta FROM kin")
def _(spark, d):
    return six(kinematics.kinematics(_pings(spark, d)).select("entity_id", "event_id", "heading_deg", "heading_delta"))


@query("km_to_deg", f"WITH {S.PINGS} SELECT {_POINT}, round(sog_knots / 110.574, 6) AS dlat, round(sog_knots / (111.32 * cos(radians(lat))), 6) AS dlon FROM pings")
def _(spark, d):
    return six(_pings(spark, d).select("entity_id", "event_id", geo.km_to_deg_lat("sog_knots").alias("dlat"), geo.km_to_deg_lon("sog_knots", "lat").alias("dlon")))


@query("inside_stratum", f"WITH {S.PINGS} SELECT {_POINT}, {S.INSIDE} AS inside, round({S.ZONE_NM}, 6) AS zone_nm FROM pings")
def _(spark, d):
    return six(_pings(spark, d).select("entity_id", "event_id", geo.inside_zone("lat", "lon").alias("inside"), geo.zone_distance_nm("lat", "lon").alias("zone_nm")))


@query("nearest_zone", f"WITH {S.PINGS}, z AS (" + " UNION ALL ".join(f"SELECT {_POINT}, {k} AS km, '{n}' AS zone FROM pings" for n, k in S.ZONE_KM.items()) + ") SELECT entity_id, event_id, round(min(km), 6) AS km, arg_min(zone, (km, zone)) AS zone FROM z GROUP BY entity_id, event_id")
def _(spark, d):
    z = _pings(spark, d).select("entity_id", "event_id", geo.nearest_zone("lat", "lon").alias("z"))
    return six(z.select("entity_id", "event_id", F.col("z.distance_km").alias("km"), F.col("z.zone").alias("zone")))


@query("time_parts", f"WITH {S.PINGS} SELECT {_POINT}, hour(timestamp)::INT AS hour_of_day, (isodow(timestamp) - 1)::INT AS day_of_week FROM pings")
def _(spark, d):
    return _pings(spark, d).select("entity_id", "event_id", F.hour("timestamp").alias("hour_of_day"), F.weekday("timestamp").alias("day_of_week"))


# windows
@query("kinematics", f"{S.BASE} SELECT entity_id, event_id, round(dt_h, 6) AS dt_h, round(dist_km, 6) AS dist_km, round(speed_kt, 6) AS speed_kt, round(heading_deg, 6) AS heading_deg, round(heading_delta, 6) AS heading_delta FROM kin")
def _(spark, d):
    return six(kinematics.kinematics(_pings(spark, d)).select("entity_id", "event_id", "dt_h", "dist_km", "speed_kt", "heading_deg", "heading_delta"))


@query("ping_features", f"{S.PING_BASE} SELECT entity_id, event_id, {S.rounded(S.PING_COLUMNS)}, 0 AS is_stay_int, hour_of_day::INT AS hour_of_day, day_of_week::INT AS day_of_week FROM pf")
def _(spark, d):
    return six(kinematics.ping_features(_pings(spark, d)).select("entity_id", "event_id", *S.PING_COLUMNS, "is_stay_int", "hour_of_day", "day_of_week"))


@query("dist_from_median", f"{S.PING_BASE} SELECT entity_id, event_id, round(dist_from_median_km, 6) AS km FROM pf")
def _(spark, d):
    p = _pings(spark, d)
    joined = p.join(kinematics.median_position(p), "entity_id")
    return six(joined.select("entity_id", "event_id", geo.haversine_km("lat", "lon", "median_lat", "median_lon", geo.EARTH_RADIUS_KM_COARSE, clip=False).alias("km")))


@query("gap_capped", f"{S.PING_BASE} SELECT entity_id, event_id, round(time_gap_min_capped, 6) AS time_gap_min_capped FROM pf")
def _(spark, d):
    return six(kinematics.ping_features(_pings(spark, d)).select("entity_id", "event_id", "time_gap_min_capped"))


@query("rolling_slow", f"{S.PING_BASE}, {S.SLOW} SELECT entity_id, event_id, rolling AS rolling_slow FROM slow")
def _(spark, d):
    return kinematics.rolling_slow(_pings(spark, d)).select("entity_id", "event_id", "rolling_slow")


@query("stay_segments", f"{S.PING_BASE}, s AS (SELECT *, sum(CASE WHEN time_gap_min > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM pf) SELECT entity_id, segment::BIGINT AS segment, count(*) AS n, round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 6e7, 6) AS minutes FROM s GROUP BY entity_id, segment")
def _(spark, d):
    s = kinematics.gap_segments(_pings(spark, d)).groupBy("entity_id", "segment")
    return six(s.agg(F.count("*").alias("n"), ((F.max(F.unix_micros("timestamp")) - F.min(F.unix_micros("timestamp"))) / 6e7).alias("minutes")))


@query("sog", f"{S.BASE} SELECT entity_id, event_id, round(coalesce(speed_kt, 0.0), 6) AS sog_emitted FROM kin")
def _(spark, d):
    return six(kinematics.emitted_speed(_pings(spark, d), INTERVAL_H).select("entity_id", "event_id", "sog_emitted"))


@query("low_speed", f"WITH {S.PINGS} SELECT entity_id, event_id, sog_knots < 1.0 AS low_speed_flag FROM pings")
def _(spark, d):
    return stays.low_speed(_pings(spark, d)).select("entity_id", "event_id", "low_speed_flag")


# entity features
_GAP_H = f"WITH {S.PINGS}, {S.LAGGED}, g AS (SELECT *, (epoch_us(timestamp) - epoch_us(pts)) / 1e6 / 3600.0 AS gap_h FROM lagged)"
_MODE = "m AS (SELECT round_even(gap_h * 12, 0) / 12 AS interval_h, count(*) AS n FROM g WHERE gap_h IS NOT NULL AND round_even(gap_h * 12, 0) / 12 < 2 GROUP BY 1), iv AS (SELECT interval_h FROM m ORDER BY n DESC, interval_h LIMIT 1)"


@query("estimate_interval", f"{_GAP_H}, {_MODE} SELECT round(interval_h, 6) AS interval_h FROM iv")
def _(spark, d):
    return six(feat.estimate_interval(_pings(spark, d)))


@query("estimate_contamination", f"{_GAP_H}, {_MODE}, o AS (SELECT entity_id, max(CASE WHEN gap_h > 10 * (SELECT interval_h FROM iv) OR CASE WHEN gap_h > 0 THEN {S.haversine('plat', 'plon', 'lat', 'lon')} / gap_h / 1.852 END > 60 THEN 1 ELSE 0 END) AS odd FROM g GROUP BY entity_id) SELECT round(greatest(0.005, least(0.15, avg(odd))), 6) AS contamination FROM o")
def _(spark, d):
    p = _pings(spark, d)
    return six(feat.estimate_contamination(p, feat.interval_of(p)))


def _features(spark, d, hull: bool = False) -> DataFrame:
    return feat.track_features(_pings(spark, d), INTERVAL_H, hull)


@query("motion_features", f"{S.BASE} {S.group(S.MOTION)}")
def _(spark, d):
    return six(_features(spark, d).select("entity_id", *S.MOTION))


@query("straightness", f"{S.BASE} {S.group({'straightness': S.STRAIGHT})}")
def _(spark, d):
    return six(_features(spark, d).select("entity_id", "straightness"))


@query("gap_features", f"{S.BASE} {S.group(S.gaps())}")
def _(spark, d):
    return six(_features(spark, d).select("entity_id", *feat.GAPS))


@query("strata_features", f"{S.BASE} {S.group({k: v for k, v in S.PLACES.items() if 'port' not in k})}")
def _(spark, d):
    return six(_features(spark, d).select("entity_id", *[c for c in feat.PLACES if "port" not in c]))


@query("port_distance", f"{S.BASE} {S.group({'min_port_dist_nm': S.PLACES['min_port_dist_nm']})}")
def _(spark, d):
    return six(_pings(spark, d).groupBy("entity_id").agg(F.min(geo.port_distance_nm("lat", "lon")).alias("min_port_dist_nm")))


@query("truth_labels", f"{S.BASE} {S.group(S.TRUTH)}")
def _(spark, d):
    return _features(spark, d).select("entity_id", "true_anomalous", "true_type")


@query("hull_area", f"{S.BASE}, {S.FEATS}, {S.HULL} SELECT f.entity_id, round({S.HULL_VALUE}, 11) AS hull_area_deg2 FROM feats f LEFT JOIN hull h ON h.entity_id = f.entity_id")
def _(spark, d):
    return six(_features(spark, d, True).select("entity_id", "hull_area_deg2"))


# proximity
def _near(spark, d) -> DataFrame:
    slim = kinematics.kinematics(_pings(spark, d)).select("entity_id", "bucket", "timestamp", "event_id", "lat", "lon", "speed_kt")
    return proximity.nearest(proximity.first_in_bucket(slim), "bucket")


@query("nearest_neighbor", f"{S.BASE}, {S.NEAR} SELECT entity_id, epoch_us(moment) // 1000000 AS moment, round(nn_dist_nm, 6) AS nn_dist_nm, nn_id, round(nn_speed_kt, 6) AS nn_speed_kt FROM near")
def _(spark, d):
    return six(_near(spark, d).select("entity_id", F.unix_seconds("moment").alias("moment"), "nn_dist_nm", "nn_id", "nn_speed_kt"))


@query("close_episodes", f"{S.BASE}, {S.NEAR} SELECT entity_id, n, epoch_us(begin_) // 1000000 AS begin_s, epoch_us(end_) // 1000000 AS end_s FROM episodes")
def _(spark, d):
    return proximity.close_runs(_near(spark, d)).select("entity_id", "n", F.unix_seconds("begin").alias("begin_s"), F.unix_seconds("end").alias("end_s"))


@query("proximity_features", f"{S.BASE}, {S.NEAR} SELECT entity_id, {S.rounded(S.PROX)} FROM prox")
def _(spark, d):
    return six(proximity.proximity_features(_near(spark, d), _pings(spark, d).select("entity_id").distinct(), INTERVAL_H))


_ALL = [*S.MOTION, "straightness", *feat.GAPS, *feat.PLACES]


@query("feature_matrix", f"{S.BASE}, {S.FEATS}, {S.HULL}, {S.NEAR} SELECT f.entity_id, {S.rounded({n: 'f.' + n for n in _ALL})}, round({S.HULL_VALUE}, 11) AS hull_area_deg2, true_anomalous, true_type, {S.rounded({n: 'p.' + n for n in S.PROX})} FROM feats f LEFT JOIN hull h ON h.entity_id = f.entity_id JOIN prox p ON p.entity_id = f.entity_id")
def _(spark, d):
    return six(pipeline.build_feature_matrix(_pings(spark, d), INTERVAL_H, "bucket")[0])


# detectors
def _rule_scores(spark, d) -> DataFrame:
    return _features(spark, d).select("entity_id", detectors.teleport().alias("score_teleport"), detectors.blackout().alias("score_blackout"))


@query("score_teleport", f"{S.BASE}, {S.FEATS} SELECT entity_id, round({S.TELEPORT}, 6) AS score_teleport FROM feats")
def _(spark, d):
    return six(_rule_scores(spark, d).select("entity_id", "score_teleport"))


@query("score_blackout", f"{S.BASE}, {S.FEATS} SELECT entity_id, round({S.BLACKOUT}, 6) AS score_blackout FROM feats")
def _(spark, d):
    return six(_rule_scores(spark, d).select("entity_id", "score_blackout"))


def _scored(spark, d) -> DataFrame:
    """Ensemble over the rule scores and plain stand-ins for the learnt ones, so that SQL can follow."""
    f = pipeline.track_features(_pings(spark, d), INTERVAL_H, hull=False).join(proximity.proximity_features(_near(spark, d), _pings(spark, d).select("entity_id").distinct(), INTERVAL_H), "entity_id")
    one = lambda c: F.least(F.lit(1.0), c)
    s = f.select(
        "entity_id", detectors.teleport().alias("score_teleport"), detectors.blackout().alias("score_blackout"), one(F.col("frac_slow")).alias("score_slow_stratum"),
        one(F.col("hours_within_1nm") / 24.0).alias("score_colocation"), one(F.col("heading_change_rate") / 360.0).alias("score_erratic_pursuit"), "true_anomalous", "true_type",
    )
    return detectors.ensemble(s)


@query("ensemble", f"{S.SCORED} SELECT entity_id, {S.rounded([*S.NAMES, 'ensemble_score', 'ensemble_mean'])} FROM ens")
def _(spark, d):
    return six(_scored(spark, d).drop("true_anomalous", "true_type"))


@query("flagged", f"{S.SCORED} SELECT entity_id, round(ensemble_score, 6) AS ensemble_score, ensemble_score >= 0.5 AS flagged FROM ens")
def _(spark, d):
    return six(detectors.flag(_scored(spark, d)).select("entity_id", "ensemble_score", "flagged"))


@query("top_detections", f"{S.SCORED} SELECT entity_id, {S.rounded(['ensemble_score', 'ensemble_mean', *S.NAMES])}, true_anomalous, true_type FROM ens ORDER BY ens.ensemble_score DESC, entity_id LIMIT 20")
def _(spark, d):
    return six(evaluate.top_detections(_scored(spark, d)))


_METRICS = """c AS (SELECT count(*) AS n_contacts, count(CASE WHEN true_anomalous = 1 THEN 1 END) AS n_true_anomalous, count(CASE WHEN ensemble_score >= 0.5 THEN 1 END) AS n_flagged, count(CASE WHEN ensemble_score >= 0.5 AND true_anomalous = 1 THEN 1 END) AS tp,
 count(CASE WHEN ensemble_score >= 0.5 AND true_anomalous <> 1 THEN 1 END) AS fp, count(CASE WHEN ensemble_score < 0.5 AND true_anomalous = 1 THEN 1 END) AS fn, count(CASE WHEN ensemble_score < 0.5 AND true_anomalous <> 1 THEN 1 END) AS tn FROM ens),
r AS (SELECT *, tp / (tp + fp + 1e-12) AS p, tp / (tp + fn + 1e-12) AS q FROM c)"""


@query("eval_metrics", f"{S.SCORED}, es AS (SELECT ensemble_score AS score, true_anomalous AS label FROM ens), {S.BY_SCORE.format(src='es')}, {_METRICS} SELECT 0.5::DOUBLE AS threshold, n_contacts, n_true_anomalous, n_flagged, tp, fp, fn, tn, round(p, 4) AS precision, round(q, 4) AS recall, round(2 * p * q / (p + q + 1e-12), 4) AS f1, round((SELECT {S.AUROC} FROM cum), 4) AS auroc, round((SELECT {S.AP} FROM cum), 4) AS average_precision FROM r")
def _(spark, d):
    return evaluate.evaluate(_scored(spark, d))


@query("per_type_breakdown", f"{S.SCORED} SELECT true_type AS anomaly_type, count(*) AS n, count(CASE WHEN ensemble_score >= 0.5 THEN 1 END) AS flagged, round(count(CASE WHEN ensemble_score >= 0.5 THEN 1 END) / count(*)::DOUBLE, 3) AS recall, {', '.join(f'round(avg({n}), 3) AS mean_{n}' for n in S.NAMES)} FROM ens GROUP BY true_type")
def _(spark, d):
    return evaluate.per_type_breakdown(_scored(spark, d))


# rules and their evaluation
def _ruled(spark, d, preset: str) -> DataFrame:
    return rules.apply_rules(kinematics.ping_features(_pings(spark, d)), preset)


def _rule_query(preset: str) -> None:
    names = ", ".join(S.rule_names(preset))

    @query(f"rules_{preset}", f"{S.PING_BASE}, {S.SLOW}, {S.rules(preset)} SELECT entity_id, event_id, round(implied_speed_knots, 6) AS implied_speed_knots, {names}, any_rule_flag FROM ruled")
    def _(spark, d):
        return six(_ruled(spark, d, preset).select("entity_id", "event_id", "implied_speed_knots", *S.rule_names(preset), "any_rule_flag"))


for _preset in rules.PRESETS:
    _rule_query(_preset)


def _scored_pings(spark, d) -> DataFrame:
    r = _ruled(spark, d, "iforest").withColumn("score", F.col("sog_knots") / 600.0).withColumn("label", F.col("is_anomalous"))
    return rules.combine(r, F.col("score") >= 0.5)


@query("pred_combined", f"{S.SCORED_PINGS} SELECT entity_id, event_id, pred AS pred_anomalous FROM sp")
def _(spark, d):
    return _scored_pings(spark, d).select("entity_id", "event_id", "pred_anomalous")


@query("sample_flagged", f"{S.SCORED_PINGS} SELECT entity_id, event_id, vessel_type, round(score, 6) AS score FROM sp WHERE pred = 1 ORDER BY sp.score DESC, event_id LIMIT 15")
def _(spark, d):
    return six(_scored_pings(spark, d).filter("pred_anomalous = 1").orderBy(F.desc("score"), "event_id").limit(15).select("entity_id", "event_id", "vessel_type", "score"))


@query("auroc", f"{S.SCORED_PINGS}, {S.BY_SCORE.format(src='sp')} SELECT round({S.AUROC}, 6) AS auroc FROM cum")
def _(spark, d):
    return six(evaluate.auroc(_scored_pings(spark, d), "score", "label"))


@query("average_precision", f"{S.SCORED_PINGS}, {S.BY_SCORE.format(src='sp')} SELECT round({S.AP}, 6) AS average_precision FROM cum")
def _(spark, d):
    return six(evaluate.average_precision(_scored_pings(spark, d), "score", "label"))


_REPORT = """k AS (SELECT count(CASE WHEN pred = 1 AND label = 1 THEN 1 END)::DOUBLE AS a, count(CASE WHEN pred = 1 AND label <> 1 THEN 1 END)::DOUBLE AS b, count(CASE WHEN pred <> 1 AND label = 1 THEN 1 END)::DOUBLE AS c, count(CASE WHEN pred <> 1 AND label <> 1 THEN 1 END)::DOUBLE AS d FROM sp),
one AS (SELECT 'Normal' AS class, coalesce(d / nullif(d + c, 0), 0) AS precision, coalesce(d / nullif(d + b, 0), 0) AS recall, coalesce(2 * d / nullif(2 * d + c + b, 0), 0) AS f1, d + b AS support FROM k
 UNION ALL SELECT 'Anomalous', coalesce(a / nullif(a + b, 0), 0), coalesce(a / nullif(a + c, 0), 0), coalesce(2 * a / nullif(2 * a + b + c, 0), 0), a + c FROM k),
every AS (SELECT * FROM one UNION ALL SELECT 'accuracy', (a + d) / (a + b + c + d), (a + d) / (a + b + c + d), (a + d) / (a + b + c + d), a + b + c + d FROM k
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM one UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM one)"""


@query("classification_report", f"{S.SCORED_PINGS}, {_REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM every")
def _(spark, d):
    return six(evaluate.classification_report(_scored_pings(spark, d), "pred_anomalous", "label"))


@query("rule_precision", f"{S.SCORED_PINGS} " + " UNION ALL ".join(f"SELECT '{n[5:]}' AS rule, count(CASE WHEN {n} THEN 1 END) AS n_flagged, round(coalesce(count(CASE WHEN {n} AND label = 1 THEN 1 END) / nullif(count(CASE WHEN {n} THEN 1 END), 0)::DOUBLE, 0.0), 6) AS precision FROM sp" for n in S.rule_names("iforest")))
def _(spark, d):
    return six(evaluate.rule_precision(_scored_pings(spark, d), "label"))


@query("score_distribution", f"{S.SCORED_PINGS} SELECT anomaly_type, round(avg(score), 3) AS mean, round(quantile_cont(score, 0.5), 3) AS p50, round(quantile_cont(score, 0.75), 3) AS p75, round(max(score), 3) AS max FROM sp GROUP BY anomaly_type")
def _(spark, d):
    return evaluate.score_distribution(_scored_pings(spark, d), "score")


@query("score_threshold", f"{S.SCORED_PINGS} SELECT round(quantile_cont(score, 0.97), 6) AS threshold FROM sp")
def _(spark, d):
    return six(evaluate.score_threshold(_scored_pings(spark, d), "score"))


@query("oracle_threshold", f"{S.SCORED_PINGS}, t AS (SELECT i, quantile_cont(score, (85.0 + 14.9 * i / 199) / 100.0) AS t FROM sp, range(200) g(i) GROUP BY i), f AS (SELECT i, t, count(CASE WHEN label = 1 AND (score >= t OR any_rule_flag) THEN 1 END) AS tp, count(CASE WHEN score >= t OR any_rule_flag THEN 1 END) AS s, count(CASE WHEN label = 1 THEN 1 END) AS p FROM t, sp GROUP BY i, t) SELECT round(t, 6) AS threshold, round(2.0 * tp / (s + p), 6) AS f1 FROM f ORDER BY round(2.0 * tp / (s + p), 12) DESC, i LIMIT 1".replace("quantile_cont(score, (85.0 + 14.9 * i / 199) / 100.0) AS t FROM sp, range(200) g(i) GROUP BY i", "q[i + 1] AS t FROM (SELECT quantile_cont(score, [" + ", ".join(repr((85.0 + 14.9 * i / 199) / 100.0) for i in range(200)) + "]) AS q FROM sp), range(200) g(i)"))
def _(spark, d):
    return six(evaluate.oracle_threshold(_scored_pings(spark, d), "score", "label"))


# scalers and neighbours, on the embeddings
_COLUMNS = [f"x{i}" for i in range(1, S.DIMS + 1)]


def _vectors(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_COLUMNS)))


def _long(df: DataFrame) -> DataFrame:
    each = F.posexplode(F.array(*_COLUMNS)).alias("p", "x")
    return six(df.select("id", each).select("id", (F.col("p") + 1).alias("d"), "x"))


@query("robust_scale", f"WITH {S.LONG}, s AS (SELECT d, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS hi FROM long_ GROUP BY d) SELECT id, l.d::INT AS d, round((x - m) / CASE WHEN hi - lo = 0 THEN 1.0 ELSE hi - lo END, 6) AS x FROM long_ l JOIN s ON s.d = l.d")
def _(spark, d):
    return _long(scaling.robust_scale(_vectors(spark, d), _COLUMNS))


@query("standard_scale", f"WITH {S.LONG}, s AS (SELECT label, d, avg(x) AS m, stddev_pop(x) AS v FROM long_ GROUP BY label, d) SELECT id, l.d::INT AS d, round((x - m) / CASE WHEN v = 0 THEN 1.0 ELSE v END, 6) AS x FROM long_ l JOIN s ON s.d = l.d AND s.label = l.label")
def _(spark, d):
    return _long(scaling.standard_scale(_vectors(spark, d), _COLUMNS, "label"))


@query("minmax", f"{S.BASE}, {S.FEATS} SELECT entity_id, round((max_gap_h - (SELECT min(max_gap_h) FROM feats)) / ((SELECT max(max_gap_h) - min(max_gap_h) FROM feats) + 1e-12), 6) AS score FROM feats")
def _(spark, d):
    return six(scaling.min_max(_features(spark, d).select("entity_id", "max_gap_h"), "max_gap_h", "score").select("entity_id", "score"))


@query("knn_outlier", f"WITH {S.LONG}, {S.pairs(True)} SELECT id, round(avg(dist), 6) AS knn_outlier_score FROM ranked WHERE k <= 10 GROUP BY id")
def _(spark, d):
    return six(neighbors.knn_outlier(_vectors(spark, d), _COLUMNS, 10, "label"))


@query("lof_score", f"WITH {S.LONG}, {S.pairs(False)}, nb AS (SELECT * FROM ranked WHERE k <= 20), kd AS (SELECT id, max(dist) AS kd FROM nb GROUP BY id), lrd AS (SELECT n.id, 1.0 / (avg(greatest(kd.kd, n.dist)) + 1e-10) AS lrd FROM nb n JOIN kd ON kd.id = n.nn GROUP BY n.id) SELECT n.id, round(avg(b.lrd) / any_value(a.lrd), 6) AS lof FROM nb n JOIN lrd b ON b.id = n.nn JOIN lrd a ON a.id = n.id GROUP BY n.id")
def _(spark, d):
    return six(neighbors.lof(_vectors(spark, d), _COLUMNS, 20))


# what SQL can't say: seeded draws, greedy scans and what is built on them
@query("isolation_forest")
def _(spark, d):
    f = scaling.robust_scale(_features(spark, d).select("entity_id", "max_gap_h", "mean_speed_kt", "heading_variance", "frac_inside_stratum"), ["max_gap_h", "mean_speed_kt", "heading_variance", "frac_inside_stratum"])
    return iforest.score(f, iforest.fit(f, f.columns[1:], "entity_id"), "if_score").select("entity_id", "if_score")


@query("iforest_by_type")
def _(spark, d):
    p = kinematics.ping_features(_pings(spark, d))
    return iforest.score_by_type(p, pipeline.IF_COLUMNS, "vessel_type", "event_id").select("entity_id", "event_id", "if_score", "if_anomalous")


def _learnt_query(name: str, score: str) -> None:
    @query(name)
    def _(spark, d):
        return detectors.learnt(pipeline.build_feature_matrix(_pings(spark, d), INTERVAL_H, "bucket")[0], score)


for _name, _score in (("score_slow_stratum", "score_slow_stratum"), ("score_colocation", "score_colocation"), ("score_erratic", "score_erratic_pursuit")):
    _learnt_query(_name, _score)


@query("detect")
def _(spark, d):
    return detectors.detect(staged(pipeline.build_feature_matrix(_pings(spark, d), INTERVAL_H, "bucket")[0], "features"))


def _stayed(spark, d, method: str) -> DataFrame:
    return stays.detect_stays(_pings(spark, d), method)


@query("stays_window")
def _(spark, d):
    return _stayed(spark, d, "window").select("entity_id", "event_id", "is_stay", "stay_id", "stay_duration_min", "low_speed_flag")


@query("stays_cluster")
def _(spark, d):
    return _stayed(spark, d, "cluster").select("entity_id", "event_id", "is_stay", "stay_id", "stay_duration_min")


@query("stay_summary")
def _(spark, d):
    return stays.stay_summary(_stayed(spark, d, "window"))


@query("distinct_stays")
def _(spark, d):
    return stays.distinct_stays(_stayed(spark, d, "window"))


def _pipeline_query(preset: str) -> None:
    @query(f"ping_pipeline_{preset}")
    def _(spark, d):
        return pipeline.run_ping_pipeline(_pings(spark, d), preset).select("entity_id", "event_id", "any_rule_flag", "pred_anomalous")


for _preset in rules.PRESETS:
    _pipeline_query(_preset)


@query("simulate_fleet")
def _(spark, d):
    return simulate.simulate(spark, simulate.Config(num_entities=60, duration_days=3.0, report_interval_minutes=30.0, anomaly_rate=0.2))
