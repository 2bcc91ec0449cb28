"""The queries' SQL for DuckDB, built from shared parts."""

from __future__ import annotations

from ..functions.geo import PORTS, ZONES
from ..sources.pings import event_columns

PINGS = "pings AS (SELECT " + ", ".join(event_columns("ts", "::DOUBLE")) + " FROM events)"


def haversine(a: str, b: str, c: str, d: str, r: float = 6371.0088, clip: bool = True) -> str:
    """Distance of points (a, b) and (c, d), latitude first."""
    x = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"({2 * r} * asin(sqrt({f'CASE WHEN {x} > 1 THEN 1 ELSE {x} END' if clip else x})))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    t = f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
    return f"({t} + 360 - 360 * floor(({t} + 360) / 360))"


def wrap(x: str) -> str:
    return f"(({x} + 180) - 360 * floor(({x} + 180) / 360) - 180)"


LAGGED = """lagged AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(timestamp) OVER w AS pts, lag(sog_knots) OVER w AS psog,
 epoch_us(timestamp) // 1000000 AS sec FROM pings WINDOW w AS (PARTITION BY entity_id ORDER BY timestamp, event_id))"""
KIN = f"""seg AS (SELECT *, (sec - epoch_us(pts) // 1000000) / 3600.0::DOUBLE AS dt_h, {haversine('plat', 'plon', 'lat', 'lon')} AS dist_km, {bearing('plat', 'plon', 'lat', 'lon')} AS heading_deg FROM lagged),
kin AS (SELECT *, CASE WHEN dt_h > 0 THEN dist_km / dt_h / 1.852 END AS speed_kt, {wrap('(heading_deg - lag(heading_deg) OVER (PARTITION BY entity_id ORDER BY timestamp, event_id))')} AS heading_delta FROM seg)"""
BASE = f"WITH {PINGS}, {LAGGED}, {KIN}"

ZONE_KM = {n: haversine("lat", "lon", f"{z[1]}::DOUBLE", f"({z[0]}::DOUBLE)") for n, z in ZONES.items()}
ZONE_NM = f"least({', '.join(ZONE_KM.values())}) / 1.852"
INSIDE = "(" + " OR ".join(f"{k} <= {ZONES[n][2]}" for n, k in ZONE_KM.items()) + ")"
PORT_NM = f"least({', '.join(haversine('lat', 'lon', f'{p[1]}::DOUBLE', f'({p[0]}::DOUBLE)') for p in PORTS.values())}) / 1.852"

SUM_DT = "sum(dt_h)"


def share(limit: float) -> str:
    return f"CASE WHEN count(speed_kt) = 0 THEN 0.0 WHEN sum(dt_h) > 0 THEN coalesce(sum(CASE WHEN speed_kt < {limit} THEN dt_h END), 0) / sum(dt_h) ELSE 0.0 END"


def moving(x: str) -> str:
    return f"CASE WHEN count(speed_kt) > 0 THEN {x} ELSE 0.0 END"


MOTION = {
    "mean_speed_kt": moving("avg(speed_kt)"), "median_speed_kt": moving("quantile_cont(speed_kt, 0.5)"), "p95_speed_kt": moving("quantile_cont(speed_kt, 0.95)"), "std_speed_kt": moving("stddev_pop(speed_kt)"),
    "frac_slow": share(2.0), "frac_stopped": share(0.5), "heading_variance": moving("coalesce(var_pop(heading_delta), 0)"), "heading_change_rate": moving("coalesce(avg(abs(heading_delta)), 0)"),
}
STRAIGHT = moving("CASE WHEN sum(CASE WHEN speed_kt IS NOT NULL THEN dist_km END) > 0 THEN " + haversine("arg_min(lat, (timestamp, event_id))", "arg_min(lon, (timestamp, event_id))", "arg_max(lat, (timestamp, event_id))", "arg_max(lon, (timestamp, event_id))") + " / sum(CASE WHEN speed_kt IS NOT NULL THEN dist_km END) ELSE 1.0 END")


def gaps(interval: str = "0.5") -> dict[str, str]:
    gap = f"dt_h > 2.5 * {interval}"
    return {
        "max_gap_h": "coalesce(max(dt_h), 0)", "p95_gap_h": "coalesce(quantile_cont(dt_h, 0.95), 0)", "gap_count": f"count(CASE WHEN {gap} THEN 1 END)", "gap_frac": f"CASE WHEN count(dt_h) > 0 THEN count(CASE WHEN {gap} THEN 1 END) / count(dt_h)::DOUBLE ELSE 0.0 END",
        "max_implied_speed_kt": "coalesce(max(speed_kt), 0)", "max_gap_displacement_nm": f"coalesce(max(CASE WHEN {gap} THEN dist_km / 1.852 END), 0)", "n_suspicious_speed_pings": "CASE WHEN count(dt_h) > 0 THEN count(CASE WHEN speed_kt > 60 THEN 1 END) END",
    }


PLACES = {
    "min_stratum_dist_nm": f"min({ZONE_NM})", "frac_inside_stratum": f"avg(CASE WHEN {INSIDE} THEN 1.0::DOUBLE ELSE 0.0 END)", "hours_inside_stratum": f"coalesce(sum(CASE WHEN {INSIDE} THEN dt_h END), 0)", "min_port_dist_nm": f"min({PORT_NM})",
}
TRUTH = {"true_anomalous": "max(is_anomalous)", "true_type": "coalesce(arg_min(CASE WHEN anomaly_type NOT IN ('none', '', '0') THEN anomaly_type END, CASE WHEN anomaly_type NOT IN ('none', '', '0') THEN (timestamp, event_id) END), 'none')"}
COUNTS = {"gap_count", "n_suspicious_speed_pings", "true_anomalous", "true_type", "sustained_close_episodes"}

#: Hull by definition: directed edges with every other point to the left, or on the edge itself; exact on the integer grid of the view.
HULL = """grid AS (SELECT DISTINCT entity_id, CAST(round(lat * 4000) AS BIGINT) AS y, CAST(round(lon * 4000) AS BIGINT) AS x FROM pings),
edges AS (SELECT a.entity_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM grid a JOIN grid b ON a.entity_id = b.entity_id AND (a.x <> b.x OR a.y <> b.y)),
hull_edges AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM grid c WHERE c.entity_id = e.entity_id AND ((e.x2 - e.x1) * (c.y - e.y1) - (e.y2 - e.y1) * (c.x - e.x1) < 0
  OR ((e.x2 - e.x1) * (c.y - e.y1) = (e.y2 - e.y1) * (c.x - e.x1) AND (c.x - e.x1) * (c.x - e.x2) + (c.y - e.y1) * (c.y - e.y2) > 0)))),
hull AS (SELECT entity_id, abs(sum(x1 * y2 - x2 * y1)) / 2.0 / 16000000.0 AS area FROM hull_edges GROUP BY entity_id)"""
HULL_VALUE = "CASE WHEN f.n_speeds > 0 THEN coalesce(h.area, 0.0) ELSE 0.0 END"

NEAR = f"""firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, bucket ORDER BY timestamp, event_id) AS r FROM kin) WHERE r = 1),
near AS (SELECT * FROM (SELECT a.bucket AS moment, a.entity_id, a.speed_kt, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 1.852 AS nn_dist_nm, b.entity_id AS nn_id, b.speed_kt AS nn_speed_kt,
  row_number() OVER (PARTITION BY a.bucket, a.entity_id ORDER BY {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}, b.entity_id) AS k FROM firsts a JOIN firsts b ON a.bucket = b.bucket AND a.entity_id <> b.entity_id) WHERE k = 1),
runs AS (SELECT *, sum(CASE WHEN nn_dist_nm < 1 THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id ORDER BY moment ROWS UNBOUNDED PRECEDING) AS run FROM near),
episodes AS (SELECT entity_id, run, count(*) AS n, min(moment) AS begin_, max(moment) AS end_ FROM runs WHERE nn_dist_nm < 1 GROUP BY entity_id, run),
prox AS (SELECT e.entity_id, coalesce(min(nn_dist_nm), 9999.0) AS min_nn_dist_nm, coalesce(avg(nn_dist_nm), 9999.0) AS mean_nn_dist_nm, 0.5::DOUBLE * count(CASE WHEN nn_dist_nm < 1 THEN 1 END) AS hours_within_1nm, 0.5::DOUBLE * count(CASE WHEN nn_dist_nm < 2 THEN 1 END) AS hours_within_2nm,
  (SELECT count(*) FROM episodes p WHERE p.entity_id = e.entity_id AND p.n * 0.5 >= 1.0) AS sustained_close_episodes, 0.5::DOUBLE * count(CASE WHEN nn_dist_nm < 1 AND speed_kt < 1 AND nn_speed_kt < 1 THEN 1 END) AS co_slow_hours
  FROM (SELECT DISTINCT entity_id FROM pings) e LEFT JOIN near n ON n.entity_id = e.entity_id GROUP BY e.entity_id)"""
PROX = ["min_nn_dist_nm", "mean_nn_dist_nm", "hours_within_1nm", "hours_within_2nm", "sustained_close_episodes", "co_slow_hours"]


def rounded(names: dict[str, str] | list[str], digits: int = 6) -> str:
    items = names.items() if isinstance(names, dict) else [(n, n) for n in names]
    return ", ".join(f"{x} AS {n}" if n in COUNTS else f"round({x}, {digits}) AS {n}" for n, x in items)


def group(names: dict[str, str]) -> str:
    return f"SELECT entity_id, {rounded(names)} FROM kin GROUP BY entity_id"


FEATURES = MOTION | {"straightness": STRAIGHT} | gaps() | PLACES | TRUTH
FEATS = f"feats AS (SELECT entity_id, {', '.join(f'{x} AS {n}' for n, x in FEATURES.items())}, count(speed_kt) AS n_speeds FROM kin GROUP BY entity_id)"

TELEPORT = "(greatest(0.0, least(1.0, (coalesce(max_implied_speed_kt, 0) - 35.0) / (15.0 + 1e-6))) * CASE WHEN coalesce(n_suspicious_speed_pings, 0) >= 2 THEN 1.0 ELSE 0.45 END)"
BLACKOUT = "(greatest(0.0, least(1.0, (coalesce(max_gap_h, 0) - 4.0) / 44.0)) * 0.6 + greatest(0.0, least(1.0, coalesce(max_gap_displacement_nm, 0) / 300.0)) * 0.4)"
#: Stand-ins for the learnt detectors, so that all that follows them can be checked exactly.
STANDIN = {"score_slow_stratum": "least(1.0, frac_slow)", "score_colocation": "least(1.0, hours_within_1nm / 24.0)", "score_erratic_pursuit": "least(1.0, heading_change_rate / 360.0)"}
SCORES = f"scores AS (SELECT f.entity_id, {TELEPORT} AS score_teleport, {BLACKOUT} AS score_blackout, {', '.join(f'{x} AS {n}' for n, x in STANDIN.items())}, true_anomalous, true_type FROM feats f JOIN prox p ON p.entity_id = f.entity_id)"
ENSEMBLE = """tops AS (SELECT *, greatest(1.05 * score_teleport, 1.2 * score_blackout, score_slow_stratum, score_colocation, score_erratic_pursuit) AS top FROM scores),
ens AS (SELECT *, CASE WHEN 1.05 * score_teleport >= top AND greatest(score_slow_stratum, score_colocation, score_erratic_pursuit) <= 0.25 THEN top * 0.72 ELSE top END AS ensemble_score,
  (1.05 * score_teleport + 1.2 * score_blackout + score_slow_stratum + score_colocation + score_erratic_pursuit) / 5 AS ensemble_mean FROM tops)"""
SCORED = f"{BASE}, {FEATS}, {NEAR}, {SCORES}, {ENSEMBLE}"
NAMES = ["score_teleport", "score_blackout", *STANDIN]

PINGF = f"""pf0 AS (SELECT *, coalesce((epoch_us(timestamp) - epoch_us(pts)) / 1e6 / 60.0, 0.0) AS time_gap_min, coalesce(sog_knots - psog, 0.0) AS speed_delta,
  CASE WHEN stddev_samp(sog_knots) OVER e > 0 THEN (sog_knots - avg(sog_knots) OVER e) / stddev_samp(sog_knots) OVER e ELSE 0.0 END AS speed_z,
  coalesce({haversine('plat', 'plon', 'lat', 'lon', 6371.0, False)}, 0.0) AS dist_from_prev_km, coalesce({bearing('plat', 'plon', 'lat', 'lon')}, 0.0) AS bearing,
  quantile_cont(lat, 0.5) OVER e AS mlat, quantile_cont(lon, 0.5) OVER e AS mlon FROM lagged WINDOW e AS (PARTITION BY entity_id)),
pf AS (SELECT *, least(time_gap_min, 240.0) AS time_gap_min_capped, {wrap('(bearing - coalesce(lag(bearing) OVER (PARTITION BY entity_id ORDER BY timestamp, event_id), 0.0))')} AS bearing_delta,
  {haversine('lat', 'lon', 'mlat', 'mlon', 6371.0, False)} AS dist_from_median_km, hour(timestamp) AS hour_of_day, isodow(timestamp) - 1 AS day_of_week FROM pf0)"""
PING_BASE = f"WITH {PINGS}, {LAGGED}, {PINGF}"
PING_COLUMNS = ["time_gap_min", "time_gap_min_capped", "speed_delta", "speed_z", "dist_from_prev_km", "bearing", "bearing_delta", "dist_from_median_km"]
SLOW = "slow AS (SELECT *, count(sog_knots) OVER f = 4 AND max(sog_knots) OVER f < 1.0 AS rolling FROM pf WINDOW f AS (PARTITION BY entity_id ORDER BY timestamp, event_id ROWS 3 PRECEDING))"

_IMPLIED = "CASE WHEN time_gap_min > 0 THEN dist_from_prev_km / 1.852 / (time_gap_min / 60.0) ELSE 0.0 END"


def rules(preset: str) -> str:
    """CTE ruled with implied_speed_knots, the rules and any_rule_flag, after pf and slow."""
    both = "AND" if preset == "knn" else "OR"
    kt, deg = (20, 150) if preset == "knn" else (15, 120)
    fish = "sog_knots < 2 AND dist_from_median_km > 20" + ("" if preset == "staypoint" else " AND vessel_type = 'fishing'") + (" AND sog_knots > 0.5" if preset == "knn" else "")
    named = {"dark_ship": "time_gap_min > 60", "spoofing": f"dist_from_prev_km > 50 {both} implied_speed_knots > 60", "aggression": f"abs(speed_delta) > {kt} AND abs(bearing_delta) > {deg}", "illegal_fish": fish}
    any_of = list(named)
    if preset == "staypoint":
        named |= {"impossible_speed": "sog_knots > 40", "transshipment": "rolling"}
        any_of = ["impossible_speed", "aggression", "transshipment", "illegal_fish"]
    flags = ", ".join(f"coalesce({x}, FALSE) AS rule_{n}" for n, x in named.items())
    return f"implied AS (SELECT *, {_IMPLIED} AS implied_speed_knots FROM slow), ruled0 AS (SELECT *, {flags} FROM implied), ruled AS (SELECT *, ({' OR '.join(f'rule_{n}' for n in any_of)}) AS any_rule_flag FROM ruled0)"


def rule_names(preset: str) -> list[str]:
    return [f"rule_{n}" for n in ("dark_ship", "spoofing", "aggression", "illegal_fish", *(("impossible_speed", "transshipment") if preset == "staypoint" else ()))]


# classification: a score and a label of every ping
SCORED_PINGS = f"{PING_BASE}, {SLOW}, {rules('iforest')}, sp AS (SELECT *, sog_knots / 600.0 AS score, is_anomalous AS label, CASE WHEN sog_knots / 600.0 >= 0.5 OR any_rule_flag THEN 1 ELSE 0 END AS pred FROM ruled)"
BY_SCORE = "bs AS (SELECT score, count(CASE WHEN label = 1 THEN 1 END) AS p, count(CASE WHEN label <> 1 THEN 1 END) AS n FROM {src} GROUP BY score), cum AS (SELECT *, sum(p) OVER (ORDER BY score) AS cp, sum(n) OVER (ORDER BY score) AS cn, sum(p) OVER () AS tp_, sum(n) OVER () AS tn_ FROM bs)"
AUROC = "sum(p * ((cn - n) + n / 2.0)) / (any_value(tp_)::DOUBLE * any_value(tn_))"
AP = "sum(p / tp_::DOUBLE * (tp_ - cp + p) / ((tp_ - cp + p) + (tn_ - cn + n))::DOUBLE)"

# vectors: the embeddings as rows of columns
DIMS = 64
VECS = "vecs AS (SELECT vec_id AS id, label, embedding FROM embeddings)"
LONG = f"long_ AS (SELECT vec_id AS id, label, unnest(range(1, {DIMS} + 1)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def pairs(by_label: bool, scaled: str = "long_") -> str:
    same = "AND a.label = b.label" if by_label else ""
    return f"pairs AS (SELECT a.id, b.id AS nn, sqrt(sum(pow(a.x - b.x, 2))) AS dist FROM {scaled} a JOIN {scaled} b ON a.d = b.d AND a.id <> b.id {same} GROUP BY a.id, b.id), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nn) AS k FROM pairs)"
