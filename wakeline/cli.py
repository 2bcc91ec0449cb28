"""Command lines of the detector and the simulator.

python -m wakeline.cli detect PINGS [--output DIR] ...    python -m wakeline.cli simulate --output PATH ...
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import evaluate as ev
from .operators.detectors import THRESHOLD, detect
from .operators.features import estimate_contamination, interval_of
from .operators.simulate import ANOMALIES, Config, drop_columns, labelled, plan, simulate
from .plans.pipeline import build_feature_matrix
from .sources import sinks
from .sources.pings import load_summary, read_csv
from .sources.staging import staged


def weight(text: str) -> tuple[str, float]:
    kind, _, value = text.partition("=")
    if kind not in ANOMALIES or not value:
        raise argparse.ArgumentTypeError(f"TYPE=VALUE with one of {', '.join(ANOMALIES)}")
    return kind, float(value)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wakeline")
    subs = top.add_subparsers(dest="command", required=True)
    d = subs.add_parser("detect", help="score the entities of a ping CSV")
    d.add_argument("input")
    d.add_argument("--output")
    d.add_argument("--threshold", type=float, default=THRESHOLD)
    d.add_argument("--contamination", type=float, help="reported instead of the estimate; scores don't depend on it")
    d.add_argument("--interval", type=float, help="hours between reports; estimated if not given")
    d.add_argument("--no-eval", action="store_true")
    d.add_argument("--cache-features", metavar="DIR")
    d.add_argument("--chunksize", type=int, help="accepted; Spark splits files itself")
    s = subs.add_parser("simulate", help="make a labelled fleet")
    s.add_argument("--entities", type=int, default=Config.num_entities)
    s.add_argument("--days", type=float, default=Config.duration_days)
    s.add_argument("--interval", type=float, default=Config.report_interval_minutes, help="minutes")
    s.add_argument("--start", default=Config.start_time)
    s.add_argument("--anomaly-rate", type=float, default=Config.anomaly_rate)
    s.add_argument("--weight", type=weight, action="append", default=[], metavar="TYPE=VALUE")
    s.add_argument("--seed", type=int, default=Config.seed)
    s.add_argument("--output", default="ais_sim_output.csv")
    s.add_argument("--format", choices=("csv", "trip-geojson", "both"), default="csv")
    s.add_argument("--bbox", type=float, nargs=4, default=Config.region_bbox, metavar=("WEST", "SOUTH", "EAST", "NORTH"))
    s.add_argument("--noise-km", type=float, default=Config.position_noise_km)
    s.add_argument("--decimals", type=int, default=Config.coord_decimals)
    s.add_argument("--no-label", action="store_true")
    s.add_argument("--no-anomaly-type", action="store_true")
    s.add_argument("--vessel-type", action="store_true")
    s.add_argument("--speed", action="store_true")
    s.add_argument("--no-land-avoidance", action="store_true", help="accepted; all of the region is water here")
    s.add_argument("--quiet", action="store_true", help="print no summary")
    return top


def report(metrics: dict, types, top) -> str:
    """The printed report: metrics, recall by type, top entities."""
    n = max(metrics["n_contacts"], 1)
    lines = ["DETECTION RESULTS", f"  entities: {metrics['n_contacts']}   truly anomalous: {metrics['n_true_anomalous']} ({metrics['n_true_anomalous'] / n:.1%})   flagged: {metrics['n_flagged']}"]
    shown = lambda x: "-" if x is None else f"{x:.3f}"
    lines += [f"  {k}: {shown(metrics[k])}" for k in ("precision", "recall", "f1", "auroc", "average_precision")]
    lines += [f"  tp {metrics['tp']}  fp {metrics['fp']}  fn {metrics['fn']}  tn {metrics['tn']}"]
    if types is not None and len(types):
        lines += ["", "RECALL BY TYPE", types.to_string(index=False)]
    return "\n".join([*lines, "", f"TOP {len(top)}", top.to_string(index=False)])


def run_detect(spark: SparkSession, a: argparse.Namespace) -> None:
    # text is parsed once; all later reads are columnar
    pings = staged(read_csv(spark, a.input, labels=not a.no_eval, chunk_rows=a.chunksize), "pings")
    seen = load_summary(pings).head()
    print(f"{seen['n_rows']} pings of {seen['n_entities']} entities")
    known: dict = {}

    def make():
        features, known["interval"], known["rate"] = build_feature_matrix(pings, a.interval)
        return features

    features = sinks.cached_features(spark, a.cache_features, make) if a.cache_features else staged(make(), "features")
    if "interval" not in known:  # a cached matrix has neither
        known["interval"] = interval_of(pings) if a.interval is None else a.interval
        known["rate"] = estimate_contamination(pings, known["interval"]).head()[0]
    print(f"interval {known['interval']} h, contamination {known['rate'] if a.contamination is None else a.contamination}")
    found = staged(detect(features, a.threshold), "scores")
    if not a.no_eval and (metrics := ev.evaluate(found, a.threshold)) is not None:
        types = ev.per_type_breakdown(found, a.threshold)
        print(report(metrics.head().asDict(), types.toPandas() if types is not None else None, ev.top_detections(found).toPandas()))
    if a.output:
        sinks.write_csv(found, a.output)


def run_simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    base = Config()
    cfg = Config(
        num_entities=a.entities, duration_days=a.days, report_interval_minutes=a.interval, start_time=a.start, anomaly_rate=a.anomaly_rate, anomaly_weights=base.anomaly_weights | dict(a.weight), seed=a.seed,
        output_format=a.format, include_label=not a.no_label, include_anomaly_type=not a.no_anomaly_type, include_vessel_type=a.vessel_type, include_speed=a.speed, coord_decimals=a.decimals,
        region_bbox=tuple(a.bbox), position_noise_km=a.noise_km,
    )
    pings = simulate(spark, cfg)
    if a.format == "both":  # made once for two writers
        pings = staged(pings, "fleet")
    csv, trips = sinks.both_paths(a.output) if a.format == "both" else (a.output, a.output)
    if a.format != "trip-geojson":
        sinks.write_pings_csv(pings.drop(*drop_columns(cfg)), csv, a.decimals)
    if a.format != "csv":
        sinks.write_trips(pings.drop(*[c for c in drop_columns(cfg) if c != "anomaly_type"]), trips)
    if not a.quiet:
        print(f"{cfg.num_entities} entities, {cfg.n_steps} reports each at most, {labelled(plan(cfg))} with anomalies")


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("wakeline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    {"detect": run_detect, "simulate": run_simulate}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
