"""Scores against labels. Everything exact; rows are first counted by distinct score, so ties cost nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .detectors import THRESHOLD

EPS = 1e-12
#: Score ranges whose running sums are made side by side.
RANGES = 64
#: Thresholds that are tried for the best F1, and the percentiles they span.
TRIED, FROM_PERCENT, TO_PERCENT = 200, 85.0, 99.9


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """s, pos, neg, and those of smaller scores (pos_below, neg_below), a row for each distinct score.

    Running sums are made in ranges of the score; the ranges' own sums are few rows, and are added to them.
    """
    groups = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) != 1, 1)).alias("neg"))
    cuts = groups.agg(F.percentile_approx("s", [i / RANGES for i in range(1, RANGES)], 1000)).head()[0] or []
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("s"))) if cuts else F.lit(0)
    placed = groups.withColumn("r", place)
    sums = placed.groupBy("r").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("r", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    within = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    run = placed.select("*", within("pos").alias("p1"), within("neg").alias("n1"))
    return run.join(F.broadcast(base), "r").select("s", "pos", "neg", (F.col("p0") + F.col("p1")).alias("pos_below"), (F.col("n0") + F.col("n1")).alias("neg_below"))


def auroc(df: DataFrame, score: str = "ensemble_score", label: str = "true_anomalous", counted: DataFrame | None = None) -> DataFrame:
    """One row, auroc: ties count half; NULL without both labels. counted is by_score's result, if it is at hand."""
    g = by_score(df, score, label) if counted is None else counted
    p, n = F.sum("pos"), F.sum("neg")
    return g.agg(F.when((p > 0) & (n > 0), F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)) / (p.cast("double") * n)).alias("auroc"))


def average_precision(df: DataFrame, score: str = "ensemble_score", label: str = "true_anomalous", counted: DataFrame | None = None) -> DataFrame:
    """One row, average_precision: the sum over thresholds of gained recall times precision; NULL without positives."""
    g = by_score(df, score, label) if counted is None else counted
    total = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    at = g.crossJoin(F.broadcast(total))  # one row
    tp, fp = F.col("P") - F.col("pos_below"), F.col("N") - F.col("neg_below")
    return at.agg(F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P") * tp / (tp + fp))).alias("average_precision"))


def _count(c: Column) -> Column:
    return F.count(F.when(c, 1))


def _rates(df: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    df = df.withColumn("precision", tp / (tp + fp + EPS)).withColumn("recall", tp / (tp + fn + EPS))
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", p * 2 * r / (p + r + EPS))


def evaluate(df: DataFrame, threshold: float = THRESHOLD, score: str = "ensemble_score", label: str = "true_anomalous") -> DataFrame | None:
    """One row of metrics, rounded to four places; None if there is no truth."""
    if label not in df.columns:
        return None
    said, true = F.col(score) >= threshold, F.col(label) == 1
    c = df.agg(F.count("*").alias("n_contacts"), _count(true).alias("n_true_anomalous"), _count(said).alias("n_flagged"), _count(said & true).alias("tp"), _count(said & ~true).alias("fp"), _count(~said & true).alias("fn"), _count(~said & ~true).alias("tn"))
    counted = staged(by_score(df, score, label), "by-score")  # a row for each distinct score
    c = _rates(c).crossJoin(F.broadcast(auroc(df, score, label, counted))).crossJoin(F.broadcast(average_precision(df, score, label, counted)))
    four = [F.round(x, 4).alias(x) for x in ("precision", "recall", "f1", "auroc", "average_precision")]
    return c.select(F.lit(float(threshold)).alias("threshold"), "n_contacts", "n_true_anomalous", "n_flagged", "tp", "fp", "fn", "tn", *four)


def per_type_breakdown(df: DataFrame, threshold: float = THRESHOLD, by: str = "true_type") -> DataFrame | None:
    if by not in df.columns:
        return None
    scores = [c for c in df.columns if c.startswith("score_")]
    flagged = _count(F.col("ensemble_score") >= threshold)
    out = df.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("anomaly_type")).agg(F.count("*").alias("n"), flagged.alias("flagged"), F.round(flagged / F.count("*"), 3).alias("recall"), *(F.round(F.avg(c), 3).alias(f"mean_{c}") for c in scores))
    return out.orderBy(F.desc("recall"), "anomaly_type")


def top_detections(df: DataFrame, n: int = 20) -> DataFrame:
    columns = ["entity_id", "ensemble_score", "ensemble_mean", *(c for c in df.columns if c.startswith("score_")), *(c for c in ("true_anomalous", "true_type") if c in df.columns)]
    return df.select(*columns).orderBy(F.desc("ensemble_score"), "entity_id").limit(n)


def classification_report(df: DataFrame, pred: str, label: str) -> DataFrame:
    """class, precision, recall, f1, support for Normal, Anomalous, accuracy (all three the same), macro and weighted averages."""
    said, true = F.col(pred) == 1, F.col(label) == 1
    c = df.agg(_count(said & true).alias("a"), _count(said & ~true).alias("b"), _count(~said & true).alias("c"), _count(~said & ~true).alias("d"))
    safe = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    a, b, cc, d = (F.col(x) for x in "abcd")

    def of(name, tp, fp, fn):
        p, r = safe(tp, tp + fp), safe(tp, tp + fn)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))

    rows = c.select(of("Normal", d, cc, b).alias("x"), of("Anomalous", a, b, cc).alias("y"), safe(a + d, a + b + cc + d).alias("acc"), (a + b + cc + d).alias("n"))
    x, y, n = F.col("x"), F.col("y"), F.col("n")

    def mean(name, wx, wy):
        return F.struct(F.lit(name).alias("class"), *((x[k] * wx + y[k] * wy).alias(k) for k in ("precision", "recall", "f1")), n.alias("support"))

    accuracy = F.struct(F.lit("accuracy").alias("class"), *(F.col("acc").alias(k) for k in ("precision", "recall", "f1")), n.alias("support"))
    every = F.array(x, y, accuracy, mean("macro avg", F.lit(0.5), F.lit(0.5)), mean("weighted avg", safe(x["support"], n), safe(y["support"], n)))
    return rows.select(F.explode(every).alias("r")).select("r.*")


def rule_precision(df: DataFrame, label: str) -> DataFrame:
    """rule, n_flagged, precision (0 if nothing is flagged) of every rule column."""
    rules = [c for c in df.columns if c.startswith("rule_")]
    counts = df.agg(*(_count(F.col(c)).alias(f"n_{c}") for c in rules), *(_count(F.col(c) & (F.col(label) == 1)).alias(f"t_{c}") for c in rules))
    each = F.array(*(F.struct(F.lit(c[len("rule_") :]).alias("rule"), F.col(f"n_{c}").alias("n_flagged"), F.when(F.col(f"n_{c}") > 0, F.col(f"t_{c}") / F.col(f"n_{c}")).otherwise(0.0).alias("precision")) for c in rules))
    return counts.select(F.explode(each).alias("r")).select("r.*")


def score_distribution(df: DataFrame, score: str, by: str = "anomaly_type") -> DataFrame:
    three = lambda c, n: F.round(c, 3).alias(n)
    return df.groupBy(by).agg(three(F.avg(score), "mean"), three(F.percentile(score, 0.5), "p50"), three(F.percentile(score, 0.75), "p75"), three(F.max(score), "max"))


def percentiles(df: DataFrame, score: str, shares: list[float]) -> DataFrame:
    """One row, cuts: exact percentiles of the scores that are there, ascending, with steps between two values filled in evenly.

    Values are ranked by counts in score ranges side by side, so no task holds them all; NULL without a score.
    """
    ranked = by_score(df.select(F.col(score).alias("x"), F.lit(1).alias("y")), "x", "y").select("s", F.col("pos_below").alias("below"), "pos")
    total = ranked.agg(F.sum("pos").alias("n"))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(sorted(shares))))
    places = total.select(F.explode(F.when(F.col("n") > 0, wanted).otherwise(F.array())).alias("w"), "n").select("w.i", ((F.col("n") - 1) * F.col("w.q")).alias("at"))
    places = places.select("i", "at", F.floor("at").alias("lo"), F.ceil("at").alias("hi"))
    holds = lambda p: (F.col(p) >= F.col("below")) & (F.col(p) < F.col("below") + F.col("pos"))
    # a value meets the few places that fall on it
    at = ranked.join(F.broadcast(places), holds("lo") | holds("hi")).groupBy("i").agg(F.max(F.when(holds("lo"), F.col("s"))).alias("a"), F.max(F.when(holds("hi"), F.col("s"))).alias("b"), F.first(F.col("at") - F.col("lo")).alias("f"))
    cuts = at.agg(F.sort_array(F.collect_list(F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("x")))).alias("c"))
    return cuts.select(F.when(F.size("c") > 0, F.transform("c", lambda c: c["x"])).alias("cuts"))


def score_threshold(df: DataFrame, score: str, percent: float = 97.0) -> DataFrame:
    """One row, threshold: the exact percentile of the scores that are there."""
    return percentiles(df, score, [percent / 100.0]).select(F.col("cuts")[0].alias("threshold"))


def oracle_threshold(df: DataFrame, score: str, label: str, rule: str = "any_rule_flag") -> DataFrame:
    """One row, threshold and f1: the best of TRIED percentile thresholds of (score >= t or rule), the lowest of equals.

    Flagged rows of a rule count whatever the score. For the others, counts above a threshold are counts by number of
    thresholds passed, so the rows are read once and not once for each threshold.
    """
    percents = [(FROM_PERCENT + (TO_PERCENT - FROM_PERCENT) * i / (TRIED - 1)) / 100.0 for i in range(TRIED)]
    cuts = staged(percentiles(df, score, percents), "cuts")
    passed = F.expr(f"size(filter(cuts, c -> c <= {score}))")
    rule_said, true = F.coalesce(F.col(rule), F.lit(False)), F.col(label) == 1
    rows = df.crossJoin(F.broadcast(cuts)).select(F.when(rule_said, TRIED).when(F.col(score).isNull(), 0).otherwise(passed).alias("k"), true.alias("y"))
    by = rows.groupBy("k").agg(_count(F.col("y")).alias("pos"), _count(~F.col("y")).alias("neg"))  # TRIED + 1 rows at most
    total = by.agg(F.sum("pos").alias("P"))
    steps = cuts.select(F.posexplode("cuts").alias("i", "threshold"))
    at = steps.join(F.broadcast(by), F.col("k") > F.col("i"), "left").groupBy("i", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    scored = at.crossJoin(F.broadcast(total)).withColumn("f1", F.when(F.col("tp") > 0, F.col("tp") * 2.0 / (F.col("tp") + F.col("fp") + F.col("P"))).otherwise(0.0))
    return scored.orderBy(F.desc("f1"), "i").limit(1).select("threshold", "f1")
