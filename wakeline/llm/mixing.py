"""Mixing sources to target weights by capped water-filling.

targets() turns source sizes and weights into targets: every source gets a share by weight, sources that
would pass max_epochs times their own size are clamped there, and the excess is shared again by weight
until none is above. That fixed point is min(cap, level * weight) for one level, found by sorting sources
by cap / weight and summing from the tight end, so no loop is needed.

mix() then samples: each row is taken floor(target / source_size) times, and the fractional epoch takes the
rows with the smallest seeded draw until their words fill it. The cut in the draws comes from a histogram
by source of the draw's leading bits. Only rows in the one bin that the cut falls in are put in order: dealt to
tasks by ranges of (draw, id, size, text, row), with running sums inside and offsets between them, so that neither a hot
source nor many rows of one id (or none) meet in one task. repeated() gives whole rows as often as the mix takes them;
texts are not shuffled for it.

Defined results: null or empty texts have size 0 and are taken 0 times in words; a null source is a source
(the last); sources of size 0 have target 0; repeated rows are rows of their own; rows without an id have the same draw
and are ordered by size and text; an empty table gives an empty table; columns of the input other than id, text and source don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, stage

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = "mix-1"
#: Bits of a draw, and those that choose its histogram bin.
DRAW_BITS, BIN_BITS = 52, 12
#: Source tables of up to so many rows are broadcast; beyond it Spark chooses the join.
BROADCAST_SOURCES = 10_000
#: Rows of a cut bin that one task puts in order.
EDGE_ROWS = 65_536
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A seeded number below 2**DRAW_BITS: the same for the same id in any run and on any machine."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from one row per source with source and source_size.

    The windows without a key run over one row per source; sources are a configuration, not data rows.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    tight = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below, rest, whole = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(0, Window.unboundedFollowing), tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = capped.select(
        "*",
        ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(rest)).alias("level"),
    )
    # the first source in this order whose cap is not reached fixes the level of it and of all after it
    free = filled.withColumn("free", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")))
    fixed = free.withColumn("level", F.first("free", ignorenulls=True).over(whole))
    return fixed.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _with_sources(rows: DataFrame, table: DataFrame, few: bool, *more: str) -> DataFrame:
    table = table.withColumnRenamed("source", "_source")
    on = F.col("source").eqNullSafe(F.col("_source"))
    for c in more:
        table = table.withColumnRenamed(c, f"_{c}")
        on = on & (F.col(c) == F.col(f"_{c}"))
    return rows.join(F.broadcast(table) if few else table, on, "left").drop("_source", *[f"_{c}" for c in more])


def _edge(inside: DataFrame) -> DataFrame:
    """row, upto: the words up to each row of its source's cut bin, itself included, in order."""
    order = ["draw", "id", "size", "tie", "row"]
    tasks = -(-max(1, inside.count()) // EDGE_ROWS)
    dealt = stage(inside.repartitionByRange(tasks, "source", *order).withColumn("task", F.spark_partition_id()), "mix-edge")
    # one row for each source and task
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("source", "task").agg(F.sum("size").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    offsets = offsets.select(F.col("source").alias("s"), F.col("task").alias("t"), "offset")
    inner = Window.partitionBy("source", "task").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.select("source", "task", "row", F.sum("size").over(inner).alias("words"))
    return within.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("task") == F.col("t"))).select("row", (F.col("words") + F.col("offset")).alias("upto"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, max_epochs: float, seed: str, keep: tuple[str, ...]) -> DataFrame:
    """id, source, size, source_size, target, repeats of every row, and `kept`, a struct of the columns to keep."""
    bins = 1 << BIN_BITS
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = stage(
        docs.select(
            id_.alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"), draw(id_, seed).alias("draw"), F.xxhash64(text).alias("tie"),
            F.struct(F.lit(None).cast("int"), *(F.col(f"`{c}`") for c in keep)).alias("kept"), F.monotonically_increasing_id().alias("row"),
        ).withColumn("bin", F.shiftright("draw", DRAW_BITS - BIN_BITS).cast("int")),
        "mix-rows",
    )
    histogram = stage(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mix-histogram")
    sources = stage(targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs), "mix-targets")
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = sources.select("*", F.floor(rate).alias("whole")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))

    # at most `bins` rows of a source meet in this window
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        _with_sources(histogram, plan, few).withColumn("upto", F.sum("words").over(running))
        .filter(F.col("upto") >= F.col("need")).groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
        .select("source", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"))
    )
    plan = stage(_with_sources(plan, cut, few), "mix-plan")
    planned = _with_sources(rows, plan, few)
    inside = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    outside = planned.filter(~inside).withColumn("extra", F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(True)))
    ordered = _edge(planned.filter(inside).select("source", "draw", "id", "size", "tie", "row")).withColumnRenamed("row", "row_")
    between = planned.filter(inside).join(ordered, F.col("row") == F.col("row_")).withColumn("extra", F.col("before") + F.col("upto") - F.col("size") / 2.0 <= F.col("need")).drop("row_", "upto")
    out = outside.unionByName(between)
    # a whole number of epochs needs no extra row
    repeats = (F.col("whole") + F.when(F.col("extra") & (F.col("need") > 0) & (F.col("size") > 0), 1).otherwise(0)).cast("long")
    return out.select("id", "source", "size", "source_size", "target", repeats.alias("repeats"), "kept")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats (times the mix takes the row), taken (words it takes)."""
    out = _mixed(docs, id_col, text_col, source_col, weights, max_epochs, seed, ())
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Every row of docs as many times as the mix takes it, with the columns of docs."""
    out = _mixed(docs, id_col, text_col, source_col, weights, max_epochs, seed, tuple(docs.columns)).filter("repeats > 0")
    turns = out.select("kept", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return turns.select(*(F.col("kept").getField(c).alias(c) for c in docs.columns))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "repeats")


_WEIGHT_SQL = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"

#: The same mix over a table given as {docs}; levels are tried one by one, for every source as the first one free.
MIX_SQL = f"""
rows_ AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|{SEED}'), 1, {DRAW_BITS // 4}))::BIGINT AS draw FROM {{docs}}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source),
weighted AS (SELECT *, {_WEIGHT_SQL} AS weight, {MAX_EPOCHS}::DOUBLE * source_size AS cap FROM sizes),
levels AS (SELECT a.source, any_value(a.cap / a.weight) AS ratio,
  ((SELECT sum(source_size) FROM sizes)::DOUBLE - coalesce(sum(CASE WHEN b.cap / b.weight < a.cap / a.weight THEN b.cap END), 0.0)) / sum(CASE WHEN b.cap / b.weight >= a.cap / a.weight THEN b.weight END) AS level
  FROM weighted a, weighted b GROUP BY a.source),
level AS (SELECT min_by(level, ratio) AS level FROM levels WHERE ratio > level),
targets AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM weighted, (SELECT (SELECT level FROM level) AS level)),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
run_ AS (SELECT r.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
  sum(r.size) OVER (PARTITION BY r.source ORDER BY r.draw, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows_ r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
mixed AS (SELECT *, (whole + CASE WHEN need > 0 AND size > 0 AND upto - size / 2.0 <= need THEN 1 ELSE 0 END)::BIGINT AS repeats FROM run_)
"""

OP1_SQL = f"WITH {MIX_SQL.format(docs='documents')} SELECT doc_id, size, source_size, target, (repeats * size)::BIGINT AS taken, repeats FROM mixed"
