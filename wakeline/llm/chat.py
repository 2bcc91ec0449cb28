"""Chat formatting with cumulative-snapshot collapse. DataFrame functions only.

Logs hold a conversation again and again as it grows. Every turn gets the hash of all turns up to it: a running sum
over the conversation of hashes of (place, role, text), three of HASH_BITS bits each, so a prefix's hash needs no
list of its turns. A conversation whose hash over all turns is a proper prefix hash of another is dropped by an
anti-join against the distinct prefix hashes; of equal conversations the smallest id stays. What stays is rendered.

Distinct prefix hashes are made by grouped aggregation, which combines before the shuffle, so a first turn or a whole
conversation that a third of all logs share costs one row a task. Texts are shuffled once, and only those of
conversations that stay. A conversation is one row of the result, so it must fit in one.

Defined results: turns are in order of turn (null first), then role, then text, so repeated turns stay and count;
null role and text render as nothing, but differ from empty ones; rows without conv_id belong to no conversation and
aren't read; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

#: Sums of so many bits stay within 64 bits for conversations of 2**23 turns.
HASH_BITS = 40


def collapse(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place, and (conv_id, n_turns, copies) of the conversations that stay."""
    turns = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumn("place", F.row_number().over(order))
    each = [F.xxhash64(F.lit(k), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text").bitwiseAND(F.lit((1 << HASH_BITS) - 1)) for k in range(3)]
    hashed = placed.select("conv_id", "place", *(x.alias(f"e{k}") for k, x in enumerate(each)))
    running = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    # the same partitioning, so this needs no second shuffle
    prefix = stage(hashed.select("conv_id", "place", *(F.sum(f"e{k}").over(running).alias(f"h{k}") for k in range(3)), F.lead("place").over(Window.partitionBy("conv_id").orderBy("place")).isNull().alias("last")), "chat-prefixes")
    key = ["place", "h0", "h1", "h2"]
    whole = prefix.filter("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = prefix.filter("not last").select(*key).distinct()
    stays = stage(whole.join(inner, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "copies"), "chat-stays")
    return placed, stays


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, text of maximal conversations."""
    _, stays = collapse(conversations)
    turns = conversations.select("conv_id", "turn", "role", "text").join(stays.select("conv_id"), "conv_id", "left_semi")
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    piece = lambda x: F.concat(F.lit("<|im_start|>"), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit("<|im_end|>\n"))
    text = listed.select("conv_id", F.array_join(F.transform("turns", piece), "").alias("text"))
    return text.join(stays, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "copies", "text")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, place, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
whole AS (SELECT min(conv_id) AS conv_id, place AS n_turns, count(*) AS copies, upto AS text FROM r WHERE place = n GROUP BY place, upto)
SELECT conv_id, n_turns, copies, text FROM whole w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.place < r.n AND r.place = w.n_turns AND r.upto = w.text)
"""
