"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, sources are mixed to
target weights, and what is taken is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet, and read as docs of
the next. All but the last return the columns of documents.

Defined results, whatever the ids are: stages decide row by row, never by joining on doc_id. Rows without an id, and
rows that share one, are documents of their own. Null and empty texts have the score of texts without words, are in no group of
near duplicates (all of them stay), and are taken 0 times by the mix, which counts words. Of equal rows, one stays beside the
others' group. An empty table gives an empty table; other columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import bpe, mixing, neardup, toxicity
from wakeline.llm.common import documents, settle, spare, stage, with_ids


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; labels come from rows that aren't held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    prefix = spare(docs.columns, "_toxic_")
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), prefix=prefix)
    del model  # executors have it
    settle(spark)
    return scored.filter(F.col(f"{prefix}predicted") == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id (none comes last), among these of the least hash of its columns."""
    row = f"{spare(docs.columns, '_near_')}row"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    found = neardup.near_duplicates(rows, id_col=row, size=5).filter("n_shingles > 0").select(F.col("doc_id").alias("found"), "component_id")
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()))
    place = rows.select(F.col(row).alias("row"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), hashed, F.col(row).alias("row")).alias("place"))
    found = stage(found.join(place, F.col("found") == F.col("row")).select("component_id", "place", "row"), "pipeline-groups")
    best = found.groupBy("component_id").agg(F.min("place").alias("best")).select(F.col("best.row").alias("best"))
    gone = stage(found.join(best, F.col("row") == F.col("best"), "left_anti").select(F.col("row").alias("id")), "pipeline-gone")
    return with_ids(rows, row, gone, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as many times as the mix takes it."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_duplicates), ("mixing", mix_sources), ("byte-bpe", encode)]

#: No SQL for the toxicity model and the encoding; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
