"""The corpus pipeline: quality, near duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared folder
and reads it again as the next stage's docs, so a lost executor costs part of one stage. A stage's own tables are dropped
once its result is written, and so is the result before.

Every stage takes empty tables, null and repeated ids, null and empty texts, and further columns of any name; these pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, mixing, near_dedup, quality, sharding
from graphloom.llm.common import save, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.kept(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix of sources reaches them: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard (0 to 15) and slot; copies stand in one shard.

    Where docs has a column of such a name, it stays and the new one gets a trailing underscore.
    """
    whole = save(docs.select(F.struct(*docs.columns).alias("whole"), F.monotonically_increasing_id().alias("row")), "shard-docs").df
    rows = whole.select("row", F.col("whole.doc_id").alias("doc_id"), *sharding.measures(F.col("whole.text")))
    out = whole.join(sharding.assign(rows, 16).select("row", "size", "shard", "slot"), "row")  # texts move once
    new, taken = [], set(docs.columns)
    for c in ("size", "shard", "slot"):
        name = c
        while name in taken:
            name += "_"
        taken.add(name)
        new.append(F.col(c).alias(name))
    return out.select(*(F.col("whole").getField(c).alias(c) for c in docs.columns), *new)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can express neither the quality classifier nor the near duplicates of all its rows: tests/test_pipeline.py holds
#: every stage, and run() itself, against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch():
            written = save(stage(spark, docs, sf_dir), f"pipeline-{name}").keep()
        if before:
            before.drop()
        before, docs = written, written.df
    return docs
