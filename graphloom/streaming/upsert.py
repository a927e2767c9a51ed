"""Streams into a graph: idempotent ingest of micro-batches, windowed counts, and community refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import community


def deduplicated(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The stream with each external_id once within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["external_id"])


def upsert_into(path: str, key: str = "external_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows with new keys are appended to the Parquet table at path, in a folder for each batch.

    A batch that is run again writes the same folder again, so a restart leaves no duplicates. Known keys are left
    out by an anti-join against the other batches.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if fs.exists(jvm_path):
            schema = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
            known = spark.read.schema(schema).parquet(path).filter(F.col("batch") != number)
            rows = rows.join(known.select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events in tumbling windows by a column; rows later than the watermark's delay don't count."""
    out = stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), by, "n")


def communities_of(path: str, edges_of: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: after every batch the memberships of the edges so far are written as snapshot <batch>."""

    def sink(batch: DataFrame, number: int) -> None:
        all_edges = edges_of(batch)
        community.refresh(community.undirected(all_edges), number).write.mode("overwrite").parquet(f"{path}/snapshot={number}")

    return sink
