"""EXPLAIN and PROFILE."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


def outlined(spark: SparkSession, clauses: list) -> DataFrame:
    """step, operator, details of a statement that writes or searches: its clauses in order. Nothing is run."""
    rows = [(i, type(k).__name__, repr(k)[:400]) for i, k in enumerate(clauses)]
    return spark.createDataFrame(rows, "step int, operator string, details string")


def explained(spark: SparkSession, steps: list[tuple[str, str]], df: DataFrame, profile: bool) -> DataFrame:
    """step, operator, details in order of building; at the end Spark's own plan. PROFILE runs the query and adds rows and milliseconds."""
    rows = [(i, a, b, None, None) for i, (a, b) in enumerate(steps)]
    counted, took = None, None
    if profile:
        began = time.monotonic()
        counted = df.count()
        took = round((time.monotonic() - began) * 1000, 1)
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    rows.append((len(rows), "Result", ", ".join(df.columns), counted, took))
    rows.append((len(rows), "SparkPlan", plan, None, None))
    out = spark.createDataFrame(rows, "step int, operator string, details string, rows long, ms double")
    return out if profile else out.drop("rows", "ms")
