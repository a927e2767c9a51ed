"""The registered queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.star import star_graph
from .api import API
from .language import LANGUAGE


def _language(text: str, params: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: star_graph(spark, sf_dir).query(text, params)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _language(text, params) for n, (text, _, params) in LANGUAGE.items()} | {n: f for n, (f, _) in API.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql, _) in LANGUAGE.items() if sql} | {n: sql for n, (_, sql) in API.items() if sql}
