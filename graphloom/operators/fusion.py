"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """key, score: the sum of 1 / (k + rank), ranks from 1 by falling score, ties by key.

    The lists are top-k results, so a rank needs only a window over k rows.
    """
    out = None
    for df in lists:
        rank = F.row_number().over(Window.orderBy(F.desc("score"), key))
        part = df.select(key, (1.0 / (F.lit(k) + rank)).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), key)


def hybrid_search(graph, labels: list[str], text: str | None = None, vector: list[float] | None = None, prop: str = "text", vector_prop: str = "embedding", k: int = 10, principals: list[str] | None = None, rrf_k: int = 60) -> DataFrame:
    """_id, score: text search, vector search, or both fused. Labels and rights are filtered before ranking, so the k
    best visible nodes come out exactly."""
    from .text import bm25
    from .vector import top_k

    g = graph.restricted(principals) if principals is not None else graph
    found = []
    if vector is not None:
        found.append(top_k(g.scan(labels, [vector_prop]), "_id", vector_prop, vector, k))
    if text is not None:
        found.append(bm25(g.scan(labels, [prop]).select("_id", F.col(prop).alias("body")), text, k))
    if not found:
        raise ValueError("a text or a vector is needed")
    return found[0] if len(found) == 1 else rrf(found, "_id", rrf_k).limit(k)
