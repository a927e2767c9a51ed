"""BM25 text search without an index: one pass for the statistics, one for the scores, no shuffle of texts."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
MAX_TOKEN_BYTES = 40


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; longer ones than MAX_TOKEN_BYTES are left out."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda t: (t != "") & (F.octet_length(t) < MAX_TOKEN_BYTES))


def query_parts(query: str) -> list[tuple[str, ...]]:
    """Words of the query; one that holds several tokens is a phrase. No character has a special meaning."""
    parts = []
    for word in query.split():
        ts = tuple(t for t in re.split(r"[\W_]+", word.lower()) if t and len(t.encode()) < MAX_TOKEN_BYTES)
        if ts:
            parts.append(ts)
    return parts


def _frequency(ts: Column, part: tuple[str, ...]) -> Column:
    if len(part) == 1:
        return F.size(F.filter(ts, lambda t: t == part[0]))
    n = F.size(ts) - len(part)
    starts = F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:  # get() reads one element; slice() would copy the whole array for each place
        out = F.get(ts, i) == part[0]
        for j, word in enumerate(part[1:], 1):
            out = out & (F.get(ts, i + j) == word)
        return out

    return F.size(F.filter(starts, here))


def bm25(table: DataFrame, query: str, k: int | None = None) -> DataFrame:
    """_id, score of the rows of (_id, body) that match a part of the query, best first. k 0 or no words: no rows."""
    parts = query_parts(query)
    if not parts or k == 0:
        return table.select("_id", F.lit(0.0).alias("score")).limit(0)
    docs = table.filter(F.col("body").isNotNull()).select("_id", tokens(F.col("body")).alias("ts"))
    words = sorted({t for p in parts for t in p})
    stats = docs.agg(F.count("*").alias("n"), F.sum(F.size("ts")).alias("length"), *(F.sum(F.array_contains("ts", w).cast("long")).alias(f"df{i}") for i, w in enumerate(words))).first()
    n, average = stats["n"], (stats["length"] or 0) / max(stats["n"], 1)
    idf = {w: math.log(1 + (n - (stats[f"df{i}"] or 0) + 0.5) / ((stats[f"df{i}"] or 0) + 0.5)) for i, w in enumerate(words)}
    total, any_hit = F.lit(0.0), F.lit(False)
    # one lambda holds all uses of the tokens; else the optimizer would tokenise again inside of each of them
    measured = F.transform(F.array(tokens(F.col("body"))), lambda ts: F.struct(F.size(ts).alias("dl"), *(_frequency(ts, p).alias(f"f{i}") for i, p in enumerate(parts))))
    scored = table.filter(F.col("body").isNotNull()).select("_id", F.explode(measured).alias("m")).select("_id", "m.*")
    for i, p in enumerate(parts):
        f = F.col(f"f{i}")
        total = total + sum(idf[t] for t in p) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(average or 1.0)))
        any_hit = any_hit | (f > 0)
    out = scored.filter(any_hit).select("_id", total.alias("score")).orderBy(F.desc("score"), "_id")
    return out if k is None else out.limit(k)
