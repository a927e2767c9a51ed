"""Sharding by the longest-processing-time rule: groups that must stay together go, by falling size, to the
least-loaded shard.

Groups are rows with equal texts (null texts form one group). Their sizes are counted in classes: exact sizes
below 65,536 bytes, and classes 1/1024 wide above, so there are under 115,000 classes whatever the input.
Only that histogram reaches the driver. There a heap hands out small classes group by group, and the groups of
a large class, which are all of one size, by filling the shards up to one level, which is what the heap would do.
The result is a list of intervals over the groups in order of (class, key); every group finds its shard by its
position in a distributed sort. The heap takes a large class's mean size for each of its groups, so a shard's load is known to
within 1/1024 of what it holds in such groups; smaller ones are exact. A group larger than a shard's fair share makes its shard uneven: it can't be split.

Empty input gives no rows. Ties are broken by the text's hash, and rows in a shard are numbered by doc_id,
so reruns agree.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, save

FINE = 1 << 16


def size_class() -> str:
    """SQL for the class of the long w."""
    return f"CASE WHEN w < {FINE} THEN w ELSE {FINE} + (length(bin(w)) - 17) * 1024 + shiftright(w, length(bin(w)) - 11) - 1024 END"


def schedule(classes: Sequence[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """(groups, total size) of each class in falling order of size -> (first position, shard) of intervals."""
    heap = [(0.0, s) for s in range(shards)]
    intervals: list[tuple[int, int]] = []
    at = 0

    def give(shard: int, n: int) -> None:
        nonlocal at
        if n:
            if not intervals or intervals[-1][1] != shard:
                intervals.append((at, shard))
            at += n

    for n, total in classes:
        each = total / n
        if n > 4 * shards:
            loads = np.array([load for load, _ in heap])
            low, high = loads.min(), loads.max() + each * (n + 1)
            for _ in range(100):
                level = (low + high) / 2
                if np.maximum(0, (level - loads) // each).sum() <= n:
                    low = level
                else:
                    high = level
            counts = np.maximum(0, (low - loads) // each).astype(int)
            for (load, shard), m in sorted(zip(heap, counts.tolist()), key=lambda x: x[0][1]):
                give(shard, m)
            heap = [(load + m * each, shard) for (load, shard), m in zip(heap, counts.tolist())]
            heapq.heapify(heap)
            n -= int(counts.sum())
        for _ in range(n):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + each, shard))
            give(shard, 1)
    return intervals


def _numbered(df: DataFrame, name: str, *order) -> Saved:
    """A distributed sort; pid and idx are a row's partition and its place in it."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    return save(ordered.select("*", F.shiftright(mid, 33).cast("int").alias("pid"), mid.bitwiseAND((1 << 33) - 1).alias("idx")), name)


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, shard and slot of every row."""
    return assign(docs.select("doc_id", *measures()), shards)


def measures(t=None) -> list:
    """size, text_crc32 and key (its md5; of a null text the empty string) of a text column."""
    t = F.col("text") if t is None else t
    return [
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(t.cast("binary"))), F.lit(b"")).alias("key"),
    ]


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """Adds shard and slot to rows that have doc_id, size and key; drops key. All other columns stay."""
    spark = rows.sparkSession
    groups = rows.groupBy("key").agg(F.sum("size").alias("w")).withColumn("cls", F.expr(size_class()))
    placed = _numbered(groups, "lpt-groups", F.col("cls").desc(), F.col("key"))
    histogram = placed.df.groupBy("cls").agg(F.count("*").alias("n"), F.sum("w").alias("w")).orderBy(F.desc("cls")).collect()
    intervals = schedule([(r.n, r.w) for r in histogram], shards)
    parts = {r.pid: r["count"] for r in placed.df.groupBy("pid").count().collect()}
    starts = np.zeros(max(parts, default=0) + 2, dtype=np.int64)
    for pid, n in parts.items():
        starts[pid + 1] = n
    known = spark.sparkContext.broadcast((np.cumsum(starts), np.array([a for a, _ in intervals]), np.array([s for _, s in intervals], dtype=np.int32)))

    @F.pandas_udf("int")
    def shard_of(pid, idx):
        first, at, which = known.value
        return pd.Series(which[np.searchsorted(at, first[pid.to_numpy()] + idx.to_numpy(), side="right") - 1])

    shard_by_key = placed.df.select("key", shard_of("pid", "idx").alias("shard"))
    laid = _numbered(rows.join(shard_by_key, "key").drop("key"), "lpt-rows", "shard", "doc_id", "size", *(["text_crc32"] if "text_crc32" in rows.columns else []))
    placed.drop()
    runs = laid.df.groupBy("shard", "pid").agg(F.count("*").alias("n"), F.min("idx").alias("first")).orderBy("shard", "pid").collect()
    shift, done = [], dict.fromkeys(range(shards), 0)
    for r in runs:  # one row for each partition and one more for each shard
        shift.append((r.shard, r.pid, done[r.shard] - r.first))
        done[r.shard] += r.n
    base = spark.createDataFrame(shift, "shard int, pid int, shift long")
    return laid.df.join(F.broadcast(base), ["shard", "pid"]).withColumn("slot", F.col("idx") + F.col("shift")).drop("pid", "idx", "shift")


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
