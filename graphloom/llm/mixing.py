"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Targets: the sources, ordered by code point with null last, weigh 5, 2, 1 in turn and share 150 % of all
words; no target exceeds twice its source, and what that frees is shared by weight again. That is a water level:
a target is min(weight * level, 2 * size), and the level follows from sums over the sources sorted by size / weight.

Schedule: slot i of a block of words has the point frac((i + 1/2) * golden ratio), in 64-bit fixed point; the point's place in the
cumulated targets names the source. Slots are ranked per source, and rank k takes block k of the source's
shuffled text: its documents in order of a hash of doc_id and text, end to end, twice over. The words that the mix takes of a document
are those of its pieces whose block joins a slot.

Sums along a source are made in two levels (runs, then inside a run, about the square root of the rows of each), so that no task
holds a whole source, whatever its share. Only tables with one row a source or run go through one task. Null texts
and texts without words have size 0 and are taken 0 times; an empty table gives no rows. Rows with the same
doc_id and text are told apart by their size only: equal ones may stand for each other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved, save

SHARE, CAP = 1.5, 2
BLOCK_WORDS = 64
#: The golden ratio's fraction, and half of it, of 2 ** 64.
GOLDEN, HALF, WHOLE = 0x9E3779B97F4A7C15, 0x4F1BBCDCBFA53E0A, 1 << 64
#: Least rows in a run of the hash, cells of the grid that maps points to sources, and least slots in a run.
RUN_ROWS, CELLS, RUN_SLOTS = 1024, 4096, 4096
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> source, number (its place in order), source_size, weight, target, low, high. One row a source."""
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", F.col("source").asc_nulls_last())
    s = sizes.withColumn("number", F.row_number().over(by_name))
    s = s.withColumn("weight", F.when(F.col("number") % 3 == 1, 5).when(F.col("number") % 3 == 2, 2).otherwise(1).cast("long"))
    s = s.withColumn("fill", F.lit(CAP) * F.col("source_size") / F.col("weight"))
    everything, before = Window.partitionBy(), by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*", (F.lit(SHARE) * F.sum("source_size").over(everything)).alias("total"), F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    # the level if all sources before this one are full and no other; each such line lies above the true sum of
    # targets, so the true level is the greatest of them
    level = (F.col("total") - F.lit(CAP) * F.col("size_before")) / (F.col("weights") - F.col("weight_before")).cast("double")
    s = s.withColumn("level", F.max(level).over(everything))
    full = F.col("fill") <= F.col("level")
    s = s.withColumn("target", F.when(full, (F.lit(CAP) * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("level")))
    high = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    return s.select("source", "number", "source_size", "weight", "target", F.coalesce(F.lag(high).over(by_name), F.lit(0.0)).alias("low"), high.alias("high"))


def slots(plan: DataFrame, block_words: int) -> DataFrame:
    """slot, number (its source) and block (its rank in the source) of every slot; plan is from targets()."""
    total = plan.agg(F.max("high")).first()[0] or 0.0
    n = math.ceil(total / block_words)
    if not n:
        return plan.select(F.lit(0).cast("long").alias("slot"), "number", F.lit(0).cast("long").alias("block")).limit(0)
    fixed = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    x = F.pmod(F.col("slot").cast("decimal(18,0)") * fixed(GOLDEN) + fixed(HALF), fixed(WHOLE)).cast("double")
    points = plan.sparkSession.range(n).withColumnRenamed("id", "slot").withColumn("x", x / F.lit(float(WHOLE)) * F.lit(total))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS / total))
    cell = lambda c: F.floor(F.col(c) * CELLS / total)
    spans = plan.filter("high > low").select("number", "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    schedule = points.join(spans, (points.cell == spans.cell) & (points.x >= spans.low) & (points.x < spans.high))
    schedule = schedule.select("slot", "number", F.floor(F.col("slot") / max(RUN_SLOTS, math.isqrt(n))).alias("run"))
    runs = schedule.groupBy("number", "run").count()
    ahead = F.sum("count").over(Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    s = schedule.join(runs.select("number", "run", F.coalesce(ahead, F.lit(0)).alias("ahead")), ["number", "run"])
    return s.select("slot", "number", (F.col("ahead") + F.row_number().over(Window.partitionBy("number", "run").orderBy("slot")) - 1).alias("block"))


def placed(rows: DataFrame) -> DataFrame:
    """Adds start: the words of the source that stand before the row in its shuffled order. rows has doc_id, number, size, h."""
    n = rows.count()
    bits = min(30, (n // max(RUN_ROWS, math.isqrt(n))).bit_length())
    r = rows.withColumn("run", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - bits))
    runs = r.groupBy("number", "run").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("size").over(Window.partitionBy("number", "run").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("inside", F.coalesce(inside, F.lit(0)))
    r = r.join(runs.select("number", "run", F.coalesce(ahead, F.lit(0)).alias("ahead")), ["number", "run"])
    return r.withColumn("start", F.col("ahead") + F.col("inside")).drop("run", "ahead", "inside")


def measured(docs: DataFrame, row=None) -> Saved:
    """row (a number), doc_id, source, size and h (the shuffle's hash), written, so that texts are read once."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.monotonically_increasing_id() if row is None else row
    return save(docs.select(row.alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.concat(text("doc_id"), F.lit("|"), text("text")).cast("binary")).alias("h")), "mix")


def scheduled(docs: DataFrame, block_words: int, row=None) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, source, size, number, source_size, target, start) and slots."""
    rows = measured(docs, row).df
    plan = save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-plan").df
    own = plan.select(F.col("source").alias("_s"), "number", "source_size", "target")
    return placed(rows.join(own, rows.source.eqNullSafe(own["_s"])).drop("_s")), slots(plan, block_words)


def turns(rows: DataFrame) -> DataFrame:
    """A row for each turn through the source: words from `from` to `to`, of its text written end to end twice."""
    r = rows.filter("size > 0").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    return r.withColumn("from", F.col("start") + F.col("turn") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))


def pieces(rows: DataFrame, schedule: DataFrame, block_words: int) -> DataFrame:
    """The pieces of documents in the blocks that the schedule takes."""
    b = F.lit(block_words)
    r = turns(rows)
    r = r.select("*", F.explode(F.sequence(F.floor(F.col("from") / b), F.floor((F.col("to") - 1) / b))).alias("block"))
    lo, hi = F.greatest(F.col("from"), F.col("block") * b), F.least(F.col("to"), (F.col("block") + 1) * b)
    r = r.select("row", "number", "source", "block", "doc_id", (lo - F.col("from")).alias("first_word"), (hi - lo).alias("words"))
    return r.join(schedule, ["number", "block"])


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of every row."""
    rows, schedule = scheduled(docs, block_words)
    rows = save(rows, "mix-rows").df
    words = pieces(rows, schedule, block_words).groupBy("row").agg(F.sum("words").alias("words"))
    return rows.join(words, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: slot, source, block, doc_id, first_word and words, a row for each piece of a document in a block."""
    return pieces(*scheduled(docs, block_words), block_words).select("slot", "source", "block", "doc_id", "first_word", "words")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Whole documents: a row appears once for each turn in which a slot takes the block of its first word. Columns stay.

    Rows of size 0 take no words; they are left out.
    """
    whole = save(docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "source", "text", F.monotonically_increasing_id().alias("row")), "mix-docs")
    rows, schedule = scheduled(whole.df, block_words, F.col("row"))
    first = turns(rows).select("row", "number", F.floor(F.col("from") / block_words).alias("block"))
    chosen = first.join(schedule, ["number", "block"]).groupBy("row").agg(F.count("*").cast("int").alias("times"))
    return whole.df.select("whole", "row").join(chosen, "row").select("whole", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn")).select("whole.*")
