"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items.

Items and documents are taken as sequences of words (lower-cased, punctuation dropped). Every run of `width`
words of an item is a window; an item of fewer words is one window. The automaton's letters are the
benchmark's words, so a document is read once, and matches are offsets in words, which are mapped back to
character offsets in the original text.

The benchmark is collected to the driver only in blocks of a checked size (`block_windows`); one block is the
usual case and needs no shuffle. Beyond that the documents are scanned once a block, and the blocks' hits are
merged by row. Null or empty texts, on either side, have no words: nothing is hit. An empty benchmark hits
nothing. Items with a null id mark words but are not listed. Repeated rows each get a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, keep_rows, map_rows, real_words, save

WIDTH = 10
#: Windows in one automaton (about 0.5 KB each).
BLOCK_WINDOWS = 200_000


def windows(items: Iterable[tuple[str | None, str | None]], width: int) -> dict[tuple[bytes, ...], set]:
    found: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        ws = real_words(text)
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            found.setdefault(tuple(ws[i : i + width]), set()).add(item)
    return found


class Automaton:
    """Finds windows in a sequence of words."""

    def __init__(self, found: dict[tuple[bytes, ...], set]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ws, items in found.items():
            self.automaton.add_word(tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws), (len(ws), tuple(items)))
        if found:
            self.automaton.make_automaton()

    def hits(self, ws: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged half-open word ranges, and the items."""
        ids = tuple(map(self.vocabulary.get, ws, (0,) * len(ws))) if self.vocabulary else ()
        ranges: list[list[int]] = []
        items: set = set()
        for end, (length, own) in self.automaton.iter(ids) if ids else ():
            items.update(own)
            start = end - length + 1
            while ranges and ranges[-1][0] >= start:
                ranges.pop()
            if ranges and ranges[-1][1] >= start:
                ranges[-1][1] = end + 1
            else:
                ranges.append([start, end + 1])
        return ranges, items


def char_ranges(text: str, ranges: list[list[int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of word ranges."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = raw.translate(WORD_BYTES)
    bounds, at = [], 0
    for w in flat.split(b" "):
        if w:
            bounds.append((at, at + len(w)))
        at += len(w) + 1
    chars = lambda n: len(raw[:n].decode("utf-8", "surrogatepass"))
    return [(chars(bounds[a][0]), chars(bounds[b - 1][1])) for a, b in ranges]


SCHEMA = "row long, doc_id {id}, n_words long, ranges array<array<int>>, items array<string>, spans array<array<int>>"


def _scan(docs: DataFrame, found: dict) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def make():
        automaton = Automaton(shared.value)

        def run(rows: dict) -> list:
            out: list[list] = [[] for _ in range(6)]
            for row, doc_id, text in zip(rows["row"], rows["doc_id"], rows["text"]):
                ws = real_words(text)
                ranges, items = automaton.hits(ws)
                for column, x in zip(out, (row, doc_id, len(ws), ranges, sorted(i for i in items if i is not None), char_ranges(text, ranges) if ranges else [])):
                    column.append(x)
            return out

        return run

    return map_rows(docs, make, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _blocks(benchmark: DataFrame, width: int, block_windows: int) -> Iterator:
    """The number of blocks, then each: the windows of some items. Their size is bounded before anything is collected."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t"))
    total = items.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0  # a word takes two characters with its space
    blocks = int(total // block_windows) + 1
    yield blocks
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        yield windows(part.toLocalIterator(), width)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, ranges (merged word ranges), items (sorted ids as strings), spans (character ranges)."""
    blocks = _blocks(benchmark, width, block_windows)
    n = next(blocks)
    if n == 1:
        return _scan(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), next(blocks)).drop("row")
    rows = save(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontaminate")
    parts = None
    for own_windows in blocks:  # the driver holds one block at a time
        own = save(_scan(rows.df, own_windows), "decontaminate-hits").df
        parts = own if parts is None else parts.unionByName(own)
    merged = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("ranges", "items", "spans")))
    join = lambda c: F.aggregate(
        F.array_sort(c), F.lit(None).cast("array<array<int>>"),
        lambda acc, r: F.when(acc.isNull(), F.array(r)).when(r[0] > F.element_at(acc, -1)[1], F.concat(acc, F.array(r)))
        .otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], r[1]))))),
    )
    return merged.select("doc_id", "n_words", F.coalesce(join(F.col("ranges")), F.array().cast("array<array<int>>")).alias("ranges"), F.array_sort("items").alias("items"), F.array_sort("spans").alias("spans"))


def digest(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows in which no window occurs, with all their columns. A row filter: no shuffle, whatever the benchmark's size."""
    blocks = _blocks(benchmark, width, block_windows)
    next(blocks)
    for found in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def make(shared=shared):
            automaton = Automaton(shared.value)
            return lambda texts: [not automaton.hits(real_words(t))[0] for t in texts]

        docs = keep_rows(docs, "text", make)
    return docs
