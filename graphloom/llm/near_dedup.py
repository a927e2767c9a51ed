"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct shingles of `width` words (fewer words: the sequence as one; none: empty). Its
signature has SYMBOLS b-bit symbols, the low bits of that many min-hashes; the distance of two signatures is the
number of symbols that differ. The signature is split into CHUNKS chunks. If two signatures differ in at most
2 * CHUNKS - 1 symbols, some chunk has at most one error (pigeonhole), so each chunk is indexed under every
way to leave one symbol out. All pairs within that distance share a key, and a pair with Jaccard similarity
0.8 shares none with a probability of about 1e-7: that is all that can be lost. Pairs that share a key are candidates, and are
confirmed on their full sets, as 64-bit hashes of the shingles.

The pairs of a group are never emitted:

* Documents with one set are a class (a 128-bit hash of the set), and only one row of each is indexed.
* A task looks up its own keys in blocks of BLOCK classes and sends each key once, for the block's first class that has it; so
  a frequent key is one row a block.
* Stars: the first class of a key is held against the others of its block or, for blocks, of the key. The links make components.
* Keys whose classes are then in several components are searched for the rest: those outside of a key's main component
  are put into blocks of neighbours, and a block is held against every class that shares a key with one of it. What is
  joined are rows (block, class), never pairs; the sets of a block stay in a task while the others stream by.

So a pair that shares a key is either in one component already or compared.

The component's id is the smallest doc_id in it. Rows with a null id get it too, if other rows of their component have an id,
else null (and are kept). Null and empty texts have an empty set and stand alone. Repeated rows each get a row. doc_id can have any type that
has an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import Saved, save
from .linking import components, composed

SYMBOLS, CHUNKS = 60, 12
PER_CHUNK = SYMBOLS // CHUNKS
#: Classes whose keys are looked up at once; keys of a partition; classes of a block in the last search, and others in a cell.
BLOCK, PART_KEYS, NEIGHBOURS, CELL = 16384, 1 << 20, 512, 512
_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    g = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
        g ^= g >> np.uint64(31)
    g *= np.uint64(0x94D049BB133111EB)
    return np.unique(g ^ (g >> np.uint64(29)))


def shingles(text: str | None, width: int) -> set:
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return set(zip(*(ws[i:] for i in range(width)))) if len(ws) >= width else {tuple(ws)} if ws else set()


def signature(h: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols of 16 bits."""
    least = np.full(SYMBOLS, ~np.uint64(0))
    for at in range(0, len(h), 2048):
        np.minimum(least, (h[at : at + 2048, None] * MULTIPLIERS).min(axis=0), out=least)
    least ^= least >> np.uint64(32)
    return ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16)


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """One row of SYMBOLS keys a signature: each chunk with each of its symbols left out."""
    chunks = symbols.reshape(-1, CHUNKS, PER_CHUNK).astype(np.uint64)
    keys = np.empty((len(chunks), SYMBOLS), dtype=np.uint64)
    for out in range(PER_CHUNK):
        left = [i for i in range(PER_CHUNK) if i != out]
        keys[:, out::PER_CHUNK] = sum(chunks[:, :, i] << np.uint64(16 * k) for k, i in enumerate(left))
    keys = (keys ^ SALTS) * np.uint64(0xE7037ED1A0B428DB)
    return keys ^ (keys >> np.uint64(32))


def signed(docs: DataFrame, width: int) -> Saved:
    """The rows' columns as c0, c1, ..., and row (a number), n_shingles, a 128-bit hash of the set, and the signature."""
    text = f"c{docs.columns.index('text')}"
    numbered = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids, sigs = [], [], []
                for t in part.column(text):
                    h = shingle_hashes(t.as_py(), width)
                    n.append(len(h))
                    ids.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64))
                    sigs.append(signature(h).tobytes())
                ids = np.array(ids).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), pa.array(sigs, pa.binary())], names=[*part.schema.names, "n_shingles", "h1", "h2", "f"])

    schema = StructType([*numbered.schema.fields, *(StructField(c, LongType()) for c in ("n_shingles", "h1", "h2")), StructField("f", BinaryType())])
    return save(numbered.mapInArrow(run, schema), "signatures")


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])), [len(sorted_keys)]]) if len(sorted_keys) else np.zeros(1, np.int64)


def _key_rows(key: np.ndarray, lead: np.ndarray, id: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(lead), pa.array(id), pa.array(n.astype(np.int32))], names=["key", "lead", "id", "n"])


KEYS = "key long, lead long, id long, n int"


def shared_keys(reps: DataFrame, n_reps: int) -> DataFrame:
    """key, lead, id for the classes that share a key. lead is the first class of the key in the block or, for a block's own lead, of the key."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n > 0: a key of a block, with its number of classes; n = 0: another class than its lead."""
        ids, sigs = [], []

        def block() -> Iterator[pa.RecordBatch]:
            own = np.concatenate(ids)
            keys = index_keys(np.frombuffer(b"".join(sigs), np.uint16)).ravel()
            ids.clear(), sigs.clear()
            by = np.argsort(keys, kind="stable")
            keys, who = keys[by], own[by // SYMBOLS]
            cuts = _runs(keys)
            size = np.diff(cuts)
            lead = np.minimum.reduceat(who, cuts[:-1])
            for at in range(0, len(size), 100_000):
                part = slice(at, at + 100_000)
                yield _key_rows(keys[cuts[:-1][part]], lead[part], lead[part], size[part])
            many = np.repeat(size > 1, size)
            keys, who, lead = keys[many], who[many], np.repeat(lead, size)[many]
            rest = who != lead
            yield _key_rows(keys[rest], lead[rest], who[rest], np.zeros(int(rest.sum())))

        for batch in batches:
            ids.append(batch.column("id").to_numpy())
            sigs += batch.column("f").to_pylist()
            if len(sigs) >= BLOCK:
                yield from block()
        if sigs:
            yield from block()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            key, lead, id, n = (batch.column(c).to_numpy() for c in ("key", "lead", "id", "n"))
            if (inner := n == 0).any():
                yield _key_rows(key[inner], lead[inner], id[inner], n[inner])
            for column, x in zip(parts, (key, lead, n)):
                column.append(x[~inner])
        key, lead, n = map(np.concatenate, parts) if parts[0] else [np.zeros(0, np.int64)] * 3
        if len(key):
            by = np.argsort(key)
            key, lead, n = key[by], lead[by], n[by]
            cuts = _runs(key)
            size = np.diff(cuts)
            first = np.repeat(np.minimum.reduceat(lead, cuts[:-1]), size)
            keep = np.repeat((size > 1) | (n[cuts[:-1]] > 1), size)
            yield _key_rows(key[keep], first[keep], lead[keep], n[keep])

    parts = max(reps.sparkSession.sparkContext.defaultParallelism, n_reps * SYMBOLS // PART_KEYS)
    rows = reps.select("id", "f").mapInArrow(look_up, KEYS)
    return rows.repartition(parts, F.when(F.col("n") > 0, F.col("key")).otherwise(F.col("lead"))).mapInArrow(meet, KEYS).select("key", "lead", "id")


def candidate_sets(table: DataFrame, text: str, ids: DataFrame, width: int) -> DataFrame:
    """(id, s): sorted hashes of the shingles of the rows with these numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shingle_hashes(t.as_py(), width).tobytes() for t in part.column(text)], pa.binary())], names=["id", "s"])

    return table.select(F.col("row").alias("id"), text).join(ids, "id", "left_semi").mapInArrow(run, "id long, s binary")


def _compare(percent: int):
    """Rows of a cell, those that ask (asks = 0) before the others -> links. The former are held, the others stream by."""

    def links(asking: list, others: list) -> Iterator[tuple[int, int, int, int]]:
        sets = [np.frombuffer(r[4], np.uint64) for r in others]
        flat = np.concatenate(sets)
        lengths = np.array([len(x) for x in sets])
        starts = np.cumsum(lengths) - lengths
        ids, roots = np.array([r[2] for r in others]), np.array([r[3] for r in others])
        if len(asking) > 4:
            vocabulary, flat = np.unique(flat, return_inverse=True)
            mark = np.zeros(len(vocabulary) + 1, np.int32)
        for _, _, a, root, s in asking:
            s = np.frombuffer(s, np.uint64)
            if len(asking) > 4:
                at = np.searchsorted(vocabulary, s)
                at = at[vocabulary[np.minimum(at, len(vocabulary) - 1)] == s]
                mark[at] = 1
                common = np.add.reduceat(mark[flat], starts)
                mark[at] = 0
            else:
                at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
                common = np.add.reduceat((s[at] == flat).astype(np.int32), starts)
            hit = np.flatnonzero((100 * common >= percent * (lengths + len(s) - common)) & (roots != root))
            hit = hit[np.unique(roots[hit], return_index=True)[1]]  # one link to a component is enough
            for b, other in zip(ids[hit].tolist(), roots[hit].tolist()):
                yield a, b, root, other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asking, others, held = None, [], [], 0
        for batch in batches:
            found: list = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "asks", "id", "root", "s"))):
                if row[0] != cell or held > 1 << 23:
                    if others:
                        found += links(asking, others)
                    others, held = [], 0
                    if row[0] != cell:
                        cell, asking = row[0], []
                if row[1] == 0:
                    asking.append(row)
                else:
                    others.append(row)
                    held += len(row[4])
            yield _links(found)
        if others:
            yield _links(list(links(asking, others)))

    def _links(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 4, names=["a", "b", "root_a", "root_b"])

    return run


LINKS = "a long, b long, root_a long, root_b long"


def compared(asking: DataFrame, others: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between those that ask (block, id, root) and the others (block, id, root) of their block; roots of a link differ.

    A block is cut into cells of about CELL others, so that a large one is many tasks' work.
    """
    cells = others.groupBy("block").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    others = others.join(cells, "block").select("block", F.pmod(F.xxhash64("id"), F.col("cells")).alias("salt"), "id", "root", F.lit(1).alias("asks"))
    asking = asking.join(cells, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("salt"), "id", "root", F.lit(0).alias("asks"))
    rows = asking.unionByName(others).join(sets, "id").select(F.xxhash64("block", "salt").alias("cell"), "asks", "id", "root", "s")
    return rows.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(_compare(percent), LINKS)


def links_left(shared: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between components whose classes share a key."""
    labelled = shared.join(roots.withColumnRenamed("v", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    split = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.mode("root").alias("main"), F.min("id").alias("near")).filter("lo < hi")
    several = save(labelled.join(split.select("key", "main", "near"), "key"), "dup-several").df
    if several.isEmpty():
        return None
    outside = several.filter("root <> main")
    # classes that share keys with the same ones should come into one block, so the least neighbour is handed on once more
    least = several.groupBy("id").agg(F.min("near").alias("least"))
    handed = several.select("key", "id").join(least, "id").groupBy("key").agg(F.min("least").alias("least"))
    asking = outside.join(handed, "key").groupBy("id", "root").agg(F.min("least").alias("near"))
    many = asking.groupBy("near").agg(F.ceil(F.count("*") / NEIGHBOURS).alias("blocks"))
    asking = save(asking.join(many, "near").select(F.xxhash64("near", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block"), "id", "root"), "dup-asking").df
    blocks = outside.select("key", "id").join(asking.select("id", "block"), "id").select("key", "block").distinct()
    others = save(several.select("key", "id", "root").join(blocks, "key").select("block", "id", "root").distinct(), "dup-others").df
    return compared(asking, others, sets, percent)


def linked_classes(reps: DataFrame, table: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """(v, root) of the classes (reps: id, f) that have links."""
    shared = save(shared_keys(reps, reps.count()), "dup-keys")
    sets = save(candidate_sets(table, text, shared.df.select("id").distinct(), width), "dup-sets")
    star = save(shared.df.filter("lead <> id").select(F.col("lead").alias("block"), "id", F.col("id").alias("root")).distinct(), "dup-star")
    leads = star.df.select("block").distinct().select("block", F.col("block").alias("id"), F.col("block").alias("root"))
    roots = components(compared(leads, star.df, sets.df, percent))
    star.drop()
    rest = links_left(shared.df, roots, sets.df, percent)
    if rest is not None:
        roots = composed(roots, components(rest.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
    shared.drop()
    sets.drop()
    return roots


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """signed() rows, and for each class (h1, h2) its component's first row as best: (doc_id is null, doc_id, row)."""
    table = signed(docs, width).df
    id = f"c{docs.columns.index('doc_id')}"
    best = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("doc_id"), "row")
    classes = table.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min(best).alias("best"), F.first("f").alias("f"))
    made = save(classes.select(F.col("best.row").alias("id"), "h1", "h2", "best", "f"), "dup-reps")
    reps = made.df
    roots = linked_classes(reps, table, f"c{docs.columns.index('text')}", width, percent)
    member = save(roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct()), "dup-members").df
    first = member.join(reps.select(F.col("id").alias("v"), "best"), "v").groupBy("root").agg(F.min("best").alias("first"))
    member = member.join(first, "root").select(F.col("v").alias("id"), "first")
    found = reps.select("id", "h1", "h2", "best").join(member, "id", "left").select("h1", "h2", F.coalesce("first", "best").alias("best"))
    found = save(found, "dup-classes").df
    made.drop()
    return table, found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept, for every row."""
    table, classes = _grouped(docs.select("doc_id", "text"), width, percent)
    joined = table.select(F.col("c0").alias("doc_id"), "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"))


def kept(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their columns, of which each group of near duplicates leaves one row: that with the smallest doc_id
    (null ids last); among repeated ids, the first row as the table is read. Documents without words all stay."""
    table, classes = _grouped(docs, width, percent)
    joined = table.select("row", "n_shingles", "h1", "h2").filter("n_shingles > 0").join(classes, ["h1", "h2"])
    gone = save(joined.filter(F.col("best.row") != F.col("row")).select("row"), "dup-gone").df
    return table.join(gone, "row", "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
