"""Exact top-k search: an inverted index in shards, block-max WAND with BM25, merged under global statistics.

Index: a task cuts its rows into shards of about SHARD_BYTES of text, without a shuffle; a shard is one row of packed
postings. Every shard sends its distinct terms once with their document frequencies, as sorted hashes dealt by hash;
they are added up, and the shard gets back the global ones of the terms that its queries hold. So all shards
score with the same N, average length and frequencies, and the merge of their top k is the exact top k.

Queries: all distinct terms of a document (n_terms=None, as op6_topk_search does), or its `n_terms` terms with the greatest
tf * idf (ties: least hash). Equal queries are run once. They are run in blocks of QUERY_BLOCK queries and TERM_BLOCK
terms at most on average, which bounds what is broadcast; a task keeps the running top k of a block over all shards that it reads.

Pruning: a query is first run over the shard that it comes from, in one step for all blocks. Its k-th score there is a threshold that holds
everywhere, and rises with the task's running top k. Postings are in order of documents and have maxima for blocks, aligned
to windows of BLOCK documents. The WAND test (can the maxima of the lists that meet here reach the threshold?)
is made window by window, for many queries in one array operation; blocks of windows that fail are not read.
Whole texts have hundreds of terms, whose maxima in windows of BLOCK documents reach nearly every threshold. So their rare terms are
added up first, posting by posting, and the test for a window of SPAN documents takes the best sum there and the maxima
of the frequent lists. Those lists are a matrix: queries are multiplied with the windows that they enter, or with all of it if a batch of
queries enters most; in single precision, and what that leaves near a threshold is scored again in full. Scores are rounded to nine decimals, so that copies tie whatever the order of the additions.

Null and empty texts have no terms: they are never found, and as queries find nothing (no row). Ties go to the
smaller doc_id. Rows with a null doc_id are no queries and are not found. Rows that repeat a doc_id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import real_words, save
from .lm_score import _Hashes, _planes, _unplanes

K1, B, K, TERMS, EVERY = 1.2, 0.75, 10, 8, 20
SHARD_BYTES, BLOCK, QUERY_BLOCK, TERM_BLOCK = 16 << 20, 64, 20_000, 1_000_000
#: Documents of a window when queries are whole texts.
SPAN = 32

INDEX = "shard long, part int, ids binary, lengths binary, terms binary, starts binary, docs binary, tfs binary, wanted binary, queries binary, n_docs long, n_words long"
FIELDS = [f.split() for f in INDEX.split(", ")]
#: Columns of a shard's postings.
PACKED = ["shard", "ids", "lengths", "terms", "starts", "docs", "tfs"]
ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in FIELDS])


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.ascontiguousarray(a))) if len(a) else b""


def _unpack(b: bytes, kind) -> np.ndarray:
    return _unplanes(zstandard.ZstdDecompressor().decompress(b), kind) if b else np.zeros(0, kind)


def postings(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct term hashes, starts of their postings, documents and frequencies, and the documents' lengths."""
    known, parts, lengths = _Hashes(), [], []
    for text in texts:
        ws = real_words(text)
        parts.append(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)))
        lengths.append(len(ws))
    lengths = np.array(lengths, dtype=np.int64)
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    del parts
    terms, at = np.unique(words, return_inverse=True)
    n = max(len(texts), 1)
    code, tf = np.unique(at * n + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    starts = np.searchsorted(code, np.arange(len(terms) + 1) * n)
    return terms, starts, (code % n).astype(np.uint32), tf.astype(np.uint32), lengths


def _shard_rows(number: int, ids: list[int], texts: list, parts: int, every: int) -> Iterator[pa.RecordBatch]:
    order = sorted(range(len(ids)), key=ids.__getitem__)  # stable: repeated ids stay documents of their own
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    terms, starts, docs, tfs, lengths = postings(texts)
    ids = np.array(ids, dtype=np.int64)
    asked = np.flatnonzero(ids % every == 0)
    of_query = np.isin(docs, asked)
    owner = np.repeat(np.arange(len(terms)), np.diff(starts))
    wanted = np.zeros(len(terms), bool)
    wanted[owner[of_query]] = True
    queries = np.concatenate([docs[of_query], owner[of_query].astype(np.uint32), tfs[of_query]])
    gaps = docs.copy()
    gaps[1:] -= docs[:-1]
    term_gaps = terms.copy()
    term_gaps[1:] -= terms[:-1]
    rows = [[number, -1, _pack(ids), _pack(lengths), _pack(term_gaps), _pack(np.diff(starts).astype(np.uint32)), _pack(gaps), _pack(tfs), None, None, len(ids), int(lengths.sum())]]
    if len(asked):
        rows.append([number, -2, _pack(ids), None, None, None, None, None, _pack(np.flatnonzero(wanted).astype(np.uint32)), _pack(queries), None, None])
    df = np.diff(starts).astype(np.uint32)
    part = (terms % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    for p in range(parts):
        at = by[cuts[p] : cuts[p + 1]]
        if len(at):
            own = terms[at]
            own[1:] -= own[:-1].copy()
            rows.append([number, p, None, None, _pack(own), _pack(df[at]), None, None, np.packbits(wanted[at]).tobytes(), None, None, None])
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def index(docs: DataFrame, parts: int, shard_bytes: int = SHARD_BYTES, every: int = EVERY) -> DataFrame:
    """part -1: a shard's postings; -2: its queries' postings; from 0: its terms with that remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        ids, texts, size, number = [], [], 0, 0
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1] or "") + 64
                if size >= shard_bytes:
                    yield from _shard_rows(first + number, ids, texts, parts, every)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield from _shard_rows(first + number, ids, texts, parts, every)

    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, INDEX)


def _add_up(table: pa.Table) -> pa.Table:
    """Global document frequencies of one part's terms, for each shard those that it wants."""
    table = table.sort_by("shard")
    grams = [np.cumsum(_unpack(b.as_py(), np.uint64), dtype=np.uint64) for b in table.column("terms")]
    u, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([_unpack(b.as_py(), np.uint32) for b in table.column("starts")]), len(u)).astype(np.int64)
    answers = []
    for own, w in zip(np.split(total[inverse], np.cumsum([len(g) for g in grams])[:-1]), table.column("wanted")):
        bits = np.unpackbits(np.frombuffer(w.as_py(), np.uint8))[: len(own)].astype(bool)
        answers.append((_pack(own[bits]), bits))
    hashes = [_pack(g[b]) for g, (_, b) in zip(grams, answers)]
    return pa.table([table.column("shard"), table.column("part").cast(pa.int32()), pa.array(hashes, pa.binary()), pa.array([a for a, _ in answers], pa.binary())], names=["shard", "part", "terms", "df"])


def _make_queries(n_docs: int, n_terms: int | None):
    def run(queries: pa.Table, answers: pa.Table) -> pa.Table:
        names, types = ["doc_id", "key", "home", "terms", "weights"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        rows: list[list] = [[], [], [], [], []]
        for row in queries.to_pylist() if answers.num_rows else []:  # without terms there is nothing to ask
            ids, (doc, owner, tf) = _unpack(row["ids"], np.int64), np.split(_unpack(row["queries"], np.uint32), 3)
            slot = np.searchsorted(_unpack(row["wanted"], np.uint32), owner)
            hashes = np.concatenate([_unpack(b, np.uint64) for b in answers.column("terms").to_pylist()])
            df = np.concatenate([_unpack(b, np.int64) for b in answers.column("df").to_pylist()])
            by = np.argsort(hashes)  # a shard's terms are in order of their hashes, and so are the wanted ones
            hashes, df = hashes[by], df[by]
            idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
            order = np.lexsort((slot, -(tf * idf[slot]), doc))
            doc, slot = doc[order], slot[order]
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            if n_terms is not None:
                keep = place < n_terms
                doc, slot = doc[keep], slot[keep]
            cuts = np.flatnonzero(np.diff(doc)) + 1
            for d, s in zip(doc[np.concatenate([[0], cuts])].tolist() if len(doc) else [], np.split(slot, cuts)):
                s = np.sort(s)
                h = hashes[s].view(np.int64)
                mixed = int(np.bitwise_xor.reduce((h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (h.view(np.uint64) >> np.uint64(29))))
                for column, x in zip(rows, (int(ids[d]), mixed - (1 << 64) if mixed >> 63 else mixed, row["shard"], h.tolist(), idf[s].tolist())):
                    column.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return run


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i."""
    ends = np.cumsum(counts)
    out = np.repeat(starts - ends + counts, counts)
    out += np.arange(len(out))
    return out


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each q by falling score, then id; sorted so."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], scores[keep]


class Shard:
    """A shard in memory: impacts of all postings without idf, and their maxima in each list's blocks.

    A block is what a list has in one window of BLOCK documents, so the blocks of all lists are aligned.
    """

    def __init__(self, row: dict, average: float, blocks: bool = True) -> None:
        self.ids = _unpack(row["ids"], np.int64)
        lengths = _unpack(row["lengths"], np.int64)
        self.terms = np.cumsum(_unpack(row["terms"], np.uint64), dtype=np.uint64)
        starts = np.concatenate([[0], np.cumsum(_unpack(row["starts"], np.uint32).astype(np.int64))])
        self.docs = np.cumsum(_unpack(row["docs"], np.uint32), dtype=np.uint32).view(np.int32)
        tf = _unpack(row["tfs"], np.uint32).astype(np.float64)
        norm = K1 * (1 - B + B * lengths / (average or 1.0))
        self.impacts = tf * (K1 + 1) / (tf + norm[self.docs]) if len(tf) else tf
        self.starts, self.matrix = starts, None
        self.entered = self.offered = 0
        if not blocks:  # search_whole() reads none; a posting's document and impact stand together there, so that one read from memory gets both
            self.pairs = np.empty((len(tf), 2))
            self.pairs.view(np.int64)[:, 0], self.pairs[:, 1] = self.docs, self.impacts
            self.docs, self.impacts = self.pairs.view(np.int64)[:, 0], self.pairs[:, 1]
            return
        window = self.docs // BLOCK
        fresh = np.ones(len(window), bool)
        fresh[1:] = window[1:] != window[:-1]
        fresh[starts[:-1]] = True
        self.block_start = np.flatnonzero(fresh)
        self.block_size = np.diff(np.append(self.block_start, len(window)))
        self.block_window = window[self.block_start]
        self.block_max = np.maximum.reduceat(self.impacts, self.block_start) if len(window) else np.zeros(0)
        self.first_block = np.searchsorted(self.block_start, starts)
        self.windows = -(-len(self.ids) // BLOCK)

    def search(self, q: np.ndarray, lists: np.ndarray, idfs: np.ndarray, floors: np.ndarray, k: int, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Top k (query, local document, score) of many queries: (q ascending, list, idf) of their terms; floors by query.

        The pivot test of block-max WAND is made for all windows of a batch of queries at once: a window is entered only
        if the maxima of its blocks can reach the query's threshold, and only blocks in such windows are read.
        """
        out = []
        queries = np.unique(q)
        step = max(1, cells // max(len(self.ids), 1))
        for at in range(0, len(queries), step):
            own = queries[at : at + step]
            a, b = np.searchsorted(q, own[0]), np.searchsorted(q, own[-1], side="right")
            local = np.searchsorted(own, q[a:b])
            counts = self.first_block[lists[a:b] + 1] - self.first_block[lists[a:b]]
            block = _spread(self.first_block[lists[a:b]], counts)
            of, w = np.repeat(local, counts), np.repeat(idfs[a:b], counts)
            cell = of * self.windows + self.block_window[block]
            bound = np.bincount(cell, self.block_max[block] * w)
            enter = bound[cell] >= floors[own][of] - 1e-9  # ties with the floor count: the other document may have the larger id
            block, of, w = block[enter], of[enter], w[enter]
            size = self.block_size[block]
            post = _spread(self.block_start[block], size)
            key = np.repeat(of, size) * len(self.ids) + self.docs[post]
            parts = self.impacts[post] * np.repeat(w, size)  # added in the order of the terms
            if len(key) * 8 < len(own) * len(self.ids):
                key, inverse = np.unique(key, return_inverse=True)
                score = np.bincount(inverse, parts, len(key))
            else:
                score = np.bincount(key, parts)
                key = np.flatnonzero(score)
                score = score[key]
            of = own[key // max(len(self.ids), 1)]
            good = score >= floors[of] - 1e-9
            out.append(_best(of[good], (key % max(len(self.ids), 1))[good], score[good], k))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def frequent(self, share: int = 20, cells: int = 8_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each list's row or -1; impacts of the lists with one document in `share` or more, by document and row, and in single
        precision by row and document; their maxima by row and window."""
        if self.matrix is None:
            counts = np.diff(self.starts)
            rows = np.flatnonzero(counts * share >= len(self.ids))
            rows = rows[np.argsort(-counts[rows], kind="stable")][: max(1, cells // len(self.ids))]
            place, dense = np.full(len(counts), -1), np.zeros((len(rows), -(-len(self.ids) // SPAN) * SPAN))
            place[rows] = np.arange(len(rows))
            post = _spread(self.starts[rows], counts[rows])
            dense[np.repeat(np.arange(len(rows)), counts[rows]), self.docs[post]] = self.impacts[post]
            self.matrix = place, dense.T.copy(), dense.astype(np.float32), dense.reshape(len(rows), dense.shape[1] // SPAN, SPAN).max(axis=2).astype(np.float32)
        return self.matrix

    def search_whole(self, q: np.ndarray, lists: np.ndarray, idfs: np.ndarray, floors: np.ndarray, k: int, cells: int = 2_400_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As search(), for queries of many terms.

        The lists of rare terms are added up first. A window of SPAN documents is entered by a query if its best sum so far and
        the maxima of the frequent lists there can reach the threshold; only then are its documents scored with those lists.
        Where a batch enters most, all is multiplied, and the next seven batches make no test.

        That product is in single precision. As nothing is negative, a sum of n parts is off by n + 2 roundings at most, relative to it;
        what reaches the threshold less that is scored again in full precision.
        """
        place, by_doc, dense, tops = self.frequent()
        n, out, queries = dense.shape[1], [], np.unique(q)
        step, full = max(1, cells // n), False
        rare, scores = (np.empty((min(step, len(queries)), n), kind) for kind in (np.float64, np.float32))
        for number, at in enumerate(range(0, len(queries), step)):
            own = queries[at : at + step]
            a, b = np.searchsorted(q, own[0]), np.searchsorted(q, own[-1], side="right")
            local, here, w = np.searchsorted(own, q[a:b]), lists[a:b], idfs[a:b]
            slack = (np.bincount(local) + 8) * 2.0**-23
            least = np.maximum((floors[own] - 1e-8) * (1 - slack), 1e-12).astype(np.float32)
            often = place[here] >= 0
            exact = np.zeros((len(own), len(dense)))
            exact[local[often], place[here[often]]] = w[often]
            weights = exact.astype(np.float32)
            rare, scores = rare[: len(own)], scores[: len(own)]
            self._add_up(rare, local[~often], here[~often], w[~often])
            entered = offered = len(own) * (n // SPAN)
            if not full or number % 8 == 0:
                bound = weights @ tops
                bound += rare.reshape(len(own), -1, SPAN).max(axis=2)
                enter = bound >= least[:, None]
                entered = int(enter.sum())
                full = 2 * entered > offered
            self.entered, self.offered = self.entered + entered, self.offered + offered
            if full:  # most windows are entered: all in one product
                np.matmul(weights, dense, out=scores)
                np.add(scores, rare, out=scores, casting="same_kind")
            else:
                scores.fill(0)
                window, who = np.nonzero(enter.T)
                cuts = np.flatnonzero(np.diff(window)) + 1
                for x, some in zip((window[np.concatenate([[0], cuts])] * SPAN).tolist() if len(window) else [], np.split(who, cuts)):
                    scores[some, x : x + SPAN] = weights[some] @ dense[:, x : x + SPAN] + rare[some, x : x + SPAN]
            of, docs = np.divmod(np.flatnonzero(scores >= least[:, None]), n)
            many = np.flatnonzero(np.bincount(of, minlength=len(own)) > 2 * k)
            if len(many):
                least[many] = np.maximum(least[many], np.partition(scores[many], n - k, axis=1)[:, n - k] * (1 - 2 * slack[many]) - 1e-8)
                stays = scores[of, docs] >= least[of]
                of, docs = of[stays], docs[stays]
            found = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", exact[of[i : i + 1024]], by_doc[docs[i : i + 1024]]) for i in range(0, len(of), 1024)])
            found = np.round(found + rare[of, docs], 9)
            stays = found >= np.maximum(floors[own][of] - 1e-8, 1e-12)
            out.append(_best(own[of[stays]], docs[stays], found[stays], k))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _add_up(self, sums: np.ndarray, local: np.ndarray, lists: np.ndarray, w: np.ndarray, rows: int = 4) -> None:
        """Sets sums to those of the lists, a few queries at a time: what they read and write then stays in the cache."""
        sums.fill(0)
        n, counts, pairs = sums.shape[1], self.starts[lists + 1] - self.starts[lists], self.pairs.view(np.complex128).ravel()
        for at in range(0, len(sums), rows):
            a, b = np.searchsorted(local, (at, at + rows))
            pair = pairs.take(_spread(self.starts[lists[a:b]], counts[a:b]), mode="clip")
            cell, part = np.repeat((local[a:b] - at) * n, counts[a:b]), np.repeat(w[a:b], counts[a:b])
            cell += pair.view(np.int64)[::2]
            part *= pair.imag
            np.add.at(sums[at : at + rows].reshape(-1), cell, part)


def _search_shard(row: dict, average: float, k: int, whole: bool, words: np.ndarray, of: np.ndarray, idfs: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k (query, doc_id, score) of the queries' terms in a packed shard."""
    shard = Shard(row, average, not whole)
    row.clear()
    if not len(shard.terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(shard.terms, words), len(shard.terms) - 1)
    hit = np.flatnonzero(shard.terms[at] == words)
    q, d, s = (shard.search_whole if whole else shard.search)(of[hit], at[hit], idfs[hit], floors, k)
    return q, shard.ids[d], s


def _search_home(average: float, k: int, whole: bool):
    """The k-th score of each query in the shard that it comes from, which no document of the result can stay below."""

    def run(shards: pa.Table, queries: pa.Table) -> pa.Table:
        keys, floors = queries["key"].to_numpy(), np.zeros(queries.num_rows)
        for i in range(shards.num_rows if len(keys) else 0):
            lists = queries["terms"].combine_chunks()
            of = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy())
            words, idfs = lists.flatten().to_numpy().view(np.uint64), queries["weights"].combine_chunks().flatten().to_numpy()
            q, _, s = _search_shard({n: shards[n][i].as_py() for n in PACKED}, average, k, whole, words, of, idfs, floors)
            last = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
            floors[q[last]] = s[last]
        reached = np.flatnonzero(floors)
        return pa.table([pa.array(keys[reached]), pa.array(floors[reached])], names=["key", "floor"])

    return run


def _search_block(queries, average: float, k: int, whole: bool):
    """Over a task's shards: the best k of every query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, idfs, cuts, floors = queries.value
        floors = floors.copy()
        of = np.repeat(np.arange(len(keys)), np.diff(cuts))
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for i in range(batch.num_rows):
                found = _search_shard({n: batch.column(n)[i].as_py() for n in PACKED}, average, k, whole, words, of, idfs, floors)
                best = _best(*(np.concatenate(x) for x in zip(best, found)), k)
                last = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
                floors[best[0][last]] = np.maximum(floors[best[0][last]], best[2][last])
        for at in range(0, len(best[0]), 100_000):
            q, d, s = (x[at : at + 100_000] for x in best)
            yield pa.RecordBatch.from_arrays([pa.array(keys[q]), pa.array(d), pa.array(s)], names=["key", "doc_id", "score"])

    return run


def search(docs: DataFrame, every: int = EVERY, k: int = K, n_terms: int | None = TERMS, shard_bytes: int = SHARD_BYTES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, doc_id, score: for each row whose doc_id is divisible by `every`, the k best of all rows.

    n_terms=None: queries are whole texts, without a choice of terms.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // shard_bytes) + 1
    parts = max(4, shards // 2)
    made = save(index(docs, parts, shard_bytes, every), "search-index").df
    n_docs, n_words = made.filter("part = -1").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    average = n_words / max(n_docs, 1)
    answers = made.filter("part >= 0").select("shard", "part", "terms", "starts", "wanted").groupBy("part").applyInArrow(_add_up, "shard long, part int, terms binary, df binary")
    asked = made.filter("part = -2").select("shard", "ids", "wanted", "queries")
    formed = asked.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_make_queries(int(n_docs), n_terms), "doc_id long, key long, home long, terms array<long>, weights array<double>")
    queries = save(formed, "search-queries").df
    distinct = save(queries.dropDuplicates(["key"]).select("key", "home", "terms", "weights"), "search-distinct").df
    n_queries, asked_terms = distinct.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(n_queries // query_block, asked_terms // TERM_BLOCK) + 1
    spans = max(2 * spark.sparkContext.defaultParallelism, shards // 64)
    packed = made.filter("part = -1").select(*PACKED)
    # once for all blocks, as it unpacks every shard
    homes = packed.groupBy("shard").cogroup(distinct.groupBy("home")).applyInArrow(_search_home(average, k, n_terms is None), "key long, floor double")
    homes = save(homes, "search-floors").df
    # a task gets a fair number of shards, and keeps one top k over all of them
    dealt = save(packed.repartition(min(spans, shards)), "search-shards").df
    found = None
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("key"), F.lit(blocks)) == b
        rows = distinct.filter(mine).join(homes.filter(mine), "key", "left").select("key", "terms", "weights", F.coalesce("floor", F.lit(0.0)).alias("floor")).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        lists = rows["terms"].combine_chunks()
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        words, weights = lists.flatten().to_numpy().view(np.uint64), rows["weights"].combine_chunks().flatten().to_numpy()
        shared = spark.sparkContext.broadcast((rows["key"].to_numpy(), words, weights, cuts, rows["floor"].to_numpy()))
        part = save(dealt.mapInArrow(_search_block(shared, average, k, n_terms is None), "key long, doc_id long, score double"), "search-found").df
        shared.destroy(blocking=True)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.select(F.col("doc_id").alias("query_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0.0).alias("score")).limit(0)
    top = found.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d")))), 1, k).alias("hits"))
    out = queries.select(F.col("doc_id").alias("query_id"), "key").join(top, "key").select("query_id", F.posexplode("hits").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.d").alias("doc_id"), (-F.col("hit.s")).alias("score"))
