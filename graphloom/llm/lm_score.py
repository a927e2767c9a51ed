"""LM scoring with deleted interpolation over a bigram model.

p(w | x) = a * c(xw) / c(x) + b * c(w) / N + (1 - a - b) / (V + 1), where the weights depend on the bucket of
the context's frequency c(x) (powers of two). They are learned by expectation-maximisation: the counts of one
part of the training documents predict the tokens of the part that was held out (fold `part`), and what the
EM needs of those tokens is a histogram over (bucket, log p of the bigram, log p of the word) in steps of 1/8
octave, which is small whatever the corpus. Scores use the counts of all training documents.

Counting: documents are dealt into blocks of about BLOCK_BYTES of text by a hash of doc_id. A block sends each
distinct n-gram once, with its counts, as sorted 64-bit hashes packed by shard of the hash; a shard adds
them up and answers each block with the totals in the order of its request. So a frequent n-gram is one
number a block, never a group of rows, and the number of shards grows with the blocks. Rows never outnumber
the distinct n-grams of the blocks. The texts are shuffled once for counting and once for scoring.

Null texts count as empty; an empty text has one token, its end. Repeated rows each count and get their score.
With no training documents base_score is 0 a token, and the model is uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, save

FOLDS, HELD_OUT, PART = 7, 2, 3
BLOCK_BYTES = 6 << 20
BUCKETS, STEP, FLOOR = 64, 8, -60
END, START = np.uint64(xxhash.xxh3_64_intdigest(b" end")), np.uint64(xxhash.xxh3_64_intdigest(b" start"))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text ended by END, and the number of tokens of each text."""
    known, parts, counts = _Hashes(), [], []
    for text in texts:
        ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        parts.append(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)))
        parts.append(np.array([END]))
        counts.append(len(ws) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(counts, dtype=np.int64)


def bigrams(w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens' contexts and of the bigrams."""
    x = np.empty_like(w)
    x[1:] = w[:-1]
    x[np.cumsum(counts) - counts] = START
    h = x * np.uint64(0x9E3779B97F4A7C15) + w
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return x, h ^ (h >> np.uint64(32))


def _planes(a: np.ndarray) -> bytes:
    """Little-endian bytes, all first bytes before all second ones: small numbers then compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _requests(w: np.ndarray, h: np.ndarray, shards: int):
    """(part, indices of the distinct hashes in order, sorted distinct hashes, inverse) of both orders."""
    for order, a in ((0, w), (1, h)):
        u, inverse = np.unique(a, return_inverse=True)
        shard = (u % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(shards + 1))
        yield order, u, inverse, [(order * shards + s, by[cuts[s] : cuts[s + 1]]) for s in range(shards) if cuts[s] < cuts[s + 1]]


REQUEST = "part int, block int, grams binary, n_a binary, n_b binary"
ANSWER = "part int, block int, n_a binary, n_b binary, total_a long, total_b long, kinds_a long, kinds long"


def _count_block(shards: int):
    def run(table: pa.Table) -> pa.Table:
        w, counts = tokens(table.column("text").to_pylist())
        _, h = bigrams(w, counts)
        folds = np.repeat(np.array(table.column("fold").to_pylist()), counts)
        in_a, in_b = (folds != HELD_OUT) & (folds != PART), folds == PART
        rows: list[list] = [[], [], [], [], []]
        block = table.column("block")[0].as_py()
        for _, u, inverse, parts in _requests(w, h, shards):
            n_a, n_b = (np.bincount(inverse[m], minlength=len(u)).astype(np.uint32) for m in (in_a, in_b))
            for part, at in parts:
                own = u[at]
                own[1:] = np.diff(own)
                for column, x in zip(rows, (part, block, _planes(own), _planes(n_a[at]), _planes(n_b[at]))):
                    column.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "block", "grams", "n_a", "n_b"])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    grams = [np.cumsum(_unplanes(b.as_py(), np.uint64), dtype=np.uint64) for b in table.column("grams")]
    u, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    sums = [np.bincount(inverse, np.concatenate([_unplanes(b.as_py(), np.uint32) for b in table.column(c)]), len(u)).astype(np.uint32 if table.num_rows < 1000 else np.uint64) for c in ("n_a", "n_b")]
    cuts = np.cumsum([len(g) for g in grams])[:-1]
    answers = [[_planes(s[i].astype(np.uint64)) for i in np.split(inverse, cuts)] for s in sums]
    part, n = table.column("part")[0].as_py(), table.num_rows
    first = lambda x: [int(x)] + [0] * (n - 1)  # noqa: E731  the shard's totals stand in its first row
    return pa.table({
        "part": pa.array([part] * n, pa.int32()), "block": table.column("block").cast(pa.int32()), "n_a": pa.array(answers[0], pa.binary()), "n_b": pa.array(answers[1], pa.binary()),
        "total_a": pa.array(first(sums[0].sum()), pa.int64()), "total_b": pa.array(first(sums[1].sum()), pa.int64()),
        "kinds_a": pa.array(first((sums[0] > 0).sum()), pa.int64()), "kinds": pa.array(first(((sums[0] > 0) | (sums[1] > 0)).sum()), pa.int64()),
    })


def _looked_up(texts: pa.Table, answers: pa.Table, shards: int, with_b: bool):
    """Tokens' lengths by document, counts of each token, its bigram and its context (start of text: -1)."""
    w, counts = tokens(texts.column("text").to_pylist())
    _, h = bigrams(w, counts)
    got = {p: (a, b) for p, a, b in zip(*(answers.column(c).to_pylist() for c in ("part", "n_a", "n_b")))}
    found = []
    for _, u, inverse, parts in _requests(w, h, shards):
        n = np.zeros(len(u), dtype=np.int64)
        for part, at in parts:
            a, b = got[part]
            n[at] = _unplanes(a, np.uint64)
            if with_b:
                n[at] += _unplanes(b, np.uint64).astype(np.int64)
        found.append(n[inverse])
    context = np.empty_like(found[0])
    context[1:] = found[0][:-1]
    context[np.cumsum(counts) - counts] = -1
    return counts, *found, context


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(int), 0)


def _held_out(shards: int, total: int, starts: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names, kinds = ["bucket", "q2", "q1", "n"], [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        if not texts.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        _, one, two, context = _looked_up(texts, answers, shards, False)
        context = np.where(context < 0, starts, context)
        level = lambda n, of: np.where(n > 0, np.rint(STEP * np.log2(np.maximum(n, 1) / np.maximum(of, 1))), FLOOR * STEP).astype(np.int64)
        packed, n = np.unique((_bucket(context) * 1000 - level(two, context)) * 1000 - level(one, total), return_counts=True)
        return pa.table([pa.array(packed // 1_000_000, kinds[0]), pa.array(-(packed // 1000 % 1000), kinds[1]), pa.array(-(packed % 1000), kinds[2]), pa.array(n, kinds[3])], names=names)

    return run


def learn(histogram: np.ndarray, kinds: int, rounds: int = 60) -> np.ndarray:
    """EM on rows (bucket, q2, q1, n): weights of bigram, word and uniform for each bucket."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    last = None
    for bucket in range(BUCKETS):
        rows = histogram[histogram[:, 0] == bucket]
        if len(rows):
            p = np.stack([np.where(rows[:, i] <= FLOOR * STEP, 0.0, 2.0 ** (rows[:, i] / STEP)) for i in (1, 2)] + [np.full(len(rows), 1 / (kinds + 1))], axis=1)
            own = weights[bucket]
            for _ in range(rounds):
                share = p * own
                share *= (rows[:, 3] / share.sum(axis=1))[:, None]
                own = np.maximum(share.sum(axis=0) / rows[:, 3].sum(), 1e-9)
                own /= own.sum()
            last = own
        if last is not None:
            weights[bucket] = last
    return weights


def _score(shards: int, total: int, kinds: int, starts: int, weights: np.ndarray, id_type: pa.DataType):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        counts, one, two, context = _looked_up(texts, answers, shards, True)
        context = np.where(context < 0, starts, context)
        own = weights[_bucket(context)]
        p = own[:, 0] * two / np.maximum(context, 1) + own[:, 1] * one / max(total, 1) + own[:, 2] / (kinds + 1)
        at = np.cumsum(counts) - counts
        by_doc = lambda x: np.add.reduceat(x, at)
        base = by_doc(np.log10((one + 1) / (total + kinds + 1)))
        columns = [texts.column("doc_id").combine_chunks(), np.array(texts.column("fold").to_pylist()) == HELD_OUT, counts, by_doc((one > 0).astype(np.int64)), np.full(len(counts), total), base, by_doc(np.log10(p))]
        return pa.table([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    id_type = docs.schema["doc_id"].dataType
    d = docs.select("doc_id", "text", fold(F.col("doc_id"), FOLDS).cast("int").alias("fold"))
    size, starts, starts_a = d.agg(F.sum(F.octet_length("text")), F.sum((F.col("fold") != HELD_OUT).cast("long")), F.sum((~F.col("fold").isin(HELD_OUT, PART)).cast("long"))).first()
    main = int((size or 0) // block_bytes) + 1
    blocks = main + -(-main // (FOLDS - 1))  # those of the part that is held out for EM stand at the end
    shards = max(4, blocks // 2)
    h = F.xxhash64("doc_id")
    d = d.withColumn("block", F.when(F.col("fold") == PART, main + F.pmod(h, F.lit(blocks - main))).otherwise(F.pmod(h, F.lit(main))).cast("int"))
    answers = save(d.groupBy("block").applyInArrow(_count_block(shards), REQUEST).groupBy("part").applyInArrow(_add_up, ANSWER), "lm-counts")
    totals = answers.df.filter(F.col("part") < shards).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total_a", "total_b", "kinds_a", "kinds"))).first()
    total_a, total_b, kinds_a, kinds = map(int, totals)
    slim = answers.df.select("part", "block", "n_a", "n_b")
    held = d.filter(F.col("block") >= main).groupBy("block").cogroup(slim.filter(F.col("block") >= main).groupBy("block"))
    histogram = held.applyInArrow(_held_out(shards, total_a, int(starts_a or 0)), "bucket int, q2 int, q1 int, n long").groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).collect()
    weights = learn(np.array([tuple(r) for r in histogram], dtype=float).reshape(-1, 4), kinds_a)
    from pyspark.sql.pandas.types import to_arrow_type

    scored = d.groupBy("block").cogroup(slim.groupBy("block")).applyInArrow(
        _score(shards, total_a + total_b, kinds, int(starts or 0), weights, to_arrow_type(id_type)),
        f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored
