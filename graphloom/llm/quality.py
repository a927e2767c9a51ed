"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms are hashed: character trigrams, trigrams of character classes (so that shapes of words count whatever
the language), and words that repeat the one before, with levels of their share. Weights are sqrt(term frequency) times inverse document frequency, which
is counted over all documents. The latent-semantic axes are the leading right singular vectors of a bounded
sample of labelled rows: up to SAMPLE rows of each label, those with the least hash of doc_id. Their vectors
(2 * SAMPLE * RANK floats, 1 MB) are broadcast; every document gets its exact cosines to all of them in
blocks of rows, and the NEIGHBOURS nearest vote with the POWER-th power of their similarity, each label's votes
scaled from the sample to its share of all labelled rows.

Labels of the held-out fold are never read; doc_id, lang and source are no inputs. Texts without terms, and all
texts if no labels can be learned, get the share of label 1 (0.5 without labels). Rows with a null label are
not learned from; conflicting labels count as rows each. Repeated rows each get their score. If texts share a
doc_id, one of them (that of the least vector) is learned from. Neighbours that tie with the last one vote as well; cosines
are rounded to five places, so that a text's score doesn't hang on the batch it comes in.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

FOLDS, HELD_OUT = 4, 2
SAMPLE, RANK, NEIGHBOURS, POWER, THRESHOLD = 1024, 64, 25, 4, 0.7
TRIGRAMS, SHAPES = 4096, 1024
REPEATS = (0.1, 0.2, 0.4, 0.7)
DIMS = TRIGRAMS + SHAPES + 1 + len(REPEATS)
CLASSES = bytes(ord("a") if b >= 0x80 or chr(b).islower() else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b for b in range(256))


def _trigrams(raw: bytes, dims: int) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(dims)
    code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(32 - dims.bit_length() + 1), minlength=dims)


def features(text: str | None) -> np.ndarray:
    """Counts of the hashed terms."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = raw.lower().split()
    again = sum(map(bytes.__eq__, ws, ws[1:]))
    return np.concatenate([_trigrams(raw.lower(), TRIGRAMS), _trigrams(raw.translate(CLASSES), SHAPES), [again, *(len(ws) * (again > r * len(ws) + 2) for r in REPEATS)]])


def weighted(texts: list, idf: np.ndarray) -> np.ndarray:
    x = np.stack([features(t) for t in texts]).astype(np.float32) if texts else np.zeros((0, DIMS), np.float32)
    np.sqrt(x, out=x)
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x, where=norm > 0)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen += features(text.as_py()) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(np.append(seen, n))], names=["dim", "n"])

    rows = docs.select("text").mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(DIMS + 1)
    for r in rows:  # a row for each hashed term
        found[r.dim] = r.n
    return found[:-1], int(found[-1])


class Model:
    """Axes, the sample's unit vectors in them, its labels and votes."""

    def __init__(self, idf: np.ndarray, x: np.ndarray, y: np.ndarray, shares: dict[int, float]) -> None:
        self.idf, self.y = idf.astype(np.float32), y
        self.prior = shares.get(1, 0.0) / sum(shares.values()) if shares else 0.5
        self.axes = None
        if len(x):
            values, left = np.linalg.eigh(x.astype(np.float64) @ x.T)
            top = np.argsort(-values)[:RANK]
            top = top[values[top] > 1e-9]
            if len(top):
                self.axes = (x.T @ (left[:, top] / np.sqrt(values[top]))).astype(np.float32)
                self.vectors = self._unit(x @ self.axes)
                counts = {c: int((y == c).sum()) for c in (0, 1)}
                self.votes = np.array([shares[int(c)] / counts[int(c)] for c in y], dtype=np.float32)

    @staticmethod
    def _unit(z: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-6)

    def score(self, texts: list) -> np.ndarray:
        if self.axes is None:
            return np.full(len(texts), self.prior)
        cosines = np.round(self._unit(weighted(texts, self.idf) @ self.axes) @ self.vectors.T, 5)
        k = min(NEIGHBOURS, cosines.shape[1])
        last = np.partition(cosines, -k, axis=1)[:, -k]
        row, near = np.nonzero((cosines >= last[:, None]) & (cosines > 0))  # those that tie with the last one vote too
        votes = cosines[row, near].astype(np.float64) ** POWER * self.votes[near]
        total, good = (np.bincount(row, x, len(texts)) for x in (votes, votes * (self.y[near] == 1)))
        return np.where(total > 0, good / np.where(total > 0, total, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    learn = labels.select(F.col("doc_id").alias("_l"), F.col("quality").cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_l").isNotNull() & (fold(F.col("_l"), FOLDS) != HELD_OUT))
    shares = {r["_y"]: r["count"] for r in learn.groupBy("_y").count().collect()}
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    order = F.crc32(F.concat(F.lit("s"), F.col("_l").cast("string")).cast("binary"))
    chosen = [learn.filter(F.col("_y") == c).orderBy(order, "_l").limit(sample) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # 2 * sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [weighted([t.as_py()], idf.astype(np.float32)).astype(np.float16).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_l").cast(pa.string()), batch.column("_y").cast(pa.int32()), pa.array(x, pa.binary())], names=["id", "y", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In one task, whose input is the bounded sample; the driver gets the model alone, about 2 MB."""
        got = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("y", "id", "x")))), key=lambda r: r[:2])
        got = [r for r in got if np.frombuffer(r[2], np.float16).any()]
        x = np.array([np.frombuffer(r[2], np.float16) for r in got], dtype=np.float32).reshape(-1, DIMS)
        model = Model(idf, x, np.array([r[0] for r in got], dtype=np.int32), shares)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_l")).mapInArrow(run, "id string, y int, x binary")
    # rows that repeat a doc_id repeat its label: the least vector of each is taken, which keeps the sample within its bound
    return pickle.loads(rows.groupBy("id", "y").agg(F.min("x").alias("x")).repartition(1).mapInArrow(train, "model binary").first()[0])


def score(self, texts: list) -> np.ndarray:
        if self.axes is None:
            return np.full(len(texts), self.prior)
        cosines = np.round(self._unit(weighted(texts, self.idf) @ self.axes) @ self.vectors.T, 5)
        k = min(NEIGHBOURS, cosines.shape[1])
        last = np.partition(cosines, -k, axis=1)[:, -k]
        row, near = np.nonzero((cosines >= last[:, None]) & (cosines > 0))  # those that tie with the last one vote too
        votes = cosines[row, near].astype(np.float64) ** POWER * self.votes[near]
        total, good = (np.bincount(row, x, len(texts)) for x in (votes, votes * (self.y[near] == 1)))
        return np.where(total > 0, good / np.where(total > 0, total, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    learn = labels.select(F.col("doc_id").alias("_l"), F.col("quality").cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_l").isNotNull() & (fold(F.col("_l"), FOLDS) != HELD_OUT))
    shares = {r["_y"]: r["count"] for r in learn.groupBy("_y").count().collect()}
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    order = F.crc32(F.concat(F.lit("s"), F.col("_l").cast("string")).cast("binary"))
    chosen = [learn.filter(F.col("_y") == c).orderBy(order, "_l").limit(sample) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # 2 * sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [weighted([t.as_py()], idf.astype(np.float32)).astype(np.float16).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_l").cast(pa.string()), batch.column("_y").cast(pa.int32()), pa.array(x, pa.binary())], names=["id", "y", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_l")).mapInArrow(run, "id string, y int, x binary")
    # rows that repeat a doc_id repeat its label: the least vector of each is taken, which keeps the sample within its bound
    got = sorted(rows.groupBy("id", "y").agg(F.min("x").alias("x")).collect(), key=lambda r: (r.y, r.id))
    got = [r for r in got if np.frombuffer(r.x, np.float16).any()]
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], dtype=np.float32).reshape(-1, DIMS)
    y = np.array([r.y for r in got], dtype=np.int32)
    return Model(idf, x, y, {c: shares[c] for c in shares})


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = shared.value.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, all_docs: DataFrame | None = None) -> DataFrame:
    """The rows that are predicted 1, with their columns: a filter without a shuffle."""
    from .common import keep_rows

    shared = docs.sparkSession.sparkContext.broadcast(fit(docs if all_docs is None else all_docs, labels))
    return keep_rows(docs, "text", lambda: lambda texts: list(map(bool, shared.value.score(texts) >= THRESHOLD)))
