"""Quality classifier: a byte convolutional network over overlapping chunks that cover the whole document.

Filters of several widths are max-pooled over each chunk; a hidden layer turns a chunk into a few detectors; the largest
value of each detector over all chunks of a document is combined into one probability. Trained in numpy, end to end, on
a bounded labelled sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsinlake.llm.bytecnn import Adam, Filters, windows
from opsinlake.llm.scratch import hashed_sample
from opsinlake.llm.words import blocks, utf8

CHUNK, STRIDE = 256, 208
TRAIN_ROWS = 3_000  # bound of the labelled sample
TRAIN_CHUNKS = 64  # a text of more chunks is learned from that many, at hashed places anywhere in it
STEPS, BATCH, HIDDEN = 400, 48, 16
STEP_CHUNKS = 480  # a step takes fewer texts if they have more chunks in all, two at least
THRESHOLD = 0.3


class Model:
    def __init__(self, filters: Filters, w1, b1, w2, b2):
        self.filters, self.w1, self.b1, self.w2, self.b2 = filters, w1, b1, w2, b2

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Of label 1. A text without a chunk has all detectors at rest."""
        row, x = windows(texts, CHUNK, STRIDE)
        hidden = np.maximum(self.filters.infer(x) @ self.w1 + self.b1, 0)
        top = np.zeros((len(texts), HIDDEN), np.float32)
        if len(row):
            head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            top[row[head]] = np.maximum.reduceat(hidden, head, axis=0)
        return 1 / (1 + np.exp(-(top @ self.w2 + self.b2[0]).astype(np.float64)))


def train(texts: list[list[str]], labels: list[int], seed: int = 3) -> Model | None:
    """From texts given as pieces; a step sees all chunks of its texts. None unless there are texts of both labels. Both labels
    weigh the same."""
    y = np.array(labels, np.float32)
    piece, x = windows(pa.array([p for t in texts for p in t], pa.large_string()), CHUNK, STRIDE)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[piece]
    first = np.searchsorted(row, np.arange(len(y) + 1))
    usable = [np.flatnonzero((y == v) & (np.diff(first) > 0)) for v in (0, 1)]
    if not len(usable[0]) or not len(usable[1]):
        return None
    rng = np.random.default_rng(seed)
    filters = Filters(widths=(2, 3, 5), seed=seed)
    w1 = rng.normal(0, 0.2, (filters.size, HIDDEN)).astype(np.float32)
    b1 = np.full(HIDDEN, 0.1, np.float32)
    w2 = rng.normal(0, 0.3, HIDDEN).astype(np.float32)
    b2 = np.zeros(1, np.float32)
    adam = Adam([*filters.tables, w1, b1, w2, b2], 0.005)
    for _ in range(STEPS):
        docs = np.stack([rng.choice(u, BATCH // 2) for u in usable], axis=1).ravel()  # labels in turn
        fit_in = int(np.searchsorted(np.cumsum(first[docs + 1] - first[docs]), STEP_CHUNKS, side="right"))
        docs = docs[: max(2, fit_in // 2 * 2)]
        take = [np.arange(first[d], first[d + 1]) for d in docs]
        own = np.repeat(np.arange(len(docs)), [len(t) for t in take])
        chunks = x[np.concatenate(take)]
        top, where = filters.pooled(chunks)
        hidden = np.maximum(top @ w1 + b1, 0)
        best, at = np.zeros((len(docs), HIDDEN), np.float32), np.zeros((len(docs), HIDDEN), int)
        for i in range(len(docs)):
            inside = np.flatnonzero(own == i)
            at[i] = inside[hidden[inside].argmax(axis=0)]
            best[i] = hidden[at[i], np.arange(HIDDEN)]
        g = ((1 / (1 + np.exp(-(best @ w2 + b2[0]))) - y[docs]) / len(docs)).astype(np.float32)
        gh = np.zeros_like(hidden)
        np.add.at(gh, (at, np.arange(HIDDEN)[None, :].repeat(len(docs), 0)), g[:, None] * w2[None, :])
        gh *= hidden > 0
        adam.step([*filters.gradients(chunks, where, gh @ w1.T), top.T @ gh, gh.sum(axis=0), best.T @ g, np.array([g.sum()], np.float32)])
    return Model(filters, w1, b1, w2, b2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from at most ``train_rows`` labelled rows outside the held-out fifth, taken by a hash of doc_id. A document
    with both labels counts as 0."""
    marked = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    sample = hashed_sample(marked.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality")), train_rows)
    size = F.length("text")
    places = F.transform(F.sequence(F.lit(1), F.lit(TRAIN_CHUNKS)), lambda i: F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", i), size - CHUNK + 1) + 1).cast("int"), F.lit(CHUNK)))
    pieces = F.when(size <= TRAIN_CHUNKS * STRIDE, F.array("text")).otherwise(places)
    rows = docs.where("text is not null and text <> ''").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", pieces.alias("pieces"))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("pieces").alias("pieces")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return train([r["pieces"] for r in rows], [int(r["quality"] == 1) for r in rows])


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=1 << 20):
                texts = utf8(part.column("text"))
                p = model.probabilities(texts) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; predicted is 1 from a score of 0.3.

    Null and empty texts have the score of a document in which no detector fires. Without labels of both kinds every
    score is 0.5. A null doc_id is kept and not held out; repeated rows give equal rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = model or fit(docs, labels, train_rows)
    found = docs.mapInArrow(_score(model), "doc_id bigint, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
