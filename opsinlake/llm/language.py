"""Language identification by a byte convolutional network: filters of several widths over fixed windows, max pooling,
softmax. Trained in numpy on a bounded labelled sample; applied to windows that cover the whole of every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsinlake.llm.bytecnn import Adam, Filters, windows
from opsinlake.llm.scratch import hashed_sample
from opsinlake.llm.words import blocks, utf8

WINDOW = 256
TRAIN_ROWS = 4_000  # bound of the labelled sample
TRAIN_PIECES = 8  # pieces of a window's length from each sampled text, at hashed places over the whole of it
STEPS, BATCH = 500, 64
UNKNOWN = "und"


class Model:
    def __init__(self, names: list[str], filters: Filters, weights: np.ndarray, bias: np.ndarray):
        self.names, self.filters, self.weights, self.bias = names, filters, weights, bias

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Mean over a text's windows of the window's probabilities; equal for all languages without a window."""
        row, x = windows(texts, WINDOW, WINDOW - max(self.filters.widths) + 1)
        z = self.filters.infer(x) @ self.weights + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-30)
        total = np.stack([np.bincount(row, p[:, c], len(texts)) for c in range(len(self.names))], axis=1)
        count = np.bincount(row, minlength=len(texts))[:, None]
        return np.where(count > 0, total / np.maximum(count, 1), 1 / len(self.names))


def train(texts: list[str], langs: list[str], seed: int = 5) -> Model | None:
    """None without any labelled text with content."""
    names = sorted(set(langs))
    row, x = windows(pa.array(texts, pa.large_string()), WINDOW, WINDOW)
    if not len(row):
        return None
    y = np.array([names.index(v) for v in langs])[row]
    rng = np.random.default_rng(seed)
    filters = Filters(seed=seed)
    weights, bias = rng.normal(0, 0.1, (filters.size, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    adam = Adam([*filters.tables, weights, bias], 0.01)
    for _ in range(STEPS):
        at = rng.integers(0, len(row), BATCH)
        top, where = filters.pooled(x[at])
        z = top @ weights + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(BATCH), y[at]] -= 1
        g = (p / BATCH).astype(np.float32)
        adam.step([*filters.gradients(x[at], where, g @ weights.T), top.T @ g, g.sum(axis=0)])
    return Model(names, filters, weights, bias)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from at most ``train_rows`` rows outside the held-out quarter, taken by a hash of doc_id. Of a text, windows at hashed
    places anywhere in it come to the driver, as many as cover it but at most ``TRAIN_PIECES``."""
    usable = docs.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).where("text is not null and text <> ''")
    size = F.length("text")
    places = F.sequence(F.lit(1), F.least(F.lit(TRAIN_PIECES), F.ceil(size / WINDOW)).cast("int"))
    pieces = F.transform(places, lambda i: F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", i), F.greatest(F.lit(1), size - WINDOW + 1)) + 1).cast("int"), F.lit(WINDOW)))
    sampled = hashed_sample(usable.select("doc_id", "lang", pieces.alias("pieces")), train_rows, usable.count()).collect()
    rows = sorted((r["doc_id"], piece, r["lang"]) for r in sampled for piece in r["pieces"])
    return train([r[1] for r in rows], [r[2] for r in rows])


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=1 << 20):
                texts = utf8(part.column("text"))
                p = model.probabilities(texts) if model else np.zeros((len(texts), 1))
                best, known = p.argmax(axis=1), [model is not None and _has_letter(t) for t in texts.to_pylist()]
                names = [model.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)]
                score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; score is the probability of lang_pred.

    Texts that are null, empty or without a letter are ``und`` with score 0, as is everything if there is nothing to learn
    from. A null doc_id is kept and not held out. Repeated rows give equal rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *(["lang"] if "lang" in docs.columns else []))
    model = model or fit(docs, train_rows)
    found = docs.select("doc_id", "text").mapInArrow(_predict(model), "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
