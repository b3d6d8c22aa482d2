"""Byte-level convolutions in numpy: windows of bytes, filters of several widths, max pooling, and the gradients to train
them. A filter of width w is w tables of 256 rows, so a convolution is a sum of table look-ups; the gradient of a
max-pooled filter touches only the bytes under its maximum."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from opsinlake.llm.words import offsets

PAD = 0  # stands after the end of a text shorter than a window


def windows(texts: pa.Array, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window x length bytes): windows that cover every text from its first to its last byte. The last window of a
    text ends with it; a text shorter than a window is padded; an empty text has no window."""
    data, at = offsets(texts)
    size = np.diff(at)
    count = np.where(size == 0, 0, 1 + np.maximum(0, -(-(size - length) // stride)))
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[row] + np.maximum(0, np.minimum(nth * stride, size[row] - length))
    index = begin[:, None] + np.arange(length)
    out = data[np.minimum(index, max(len(data) - 1, 0))] if len(row) else np.zeros((0, length), np.uint8)
    short = np.flatnonzero(size[row] < length)
    out[short] = np.where(index[short] < at[row[short] + 1][:, None], out[short], PAD)
    return row, out


class Filters:
    """``each`` filters of every width in ``widths``."""

    def __init__(self, widths=(2, 3, 4), each: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.widths, self.each = widths, each
        self.tables = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, each)).astype(np.float32) for w in widths]
        self.pairs: list[list[np.ndarray]] | None = None

    @property
    def size(self) -> int:
        return self.each * len(self.widths)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, max(self.widths) - 1)), constant_values=PAD)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Bytes of padded windows, one row a place. Maxima over places are then taken of whole rows, which numpy does
        several times faster than along an inner axis."""
        return np.ascontiguousarray(x.T, np.intp)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maxima, first place of each) of every filter over each window, for training."""
        n, length = x.shape
        x = self.places(self.padded(x))
        left = np.arange(length, 0, -1, dtype=np.int32)[:, None, None]  # places to the end; the first of equal maxima has most
        z, more = np.empty((2, length, n, self.each), np.float32)
        top, where = [], []
        for table in self.tables:
            np.take(table[0], x[:length], axis=0, out=z, mode="clip")
            for j in range(1, len(table)):
                z += np.take(table[j], x[j : j + length], axis=0, out=more, mode="clip")
            top.append(z.max(axis=0))
            where.append(length - ((z == top[-1]) * left).max(axis=0))
        return np.concatenate(top, axis=1), np.concatenate(where, axis=1)

    def infer(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        """Maxima only. Neighbouring bytes are looked up as pairs, in tables made once."""
        if self.pairs is None:
            self.pairs = [[(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in self.tables]
        n, length = x.shape
        x, out = self.padded(x), np.empty((n, self.size), np.float32)
        for a in range(0, n, step):
            part = self.places(x[a : a + step])
            two = (part[:-1] << 8) + part[1:]
            z, more = np.empty((2, length, part.shape[1], self.each), np.float32)
            for i, tables in enumerate(self.pairs):
                for k, table in enumerate(tables):
                    index = (two if len(table) > 256 else part)[2 * k : 2 * k + length]
                    np.take(table, index, axis=0, out=more if k else z, mode="clip")
                    if k:
                        z += more
                out[a : a + step, i * self.each : (i + 1) * self.each] = z.max(axis=0)
        return out

    def gradients(self, x: np.ndarray, where: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        x = self.padded(x)
        out = []
        for i, table in enumerate(self.tables):
            own = slice(i * self.each, (i + 1) * self.each)
            n, f = np.nonzero(g[:, own])
            value, at = g[:, own][n, f], where[:, own][n, f]
            grad = [np.bincount(x[n, at + j].astype(np.int64) * self.each + f, value, 256 * self.each) for j in range(len(table))]
            out.append(np.stack(grad).reshape(table.shape).astype(np.float32))
        return out


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.t = parameters, rate, 0
        self.m = [np.zeros_like(p) for p in parameters]
        self.v = [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.parameters, gradients, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
