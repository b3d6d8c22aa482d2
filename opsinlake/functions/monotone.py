"""Monotone cubic (Fritsch-Carlson 1980) curves, vectorised over many curves at once.

``Bundle`` holds curves padded to a common length. It is the only numeric core the curve operators need
inside a task: everything around it (grids, products, sums, filters) is Spark expressions. The driver uses
the same class for the handful of receptor and light curves that are compiled into literals.
"""

from __future__ import annotations

import numpy as np

AT_ONCE = 1 << 17  # places evaluated at once


class Bundle:
    """Curves as padded rows: ``x`` ascending, ``y`` values, ``m`` tangents, ``n`` knots per row."""

    def __init__(self, flat_x, flat_y, lengths):
        lengths = np.asarray(lengths, dtype=np.int64)
        flat_x = np.asarray(flat_x, dtype=float)
        flat_y = np.asarray(flat_y, dtype=float)
        row = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((flat_x, row))  # stable, so the first of equal wavelengths stays first
        row, flat_x, flat_y = row[order], flat_x[order], flat_y[order]
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (flat_x[1:] - flat_x[:-1] >= np.finfo(float).eps)
        row, flat_x, flat_y = row[fresh], flat_x[fresh], flat_y[fresh]

        self.n = np.bincount(row, minlength=len(lengths))
        width = max(int(self.n.max(initial=0)), 1)
        col = np.arange(len(row)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.x = np.full((len(lengths), width), np.inf)
        self.y = np.zeros((len(lengths), width))
        self.x[row, col] = flat_x
        self.y[row, col] = flat_y
        self.m = tangents(self.x, self.y, self.n)

    @classmethod
    def of(cls, *curves):
        """Bundle from curves given as sequences of (wavelength, value)."""
        pts = [np.asarray(c, dtype=float).reshape(-1, 2) for c in curves]
        flat = np.concatenate(pts) if pts else np.empty((0, 2))
        return cls(flat[:, 0], flat[:, 1], [len(p) for p in pts])

    @classmethod
    def on(cls, x, y):
        """Bundle of curves that share the ascending knots ``x``; ``y`` has a row per curve."""
        out = cls.__new__(cls)
        y = np.atleast_2d(np.asarray(y, dtype=float))
        out.x = np.broadcast_to(np.asarray(x, dtype=float), y.shape)
        out.y, out.n = y, np.full(len(y), y.shape[1], dtype=np.int64)
        out.m = tangents(out.x, out.y, out.n)
        return out

    def take(self, rows):
        """The curves ``rows`` as a bundle."""
        out = Bundle.__new__(Bundle)
        out.x, out.y, out.m, out.n = self.x[rows], self.y[rows], self.m[rows], self.n[rows]
        return out

    @property
    def lo(self):
        return np.where(self.n > 0, self.x[:, 0], np.nan)

    @property
    def hi(self):
        last = np.maximum(self.n - 1, 0)
        return np.where(self.n > 0, self.x[np.arange(len(self.n)), last], np.nan)

    def segment(self, rows, xs):
        """Index of the last knot at or below each x (0 where x is left of the curve)."""
        lo = np.zeros(len(rows), dtype=np.int64)
        hi = self.n[rows]
        for _ in range(int(self.x.shape[1]).bit_length()):
            mid = (lo + hi) >> 1
            right = (mid < self.n[rows]) & (self.x[rows, np.minimum(mid, self.x.shape[1] - 1)] <= xs)
            lo = np.where((hi - lo > 1) & right, mid, lo)
            hi = np.where((hi - lo > 1) & ~right, mid, hi)
        return lo

    def at(self, rows, xs):
        """Values at ``xs`` of the curves ``rows`` (one for all, or one each); NaN outside a curve's own domain. Worked out in
        slices, so that only the result is as long as ``xs``."""
        xs = np.asarray(xs, dtype=float)
        rows = np.broadcast_to(np.asarray(rows, dtype=np.int64), xs.shape)
        out = np.empty(len(xs))
        for a in range(0, len(xs), AT_ONCE):
            out[a : a + AT_ONCE] = self._at(rows[a : a + AT_ONCE], xs[a : a + AT_ONCE])
        return out

    def _at(self, rows, xs):
        i = self.segment(rows, xs)
        j = np.minimum(i + 1, np.maximum(self.n[rows] - 1, 0))
        x0, x1, y0, y1 = self.x[rows, i], self.x[rows, j], self.y[rows, i], self.y[rows, j]
        knot = xs == x0
        with np.errstate(invalid="ignore"):
            h = np.where(j > i, x1 - x0, 1.0)
            c = hermite_weights((xs - x0) / h)
            out = c[0] * y0 + c[1] * h * self.m[rows, i] + c[2] * y1 + c[3] * h * self.m[rows, j]
            inside = (self.n[rows] > 0) & (xs >= self.x[rows, 0]) & ((xs < x1) | (xs == x0)) & ((j > i) | knot)
        return np.where(inside, np.where(knot, y0, out), np.nan)

    def sampled(self, rows, xs):
        """Curves ``rows`` on one grid, shape (rows, grid), zero outside. Where all of them have the same knots, the
        segments and weights of the grid are found once for all."""
        rows = np.asarray(rows)
        x, n = self.x[rows[0]], self.n[rows[0]]
        if n < 2 or (self.n[rows] != n).any() or (self.x[rows] != x).any():
            return np.nan_to_num(self.at(np.repeat(rows, len(xs)), np.tile(xs, len(rows)))).reshape(len(rows), len(xs))
        i = np.clip(np.searchsorted(x[:n], xs, side="right") - 1, 0, n - 2)
        h = x[i + 1] - x[i]
        c = [np.where((xs >= x[0]) & (xs <= x[n - 1]), w, 0.0) for w in hermite_weights((xs - x[i]) / h)]
        y, m = self.y[rows], self.m[rows]
        return c[0] * y[:, i] + c[1] * h * m[:, i] + c[2] * y[:, i + 1] + c[3] * h * m[:, i + 1]

    def resample(self, xs):
        """Every curve on one grid, shape (curves, grid); NaN outside."""
        k, g = len(self.n), len(xs)
        return self.at(np.repeat(np.arange(k), g), np.tile(xs, k)).reshape(k, g)


def hermite_weights(t):
    """Cubic Hermite basis at t: left value, left slope, right value, right slope (slopes times width)."""
    return (1 + 2 * t) * (1 - t) ** 2, t * (1 - t) ** 2, t * t * (3 - 2 * t), t * t * (t - 1)


def tangents(x, y, n):
    """Limited Hermite slopes of padded rows. The limiting pass runs left to right because each interval
    sees the slope its left neighbour already reduced; rows are processed side by side."""
    k, width = y.shape
    m = np.zeros((k, width))
    if width < 2:
        return m
    seg = np.arange(width - 1)[None, :] < (n - 1)[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.where(seg, (y[:, 1:] - y[:, :-1]) / (x[:, 1:] - x[:, :-1]), 0.0)
    d = np.nan_to_num(d, nan=0.0, posinf=0.0, neginf=0.0)
    m[:, 0] = d[:, 0]
    m[:, 1:-1] = np.where(seg[:, 1:], (d[:, :-1] + d[:, 1:]) / 2, d[:, :-1])
    m[:, -1] = d[:, -1]
    for i in range(width - 1):
        live, slope = seg[:, i], d[:, i]
        flat = live & (slope == 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            a, b = m[:, i] / slope, m[:, i + 1] / slope
            r = a * a + b * b
            shrink = live & ~flat & (r > 9)
            tau = np.where(shrink, 3 / np.sqrt(r), 1.0)
        m[:, i] = np.where(flat, 0.0, tau * m[:, i])
        m[:, i + 1] = np.where(flat, 0.0, tau * m[:, i + 1])
    return m
