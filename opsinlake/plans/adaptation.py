"""Sharpening matrices: the receptor mix with the least pairwise overlap.

Minimises ``sum_{i<j} O_ij^2 + lambda * |off-diagonal|^2`` with ``O = M G M'`` and a unit diagonal, by gradient
descent with step halving. All systems of one size are solved side by side, so a batch of receptor sets from a
Spark partition costs little more than one.
"""

from __future__ import annotations

import math

import numpy as np

from opsinlake import constants as C
from opsinlake.functions.monotone import Bundle

MAX_ITERATIONS = 3000


def common_grid(curves, step=C.STEP_NM) -> np.ndarray:
    """Curves sampled on the union of their domains (fixed step from the low end), zero outside their own."""
    b = Bundle.of(*curves)
    have = b.n > 0
    lo, hi = (b.lo[have].min(), b.hi[have].max()) if have.any() else (0.0, 0.0)
    n = max(int(math.floor((hi - lo) / step + 0.5)), 1)
    return np.nan_to_num(b.resample(lo + step * np.arange(n + 1)))


def gram(curves, step=C.STEP_NM) -> np.ndarray:
    s = common_grid(curves, step)
    return step * (s @ s.T)


def descend(grams: np.ndarray, lam: float) -> np.ndarray:
    """Minimisers for a stack of Gram matrices (k, n, n) at one regularisation strength.

    A step is halved until the cost falls; the next one starts a fifth longer. A matrix is done when its gradient
    vanishes or after ``MAX_ITERATIONS`` steps. Cost and products of an accepted step serve the next one, and every
    distinct matrix is solved once."""
    k, n, _ = grams.shape
    if n < 2:
        return np.broadcast_to(np.eye(n), grams.shape).copy()
    grams, where = np.unique(grams, axis=0, return_inverse=True)
    k, off = len(grams), 1.0 - np.eye(n)

    def cost(x, g):
        mg = x @ g
        o = (mg @ np.swapaxes(x, 1, 2)) * off
        free = x * off
        return 0.5 * (o * o).sum((1, 2)) + lam * (free * free).sum((1, 2)), mg, o

    m = np.broadcast_to(np.eye(n), grams.shape).copy()
    f, mg, o = cost(m, grams)
    rate, live = np.full(k, 0.5), np.arange(k)
    for _ in range(MAX_ITERATIONS):
        grad = 2.0 * ((o[live] @ mg[live]) * off + lam * (m[live] * off))
        moving = np.sqrt((grad * grad).sum((1, 2))) >= 1e-10
        if not moving.all():
            live, grad = live[moving], grad[moving]
            if not len(live):
                break
        step, todo = rate[live], np.arange(len(live))
        while len(todo):
            at = live[todo]
            trial = m[at] - step[todo, None, None] * grad[todo]
            after, mg2, o2 = cost(trial, grams[at])
            done = (after < f[at]) | (step[todo] < 1e-8)
            hit = at[done]
            m[hit], f[hit], mg[hit], o[hit] = trial[done], after[done], mg2[done], o2[done]
            rate[hit] = step[todo[done]] * 1.2
            todo = todo[~done]
            step[todo] *= 0.5
    return m[where.ravel()]


def sharpen(grams: np.ndarray):
    """Walk the regularisation ladder for a stack of same-size systems.

    Returns ``(matrix, inverse, lambda, dominant)`` arrays. The first strength with every off-diagonal entry
    below one wins; without one, the strength with the smallest largest entry.
    """
    k, n, _ = grams.shape
    eye = np.broadcast_to(np.eye(n), (k, n, n)).copy()
    if n < 2:
        return eye, eye.copy(), np.zeros(k), np.ones(k, dtype=bool)
    best, top, used, dominant = eye, np.full(k, np.inf), np.zeros(k), np.zeros(k, dtype=bool)
    open_ = np.arange(k)
    for lam in C.SHARPEN_LAMBDAS:
        m = descend(grams[open_], lam)
        worst = np.abs(m * (1.0 - np.eye(n))).max((1, 2))
        better = worst < top[open_]
        hit = open_[better]
        best[hit], top[hit], used[hit] = m[better], worst[better], lam
        dominant[open_[worst < 1.0]] = True
        open_ = open_[worst >= 1.0]
        if not len(open_):
            break
    inverse = np.empty_like(best)
    for i in range(k):
        try:
            inverse[i] = np.linalg.inv(best[i])
        except np.linalg.LinAlgError:
            inverse[i] = np.eye(n)
    return best, inverse, used, dominant
