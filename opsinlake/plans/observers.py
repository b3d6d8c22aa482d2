"""Several visual systems over stimuli with any knots: one stacked receptor operator for all of them.

A stimulus needs three steps: its monotone cubic, for a reflectance the product with the light on the common grid (whose
slopes are fitted on the product), and the trapezoid sum with every receptor over the union of their domains. Curves are fitted once, whatever
the number of systems. Weights depend only on where a curve begins and ends, so curves of one domain share them, and
curves with the same knots also share their segments.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from opsinlake import constants as C
from opsinlake.functions.monotone import Bundle
from opsinlake.plans import kernel as K
from opsinlake.plans.systems import VisualSystem, trapezoid

_KEPT = 512  # domains whose weights are kept


class ReceptorStack:
    """Integrals of receptors times stimuli on the trapezoid grid of each pair's domain."""

    def __init__(self, receptors, light, step: float = C.STEP_NM):
        self.receptors, self.light, self.step = Bundle.of(*receptors), Bundle.of(light), step
        self._weights: dict = {}

    def _over(self, lo: float, hi: float):
        """(grid, weights, receptors) for stimuli that span [lo, hi], one entry per distinct grid."""
        if (lo, hi) in self._weights:
            return self._weights[lo, hi]
        ends = np.stack([np.fmin(self.receptors.lo, lo), np.fmax(self.receptors.hi, hi)], axis=1)
        spans, which = np.unique(ends, axis=0, return_inverse=True)
        out = []
        for g, (a, b) in enumerate(spans):
            if not b > a:
                continue
            n = max(math.ceil((b - a) / self.step), 1)
            grid, mine = a + (b - a) / n * np.arange(n + 1), np.flatnonzero(which.ravel() == g)
            w = self.receptors.sampled(mine, grid) * trapezoid(n, (b - a) / n)
            inside = (grid >= lo) & (grid <= hi)
            out.append((grid[inside], w[:, inside].T, mine))
        if len(self._weights) >= _KEPT:
            self._weights.clear()
        self._weights[lo, hi] = out
        return out

    def integrals(self, curves: Bundle) -> np.ndarray:
        """(curves, receptors)."""
        out = np.zeros((len(curves.n), len(self.receptors.n)))
        for rows, (lo, hi) in _alike(np.flatnonzero(curves.n > 0), curves.lo, curves.hi):
            for grid, w, mine in self._over(lo, hi):
                out[np.ix_(rows, mine)] = curves.sampled(rows, grid) @ w
        return out

    def lit(self, curves: Bundle):
        """(rows, curves under the light): products on the grid of the common domain, from its lower end in whole steps."""
        lo, hi = np.fmax(curves.lo, self.light.lo[0]), np.fmin(curves.hi, self.light.hi[0])
        with np.errstate(invalid="ignore"):
            met = np.flatnonzero((curves.n > 0) & (hi > lo))
        for rows, (a, b) in _alike(met, lo, hi):
            n = max(math.floor((b - a) / self.step + 0.5), 1)
            grid = a + self.step * np.arange(n + 1)
            grid = grid[grid <= b]
            yield rows, Bundle.on(grid, curves.sampled(rows, grid) * self.light.sampled([0], grid))

    def seen(self, curves: Bundle, reflects: np.ndarray) -> np.ndarray:
        """Integrals of stimuli, reflectances under the light and all others as they are."""
        out = np.zeros((len(curves.n), len(self.receptors.n)))
        own = np.flatnonzero(~reflects)
        if len(own):
            out[own] = self.integrals(curves.take(own))
        lit = np.flatnonzero(reflects)
        if len(lit):
            for rows, product in self.lit(curves.take(lit)):
                out[lit[rows]] = self.integrals(product)
        return out


def _alike(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Rows by their pair (lo, hi)."""
    if not len(rows):
        return
    pairs, which = np.unique(np.stack([lo[rows], hi[rows]], axis=1), axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    cuts = np.cumsum(np.bincount(which.ravel()))[:-1]
    for pair, mine in zip(pairs, np.split(rows[order], cuts)):
        yield mine, (float(pair[0]), float(pair[1]))


@dataclass(frozen=True)
class Observer:
    """A regime (or the pool) of a system under one light, without an axis."""

    system: str
    regime: str | None
    receptors: tuple
    gains: np.ndarray
    caps: np.ndarray
    adaptation: np.ndarray | None
    opponent: np.ndarray | None
    noise: np.ndarray | None
    regime_gain: float
    receptor_names: tuple

    @property
    def chroma(self) -> int:
        return 0 if self.opponent is None else len(self.opponent) - 1

    @property
    def width(self) -> int:
        return len(self.gains) if self.opponent is None else 2 + self.chroma + len(self.gains)


@dataclass(frozen=True)
class Panel:
    """Observers that look at the same stimuli under the same light."""

    observers: tuple
    light: tuple
    step: float = C.STEP_NM

    @cached_property
    def stack(self) -> ReceptorStack:
        return ReceptorStack([points for o in self.observers for points in o.receptors], self.light, self.step)

    def with_colours(self) -> Panel:
        """Without the observers that have no colour space."""
        return Panel(tuple(o for o in self.observers if o.opponent is not None), self.light, self.step)


def observe(system: VisualSystem, light, regime="dominant") -> Observer:
    """A regime by name, index or value; the dominant one under the light; or the pool (None)."""
    if regime == "dominant":
        best = K.dominant_regime(K.regime_states(system, light))
        regime = None if best is None else system.regimes[best]
    elif regime is not None and not isinstance(regime, K.Regime):
        regime = system.regime(regime)
    if regime is None:
        defaults = (system.illumination_min, system.illumination_max, system.illumination_softness)
        gains = K.window_gains(system.pool, K.seen_irradiance(system.pool, light), defaults)
        members, adaptation, opponent, noise, activity = system.pool, None, None, None, float(np.prod(gains))
    else:
        st = K.regime_state(system, regime, light)
        members, gains, adaptation, opponent = st.resolved.members, st.gains, st.adaptation, st.opponent
        noise, activity = st.resolved.noise, st.regime_gain
    return Observer(system.name, None if regime is None else regime.name, tuple(r.points for r in members), gains, K.caps_of(members),
                    adaptation, opponent, noise, activity, tuple(r.name for r in members))


def panel(systems, light, regime="dominant") -> Panel:
    """One observer per system."""
    return Panel(tuple(observe(s, light, regime) for s in systems), tuple(map(tuple, np.asarray(light, dtype=float).tolist())))
