"""Compile a visual system and a light into the small matrices a Spark plan embeds.

Everything here is bounded by the receptor limit (64) and the band count, never by data, so it runs once on the
driver and is shipped inside the query plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from opsinlake import constants as C
from opsinlake.functions.gain import gain_value
from opsinlake.functions.monotone import Bundle, hermite_weights
from opsinlake.plans.adaptation import gram, sharpen
from opsinlake.plans.systems import (
    Regime, ResolvedRegime, VisualSystem, curve_integral, product_integral, resolve, trapezoid,
)

RAW, ADAPTED, PERCEPTUAL = "raw", "adapted", "perceptual"
REFLECTANCE, RADIANCE = "reflectance", "radiance"


class KernelError(ValueError):
    """A kernel cannot be built or applied."""


def check_wavelengths(wavelengths) -> np.ndarray:
    wl = np.asarray([] if wavelengths is None else wavelengths, dtype=float)
    if not len(wl):
        raise KernelError("bands need wavelengths before a kernel can be built")
    bad = np.nonzero(np.diff(wl) <= 0)[0]
    if len(bad):
        i = bad[0]
        raise KernelError(f"band {i + 1} at {wl[i + 1]:g} nm does not lie above band {i} at {wl[i]:g} nm")
    return wl


def band_weights(wavelengths) -> np.ndarray:
    """Trapezoid weights over band centres; a single band weighs one."""
    wl = np.asarray(wavelengths, dtype=float)
    if len(wl) == 1:
        return np.ones(1)
    gaps = np.diff(wl)
    return 0.5 * (np.concatenate([gaps, [0.0]]) + np.concatenate([[0.0], gaps]))


def chroma_axes(candidates, weights, eps=1e-9) -> np.ndarray:
    """Unit axes orthogonal to luminance and to each other; candidates that add nothing new are dropped."""
    basis, axes = [np.asarray(weights, dtype=float)], []
    for row in candidates:
        v = np.array(row, dtype=float)
        for b in basis:
            size = b @ b
            if size >= eps:
                v = v - (v @ b) / size * b
        length = math.sqrt(v @ v)
        if length > eps:
            axes.append(v / length)
            basis.append(axes[-1])
    return np.array(axes).reshape(len(axes), len(basis[0]))


@lru_cache(maxsize=4096)
def _sharpened(curves: tuple):
    m, inv, lam, dominant = sharpen(gram(curves)[None])
    return m[0], inv[0], float(lam[0]), bool(dominant[0])


@dataclass(frozen=True)
class RegimeState:
    """A regime under one light: what each member sees, its gain, and the adaptation and opponent matrices."""

    resolved: ResolvedRegime
    total_irradiance: float
    seen: np.ndarray
    gains: np.ndarray
    adaptation: np.ndarray
    axes: np.ndarray

    @property
    def regime_gain(self) -> float:
        return float(np.prod(self.gains))

    @property
    def active(self) -> bool:
        return bool((self.gains > C.ACTIVE_GAIN).any())

    @property
    def opponent(self) -> np.ndarray:
        return np.vstack([self.resolved.weights[None, :], self.axes])


def seen_irradiance(receptors, light) -> np.ndarray:
    return np.array([product_integral(r.points, light) for r in receptors])


def window_gains(receptors, seen, defaults) -> np.ndarray:
    lo, hi, soft = defaults

    def first(*values):
        return next((v for v in values if v is not None), None)

    return np.array([
        gain_value(
            float(e),
            first(r.illumination_min, lo),
            first(r.illumination_max, hi),
            first(r.illumination_softness, soft, C.DEFAULT_SOFTNESS),
        )
        for r, e in zip(receptors, seen)
    ])


def caps_of(receptors) -> np.ndarray:
    return np.array([math.inf if r.saturation is None else r.saturation for r in receptors])


def _light_key(light) -> tuple:
    return tuple(map(tuple, np.asarray(light, dtype=float).tolist()))


@lru_cache(maxsize=4096)
def _state(system: VisualSystem, regime: Regime, light: tuple) -> RegimeState:
    rr = resolve(system, regime)
    seen = seen_irradiance(rr.members, light)
    gains = window_gains(rr.members, seen, rr.window_defaults)
    if not rr.members:
        empty = np.zeros((0, 0))
        return RegimeState(rr, curve_integral(light), seen, gains, empty, empty)
    # the adapting white point passes through the same gains and caps as any stimulus
    white = np.fmin(gains * seen, caps_of(rr.members))
    m, inv, _, _ = _sharpened(tuple(r.points for r in rr.members))
    channel = m @ white
    scale = np.where(np.abs(channel) < 1e-12, 1.0, 1.0 / np.where(channel == 0, 1.0, channel))
    return RegimeState(
        rr, curve_integral(light), seen, gains, inv @ (scale[:, None] * m), chroma_axes(rr.candidates, rr.weights)
    )


def regime_state(system: VisualSystem, regime: Regime, light) -> RegimeState:
    return _state(system, regime, _light_key(light))


def regime_states(system: VisualSystem, light) -> list[RegimeState]:
    return [regime_state(system, r, light) for r in system.regimes]


def dominant_regime(states) -> int | None:
    """Index of the regime with the largest activity; the last of equals wins."""
    best = None
    for i, s in enumerate(states):
        if best is None or s.regime_gain >= states[best].regime_gain:
            best = i
    return best


@dataclass(frozen=True)
class Kernel:
    """Per-pixel linear algebra: response, gain, cap, adaptation, opponent rows."""

    stage: str
    system: str
    regime: str | None
    names: tuple
    response: np.ndarray
    gains: np.ndarray
    caps: np.ndarray
    adaptation: np.ndarray | None
    opponent: np.ndarray | None
    noise: np.ndarray | None
    regime_gain: float
    active: bool

    @property
    def bands(self) -> int:
        return self.response.shape[1]

    @property
    def channels(self) -> int:
        return len(self.names)

    @property
    def mix(self) -> np.ndarray:
        """Everything after the cap as one matrix."""
        out = np.eye(len(self.gains))
        if self.adaptation is not None:
            out = self.adaptation @ out
        return out if self.opponent is None else self.opponent @ out

    @property
    def folded(self) -> np.ndarray | None:
        """The whole kernel as one (channels, bands) matrix, or None when a cap makes it non-linear."""
        if np.isfinite(self.caps).any():
            return None
        return self.mix @ (self.gains[:, None] * self.response)


def _response(receptors, wl, light, input_kind) -> np.ndarray:
    s = np.nan_to_num(Bundle.of(*[r.points for r in receptors]).resample(wl)) * band_weights(wl)
    if input_kind == REFLECTANCE:
        s = s * np.nan_to_num(Bundle.of(light).resample(wl)[0])
    return s


def _check(receptors, light, input_kind, stage, empty):
    if not len(receptors):
        raise KernelError(empty)
    if len(receptors) > C.MAX_RECEPTORS:
        raise KernelError(f"{len(receptors)} receptors exceed the limit of {C.MAX_RECEPTORS}")
    if light is None and (input_kind == REFLECTANCE or stage != RAW):
        what = "reflectance" if input_kind == REFLECTANCE else stage
        raise KernelError(f"a reference light is required for {what} rendering")


def compile_regime(system: VisualSystem, regime, wavelengths, light=None, input_kind=REFLECTANCE,
                   stage=PERCEPTUAL) -> Kernel:
    """Kernel of one regime. Without a light (raw radiance only) every gain is one."""
    regime = regime if isinstance(regime, Regime) else system.regime(regime)
    wl = check_wavelengths(wavelengths)
    rr = resolve(system, regime)
    _check(rr.members, light, input_kind, stage, "nothing to compile: no receptor belongs to this regime")
    names = tuple(r.name for r in rr.members)
    n = len(names)
    gains, regime_gain, active, adaptation, opponent = np.ones(n), 1.0, True, None, None
    if light is not None:
        st = regime_state(system, regime, light)
        gains, regime_gain, active = st.gains, st.regime_gain, st.active
        if stage != RAW:
            adaptation = st.adaptation
        if stage == PERCEPTUAL:
            opponent = st.opponent
            names = ("L",) + tuple(f"C{i}" for i in range(1, len(opponent)))
    return Kernel(stage, system.name, regime.name, names, _response(rr.members, wl, light, input_kind), gains,
                  caps_of(rr.members), adaptation, opponent, rr.noise, regime_gain, active)


def compile_pool(system: VisualSystem, wavelengths, light=None, input_kind=REFLECTANCE) -> Kernel:
    """Raw kernel over every receptor of the pool, gated by the receptor's own window."""
    wl = check_wavelengths(wavelengths)
    _check(system.pool, light, input_kind, RAW, "nothing to compile: the receptor pool is empty")
    n = len(system.pool)
    gains = np.ones(n)
    if light is not None:
        defaults = (system.illumination_min, system.illumination_max, system.illumination_softness)
        gains = window_gains(system.pool, seen_irradiance(system.pool, light), defaults)
    return Kernel(RAW, system.name, None, tuple(r.name for r in system.pool),
                  _response(system.pool, wl, light, input_kind), gains, caps_of(system.pool), None, None, None,
                  float(np.prod(gains)), bool((gains > C.ACTIVE_GAIN).any()))


def compile_all(system: VisualSystem, wavelengths, light=None, input_kind=REFLECTANCE, stage=PERCEPTUAL):
    """One kernel per regime; a system without regimes falls back to its pool."""
    if not system.regimes:
        return [compile_pool(system, wavelengths, light, input_kind)]
    return [compile_regime(system, r, wavelengths, light, input_kind, stage) for r in system.regimes]


# ------------------------------------------------------------------ curves that share one wavelength axis


@dataclass(frozen=True)
class Resampling:
    """Stimuli times a light on the grid of their common domain, for an axis the receptor grid does not meet at its
    knots: four weights a grid point. The value and slope weights of the kernel then belong to this grid."""

    axis: np.ndarray
    index: np.ndarray
    weights: np.ndarray
    grid: np.ndarray

    @property
    def key(self) -> bytes:
        return self.axis.tobytes() + self.grid.tobytes() + self.weights.tobytes()

    def products(self, y: np.ndarray, m: np.ndarray) -> np.ndarray:
        i, w = self.index, self.weights
        return y[:, i] * w[0] + m[:, i] * w[1] + y[:, i + 1] * w[2] + m[:, i + 1] * w[3]


@dataclass(frozen=True)
class CurveKernel:
    """Exact quadrature for stimuli sampled on one axis.

    The cubic through a stimulus is linear in its knot values and tangents, so every receptor integral over the
    1 nm grid is ``value_weights @ values + slope_weights @ tangents``. Under a light whose grid does not meet the axis, values
    and tangents are those of the resampled product ``lit``.
    """

    system: str
    regime: str | None
    axis: np.ndarray
    value_weights: np.ndarray
    slope_weights: np.ndarray
    gains: np.ndarray
    caps: np.ndarray
    adaptation: np.ndarray | None
    opponent: np.ndarray | None
    noise: np.ndarray | None
    regime_gain: float
    receptor_names: tuple
    lit: Resampling | None = None

    @property
    def chroma(self) -> int:
        return 0 if self.opponent is None else len(self.opponent) - 1

    @property
    def width(self) -> int:
        """Columns a coordinate row holds: luminance, chroma axes, saturation, adapted responses."""
        return len(self.gains) if self.opponent is None else 2 + self.chroma + len(self.gains)


def _quadrature(axis, receptors, light, step):
    """(resampling or None, value weights, slope weights) of ``integral(receptor * stimulus [* light])`` for each receptor.

    Where every receptor grid meets the knots of the lit stimulus, the light folds into the weights of the axis."""
    if light is None:
        return None, *_weights(axis, receptors, None, None, step)
    lit = Bundle.of(light)
    a, b = max(axis[0], lit.lo[0]), min(axis[-1], lit.hi[0])
    n = max(int(math.floor((b - a) / step + 0.5)), 1) if b > a else -1
    knots = a + step * np.arange(n + 1)
    knots = knots[(knots <= axis[-1]) & (knots <= lit.hi[0])]
    folded = _weights(axis, receptors, lit, knots, step)
    if folded is not None:
        return None, *folded
    i = np.clip(np.searchsorted(axis, knots, side="right") - 1, 0, len(axis) - 2)
    h = axis[i + 1] - axis[i]
    c = hermite_weights((knots - axis[i]) / h)
    shine = lit.sampled([0], knots)[0]
    stage = Resampling(axis, i, np.stack([c[0], c[1] * h, c[2], c[3] * h]) * shine, knots)
    return stage, *_weights(knots, receptors, None, None, step)


def _weights(axis, receptors, lit, knots, step):
    """Value and slope weights on ``axis``; None if a grid point of a receptor is not one of ``knots``."""
    first, last = (axis[0], axis[-1]) if knots is None else (knots[0], knots[-1]) if len(knots) else (math.inf, -math.inf)
    value, slope = np.zeros((len(receptors), len(axis))), np.zeros((len(receptors), len(axis)))
    for r, rec in enumerate(receptors):
        s = Bundle.of(rec.points)
        lo, hi = min(s.lo[0], first), max(s.hi[0], last)
        n = max(math.ceil((hi - lo) / step), 1)
        grid = lo + (hi - lo) / n * np.arange(n + 1)
        w = np.nan_to_num(s.resample(grid)[0]) * trapezoid(n, (hi - lo) / n)
        inside = (grid >= first) & (grid <= last)
        grid, w = grid[inside], w[inside]
        if lit is not None and len(grid):
            if np.abs(grid[:, None] - knots[None, :]).min(axis=1).max() > 1e-9:
                return None
            w = w * lit.sampled([0], grid)[0]
        if len(axis) == 1:  # a curve of one knot has a value there only
            value[r, 0] = w.sum()
            continue
        i = np.clip(np.searchsorted(axis, grid, side="right") - 1, 0, len(axis) - 2)
        h = axis[i + 1] - axis[i]
        c = hermite_weights((grid - axis[i]) / h)
        np.add.at(value[r], i, w * c[0])
        np.add.at(value[r], i + 1, w * c[2])
        np.add.at(slope[r], i, w * c[1] * h)
        np.add.at(slope[r], i + 1, w * c[3] * h)
    return value, slope


@lru_cache(maxsize=1024)
def _curve_kernel(system, regime, axis, light, input_kind) -> CurveKernel:
    wl = check_wavelengths(axis)
    if len(wl) < 2:
        raise KernelError("a stimulus axis needs at least two wavelengths")
    if regime is None:
        receptors = system.pool
        defaults = (system.illumination_min, system.illumination_max, system.illumination_softness)
        gains = window_gains(receptors, seen_irradiance(receptors, light), defaults)
        adaptation = opponent = noise = None
        activity = float(np.prod(gains))
    else:
        st = regime_state(system, regime, light)
        receptors, gains, adaptation, opponent = st.resolved.members, st.gains, st.adaptation, st.opponent
        noise, activity = st.resolved.noise, st.regime_gain
    lit, v, m = _quadrature(wl, receptors, light if input_kind == REFLECTANCE else None, C.STEP_NM)
    return CurveKernel(system.name, None if regime is None else regime.name, wl, v, m, gains, caps_of(receptors),
                       adaptation, opponent, noise, activity, tuple(r.name for r in receptors), lit)


def compile_curves(system: VisualSystem, regime, axis, light, input_kind=REFLECTANCE) -> CurveKernel:
    """Curve kernel of a regime, of the pool (``regime=None``) or of the ``"dominant"`` regime."""
    if regime == "dominant":
        best = dominant_regime(regime_states(system, light))
        regime = None if best is None else system.regimes[best]
    elif regime is not None and not isinstance(regime, Regime):
        regime = system.regime(regime)
    return _curve_kernel(system, regime, tuple(float(x) for x in axis), _light_key(light), input_kind)
