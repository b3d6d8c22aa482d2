"""Visual systems: a receptor pool plus regimes over it, as small driver-side objects."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from opsinlake import constants as C
from opsinlake.functions.monotone import Bundle
from opsinlake.functions.pigment import droplet_curve, template_curve


@dataclass(frozen=True)
class Receptor:
    name: str
    points: tuple  # ((wavelength nm, value), ...)
    omega: float | None = None
    eta: float | None = None
    luminance_weight: float | None = None
    saturation: float | None = None
    illumination_min: float | None = None
    illumination_max: float | None = None
    illumination_softness: float | None = None
    curve_type: str = "sensitivity"
    kind: str = "Sensitivity"
    metadata: tuple = ()


@dataclass(frozen=True)
class Regime:
    name: str
    members: tuple
    luminance_weights: tuple | None = None
    contrasts: tuple | None = None  # ((name, weights), ...)


@dataclass(frozen=True)
class VisualSystem:
    name: str
    pool: tuple
    regimes: tuple = ()
    illumination_min: float | None = None
    illumination_max: float | None = None
    illumination_softness: float | None = None
    metadata: tuple = field(default=())

    def regime(self, name_or_index) -> Regime:
        if isinstance(name_or_index, int):
            return self.regimes[name_or_index]
        return next(r for r in self.regimes if r.name == name_or_index)


@dataclass(frozen=True)
class ResolvedRegime:
    """A regime with out-of-range members skipped and every override checked against the member count."""

    name: str
    members: tuple
    weights: np.ndarray
    candidates: np.ndarray
    noise: np.ndarray | None
    window_defaults: tuple


def trapezoid(n: int, dx: float) -> np.ndarray:
    w = np.full(n + 1, dx)
    w[0] = w[-1] = dx / 2
    return w


def curve_integral(points, step=C.STEP_NM) -> float:
    """Trapezoid over the curve's own domain, stretched so the last sample is the domain end."""
    b = Bundle.of(points)
    if b.n[0] < 2:
        return 0.0
    lo, hi = b.lo[0], b.hi[0]
    n = max(math.ceil((hi - lo) / step), 1)
    dx = (hi - lo) / n
    v = np.nan_to_num(b.resample(lo + dx * np.arange(n + 1))[0])
    return float(v @ trapezoid(n, dx))


def product_integral(a, b, step=C.STEP_NM) -> float:
    """Integral of a product over the union of both domains; a curve is zero outside its own."""
    bundle = Bundle.of(a, b)
    have = bundle.n > 0
    if not have.any():
        return 0.0
    lo, hi = bundle.lo[have].min(), bundle.hi[have].max()
    if hi <= lo:
        return 0.0
    n = max(math.ceil((hi - lo) / step), 1)
    dx = (hi - lo) / n
    v = np.nan_to_num(bundle.resample(lo + dx * np.arange(n + 1)))
    return float((v[0] * v[1]) @ trapezoid(n, dx))


def luminance_weights(receptors) -> np.ndarray:
    """Overrides as given, otherwise the receptor's share of the pool's integrals."""
    area = np.array([curve_integral(r.points) for r in receptors])
    total = area.sum()
    share = area / total if total > 0 else np.zeros(len(area))
    given = [r.luminance_weight for r in receptors]
    return np.array([s if g is None else g for s, g in zip(share, given)], dtype=float)


def receptor_noise(receptors) -> np.ndarray | None:
    if any(r.omega is None or r.eta is None for r in receptors):
        return None
    eta = np.array([r.eta for r in receptors], dtype=float)
    if eta.sum() <= 0:
        return None
    with np.errstate(divide="ignore"):
        return np.array([r.omega for r in receptors]) / np.sqrt(eta / eta.sum())


def generic_candidates(n: int) -> np.ndarray:
    """One contrast per receptor against the mean of the others."""
    if n <= 1:
        return np.ones((n, n))
    rows = np.full((n, n), -1.0 / (n - 1))
    np.fill_diagonal(rows, 1.0)
    return rows


def resolve(system: VisualSystem, regime: Regime) -> ResolvedRegime:
    members = tuple(system.pool[i] for i in regime.members if 0 <= i < len(system.pool))
    n = len(members)
    own = regime.luminance_weights
    weights = np.array(own, dtype=float) if own is not None and len(own) == n else luminance_weights(members)
    rows = regime.contrasts
    usable = bool(rows) and all(len(w) == n for _, w in rows)
    candidates = np.array([w for _, w in rows], dtype=float) if usable else generic_candidates(n)
    return ResolvedRegime(
        regime.name,
        members,
        weights,
        candidates,
        receptor_noise(members),
        (system.illumination_min, system.illumination_max, system.illumination_softness),
    )


def _pts(arr) -> tuple:
    return tuple((float(a), float(b)) for a, b in arr)


def _build(spec: dict) -> VisualSystem:
    chromophore = spec.get("chromophore", "A1")
    pool = []
    for i, (name, peak) in enumerate(spec.get("receptors", ())):
        lower, upper, soft = spec.get("windows", {}).get(i, (None, None, None))
        pool.append(
            Receptor(
                name,
                _pts(template_curve(chromophore, peak)),
                omega=spec.get("omega", {}).get(i),
                eta=spec.get("eta", {}).get(i),
                luminance_weight=spec.get("weights", {}).get(i),
                illumination_min=lower,
                illumination_max=upper,
                illumination_softness=soft,
                metadata=(("lambda_max_nm", f"{peak:g}"),),
            )
        )
    raw = []
    for name, peak, droplet, cutoff in spec.get("filtered", ()):
        opsin, filt = template_curve("A1", peak), droplet_curve(cutoff)
        pool.append(Receptor(f"{name} (effective)", _pts(np.column_stack([opsin[:, 0], opsin[:, 1] * filt[:, 1]]))))
        raw.append(Receptor(name, _pts(opsin), metadata=(("lambda_max_nm", f"{peak:g}"),)))
        raw.append(
            Receptor(
                droplet, _pts(filt), curve_type="transmittance", kind="Transmittance",
                metadata=(("cutoff_50pct_nm", f"{cutoff:g}"),),
            )
        )
    pool += raw
    pool += [Receptor(name, _pts(points)) for name, points in spec.get("extra", ())]
    contrasts = spec.get("contrasts")
    regimes = tuple(Regime(name, members, contrasts=contrasts) for name, members in spec["regimes"])
    return VisualSystem(spec["name"], tuple(pool), regimes)


@lru_cache(maxsize=None)
def builtin_systems() -> dict[str, VisualSystem]:
    """The shipped systems by full name, in library order."""
    return {s["name"]: _build(s) for s in C.SYSTEMS}


def builtin(prefix: str) -> VisualSystem:
    """A shipped system by the start of its name, e.g. ``builtin("Human")``."""
    return next(s for n, s in builtin_systems().items() if n.lower().startswith(prefix.lower()))
