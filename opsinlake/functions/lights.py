"""Light generators: black bodies, Gaussian peaks, notches, power scaling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsinlake import constants as C
from opsinlake.functions.bind import let


def planck_radiance(wl_nm, temperature_k, exp=F.exp):
    """Spectral radiance per nm (W sr^-1 m^-2 nm^-1)."""
    m = wl_nm * 1e-9
    x = (C.PLANCK_H * C.LIGHT_C) / (m * C.BOLTZMANN_K * temperature_k)
    return 2.0 * C.PLANCK_H * C.LIGHT_C**2 / (m * m * m * m * m * (exp(x) - 1.0)) * 1e-9


def gaussian(wl, centre_nm, amplitude, bandwidth_nm, exp=F.exp):
    d = (wl - centre_nm) / bandwidth_nm
    return amplitude * exp(-0.5 * d * d)


def notch_transmittance(wl, centre_nm, width_nm, depth, exp=F.exp):
    return 1.0 - gaussian(wl, centre_nm, depth, width_nm, exp)


def notch_product(wl, notches, exp=F.exp):
    """Combined transmittance of a fixed list of (centre, width, depth) notches."""
    out = None
    for centre, width, depth in notches:
        t = notch_transmittance(wl, centre, width, depth, exp)
        out = t if out is None else out * t
    return out


def _count(lo, hi, step) -> int:
    return max(int(np.floor((hi - lo) / step + 0.5)), 1)


def blackbody_points(temperature_k: Column, lo: float, hi: float, step: float, notches=()) -> Column:
    """Black-body light per row as ``array<struct<wl,v>>``: Planck over its own grid peak, times notches."""
    wl = np.array([lo + step * i for i in range(_count(lo, hi, step) + 1)])
    through = np.ones(len(wl)) if not notches else notch_product(wl, notches, np.exp)
    grid = F.lit([float(w) for w in wl])
    cells = F.arrays_zip(grid.alias("wl"), F.lit([float(t) for t in through]).alias("t"))

    def scaled(raw):
        def curve(top):
            rel = F.transform(raw, lambda v: F.when(top > 0, v / top).otherwise(F.lit(0.0)))
            return F.zip_with(cells, rel, lambda c, v: F.struct(c["wl"].alias("wl"), (v * c["t"]).alias("v")))

        return let(F.array_max(raw), curve)

    return let(F.transform(grid, lambda w: planck_radiance(w, temperature_k)), scaled)


def blackbody_curve(temperature_k, lo, hi, step, notches=()):
    wl = lo + step * np.arange(_count(lo, hi, step) + 1)
    v = planck_radiance(wl, temperature_k, np.exp)
    v = v / v.max()
    t = notch_product(wl, notches, np.exp)
    return np.column_stack([wl, v if t is None else v * t])


def notch_points(centre_nm: Column, width_nm: Column, depth: Column) -> Column:
    """A notch as an absorption curve over five widths each side, step = width/4 kept in [0.01, 1]."""
    half = F.lit(5.0) * F.greatest(width_nm, F.lit(1e-3))
    step = F.least(F.greatest(width_nm / 4.0, F.lit(0.01)), F.lit(1.0))
    n = F.ceil(half * 2.0 / step).cast("int")
    shape = {"c": centre_nm, "w": width_nm, "d": depth, "lo": centre_nm - half, "step": step}

    def curve(s):
        def point(i):
            wl = s["lo"] + i * s["step"]
            return F.struct(wl.alias("wl"), notch_transmittance(wl, s["c"], s["w"], s["d"]).alias("v"))

        return F.transform(F.sequence(F.lit(0), n), point)

    return let(F.struct(*[v.alias(k) for k, v in shape.items()]), curve)


def scale_points(points: Column, factor: Column) -> Column:
    """Same spectral shape, every value times ``factor``."""
    return let(factor, lambda f: F.transform(points, lambda p: F.struct(p["wl"].alias("wl"), (p["v"] * f).alias("v"))))


def power_factor(total: Column, target: Column) -> Column:
    """Factor that brings a light to a target total power; null when the light has no power to scale."""
    return F.when(total > 0, target / total)


def seed_lights():
    """Driver-side seed lights by name, as (n, 2) arrays."""
    name, t, lo, hi, step = C.SOLAR_LIGHT
    return {
        C.UNIFORM_LIGHT[0]: np.asarray(C.UNIFORM_LIGHT[1]),
        name: blackbody_curve(t, lo, hi, step, [n[1:] for n in C.NOTCHES]),
    }


def composite_curve(components, lo, hi, step):
    """Driver-side weighted sum of ((centre, amplitude, bandwidth), weight) components."""
    wl = lo + step * np.arange(_count(lo, hi, step) + 1)
    v = np.zeros(len(wl))
    for (centre, amp, bw), weight in components:
        v = v + weight * gaussian(wl, centre, amp, bw, np.exp)
    return np.column_stack([wl, v])


def composite_lights(components: DataFrame, lo: float, hi: float, step: float, key: str = "light") -> DataFrame:
    """Lights as weighted sums of Gaussian peaks: ``key, wl, v`` from ``key, centre_nm, amplitude, bandwidth_nm,
    weight``.

    Every grid wavelength is one running sum per light, so a task keeps one row per light however many components
    it sees and only those rows are shuffled; they are spread to long form afterwards.
    """
    grid = [lo + step * i for i in range(_count(lo, hi, step) + 1)]
    peak = {
        i: F.col("weight") * gaussian(F.lit(w), F.col("centre_nm"), F.col("amplitude"), F.col("bandwidth_nm"))
        for i, w in enumerate(grid)
    }
    sums = components.groupBy(key).agg(*[F.sum(p).alias(f"v{i}") for i, p in peak.items()])
    cells = [F.struct(F.lit(w).alias("wl"), F.col(f"v{i}").alias("v")) for i, w in enumerate(grid)]
    return sums.select(key, F.inline(F.array(*cells)))
