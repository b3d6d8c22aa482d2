"""Display colours as column expressions (0..1 triples or 0..255 integers)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from opsinlake import constants as C


def clamp(v: Column, lo=0.0, hi=1.0) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def _ladder(x: Column, steps, last: Column) -> Column:
    """First value whose upper bound lies above ``x``."""
    out = None
    for bound, value in steps:
        out = F.when(x < bound, value) if out is None else out.when(x < bound, value)
    return out.otherwise(last)


def _visible(wl: Column) -> list[Column]:
    one, zero = F.lit(1.0), F.lit(0.0)
    r = _ladder(wl, [(440, -(wl - 440.0) / 60.0), (510, zero), (580, (wl - 510.0) / 70.0)], one)
    g = _ladder(wl, [(440, zero), (490, (wl - 440.0) / 50.0), (580, one), (645, -(wl - 645.0) / 65.0)], zero)
    b = _ladder(wl, [(490, one), (510, -(wl - 510.0) / 20.0)], zero)
    dim = F.when(wl < 420, clamp(0.3 + 0.7 * (wl - 380.0) / 40.0, 0.3, 1.0)).otherwise(one)
    return [clamp(c * dim) for c in (r, g, b)]


def wavelength_rgb(wl: Column) -> list[Column]:
    """Physical gradient: violet fades to white below 380 nm, red fades to black above 700 nm."""
    violet, red = (0.3, 0.0, 0.3), (1.0, 0.0, 0.0)
    uv = clamp((380.0 - wl) / 180.0)
    ir = clamp((wl - 700.0) / 300.0)
    return [
        F.when(wl < 380, v + (1.0 - v) * uv).when(wl > 700, d * (1.0 - ir)).otherwise(c)
        for v, d, c in zip(violet, red, _visible(wl))
    ]


def _lobe(wl, weight, mean, left, right, exp, pick):
    d = (wl - mean) / pick(wl < mean, left, right)
    return weight * exp(-0.5 * (d * d))


def _fit(wl, lobes, exp, pick):
    total = None
    for lobe in lobes:
        v = _lobe(wl, *lobe, exp, pick)
        total = v if total is None else total + v
    return total


def color_matching(wl: Column) -> list[Column]:
    """CIE 1931 x, y, z at a wavelength."""
    def pick(test, a, b):
        return F.when(test, F.lit(a)).otherwise(F.lit(b))
    return [_fit(wl, lobes, F.exp, pick) for lobes in (C.CIE_X, C.CIE_Y, C.CIE_Z)]


def color_matching_table(wl: np.ndarray) -> np.ndarray:
    """The same three functions on a fixed grid, shape (3, grid)."""
    return np.array([_fit(wl, lobes, np.exp, np.where) for lobes in (C.CIE_X, C.CIE_Y, C.CIE_Z)])


def _gamma(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1.0 / 2.4)) * 1.055 - 0.055)


def xyz_to_srgb(x: Column, y: Column, z: Column) -> list[Column]:
    """Gamma-encoded sRGB; negatives are cut, then the brightest channel is scaled to one."""
    linear = [F.greatest(x * a + y * b + z * c, F.lit(0.0)) for a, b, c in C.XYZ_TO_SRGB]
    peak = F.greatest(*linear)
    return [_gamma(clamp(F.when(peak > 0, v / F.when(peak > 0, peak)).otherwise(F.lit(0.0)))) for v in linear]


def _f(v) -> Column:
    return F.lit(float(v)).cast("float")


def _unit(v: Column, lo=0.0) -> Column:
    return F.least(F.greatest(v.cast("float"), _f(lo)), _f(1.0))


def _span(lo: Column, hi: Column) -> Column:
    return F.greatest(hi.cast("float") - lo.cast("float"), _f(C.F32_TINY))


def normalize_unit(v: Column, lo: Column, hi: Column) -> Column:
    """Position in a range, 0..1; a flat range gives 0. Single precision throughout."""
    return _unit(F.try_divide(v.cast("float") - lo.cast("float"), _span(lo, hi)))


def normalize_opponent(v: Column, lo: Column, hi: Column) -> Column:
    """Position in a range, -1..1; a flat range gives -1."""
    t = F.try_divide(v.cast("float") - lo.cast("float"), _span(lo, hi)).cast("float")
    return t * _f(2.0) - _f(1.0)


def to_byte(v: Column) -> Column:
    """0..1 to 0..255, half away from zero, in single precision."""
    return F.floor((_unit(v) * _f(255.0)).cast("float") + _f(0.5)).cast("int")


def grayscale(t: Column) -> list[Column]:
    g = to_byte(t)
    return [g, g, g]


def blue(t: Column) -> list[Column]:
    return [F.floor((_unit(t) * _f(slope)).cast("float") + _f(base)).cast("int") for base, slope in C.BLUE_RAMP]


def viridis(t: Column) -> list[Column]:
    t = _unit(t)
    out = []
    for channel in range(3):
        stops = [float(a[channel]) for a in C.VIRIDIS]
        value = None
        for i, (a, b) in enumerate(zip(stops, stops[1:])):
            mixed = _f(a) + _f(b - a) * ((t - _f(0.25 * i)) * _f(4.0))
            bound = t <= _f(0.25 * (i + 1))
            value = F.when(bound, mixed) if value is None else value.when(bound, mixed)
        out.append(F.floor(value + _f(0.5)).cast("int"))
    return out


COLORMAPS = {"viridis": viridis, "grayscale": grayscale, "blue": blue}


def opponent_rgb(l: Column, c1: Column, c2: Column) -> list[Column]:
    """False colour of a luminance and two opponent channels."""
    l, c1, c2 = _unit(l), _unit(c1, -1.0), _unit(c2, -1.0)
    return [to_byte(l * _f(a) + c1 * _f(b) + c2 * _f(c)) for a, b, c in C.OPPONENT_RGB]
