"""Visual-pigment templates and droplet filters.

The formulas are written once over Python operators, so the same definition builds Spark columns (pass
``F.exp``) and driver-side arrays (pass ``numpy.exp``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsinlake import constants as C
from opsinlake.functions.arrays import lists

_SCAN = -5.0 + 0.05 * np.arange(201)


def _alpha(a, x, exp):
    return 1.0 / (exp(69.7 * (a - x)) + exp(28.0 * (0.922 - x)) + exp(-14.9 * (1.104 - x)) + 0.674)


def template_raw(chromophore: str, peak_nm, wl, exp):
    """Govardovskii et al. (2000) absorbance, before peak normalisation."""
    x = peak_nm / wl
    if chromophore == "A1":
        off = peak_nm - 300.0
        a = 0.8795 + 0.0459 * exp(-(off * off) / 11940.0)
        amp, centre, width = 0.26, 189.0 + 0.315 * peak_nm, -40.5 + 0.195 * peak_nm
    elif chromophore == "A2":
        grow = exp((peak_nm - 665.0) / 40.7)
        a = 0.875 + 0.0268 * grow
        amp, centre = 0.26 + 0.0215 * grow, 216.7 + 0.368 * peak_nm
        width = 317.0 - 1.149 * peak_nm + 0.00124 * (peak_nm * peak_nm)
    else:
        raise ValueError(f"unknown chromophore {chromophore!r}")
    d = (wl - centre) / width
    return _alpha(a, x, exp) + amp * exp(-(d * d))


def template_peak(chromophore: str, peak_nm: Column) -> Column:
    """Largest raw template value within 5 nm of the nominal peak, scanned every 0.05 nm."""

    @F.arrow_udf(T.DoubleType())
    def scan(peaks: pa.Array) -> pa.Array:
        centre = peaks.to_numpy(zero_copy_only=False).astype(float)
        top = np.empty(len(centre))
        for a in range(0, len(centre), 4096):
            part = centre[a:a + 4096, None]
            top[a:a + 4096] = template_raw(chromophore, part, part + _SCAN, np.exp).max(axis=1)
        return pa.array(top, mask=np.asarray(peaks.is_null()))

    return scan(peak_nm)


def template_values(chromophore: str, peak_nm: Column, wavelengths) -> Column:
    """Peak-normalised template of each row's pigment on a fixed list of wavelengths."""
    wl = np.asarray(wavelengths, dtype=float)[None, :]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def curve(peaks: pa.Array) -> pa.Array:
        ok = np.asarray(peaks.is_valid())
        centre = peaks.to_numpy(zero_copy_only=False).astype(float)[ok, None]
        out = np.empty((len(centre), wl.shape[1]))
        for a in range(0, len(centre), 4096):
            part = centre[a:a + 4096]
            top = template_raw(chromophore, part, part + _SCAN, np.exp).max(axis=1, keepdims=True)
            out[a:a + 4096] = template_raw(chromophore, part, wl, np.exp) / top
        return lists(out, ok, np.float64)

    return curve(peak_nm)


def template_points(chromophore: str, peak_nm: Column, lo: float, hi: float, step: float) -> Column:
    """Peak-normalised template as ``array<struct<wl,v>>``, both ends included."""
    wl = [lo + step * i for i in range(max(int(np.floor((hi - lo) / step + 0.5)), 0) + 1)]
    values = template_values(chromophore, peak_nm, wl)
    return F.zip_with(F.lit(wl), values, lambda w, v: F.struct(w.alias("wl"), v.alias("v")))


def template_curve(chromophore: str, peak_nm: float, lo=C.TEMPLATE_LO_NM, hi=C.TEMPLATE_HI_NM, step=C.TEMPLATE_STEP_NM):
    """Driver-side template of one receptor, as an (n, 2) array."""
    top = template_raw(chromophore, peak_nm, peak_nm + _SCAN, np.exp).max()
    wl = lo + step * np.arange(int(np.floor((hi - lo) / step + 0.5)) + 1)
    return np.column_stack([wl, template_raw(chromophore, peak_nm, wl, np.exp) / top])


def droplet_transmittance(wl, cutoff_nm, steepness_nm, exp=F.exp):
    """Sigmoid long-pass filter, one half at the cut-off."""
    return 1.0 / (1.0 + exp(-(wl - cutoff_nm) / steepness_nm))


def droplet_curve(cutoff_nm: float, steepness_nm=C.DROPLET_STEEPNESS_NM,
                  lo=C.TEMPLATE_LO_NM, hi=C.TEMPLATE_HI_NM, step=C.TEMPLATE_STEP_NM):
    wl = lo + step * np.arange(max(int(np.floor((hi - lo) / step + 0.5)), 1) + 1)
    return np.column_stack([wl, droplet_transmittance(wl, cutoff_nm, steepness_nm, np.exp)])
