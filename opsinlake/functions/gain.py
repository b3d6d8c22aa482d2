"""Operating windows, caps and noise as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsinlake import constants as C


def operating_gain(level: Column, lower: Column, upper: Column, softness: Column) -> Column:
    """Logistic window in log10(level). Bounds that are not positive, or that cross, count as absent; a dark or
    non-finite level sits infinitely far below every bound; softness at or below 1e-9 gives a hard edge."""
    lo = F.when(lower > 0, lower)
    hi = F.when(upper > 0, upper)
    crossed = F.coalesce(lo >= hi, F.lit(False))
    lo, hi = F.when(~crossed, lo), F.when(~crossed, hi)
    lit_level = F.when((level > 0) & (level < float("inf")), level)
    log_level = F.coalesce(F.log10(lit_level), F.lit(float("-inf")))

    def rise(bound):
        t = log_level - F.log10(bound)
        hard = F.when(t >= 0, F.lit(1.0)).otherwise(F.lit(0.0))
        safe = F.when(softness > 1e-9, softness)
        return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), -t / safe)), F.when(bound.isNotNull(), hard))

    g = F.coalesce(rise(lo), F.lit(1.0)) * F.coalesce(F.lit(1.0) - rise(hi), F.lit(1.0))
    return F.least(F.greatest(g, F.lit(0.0)), F.lit(1.0))


def gain_value(level: float, lower, upper, softness: float) -> float:
    """Driver-side value of the same window for one receptor."""
    lo = lower if lower is not None and lower > 0 else None
    hi = upper if upper is not None and upper > 0 else None
    if lo is not None and hi is not None and lo >= hi:
        lo = hi = None
    x = math.log10(level) if math.isfinite(level) and level > 0 else -math.inf

    def rise(bound):
        t = x - math.log10(bound)
        if softness <= 1e-9:
            return 1.0 if t >= 0 else 0.0
        exponent = -t / softness
        return 0.0 if exponent > 308 else 1.0 / (1.0 + 10.0**exponent)

    g = (1.0 if lo is None else rise(lo)) * (1.0 if hi is None else 1.0 - rise(hi))
    return min(max(g, 0.0), 1.0)


def window_gain(level, curve_min, curve_max, curve_soft, set_min=None, set_max=None, set_soft=None) -> Column:
    """Window of one receptor with the fallback curve, then set, then the default softness."""
    null = F.lit(None).cast("double")

    def pick(a, b):
        return F.coalesce(a, b if b is not None else null)

    return operating_gain(
        level,
        pick(curve_min, set_min),
        pick(curve_max, set_max),
        F.coalesce(curve_soft, set_soft if set_soft is not None else null, F.lit(C.DEFAULT_SOFTNESS)),
    )


def saturate(raw: Column, cap: Column) -> Column:
    """Ceiling on a response; a null cap leaves it alone and a NaN response takes the cap."""
    return F.least(raw, cap)


def noise_term(omega: Column, eta: Column, eta_sum: Column) -> Column:
    """Receptor noise, null when a term is missing or the pool has no positive density. A receptor of zero
    density is infinitely noisy."""
    share = F.when(eta_sum > 0, eta / eta_sum)
    empty = F.when(omega > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(share == 0, empty).otherwise(omega / F.sqrt(share))
