"""Display colours of curves and of whole visual systems."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsinlake import constants as C
from opsinlake.functions import color
from opsinlake.functions.arrays import lists
from opsinlake.functions.monotone import Bundle
from opsinlake.operators.curves import bundles


def _sums(curves: Bundle) -> np.ndarray:
    """Per curve: CIE sums x, y, z and weight inside 360-830 nm, gradient sums r, g, b and weight outside."""
    out = np.zeros((len(curves.n), 8))
    live = np.nonzero(curves.n > 0)[0]
    if not len(live):
        return out
    lo, hi = curves.lo[live], curves.hi[live]
    n = np.maximum(np.floor(hi - lo + 0.5), 1).astype(np.int64)
    start = np.cumsum(n + 1) - (n + 1)
    row = np.repeat(np.arange(len(live)), n + 1)
    wl = lo[row] + (np.arange(len(row)) - start[row])
    v = np.nan_to_num(curves.at(live[row], wl))
    outside = (wl < C.CIE_RANGE_NM[0]) | (wl > C.CIE_RANGE_NM[1])
    inner, outer = np.where(outside, 0.0, v), np.where(outside, np.abs(v), 0.0)
    columns = [*(color.color_matching_table(wl) * inner), np.abs(inner), *(gradient_table(wl) * outer), outer]
    out[live] = np.add.reduceat(np.column_stack(columns), start, axis=0)
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _color_sums(points: pa.Array) -> pa.Array:
    """The eight sums behind a curve's display colour, on its 1 nm grid."""
    ok = np.asarray(points.is_valid())
    out = np.zeros((len(ok), 8))
    for a, b, curves in bundles(points):
        out[a:b] = _sums(curves)
    return lists(out[ok], ok, np.float64)


def with_display_color(df: DataFrame, points: str = "points", into: str = "rgb") -> DataFrame:
    """Add the colour of a curve as ``struct<r,g,b>`` in 0..1, null for an empty or all-zero curve.

    Inside 360-830 nm the curve weighs the CIE functions; outside it weighs the physical gradient; both are blended
    by how much of the curve lies outside.
    """
    s = [F.col("_s")[i] for i in range(8)]
    total = s[3] + s[7]
    share = s[7] / F.when(total > 0, total)
    rgb = []
    for name, cie, far in zip("rgb", color.xyz_to_srgb(*s[:3]), s[4:7]):
        inner = F.when(s[3] > 0, cie).otherwise(F.lit(0.0))
        outer = F.when(s[7] > 0, far / F.when(s[7] > 0, s[7])).otherwise(F.lit(0.0))
        rgb.append((inner * (1.0 - share) + outer * share).alias(name))
    summed = df.withColumn("_s", _color_sums(F.col(points)))
    return summed.withColumn(into, F.when(total > 0, F.struct(*rgb))).drop("_s")


def gradient_table(wl: np.ndarray) -> np.ndarray:
    """Physical gradient outside the visible band on a fixed grid, shape (3, grid)."""
    uv, ir = np.clip((380.0 - wl) / 180.0, 0, 1), np.clip((wl - 700.0) / 300.0, 0, 1)
    violet, red = np.array([0.3, 0.0, 0.3])[:, None], np.array([1.0, 0.0, 0.0])[:, None]
    return np.where(wl < 380, violet + (1 - violet) * uv, red * (1 - ir))


def subjective_spectrum(responses: DataFrame, keys=("system",), whole: bool = True) -> DataFrame:
    """How a system colours the spectrum: ``keys, wl, r, g, b`` (0..255) from rows of ``keys, wl, response, weight`` and
    the receptor's own colour ``red, green, blue`` (0..255).

    Receptor colours are blended by response, then dimmed by the total response over the system's largest total.
    ``whole=False``
    keeps fractions instead of cutting to integers. Both steps are grouped sums with map-side combination; the per-system maximum joins back on the system.
    """
    keys = list(keys)
    strength = F.greatest(F.coalesce("response", F.lit(0.0)), F.lit(0.0)) * F.greatest(F.col("weight"), F.lit(0.0))
    live = responses.withColumn("_s", strength)
    sums = live.groupBy(*keys, "wl").agg(
        F.sum("_s").alias("_t"), *[F.sum(F.col(c) * F.col("_s")).alias(f"_{c}") for c in ("red", "green", "blue")]
    )
    top = sums.groupBy(*keys).agg(F.max("_t").alias("_top"))
    lit_up = sums.join(top, keys)
    dim = F.when(F.col("_top") > 0, F.col("_t") / F.col("_top")).otherwise(F.lit(0.0))

    def level(c):
        mixed = F.when(F.col("_t") > 0, F.col(f"_{c}") / F.col("_t")).otherwise(F.lit(0.0))
        level = color.clamp(mixed * dim, 0.0, 255.0)
        return F.floor(level).cast("int") if whole else level

    return lit_up.select(*keys, "wl", *[level(c).alias(n) for n, c in zip("rgb", ("red", "green", "blue"))])
