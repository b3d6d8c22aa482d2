"""Pixels to receptor channels.

Rendering is a row-wise projection: no shuffle, works on streams, and the kernel (at most 64 x bands numbers)
travels inside the plan. The matrix product runs on Arrow batches; ``engine="native"`` gives the same result
with array functions only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsinlake.functions.arrays import lists, matrix
from opsinlake.plans.kernel import ADAPTED, Kernel, KernelError


def _vectorised(kernels: list[Kernel], dtype: str):
    bands = kernels[0].bands
    if any(k.bands != bands for k in kernels):
        raise KernelError("kernels for different band counts cannot share one scan")
    folded = [k.folded for k in kernels]
    parts = [(k.response.T.copy(), k.gains, k.caps, k.mix.T.copy()) for k in kernels]
    linear = None if any(f is None for f in folded) else np.vstack(folded).T.copy()
    out = np.float32 if dtype == "float" else np.float64

    @F.arrow_udf(f"array<{dtype}>")
    def channels(spectra: pa.Array) -> pa.Array:
        x, ok = matrix(spectra, bands)
        if linear is not None:
            return lists(x @ linear, ok, out)
        blocks = []
        for response, gains, caps, mix in parts:
            q = (x @ response) * gains
            capped = np.isfinite(caps)
            q[:, capped] = np.fmin(q[:, capped], caps[capped])
            blocks.append(q @ mix)
        return lists(np.hstack(blocks), ok, out)

    return channels


def _dot(values: Column, row) -> Column:
    weights = F.lit([float(w) for w in row])
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)


def _native(spectrum: Column, kernel: Kernel, dtype: str) -> Column:
    x = F.transform(spectrum, lambda v: v.cast("double"))
    if kernel.folded is not None:
        return F.array(*[_dot(x, row).cast(dtype) for row in kernel.folded])
    q = F.array(*[
        F.least(_dot(x, row) * F.lit(float(g)), F.lit(float(c))) if np.isfinite(c) else _dot(x, row) * F.lit(float(g))
        for row, g, c in zip(kernel.response, kernel.gains, kernel.caps)
    ])
    return F.array(*[_dot(q, row).cast(dtype) for row in kernel.mix])


def render_column(spectrum: Column, kernels: Kernel | list[Kernel], dtype="float", engine="arrow") -> Column:
    """Channel array of one or several kernels (concatenated in order) for a spectrum column."""
    kernels = [kernels] if isinstance(kernels, Kernel) else list(kernels)
    if engine == "native":
        parts = [_native(spectrum, k, dtype) for k in kernels]
        return parts[0] if len(parts) == 1 else F.concat(*parts)
    return _vectorised(kernels, dtype)(spectrum)


def render(pixels: DataFrame, kernels: Kernel | list[Kernel], spectrum="spectrum", into="ch",
           engine="arrow") -> DataFrame:
    """Replace the spectrum by channels rounded to single precision. Several kernels share one scan."""
    return pixels.withColumn(into, render_column(F.col(spectrum), kernels, engine=engine)).drop(spectrum)


def channel_columns(rendered: DataFrame, names: list[str], ch="ch") -> DataFrame:
    """Spread the channel array into one column per channel."""
    return rendered.select(
        *[c for c in rendered.columns if c != ch], *[F.col(ch)[i].alias(n) for i, n in enumerate(names)]
    )


def channel_ranges(rendered: DataFrame, channels: int, keys=("cube_id",), ch="ch", inside: Column | None = None):
    """Smallest and largest value per channel as ``lo`` and ``hi`` arrays, one row per cube.

    NaN is ignored and a channel without any pixel reports (0, 0). Only partial minima cross the network.
    """

    def seen(i):
        v = F.col(ch)[i]
        keep = ~F.isnan(v) if inside is None else ~F.isnan(v) & inside
        return F.when(keep, v)

    zero = F.lit(0.0).cast("float")
    return rendered.groupBy(*keys).agg(
        F.array(*[F.coalesce(F.min(seen(i)), zero) for i in range(channels)]).alias("lo"),
        F.array(*[F.coalesce(F.max(seen(i)), zero) for i in range(channels)]).alias("hi"),
    )


def noise_distance(a: Column, b: Column, noise) -> Column:
    """Receptor-noise distance of two response arrays."""
    total = None
    for i, e in enumerate(noise):
        d = (a[i].cast("double") - b[i].cast("double")) / F.lit(float(e))
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def delta_s_gradient(rendered: DataFrame, kernel: Kernel, keys=("cube_id",), ch="ch", inside: str | None = None,
                     block: int = 128) -> DataFrame | None:
    """Edge strength against the right and the lower neighbour, in units of receptor noise. ``keys`` tell images apart
    (none for a table that holds a single image).

    Pixels are grouped into square blocks; the first line and column of a block are copied to the block before,
    so one shuffle serves both directions and no task ever holds more than a block. Pixels without a neighbour,
    or whose neighbour lies outside the region, add nothing on that side. None when the kernel is not an adapted
    one or its receptors lack noise data.
    """
    if kernel.stage != ADAPTED or kernel.noise is None or len(kernel.noise) != kernel.channels:
        return None
    keys = list(keys)
    member = F.col(inside) if inside else F.lit(True)
    by, bx = F.expr(f"line div {block}"), F.expr(f"sample div {block}")

    def home(y, x, own):
        return F.struct(y.alias("by"), x.alias("bx"), F.lit(own).alias("own"))

    homes = F.filter(
        F.array(
            home(by, bx, True),
            F.when(F.col("line") % block == 0, home(by - 1, bx, False)),
            F.when(F.col("sample") % block == 0, home(by, bx - 1, False)),
        ),
        lambda h: h.isNotNull() & (h["by"] >= 0) & (h["bx"] >= 0),
    )
    spread = rendered.withColumn("_h", F.explode(homes)).select(
        *rendered.columns, F.col("_h.by").alias("_by"), F.col("_h.bx").alias("_bx"), F.col("_h.own").alias("_own")
    )
    tile = keys + ["_by", "_bx"]
    spread = spread.repartition(*tile)
    right = Window.partitionBy(*tile, "line").orderBy("sample")
    below = Window.partitionBy(*tile, "sample").orderBy("line")

    def step(window, axis):
        near = F.lead(F.struct(F.col(axis).alias("at"), F.col(ch).alias("ch"), member.alias("in"))).over(window)
        return near, (lambda n: F.when(
            member & n["in"] & (n["at"] == F.col(axis) + 1), noise_distance(F.col(ch), n["ch"], kernel.noise)
        ))

    near_x, dx = step(right, "sample")
    near_y, dy = step(below, "line")
    return (
        spread.withColumn("_x", near_x)
        .withColumn("_y", near_y)
        .where("_own")
        .withColumn("_dx", F.coalesce(dx(F.col("_x")), F.lit(0.0)))
        .withColumn("_dy", F.coalesce(dy(F.col("_y")), F.lit(0.0)))
        .select(
            *[c for c in rendered.columns if c != ch],
            F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")).cast("float").alias("magnitude"),
        )
    )
