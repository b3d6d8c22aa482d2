"""Colour tables from channel tables. Ranges are joined, never collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsinlake.functions import color
from opsinlake.session import attach

BAND_SPAN_FLOOR = 1e-6


def with_ranges(rendered: DataFrame, ranges: DataFrame, keys=("cube_id",)) -> DataFrame:
    """Rows with the ranges of their image; see ``session.attach`` for images that own most pixels. Without keys the
    ranges are one aggregate over everything, and join as a scalar."""
    if not keys:
        limits = ranges.select(F.struct("lo", "hi")).scalar()
        return rendered.withColumn("_r", limits).select(*rendered.columns, "_r.lo", "_r.hi")
    return attach(rendered, ranges, list(keys), F.struct("line", F.expr("sample div 256")))


def _inside(inside: str | None) -> Column:
    return F.col(inside) if inside else F.lit(True)


def normalized(channel: int, inside: str | None = None) -> Column:
    """One channel against its range, 0 outside the region (needs ``with_ranges``)."""
    v = color.normalize_unit(F.col("ch")[channel], F.col("lo")[channel], F.col("hi")[channel])
    return F.when(_inside(inside), v).otherwise(F.lit(0.0).cast("float"))


def _masked(rgb: list[Column], inside: str | None) -> list[Column]:
    return [F.when(_inside(inside), c).otherwise(F.lit(0)) for c in rgb]


def channel_rgb(channel: int, colormap: str = "viridis", inside: str | None = None) -> list[Column]:
    return color.COLORMAPS[colormap](normalized(channel, inside))


def perceptual_rgb(channels: int, chroma_a: int = 1, chroma_b: int = 2, inside: str | None = None) -> list[Column]:
    """Opponent composite of [L, C1, ...]; black with fewer than three channels or outside the region."""
    if channels < 3:
        return [F.lit(0)] * 3
    a, b = (min(max(c, 1), channels - 1) for c in (chroma_a, chroma_b))

    def part(norm, i):
        return norm(F.col("ch")[i], F.col("lo")[i], F.col("hi")[i])

    rgb = color.opponent_rgb(
        part(color.normalize_unit, 0), part(color.normalize_opponent, a), part(color.normalize_opponent, b)
    )
    return _masked(rgb, inside)


def three_channel_rgb(channels: int, r: int, g: int, b: int, inside: str | None = None) -> list[Column]:
    """Three channels as red, green and blue; an index past the end means the last channel."""
    if channels < 1:
        return [F.lit(0)] * 3
    picked = [min(c, channels - 1) for c in (r, g, b)]
    rgb = [color.to_byte(color.normalize_unit(F.col("ch")[i], F.col("lo")[i], F.col("hi")[i])) for i in picked]
    return _masked(rgb, inside)


def gradient_rgb(magnitude: Column, lo: Column, hi: Column, colormap: str = "viridis") -> list[Column]:
    return color.COLORMAPS[colormap](color.normalize_unit(magnitude, lo, hi))


def band_preview(pixels: DataFrame, band: int, spectrum="spectrum", rounding="round") -> DataFrame:
    """One band as gray levels over its own range; ``rounding`` is "round" or "truncate"."""
    v = F.col(spectrum)[band].cast("float")
    one = pixels.select("cube_id", "line", "sample", v.alias("v"))
    ranges = one.where(~F.isnan("v")).groupBy("cube_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = F.greatest((F.col("hi") - F.col("lo")).cast("float"), F.lit(BAND_SPAN_FLOOR).cast("float"))
    t = ((F.col("v") - F.col("lo")).cast("float") / span).cast("float")
    scaled = (t * F.lit(255.0).cast("float")).cast("float")
    gray = color.to_byte(t) if rounding == "round" else F.floor(color.clamp(scaled, 0.0, 255.0)).cast("int")
    return with_ranges(one, ranges).select("cube_id", "line", "sample", gray.alias("gray"))
