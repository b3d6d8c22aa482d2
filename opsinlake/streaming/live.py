"""The row-wise operators on Structured Streaming tables.

Rendering, region tests, curve labelling and light-level activity keep no state, so the batch functions accept a
streaming table as they are. The helpers here only open folder streams with a fixed layout and put a watermark in
front of the one windowed count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsinlake import schema as S
from opsinlake.operators import light_levels, regions, render
from opsinlake.plans.kernel import Kernel
from opsinlake.plans.systems import VisualSystem


def pixel_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Pixel rows as they arrive in a Parquet folder."""
    return spark.readStream.schema(S.PIXEL).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def render_stream(pixels: DataFrame, kernel: Kernel, region: regions.Region | None = None) -> DataFrame:
    """Channels of arriving pixels, restricted to a region before any arithmetic."""
    kept = pixels if region is None else regions.select_region(pixels, region)
    return render.render(kept, kernel)


def light_stream(log: DataFrame, system: VisualSystem, light, factor: Column) -> DataFrame:
    """Regime activity of arriving light measurements."""
    return light_levels.with_regimes(log, system, light, factor)


def windowed_dominance(log: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per window and dominant regime; windows close ``late`` after their end has been seen."""
    timed = log.withColumn(time, F.col(time).cast("timestamp"))
    return light_levels.hourly_dominance(timed.withWatermark(time, late), time, width)
