"""Built-in dimension tables: sensors, absorption notches, light sources, seed lights and stimuli.

They are literal rows, so Spark knows how small they are and broadcasts them by itself when they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsinlake import constants as C
from opsinlake.functions.lights import seed_lights as seed_light_points
from opsinlake.operators.cubes import quantity


def _rows(spark: SparkSession, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*rows)))


def sensors(spark: SparkSession) -> DataFrame:
    """``name, wavelengths_nm`` in sensor order."""
    return _rows(spark, [
        F.struct(F.lit(n).alias("name"), F.lit(list(w)).alias("wavelengths_nm")) for n, w in C.SENSORS
    ])


def notches(spark: SparkSession) -> DataFrame:
    """``name, centre_nm, width_nm, depth``."""
    names = ("name", "centre_nm", "width_nm", "depth")
    return _rows(spark, [F.struct(*[F.lit(v).alias(k) for k, v in zip(names, row)]) for row in C.NOTCHES])


def light_sources(spark: SparkSession) -> DataFrame:
    """Components of the named sources, ready for ``lights.composite_lights`` with ``key="name"``."""
    names = ("centre_nm", "amplitude", "bandwidth_nm")
    return _rows(spark, [
        F.struct(F.lit(n).alias("name"), *[F.lit(v).alias(k) for k, v in zip(names, part)], F.lit(1.0).alias("weight"))
        for n, parts in C.SOURCES for part in parts
    ])


def _curve(name: str, curve_type: str, kind: Column, points) -> Column:
    pts = F.array(*[F.struct(F.lit(float(w)).alias("wl"), F.lit(float(v)).alias("v")) for w, v in points])
    return F.struct(
        F.lit(name).alias("name"), F.lit(curve_type).alias("curve_type"), kind.alias("quantity"), pts.alias("points"),
        F.expr("cast(map() as map<string,string>)").alias("metadata"),
    )


def seed_lights(spark: SparkSession) -> DataFrame:
    """The uniform and the solar light as curve rows."""
    relative = quantity("Radiance", "relative")
    return _rows(spark, [_curve(n, "Illumination", relative, p) for n, p in seed_light_points().items()])


def seed_stimuli(spark: SparkSession) -> DataFrame:
    """Three reflectances to start with."""
    return _rows(spark, [_curve(n, "Reflectance", quantity("Reflectance"), p) for n, p in C.SEED_STIMULI])
