"""Row layouts of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("wl", T.DoubleType()), T.StructField("v", T.DoubleType())])
POINTS = T.ArrayType(POINT)
QUANTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("unit", T.StringType())])
METADATA = T.MapType(T.StringType(), T.StringType())

_NULLABLE = (
    "omega", "eta", "luminance_weight", "saturation", "illumination_min", "illumination_max", "illumination_softness",
)

CURVE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("curve_type", T.StringType()),
        T.StructField("quantity", QUANTITY),
        T.StructField("points", POINTS),
        T.StructField("metadata", METADATA),
    ]
    + [T.StructField(n, T.DoubleType()) for n in _NULLABLE]
)

CONTRAST = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("weights", T.ArrayType(T.DoubleType()))]
)
REGIME = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("members", T.ArrayType(T.LongType())),
        T.StructField("luminance_weights", T.ArrayType(T.DoubleType())),
        T.StructField("contrasts", T.ArrayType(CONTRAST)),
    ]
)
SYSTEM = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("curves", T.ArrayType(CURVE)),
        T.StructField("regimes", T.ArrayType(REGIME)),
        T.StructField("metadata", METADATA),
        T.StructField("illumination_min", T.DoubleType()),
        T.StructField("illumination_max", T.DoubleType()),
        T.StructField("illumination_softness", T.DoubleType()),
    ]
)

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
REGION = T.StructType(
    [
        T.StructField("cube_id", T.StringType()),
        T.StructField("region_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("vertices", T.ArrayType(VERTEX)),
    ]
)
PIXEL = T.StructType(
    [
        T.StructField("cube_id", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("sample", T.LongType()),
        T.StructField("spectrum", T.ArrayType(T.FloatType())),
    ]
)
