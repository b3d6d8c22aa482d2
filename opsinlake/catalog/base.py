"""Registry, input views and SQL fragments of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsinlake.functions.lights import seed_lights

REGISTRY: dict[str, tuple[Callable, Callable | None]] = {}

SAMPLES = 25
BANDS = 64
AXIS = tuple(400.0 + 5.0 * b for b in range(BANDS))
UNIFORM = seed_lights()["Uniform"]
SOLAR = seed_lights()["Daytime Earth solar (5778K black body)"]


def query(sql: Callable[[], str] | None = None):
    """Register a query under its function name; ``sql`` builds the comparison text, None means rows only."""

    def wrap(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn

    return wrap


# ------------------------------------------------------------------ input views on the shared tables


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pixels(spark, sf) -> DataFrame:
    """The embeddings as one image: 25 samples per line, 64 bands from 400 to 715 nm."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.lit("embeddings").alias("cube_id"),
        "vec_id",
        F.expr(f"vec_id div {SAMPLES}").alias("line"),
        (F.col("vec_id") % SAMPLES).alias("sample"),
        F.col("embedding").alias("spectrum"),
    )


def spectra(spark, sf) -> DataFrame:
    """The embeddings as stimuli on the same axis."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("spectrum"))


PIXELS = f"""SELECT vec_id, vec_id // {SAMPLES} AS line, vec_id % {SAMPLES} AS sample,
    CAST(embedding AS DOUBLE[]) AS px FROM embeddings"""


def light_factor(value: Column) -> Column:
    """Event value to a factor on the reference light, about 1e-8 to 1."""
    return F.pow(F.lit(10.0), F.least(value, F.lit(200.0)) / 25.0 - 8.0)


LIGHT_FACTOR = "pow(10.0, least(value, 200.0) / 25.0 - 8.0)"

# ------------------------------------------------------------------ rounding that both engines agree on


def rnd(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def rsql(expr: str, digits: int = 6) -> str:
    """Rounded SQL value without a negative zero."""
    r = f"round(CAST({expr} AS DOUBLE), {digits})"
    return f"CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END"


def num(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def nums(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in np.ravel(values)) + "]::DOUBLE[]"


def dot(values: str, row) -> str:
    return f"list_inner_product({values}, {nums(row)})"


def mul(values: str, matrix) -> str:
    """SQL list of a matrix times a list expression."""
    return "[" + ", ".join(dot(values, row) for row in matrix) + "]"


def kernel_sql(kernel, values: str, source: str, keep: str) -> str:
    """Rows ``keep, ch`` of a kernel over a list expression, step by step: respond, gain, cap, adapt, oppose."""
    raw = []
    for row, g, c in zip(kernel.response, kernel.gains, kernel.caps):
        q = f"{dot(values, row)} * {num(g)}"
        raw.append(f"least({q}, {num(c)})" if np.isfinite(c) else q)
    text = f"SELECT {keep}, [{', '.join(raw)}] AS ch FROM ({source})"
    if kernel.adaptation is not None:
        text = f"SELECT {keep}, {mul('ch', kernel.adaptation)} AS ch FROM ({text})"
    if kernel.opponent is not None:
        text = f"SELECT {keep}, {mul('ch', kernel.opponent)} AS ch FROM ({text})"
    return text


def f32(expr: str) -> str:
    return f"CAST({expr} AS FLOAT)"


# Cubic slopes of every embedding, one recursion step per knot (uniform 5 nm axis).
SLOPES = f"""
base AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS y FROM embeddings),
secants AS (SELECT vec_id, label, y,
    [(y[i + 1] - y[i]) / 5.0 FOR i IN range(1, {BANDS})] AS d FROM base),
walk(vec_id, i, carry, m) AS (
    SELECT vec_id, 1, d[1], CAST([] AS DOUBLE[]) FROM secants
    UNION ALL
    SELECT w.vec_id, w.i + 1,
        CASE WHEN d[w.i] = 0 THEN 0.0
             WHEN (w.carry / d[w.i]) ** 2 + (nxt / d[w.i]) ** 2 > 9
             THEN 3 / sqrt((w.carry / d[w.i]) ** 2 + (nxt / d[w.i]) ** 2) * nxt ELSE nxt END,
        list_append(w.m,
        CASE WHEN d[w.i] = 0 THEN 0.0
             WHEN (w.carry / d[w.i]) ** 2 + (nxt / d[w.i]) ** 2 > 9
             THEN 3 / sqrt((w.carry / d[w.i]) ** 2 + (nxt / d[w.i]) ** 2) * w.carry ELSE w.carry END)
    FROM (SELECT w.*, s.d,
            CASE WHEN w.i = {BANDS - 1} THEN s.d[{BANDS - 1}] ELSE (s.d[w.i] + s.d[w.i + 1]) / 2 END AS nxt
          FROM walk w JOIN secants s USING (vec_id) WHERE w.i < {BANDS}) w
),
cubic AS (SELECT s.vec_id, s.label, s.y, list_append(w.m, w.carry) AS m
    FROM walk w JOIN secants s USING (vec_id) WHERE w.i = {BANDS})"""


def curve_value_sql(x: str) -> str:
    """Value of the cubic (columns ``y``, ``m`` on the shared axis) at a wavelength expression inside the axis."""
    i = f"least(CAST(floor(({x} - {AXIS[0]}) / 5.0) AS BIGINT) + 1, {BANDS - 1})"
    t = f"(({x} - {AXIS[0]}) / 5.0 - ({i} - 1))"
    return (
        f"((1 + 2 * {t}) * (1 - {t}) ** 2 * y[{i}] + {t} * (1 - {t}) ** 2 * 5.0 * m[{i}]"
        f" + {t} * {t} * (3 - 2 * {t}) * y[{i} + 1] + {t} * {t} * ({t} - 1) * 5.0 * m[{i} + 1])"
    )


def curve_kernel_sql(kernel, source: str, keep: str) -> str:
    """Rows ``keep, q, c`` (responses and opponent coordinates) of a curve kernel over ``y``/``m`` columns."""
    raw = []
    for v, s, g, c in zip(kernel.value_weights, kernel.slope_weights, kernel.gains, kernel.caps):
        q = f"({dot('y', v)} + {dot('m', s)}) * {num(g)}"
        raw.append(f"least({q}, {num(c)})" if np.isfinite(c) else q)
    text = f"SELECT {keep}, [{', '.join(raw)}] AS q FROM ({source})"
    if kernel.adaptation is not None:
        text = f"SELECT {keep}, {mul('q', kernel.adaptation)} AS q FROM ({text})"
    if kernel.opponent is not None:
        text = f"SELECT {keep}, q, {mul('q', kernel.opponent)} AS c FROM ({text})"
    return text
