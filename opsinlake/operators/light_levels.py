"""Which colour space is active at which light level, over logs of measured light.

What a receptor sees scales with the light, so a level is a factor on the integrals under one reference light:
nothing is integrated again per row, and every operator here is a projection of plain codegen expressions that
runs on batch and streaming tables alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsinlake import constants as C
from opsinlake.plans.kernel import RegimeState, seen_irradiance
from opsinlake.plans.systems import VisualSystem, curve_integral


def _gain_sql(receptor, seen: float, system: VisualSystem, factor: str) -> str:
    """Operating gain of one receptor as SQL over a factor column; its window is known, so only the bounds that count
    (positive and not crossed) appear."""

    def first(*values):
        return next((v for v in values if v is not None), None)

    lo = first(receptor.illumination_min, system.illumination_min)
    hi = first(receptor.illumination_max, system.illumination_max)
    soft = first(receptor.illumination_softness, system.illumination_softness, C.DEFAULT_SOFTNESS)
    lo = lo if lo is not None and lo > 0 else None
    hi = hi if hi is not None and hi > 0 else None
    if lo is not None and hi is not None and lo >= hi:
        lo = hi = None
    level = f"({factor} * {float(seen)!r}D)"

    def rise(bound):
        over = f"(log10({level}) - {math.log10(bound)!r}D)"
        value = f"1D / (1D + pow(10D, -{over} / {soft!r}D))" if soft > 1e-9 else f"if({over} >= 0, 1D, 0D)"
        return f"if({level} > 0 AND {level} < double('Infinity'), {value}, 0D)"

    parts = ([] if lo is None else [rise(lo)]) + ([] if hi is None else [f"(1D - {rise(hi)})"])
    return f"least(greatest({' * '.join(parts) or '1D'}, 0D), 1D)"


def receptor_gains(system: VisualSystem, light, factor: str) -> list[Column]:
    """Gain of every receptor of the pool when the light is scaled by the column ``factor``."""
    seen = seen_irradiance(system.pool, light)
    return [F.expr(_gain_sql(r, e, system, f"`{factor}`")) for r, e in zip(system.pool, seen)]


def _gain_columns(df: DataFrame, system: VisualSystem, light, factor: Column) -> DataFrame:
    """Add ``_f`` and one gain column ``_g<i>`` per receptor."""
    scaled = df.withColumn("_f", factor)
    gains = receptor_gains(system, light, "_f")
    return scaled.select("*", *[g.alias(f"_g{i}") for i, g in enumerate(gains)])


def _activity(system: VisualSystem) -> list[Column]:
    """Activity of each regime: the product of its members' gains."""
    out = []
    for r in system.regimes:
        inside = [f"_g{i}" for i in r.members if 0 <= i < len(system.pool)]
        out.append(F.expr(" * ".join(inside) or "1D").alias(r.name))
    return out


def dominant_sql(names: list[str]) -> str:
    """Name of the most active of the regime columns; the last of equals wins."""
    cases = []
    for i in reversed(range(len(names))):
        others = [f"`{n}`" for k, n in enumerate(names) if k != i]
        test = " AND ".join(f"`{names[i]}` >= {o}" for o in others) or "true"
        cases.append(f"WHEN {test} THEN '{names[i]}'")
    return f"CASE {' '.join(cases)} END"


def with_regimes(log: DataFrame, system: VisualSystem, light, factor: Column) -> DataFrame:
    """Add one activity column per regime (its name), ``dominant_regime`` and ``active`` (any gain above 0.1)."""
    names = [r.name for r in system.regimes]
    graded = _gain_columns(log, system, light, factor).select("*", *_activity(system))
    named = graded.withColumn("dominant_regime", F.expr(dominant_sql(names)))
    on = " ".join(
        f"WHEN '{r.name}' THEN {' OR '.join(f'_g{i} > {C.ACTIVE_GAIN}D' for i in r.members) or 'false'}"
        for r in system.regimes
    )
    return named.select(
        *log.columns, *[f"`{n}`" for n in names], "dominant_regime",
        F.expr(f"CASE dominant_regime {on} END").alias("active"),
    )


def dominance_sweep(lights: DataFrame, system: VisualSystem, light, scale: Column) -> DataFrame:
    """97 half-decade levels around each row's own light level: ``step, log_level`` and one column per regime.

    The levels are exploded from a fixed 97-element sequence per row; regimes stay columns, so nothing shuffles.
    """
    total = curve_integral(light)
    swept = lights.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(96))))
    factor = F.pow(F.lit(10.0), F.lit(-24.0) + F.col("step") * F.lit(0.5)) * scale
    graded = _gain_columns(swept, system, light, factor)
    level = F.expr(f"log10(_f * {total!r}D)").alias("log_level")
    return graded.select(*lights.columns, "step", level, *_activity(system))


def operating_report(log: DataFrame, system: VisualSystem, light, factor: Column) -> DataFrame:
    """Long report: what every receptor of the pool sees and its gain, with the regimes it belongs to."""
    seen = seen_irradiance(system.pool, light)
    cells = []
    for i, (r, e) in enumerate(zip(system.pool, seen)):
        inside = [x.name for x in system.regimes if i in x.members]
        cells.append(F.struct(
            F.lit(r.name).alias("receptor"),
            F.lit(", ".join(inside) if inside else None).cast("string").alias("regimes"),
            (F.col("_f") * F.lit(float(e))).alias("seen"),
            F.col(f"_g{i}").alias("gain"),
        ))
    return _gain_columns(log, system, light, factor).select(*log.columns, F.inline(F.array(*cells)))


def regime_report(states: list[RegimeState]) -> list[dict]:
    """Per-regime state under one light, for driver-side display."""
    return [
        {"regime": s.resolved.name, "receptor": r.name, "seen": float(e), "gain": float(g),
         "regime_gain": s.regime_gain, "active": s.active}
        for s in states for r, e, g in zip(s.resolved.members, s.seen, s.gains)
    ]


def hourly_dominance(log: DataFrame, time: str = "ts", width: str = "1 hour") -> DataFrame:
    """Rows per time window and dominant regime (batch, or streaming behind a watermark)."""
    window = F.window(F.col(time), width)
    return log.groupBy(window.alias("window"), "dominant_regime").agg(F.count(F.lit(1)).alias("n"))

