"""Curve algebra on tables of spectra.

A curve is an ``array<struct<wl,v>>`` column of any length and order. ``values_at`` is the vectorised
function that fits the monotone cubics of an Arrow batch and evaluates them on per-row grids; integrals add their
trapezoid sums on top. Grids, products, divisions and filters are array expressions around it, so every operator
here is a narrow projection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsinlake import constants as C
from opsinlake.functions.arrays import lists, ragged
from opsinlake.functions.bind import let
from opsinlake.functions.monotone import Bundle
from opsinlake.operators.cubes import quantity

BATCH_CELLS = 500_000  # padded knots fitted at once, so one very long curve cannot blow up a batch
BATCH_ROWS = 1_000  # curves fitted at once: a worker's memory follows these, not the rows of an Arrow batch


def _unpack(points: pa.Array):
    """Knots of a batch: flat wavelengths, flat values, knots per row (0 for null rows)."""
    flat = points.flatten()
    sizes = pc.fill_null(points.value_lengths(), 0).to_numpy(zero_copy_only=False)
    wl, v = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False).astype(float, copy=False) for i in (0, 1))
    return wl, v, sizes


def bundles(points: pa.Array):
    """The curves of a batch as bundles of bounded padded size, with the row range each covers."""
    wl, v, sizes = _unpack(points)
    at = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < len(sizes):
        stop, widest = start, 1
        while stop < len(sizes) and stop - start < BATCH_ROWS:
            widest = max(widest, int(sizes[stop]))
            if stop > start and widest * (stop + 1 - start) > BATCH_CELLS:
                break
            stop += 1
        cut = slice(at[start], at[stop])
        yield start, stop, Bundle(wl[cut], v[cut], sizes[start:stop])
        start = stop


def _evaluate(points: pa.Array, grid: pa.Array) -> pa.Array:
    ok = np.asarray(points.is_valid()) & np.asarray(grid.is_valid())
    steps = pc.fill_null(grid.value_lengths(), 0).to_numpy(zero_copy_only=False)
    xs = grid.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    x_at, out = np.concatenate([[0], np.cumsum(steps)]), np.empty(len(xs))
    for a, b, curves in bundles(points):
        sel = slice(x_at[a], x_at[b])
        out[sel] = curves.at(np.repeat(np.arange(b - a), steps[a:b]), xs[sel])
    return ragged(out if ok.all() else out[np.repeat(ok, steps)], np.where(ok, steps, 0), ok)


def _integrals(points: pa.Array, fixed: list[Bundle] | None, step: float) -> pa.Array:
    """Trapezoid integrals of a batch: of each curve alone, or of its product with each fixed curve."""
    ok = np.asarray(points.is_valid())
    out = np.zeros((len(ok), 1 if fixed is None else len(fixed)))
    for a, b, curves in bundles(points):
        for r, other in enumerate([None] if fixed is None else fixed):
            lo, hi = curves.lo, curves.hi
            if other is not None and other.n[0]:
                lo, hi = np.fmin(lo, other.lo[0]), np.fmax(hi, other.hi[0])
            live = np.nonzero(hi > lo)[0]
            if not len(live):
                continue
            lo, hi = lo[live], hi[live]
            n = np.maximum(np.ceil((hi - lo) / step), 1).astype(np.int64)
            dx = (hi - lo) / n
            first = np.cumsum(n + 1) - (n + 1)
            row = np.repeat(np.arange(len(live)), n + 1)
            xs = lo[row] + (np.arange(len(row)) - first[row]) * dx[row]
            v = np.nan_to_num(curves.at(live[row], xs))
            if other is not None:
                v = v * np.nan_to_num(other.at(0, xs))
            ends = (v[first] + v[first + n]) / 2
            out[a + live, r] = (np.add.reduceat(v, first) - ends) * dx
    return lists(out[ok], ok, np.float64)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _values(points: pa.Array, grid: pa.Array) -> pa.Array:
    return _evaluate(points, grid)


def values_at(points: Column, grid: Column) -> Column:
    """Monotone-cubic values of a curve on a grid of wavelengths; null outside the curve's domain."""
    return _values(points, grid)


def literal_values(curve, grid: Column) -> Column:
    """Values of one fixed curve on per-row grids."""
    fixed = Bundle.of(np.asarray(curve, dtype=float))

    @F.arrow_udf("array<double>")
    def lookup(xs: pa.Array) -> pa.Array:
        ok = np.asarray(xs.is_valid())
        steps = pc.fill_null(xs.value_lengths(), 0).to_numpy(zero_copy_only=False)
        return ragged(fixed.at(0, xs.flatten().to_numpy(zero_copy_only=False)), steps, ok)

    return lookup(grid)


def _whole(v: Column) -> Column:
    """Round half away from zero for non-negative values."""
    return F.floor(v + 0.5).cast("int")


def domain(points: Column) -> tuple[Column, Column]:
    wl = F.transform(points, lambda p: p["wl"])
    return F.array_min(wl), F.array_max(wl)


def steps_grid(lo: Column, hi: Column, step: float) -> Column:
    """lo, lo+step, ... with the number of steps rounded; null when the interval is empty."""
    n = F.greatest(_whole((hi - lo) / step), F.lit(1))
    xs = F.zip_with(F.sequence(F.lit(0), n), F.array_repeat(lo, n + 1), lambda i, a: a + i * F.lit(step))
    return F.when(hi > lo, xs)


def curve_integral(points: Column, step: float = C.STEP_NM) -> Column:
    """Area under a curve over its own domain; 0 for fewer than two distinct wavelengths."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def area(curves: pa.Array) -> pa.Array:
        return _integrals(curves, None, step)

    return F.coalesce(area(points)[0], F.lit(0.0))


def product_integrals(points: Column, fixed, step: float = C.STEP_NM) -> Column:
    """Integrals of a curve column times each fixed curve, every one over the union of the two domains."""
    others = [Bundle.of(np.asarray(c, dtype=float)) for c in fixed]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def products(curves: pa.Array) -> pa.Array:
        return _integrals(curves, others, step)

    return products(points)


def activations(points: Column, receptors, gains, step: float = C.STEP_NM) -> Column:
    """Gated and capped responses of a receptor list to curve rows, as one array."""
    q = product_integrals(points, [r.points for r in receptors], step)
    caps = F.lit([float("inf") if r.saturation is None else float(r.saturation) for r in receptors])
    gated = F.zip_with(q, F.lit([float(g) for g in gains]), lambda a, g: a * g)
    return F.zip_with(gated, caps, lambda a, c: F.when(c < float("inf"), F.least(a, c)).otherwise(a))


def _overlap_grid(points: Column, fixed: Bundle, step: float) -> Column:
    lo, hi = domain(points)
    return steps_grid(F.greatest(lo, F.lit(float(fixed.lo[0]))), F.least(hi, F.lit(float(fixed.hi[0]))), step)


def _with_grid(df: DataFrame, points: str, light, step: float) -> DataFrame:
    fixed = Bundle.of(np.asarray(light, dtype=float))
    grid = df.withColumn("_wl", _overlap_grid(F.col(points), fixed, step))
    return grid.withColumn("_a", values_at(F.col(points), F.col("_wl"))).withColumn(
        "_b", literal_values(light, F.col("_wl"))
    )


_NO_POINTS = "cast(array() as array<struct<wl:double,v:double>>)"


def divide_by_light(df: DataFrame, light, points="points", step: float = C.STEP_NM) -> DataFrame:
    """Curve over light on their common domain; wavelengths where the light is below 1e-12 are left out."""
    cells = F.arrays_zip(F.col("_wl").alias("wl"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    kept = F.filter(cells, lambda r: r["a"].isNotNull() & (F.abs(r["b"]) >= 1e-12))
    out = F.transform(kept, lambda r: F.struct(r["wl"].alias("wl"), (r["a"] / r["b"]).alias("v")))
    return _with_grid(df, points, light, step).withColumn(points, F.coalesce(out, F.expr(_NO_POINTS))).drop(
        "_wl", "_a", "_b"
    )


def _products() -> Column:
    """Points of ``_wl`` where ``_a`` and ``_b`` are both defined, multiplied."""
    cells = F.arrays_zip(F.col("_wl").alias("wl"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    kept = F.filter(cells, lambda r: r["a"].isNotNull() & r["b"].isNotNull())
    out = F.transform(kept, lambda r: F.struct(r["wl"].alias("wl"), (r["a"] * r["b"]).alias("v")))
    return F.coalesce(out, F.expr(_NO_POINTS))


def multiply_by_light(df: DataFrame, light, points="points", step: float = C.STEP_NM) -> DataFrame:
    """Reflectance times light on their common domain."""
    return _with_grid(df, points, light, step).withColumn(points, _products()).drop("_wl", "_a", "_b")


def unit_error(kind: Column, unit: Column, light_kind: str, light_unit: str | None) -> Column:
    """Why a curve cannot be divided by a light, or null: no kind, then a wrong kind, then different units."""
    missing = (kind == "Unspecified") | F.lit(light_kind == "Unspecified")
    wrong = (kind != "Radiance") | F.lit(light_kind != "Radiance")
    differs = ~unit.eqNullSafe(F.lit(light_unit))
    return (
        F.when(missing, F.lit("missing quantity kind"))
        .when(wrong, F.lit("wrong quantity kind"))
        .when(differs, F.lit("unit mismatch"))
    )


def derive_reflectance(curves: DataFrame, light, light_unit="relative", light_kind="Radiance",
                       step: float = C.STEP_NM) -> tuple[DataFrame, DataFrame]:
    """Radiance curves to reflectances under one light: (converted, rejected with ``error``).

    A curve in a batch lands in that batch's ``/reflectance`` sub-batch.
    """
    kind, unit = F.col("quantity.kind"), F.col("quantity.unit")
    checked = curves.withColumn("error", unit_error(kind, unit, light_kind, light_unit))
    good = divide_by_light(checked.where("error is null").drop("error"), light, step=step)
    batch = F.element_at("metadata", "batch")
    renamed = F.map_from_arrays(F.array(F.lit("batch")), F.array(F.concat(batch, F.lit("/reflectance"))))
    empty = F.expr("cast(map() as map<string,string>)")
    converted = (
        good.withColumn("name", F.concat("name", F.lit(" (reflectance)")))
        .withColumn("curve_type", F.lit("Reflectance"))
        .withColumn("quantity", quantity("Reflectance"))
        .withColumn("metadata", F.when(batch.isNotNull(), renamed).otherwise(empty))
    )
    return converted, checked.where("error is not null")


def conversion_tally(curves: DataFrame, light_unit="relative", light_kind="Radiance") -> DataFrame:
    """How many curves a bulk conversion takes and how many it skips."""
    error = unit_error(F.col("quantity.kind"), F.col("quantity.unit"), light_kind, light_unit)
    return curves.agg(F.count_if(error.isNull()).alias("converted"), F.count_if(error.isNotNull()).alias("skipped"))


def predict_under_light(curves: DataFrame, light, light_name: str, light_unit="relative", light_kind="Radiance",
                        step: float = C.STEP_NM) -> DataFrame:
    """What each reflectance would measure under a light."""
    note = F.concat(F.lit('reflectance of "'), F.col("name"), F.lit(f'" under illuminant "{light_name}"'))
    out = multiply_by_light(curves.withColumn("_note", note), light, step=step)
    return (
        out.withColumn("name", F.concat("name", F.lit(" (predicted)")))
        .withColumn("curve_type", F.lit("Predicted"))
        .withColumn("quantity", quantity(light_kind, light_unit))
        .withColumn("metadata", F.create_map(F.lit("derived"), F.col("_note")))
        .drop("_note")
    )


def resolve_stimuli(curves: DataFrame, light, points="points", step: float = C.STEP_NM) -> DataFrame:
    """Stimuli as light: reflectances are multiplied by the light, absorption curves are dropped, the rest pass."""
    kind = F.col("quantity.kind")
    usable = curves.where(~kind.eqNullSafe("Absorption"))
    lit_up = multiply_by_light(usable.withColumn("_raw", F.col(points)), light, points, step)
    chosen = F.when(kind == "Reflectance", F.col(points)).otherwise(F.col("_raw"))
    return lit_up.withColumn(points, chosen).drop("_raw")


def apply_absorption(df: DataFrame, absorber, weight: float, name: str, points="points",
                     step: float = C.STEP_NM) -> DataFrame:
    """Light times absorber to the power ``weight``, sampled on the regular grid and on every knot of either."""
    fixed = np.asarray(absorber, dtype=float).reshape(-1, 2)
    lo, hi = domain(F.col(points))
    own = F.transform(points, lambda p: p["wl"])

    def union(s):
        n = F.floor((s["hi"] - s["lo"]) / step).cast("int")
        regular = F.transform(F.sequence(F.lit(0), n), lambda i: s["lo"] + i * F.lit(step))
        marks = F.filter(F.lit([float(w) for w in fixed[:, 0]]), lambda w: (w >= s["lo"]) & (w <= s["hi"]))
        return F.sort_array(F.concat(regular, F.array(s["hi"]), own, marks))

    every = let(F.struct(lo.alias("lo"), hi.alias("hi")), union)

    # neighbours closer than 1e-9 collapse onto the first of them
    def thin(kept, w):
        return F.when((F.size(kept) == 0) | (w - F.element_at(kept, -1) >= 1e-9), F.concat(kept, F.array(w))).otherwise(
            kept
        )

    grid = F.aggregate(every, F.expr("cast(array() as array<double>)"), thin)
    ready = df.withColumn("_wl", grid)
    ready = ready.withColumn("_a", values_at(F.col(points), F.col("_wl"))).withColumn(
        "_t", literal_values(absorber, F.col("_wl"))
    )
    cells = F.arrays_zip(F.col("_wl").alias("wl"), F.col("_a").alias("a"), F.col("_t").alias("t"))
    out = F.transform(
        F.filter(cells, lambda r: r["a"].isNotNull()),
        lambda r: F.struct(
            r["wl"].alias("wl"),
            (r["a"] * F.pow(F.least(F.greatest(F.coalesce(r["t"], F.lit(1.0)), F.lit(0.0)), F.lit(1.0)), F.lit(weight)))
            .alias("v"),
        ),
    )
    result = ready.withColumn(points, F.coalesce(out, F.col(points))).drop("_wl", "_a", "_t")
    if "metadata" in df.columns:
        note = F.create_map(F.lit(f"absorption: {name}"), F.lit(f"weight {weight:g}"))
        result = result.withColumn("metadata", F.map_concat(F.coalesce("metadata", F.expr("map()")), note))
    return result


def multiply_curves(df: DataFrame, a: str, b: str, step: float, into: str) -> DataFrame:
    """Product of two curve columns on their common domain, e.g. a pigment behind its filter."""
    (a0, a1), (b0, b1) = domain(F.col(a)), domain(F.col(b))
    both = df.withColumn("_wl", steps_grid(F.greatest(a0, b0), F.least(a1, b1), step))
    both = both.withColumn("_a", values_at(F.col(a), F.col("_wl"))).withColumn("_b", values_at(F.col(b), F.col("_wl")))
    return both.withColumn(into, _products()).drop("_wl", "_a", "_b")


def out_of_unit_range(kind: Column, points: Column) -> Column:
    """Reflectance or absorption with a value outside [0, 1]: a flag, never a clamp."""
    return kind.isin("Reflectance", "Absorption") & F.exists(points, lambda p: ~p["v"].between(0.0, 1.0))


# ------------------------------------------------- the same cubic with array functions only (no Python worker)


def segments(points: Column) -> Column:
    """Hermite segments of a curve: ``array<struct<x0,x1,y0,y1,m0,m1>>``, built without leaving the JVM."""
    placed = F.transform(points, lambda p, i: F.struct(p["wl"].alias("wl"), i.alias("i"), p["v"].alias("v")))
    ordered = F.sort_array(placed)
    knots = F.filter(ordered, lambda p, i: (i == 0) | (p["wl"] != F.element_at(ordered, F.greatest(i, F.lit(1)))["wl"]))
    return knots


def native_segments(df: DataFrame, points="points", into="segments") -> DataFrame:
    """Add Hermite segments computed by array functions. The fold carries the slope its left neighbour left over."""
    k = df.withColumn("_k", segments(F.col(points)))
    at = F.col("_k")
    n = F.size(at)
    slopes = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: (F.element_at(at, i + 1)["v"] - F.element_at(at, i)["v"])
        / (F.element_at(at, i + 1)["wl"] - F.element_at(at, i)["wl"]),
    )
    k = k.withColumn("_d", F.when(n >= 2, slopes).otherwise(F.expr("cast(array() as array<double>)")))
    d = F.col("_d")

    def start(i):  # unlimited slope at knot i (1-based), 1 < i <= size(d)+1
        return F.when(i > F.size(d), F.element_at(d, -1)).otherwise((F.element_at(d, i - 1) + F.element_at(d, i)) / 2)

    seg_type = "array<struct<x0:double,x1:double,y0:double,y1:double,m0:double,m1:double>>"
    zero = F.struct(
        F.when(F.size(d) > 0, F.element_at(d, 1)).cast("double").alias("carry"),
        F.expr(f"cast(array() as {seg_type})").alias("out"),
    )

    def limit(state, i):
        slope, m0, m1 = F.element_at(d, i), state["carry"], start(i + 1)
        safe = F.when(slope != 0, slope)
        r = (m0 * m0 + m1 * m1) / (safe * safe)
        tau = F.when(r > 9, 3.0 / F.sqrt(r)).otherwise(F.lit(1.0))
        left = F.when(slope == 0, F.lit(0.0)).otherwise(tau * m0)
        right = F.when(slope == 0, F.lit(0.0)).otherwise(tau * m1)
        a, b = F.element_at(at, i), F.element_at(at, i + 1)
        piece = F.struct(a["wl"].alias("x0"), b["wl"].alias("x1"), a["v"].alias("y0"), b["v"].alias("y1"),
                         left.alias("m0"), right.alias("m1"))
        return F.struct(right.alias("carry"), F.concat(state["out"], F.array(piece)).alias("out"))

    # the slope at a knot shared by two segments is the one its right-hand segment settled on
    folded = F.aggregate(F.sequence(F.lit(1), F.size(d)), zero, limit, lambda s: s["out"])
    joined = F.transform(
        F.col("_s"),
        lambda s, i: F.struct(
            s["x0"].alias("x0"), s["x1"].alias("x1"), s["y0"].alias("y0"), s["y1"].alias("y1"), s["m0"].alias("m0"),
            F.coalesce(F.get(F.col("_s"), i + 1)["m0"], s["m1"]).alias("m1"),
        ),
    )
    none = F.expr(f"cast(array() as {seg_type})")
    return (
        k.withColumn("_s", F.when(F.size(d) > 0, folded).otherwise(none)).withColumn(into, joined).drop("_k", "_d", "_s")
    )


def native_value(segs: Column, x: Column) -> Column:
    """Value at one wavelength from ``native_segments``; null outside."""
    s = F.try_element_at(F.filter(segs, lambda g: (g["x0"] <= x) & (x < g["x1"])), F.lit(1))
    last = F.try_element_at(segs, F.lit(-1))
    h = s["x1"] - s["x0"]
    t = (x - s["x0"]) / h
    inside = (
        (1 + 2 * t) * (1 - t) * (1 - t) * s["y0"] + t * (1 - t) * (1 - t) * h * s["m0"]
        + t * t * (3 - 2 * t) * s["y1"] + t * t * (t - 1) * h * s["m1"]
    )
    return F.when(last["x1"] == x, last["y1"]).otherwise(inside)
