"""Perceptual coordinates and distances of stimuli.

Stimuli that share a wavelength axis (image pixels, regional means, gridded libraries) go through a compiled
``CurveKernel``: one Arrow pass computes the coordinates of every requested system. Stimuli with points of their own go
through a ``Panel`` of observers, which fits every curve once for all systems.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsinlake.functions.arrays import lists, matrix
from opsinlake.functions.monotone import tangents
from opsinlake.operators import curves
from opsinlake.operators.curves import bundles
from opsinlake.plans.kernel import CurveKernel, RegimeState
from opsinlake.plans.observers import Panel
from opsinlake.session import attach, block_pairs
from opsinlake.sources import text

EUCLIDEAN, CHROMA_ONLY, DELTA_S = "euclidean", "chroma_only", "delta_s"


def _coordinates(q: np.ndarray, k) -> list[np.ndarray]:
    """``[L, C1.., saturation], q`` of gated integrals (raw responses only for a pool kernel)."""
    q = q * k.gains
    capped = np.isfinite(k.caps)
    q[:, capped] = np.fmin(q[:, capped], k.caps[capped])
    if k.adaptation is not None:
        q = q @ k.adaptation.T
    if k.opponent is None:
        return [q]
    c = q @ k.opponent.T
    return [c, np.sqrt((c[:, 1:] ** 2).sum(1, keepdims=True)), q]


def coordinate_rows(spectrum: Column, kernels: list[CurveKernel]) -> Column:
    """``[L, C1.., saturation, q1..]`` per kernel (raw responses only for a pool kernel), concatenated. Kernels that
    resample their stimuli under one light do so once."""
    axis = kernels[0].axis
    n = len(axis)
    stages = {k.lit.key: k.lit for k in kernels if k.lit is not None}
    parts = [(None if k.lit is None else k.lit.key, k.value_weights.T.copy(), k.slope_weights.T.copy(), replace(k, lit=None)) for k in kernels]

    @F.arrow_udf("array<double>")
    def rows(spectra: pa.Array) -> pa.Array:
        y, ok = matrix(spectra, n)
        m = tangents(np.broadcast_to(axis, y.shape), y, np.full(len(y), n))
        shown = {None: (y, m)}
        for key, stage in stages.items():
            p = stage.products(y, m)
            shown[key] = p, tangents(np.broadcast_to(stage.grid, p.shape), p, np.full(len(p), p.shape[1]))
        out = []
        for key, value, slope, k in parts:
            a, b = shown[key]
            out += _coordinates(a @ value + b @ slope, k)
        return lists(np.hstack(out), ok, np.float64)

    return rows(spectrum)


def panel_rows(points: Column, reflects: Column, panel: Panel) -> Column:
    """The same rows for stimuli with points of their own: every curve is fitted once for all observers of the panel.
    Where ``reflects`` holds, the stimulus is seen under the panel's light."""
    width = sum(o.width for o in panel.observers)

    @F.arrow_udf("array<double>")
    def rows(points: pa.Array, lit: pa.Array) -> pa.Array:
        ok = np.asarray(points.is_valid())
        flags = pc.fill_null(lit, False).to_numpy(zero_copy_only=False).astype(bool)
        out = np.empty((len(ok), width))
        for a, b, fitted in bundles(points):
            q, at, parts = panel.stack.seen(fitted, flags[a:b]), 0, []
            for o in panel.observers:
                parts += _coordinates(q[:, at : at + len(o.gains)], o)
                at += len(o.gains)
            out[a:b] = np.hstack(parts)
        return lists(out[ok], ok, np.float64)

    return rows(points, reflects)


def _layout(kernels):
    at = 0
    for k in kernels:
        yield k, at
        at += k.width


def hue_angles(chroma: list[Column]) -> list[Column]:
    """Hyperspherical angles of a chroma vector; none for fewer than two axes."""
    n = len(chroma)
    out = []
    for k in range(n - 2):
        tail = None
        for c in chroma[k + 1:]:
            tail = c * c if tail is None else tail + c * c
        out.append(F.atan2(F.sqrt(tail), chroma[k]))
    if n >= 2:
        out.append(F.atan2(chroma[-1], chroma[-2]))
    return out


def coordinates(stimuli: DataFrame, kernels: CurveKernel | list[CurveKernel], spectrum="spectrum") -> DataFrame:
    """Long table: one row per stimulus and system with ``system, regime, luminance, chroma, saturation, adapted``."""
    kernels = [kernels] if isinstance(kernels, CurveKernel) else list(kernels)
    return _long(stimuli.withColumn("_r", coordinate_rows(F.col(spectrum), kernels)).drop(spectrum), kernels)


def panel_coordinates(stimuli: DataFrame, panel: Panel, points="points", kind="quantity.kind") -> DataFrame:
    """The same long table for stimuli with points of their own, all observers in one pass. Absorption curves leave,
    reflectances are lit, all other kinds pass as they are."""
    panel = panel.with_colours()
    return _long(_shown(stimuli, panel, points, kind).drop(points), panel.observers)


def _long(packed: DataFrame, kernels) -> DataFrame:
    kept = [c for c in packed.columns if c != "_r"]
    cells = []
    for k, at in _layout(kernels):
        n = k.chroma
        cells.append(F.struct(
            F.lit(k.system).alias("system"),
            F.lit(k.regime).alias("regime"),
            F.col("_r")[at].alias("luminance"),
            F.slice("_r", at + 2, n).alias("chroma"),
            F.col("_r")[at + 1 + n].alias("saturation"),
            F.slice("_r", at + 3 + n, len(k.gains)).alias("adapted"),
        ))
    return packed.withColumn("_c", F.explode(F.array(*cells))).select(*kept, "_c.*")


def _shown(stimuli: DataFrame, panel: Panel, points: str, kind: str) -> DataFrame:
    """Stimuli that can be seen, with ``_r``."""
    usable = stimuli.where(~F.col(kind).eqNullSafe("Absorption"))
    return usable.withColumn("_r", panel_rows(F.col(points), F.col(kind).eqNullSafe("Reflectance"), panel))


def coordinate_table(stimuli: DataFrame, kernel: CurveKernel, spectrum="spectrum") -> DataFrame:
    """Flat table of one system: L, C1.., and with more than one chroma axis saturation and hue angles."""
    kept = [c for c in stimuli.columns if c != spectrum]
    packed = stimuli.withColumn("_r", coordinate_rows(F.col(spectrum), [kernel]))
    n = kernel.chroma
    chroma = [F.col("_r")[1 + i] for i in range(n)]
    cols = [F.col("_r")[0].alias("L"), *[c.alias(f"C{i + 1}") for i, c in enumerate(chroma)]]
    if n > 1:
        cols.append(F.col("_r")[1 + n].alias("saturation"))
        cols += [a.alias(f"hue{i + 1}") for i, a in enumerate(hue_angles(chroma))]
    return packed.select(*kept, *cols)


def pool_responses(stimuli: DataFrame, kernel: CurveKernel, spectrum="spectrum") -> DataFrame:
    """Raw responses of every receptor of a system without regimes, one column per receptor."""
    kept = [c for c in stimuli.columns if c != spectrum]
    packed = stimuli.withColumn("_r", coordinate_rows(F.col(spectrum), [kernel]))
    return packed.select(*kept, *[F.col("_r")[i].alias(n) for i, n in enumerate(kernel.receptor_names)])


def _dot(values: Column, row) -> Column:
    total = None
    for i, w in enumerate(row):
        t = values[i] * F.lit(float(w))
        total = t if total is None else total + t
    return F.lit(0.0) if total is None else total


def point_coordinates(stimuli: DataFrame, system: str, state: RegimeState, light, points="points") -> DataFrame:
    """Coordinates of stimuli with their own points: resolve against the light, integrate, cap, adapt, oppose."""
    members = state.resolved.members
    lit_up = curves.resolve_stimuli(stimuli, light, points)
    raw = lit_up.withColumn("_q", curves.activations(F.col(points), members, state.gains))
    adapted = F.array(*[_dot(F.col("_q"), row) for row in state.adaptation])
    full = raw.withColumn("adapted", adapted)
    chroma = [_dot(F.col("adapted"), row) for row in state.axes]
    axes = F.array(*chroma) if chroma else F.expr("cast(array() as array<double>)")
    return (
        full.withColumn("system", F.lit(system))
        .withColumn("regime", F.lit(state.resolved.name))
        .withColumn("luminance", _dot(F.col("adapted"), state.resolved.weights))
        .withColumn("chroma", axes)
        .withColumn("saturation", F.sqrt(F.aggregate("chroma", F.lit(0.0), lambda s, c: s + c * c)))
        .drop("_q", points)
    )


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: dict, b: dict, metric: str, noise: Column | None = None) -> Column:
    """Distance of two coordinate rows given as column dictionaries (``luminance, chroma, adapted``).

    Different chroma dimensions are an error. The receptor-noise distance is null without matching noise terms.
    """
    same = F.size(a["chroma"]) == F.size(b["chroma"])
    if metric == DELTA_S:
        usable = (F.size(noise) == F.size(a["adapted"])) & (F.size(noise) == F.size(b["adapted"]))
        parts = F.zip_with(
            F.zip_with(a["adapted"], b["adapted"], lambda x, y: x - y), noise, lambda d, e: (d / e) * (d / e)
        )
        value = F.when(usable, F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)))
    else:
        total = squared(a["chroma"], b["chroma"])
        if metric == EUCLIDEAN:
            d = a["luminance"] - b["luminance"]
            total = total + d * d
        value = F.sqrt(total)
    message = F.lit("distance between coordinates with unequal numbers of chroma axes")
    return F.when(same, value).otherwise(F.raise_error(message).cast("double"))


def noise_column(kernels: list[CurveKernel], system: Column) -> Column:
    """Noise terms of each system as an array column; null where they are incomplete."""
    out = F.lit(None).cast("array<double>")
    for k in kernels:
        if k.noise is not None:
            out = F.when(system == k.system, F.lit([float(e) for e in k.noise])).otherwise(out)
    return out


def _side(prefix: str) -> dict:
    return {c: F.col(f"{prefix}{c}") for c in ("luminance", "chroma", "adapted")}


def _rename(coords: DataFrame, id_column: str, prefix: str) -> DataFrame:
    return coords.select(
        "system", F.col(id_column).alias(f"{prefix}id"),
        *[F.col(c).alias(f"{prefix}{c}") for c in ("luminance", "chroma", "adapted")],
    )


def distance_to_references(coords: DataFrame, references: DataFrame, kernels: list[CurveKernel], metric: str,
                           id_column="id") -> DataFrame:
    """Every stimulus against a few reference stimuli of the same system, linear in the number of stimuli. The join is
    salted by the stimulus, as a species is one key for all of them."""
    left = attach(coords, _rename(references, id_column, "ref_"), ["system"], F.col(id_column))
    here = {c: F.col(c) for c in ("luminance", "chroma", "adapted")}
    d = distance(here, _side("ref_"), metric, noise_column(kernels, F.col("system")))
    return left.select(id_column, "system", "regime", F.col("ref_id"), d.alias("distance"))


def difference_matrix(coords: DataFrame, kernels: list[CurveKernel], metric: str, id_column="id") -> DataFrame:
    """Upper triangle (``a_id < b_id``) of the distances within each system, for a chosen set of stimuli.

    The output is quadratic, so callers choose the stimuli (``distance_to_references`` is the linear form); pairs are
    dealt out by blocks of stimuli, whatever their number.
    """
    pairs = block_pairs(_rename(coords, id_column, "a_"), _rename(coords, id_column, "b_"), ["system"], "a_id", "b_id")
    d = distance(_side("a_"), _side("b_"), metric, noise_column(kernels, F.col("system")))
    return pairs.select("system", "a_id", "b_id", d.alias("distance"))


def mirrored(matrix_rows: DataFrame) -> DataFrame:
    """Full symmetric matrix with a zero diagonal, for display."""
    flipped = matrix_rows.select("system", F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "distance")
    ids = matrix_rows.select("system", "a_id").unionByName(flipped.select("system", "a_id")).distinct()
    diagonal = ids.select("system", "a_id", F.col("a_id").alias("b_id"), F.lit(0.0).alias("distance"))
    return matrix_rows.unionByName(flipped).unionByName(diagonal)


def cross_species(coords: DataFrame, kernels: list[CurveKernel], id_column="id") -> DataFrame:
    """Stimulus pairs by species: receptor-noise distance per species column, null where a species lacks noise."""
    pairs = difference_matrix(coords, kernels, DELTA_S, id_column)
    return pairs.groupBy("a_id", "b_id").pivot("system", [k.system for k in kernels]).agg(F.first("distance"))


def species_summary(coords: DataFrame, kernels, id_column="id") -> DataFrame:
    """(a_id, b_id, system, regime, has_complete_noise_data, delta_s): every stimulus pair by species, each judged in
    the regime its kernel was compiled for. delta_s is null where a species lacks noise."""
    complete = [k.system for k in kernels if k.noise is not None]
    pairs = difference_matrix(coords, kernels, DELTA_S, id_column).withColumnRenamed("distance", "delta_s")
    regime = F.lit(None).cast("string")
    for k in kernels:
        regime = F.when(F.col("system") == k.system, F.lit(k.regime)).otherwise(regime)
    flag = F.col("system").isin(complete) if complete else F.lit(False)
    return pairs.select("a_id", "b_id", "system", regime.alias("regime"), flag.alias("has_complete_noise_data"), "delta_s")


def export_columns(kernels: list[CurveKernel], references: np.ndarray | None = None) -> list[str]:
    """Column names of a batch export, in file order."""
    out = []
    for k in kernels:
        out += [f"{k.system} L"] + [f"{k.system} C{i}" for i in range(1, k.chroma + 1)] + [f"{k.system} Saturation"]
        if references is not None:
            out.append(f"{k.system} Distance-to-ref")
    return out


def _lit(stimuli: DataFrame, kernels, spectrum, kind: str | None, radiance) -> DataFrame:
    """Stimuli with their coordinates ``_r``. With ``kind`` (a column of kind names) absorption curves leave, reflectances
    are lit, and all else goes through the ``radiance`` kernels, which know no light. Without, all are reflectances."""
    if isinstance(kernels, Panel):
        return _shown(stimuli, kernels, spectrum, kind)
    if kind is None:
        return stimuli.withColumn("_r", coordinate_rows(F.col(spectrum), kernels))
    if radiance is None or [k.system for k in radiance] != [k.system for k in kernels]:
        raise ValueError("stimuli of several kinds need a radiance kernel for every kernel")
    shown = stimuli.where(~F.col(kind).eqNullSafe("Absorption"))
    reflects = F.col(kind).eqNullSafe("Reflectance")
    # a null spectrum costs its kernel nothing, so each row is multiplied once
    both = shown.withColumns({
        "_e": coordinate_rows(F.when(~reflects, F.col(spectrum)), radiance), "_l": coordinate_rows(F.when(reflects, F.col(spectrum)), kernels),
    })
    return both.withColumn("_r", F.coalesce("_e", "_l")).drop("_e", "_l")


def batch_export(stimuli: DataFrame, kernels: list[CurveKernel] | Panel, name="name", spectrum="spectrum",
                 reference: DataFrame | None = None, metric: str = EUCLIDEAN, kind: str | None = None,
                 radiance: list[CurveKernel] | None = None) -> DataFrame:
    """One wide row per stimulus: a block of coordinates per species, and optionally its distance to one reference.

    ``kernels`` are the dominant-regime kernels, or a panel for stimuli with points of their own (column ``spectrum``);
    pools contribute nothing. ``reference`` is a one-row table with the same columns; it joins as a scalar and stays lazy. ``kind``
    names a column with each stimulus's quantity (``quantity.kind`` for a panel, if not given): absorption curves are not
    exported, reflectances are lit, all else is not (``radiance``: the same systems compiled for radiance).
    """
    if isinstance(kernels, Panel):
        kernels, kind = kernels.with_colours(), kind or "quantity.kind"
        species = kernels.observers
    else:
        if radiance is not None:
            radiance = [r for k, r in zip(kernels, radiance) if k.opponent is not None]
        species = kernels = [k for k in kernels if k.opponent is not None]
    if not species:
        raise ValueError("none of the selected systems has a colour space to export")
    packed = _lit(stimuli, kernels, spectrum, kind, radiance)
    ref = None
    if reference is not None:
        one = _lit(reference, kernels, spectrum, kind, radiance).agg(F.count("_r").alias("n"), F.first("_r", ignorenulls=True).alias("r"))
        problem = F.raise_error(F.lit("pick exactly one reference stimulus for the distance column")).cast("array<double>")
        packed = packed.withColumn("_ref", one.select(F.when(F.col("n") == 1, F.col("r")).otherwise(problem)).scalar())
        ref = F.col("_ref")
    cols = [F.col(name).alias("Stimulus")]
    r = F.col("_r")
    for k, at in _layout(species):
        n = k.chroma
        cols.append(r[at].alias(f"{k.system} L"))
        cols += [r[at + i].alias(f"{k.system} C{i}") for i in range(1, n + 1)]
        cols.append(r[at + 1 + n].alias(f"{k.system} Saturation"))
        if ref is not None:
            cols.append(_reference_distance(r, ref, k, at, metric).alias(f"{k.system} Distance-to-ref"))
    return packed.select(*cols)


def write_export(path: str, stimuli: DataFrame, kernels, **options) -> None:
    """``batch_export`` as CSV, but first what is wrong with the request: no usable stimulus, or not exactly one usable
    reference. Nothing is written then."""
    wide = batch_export(stimuli, kernels, **options)
    kind = options.get("kind") or ("quantity.kind" if isinstance(kernels, Panel) else None)

    def usable(df: DataFrame) -> DataFrame:
        shown = df if kind is None else df.where(~F.col(kind).eqNullSafe("Absorption"))
        return shown.where(F.col(options.get("spectrum", "spectrum")).isNotNull())

    if usable(stimuli).isEmpty():
        raise ValueError("there is no stimulus to export; absorption curves cannot be seen")
    if options.get("reference") is not None and usable(options["reference"]).limit(2).count() != 1:
        raise ValueError("pick exactly one reference stimulus for the distance column")
    text.write_table(wide, path)


def _reference_distance(r: Column, ref, k: CurveKernel, at: int, metric: str) -> Column:
    n = k.chroma
    if metric == DELTA_S:
        if k.noise is None:
            return F.lit(None).cast("double")
        terms = [(r[at + 2 + n + i] - ref[at + 2 + n + i]) / F.lit(float(e)) for i, e in enumerate(k.noise)]
    else:
        first = 0 if metric == EUCLIDEAN else 1
        terms = [r[at + i] - ref[at + i] for i in range(first, n + 1)]
    total = F.lit(0.0)
    for t in terms:
        total = total + t * t
    return F.sqrt(total)
