"""Image cubes as pixel tables: bands, axes, sampling, pixel curves."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsinlake.operators.regions import Region, contains, in_window, region_table
from opsinlake.operators.spans import on_spans, region_spans


def pixel(pixels: DataFrame, line: int, sample: int) -> DataFrame:
    return pixels.where((F.col("line") == line) & (F.col("sample") == sample))


def band_slice(pixels: DataFrame, band: int, spectrum="spectrum") -> DataFrame:
    """One band as an image."""
    return pixels.select("cube_id", "line", "sample", F.col(spectrum)[band].alias("value"))


def from_flat(cubes: DataFrame, layout: str, values="values") -> DataFrame:
    """Rows holding a whole flat array (``cube_id, lines, samples, bands, values``) to pixel rows.

    ``layout``: "band" = band-major, "chunky" = bands of one pixel together, "column" = first index fastest (lines,
    samples, bands). Each pixel slices its own bands inside the row, so nothing is shuffled or regrouped.
    """
    lines, samples, bands = F.col("lines"), F.col("samples"), F.col("bands")

    def cut(p):
        line, sample = F.floor(p / samples), p % samples
        start, stride = {
            "band": (p, lines * samples),
            "chunky": (p * bands, F.lit(1)),
            "column": (line + sample * lines, lines * samples),
        }[layout]
        return F.struct(
            line.cast("long").alias("line"),
            sample.cast("long").alias("sample"),
            F.transform(
                F.sequence(F.lit(0), bands - 1),
                lambda b: F.element_at(F.col(values), (start + b * stride + 1).cast("int")).cast("float"),
            ).alias("spectrum"),
        )

    message = F.lit("a flat cube needs one value for every band, line and sample")
    cells = F.when(
        F.size(values) == lines * samples * bands, F.transform(F.sequence(F.lit(0), lines * samples - 1), cut)
    ).otherwise(F.raise_error(message))
    return cubes.select("cube_id", F.inline(cells))


BLOCK_VALUES = 1 << 18  # values of the pixels that are put together in one place


def from_chunks(chunks: DataFrame, cubes: DataFrame, layout: str, values="values", block_values: int = BLOCK_VALUES) -> DataFrame:
    """Flat arrays in pieces (``cube_id, offset, values``) to pixel rows ``cube_id, line, sample, spectrum``, for cubes of any
    size; ``cubes`` has ``cube_id, lines, samples, bands`` and ``layout`` is as in ``from_flat``.

    Every piece is dealt to blocks of consecutive pixels; a block is put together where its parts meet, so a task holds
    ``block_values`` values (or one pixel) however large a cube is. A cube whose pieces do not hold each value exactly once is an error;
    one without pieces or without an entry in ``cubes`` gives no rows.
    """
    if layout not in ("band", "chunky", "column"):
        raise ValueError(f"unknown layout {layout!r}")
    message = F.lit("a flat cube needs one value for every band, line and sample")
    held = chunks.groupBy("cube_id").agg(F.sum(F.size(values)).alias("_held"))
    sizes = [F.col(c).cast("bigint") for c in ("lines", "samples", "bands")]
    sized = cubes.join(held, "cube_id").where("_held > 0").select("cube_id", *sizes, "_held")
    fits = F.col("_held") == F.col("lines") * F.col("samples") * F.col("bands")
    sized = sized.select("cube_id", F.when(fits, F.col("lines")).otherwise(F.raise_error(message).cast("bigint")).alias("lines"), "samples", "bands")
    placed = chunks.select("cube_id", F.col("offset").cast("bigint").alias("offset"), F.col(values).cast("array<float>").alias("v")).join(sized, "cube_id")
    key = placed.schema["cube_id"].dataType.simpleString()

    def deal(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("offset", "lines", "samples", "bands")))
            for i, (offset, lines, samples, bands) in enumerate(rows):
                v = batch.column("v")[i].values.to_numpy(zero_copy_only=False)
                at, plane = offset + np.arange(len(v)), lines * samples
                if len(v) and not 0 <= offset <= plane * bands - len(v):
                    raise ValueError(f"values at {offset} lie outside a cube of {plane * bands}")
                if layout == "chunky":
                    pixel, band = at // bands, at % bands
                else:
                    band, pixel = at // plane, at % plane
                    if layout == "column":
                        pixel = pixel % lines * samples + pixel // lines
                step = max(block_values // bands, 1)
                block = pixel // step
                order = np.argsort(block, kind="stable")
                block, place = block[order], ((pixel - block * step) * bands + band)[order].astype(np.int32)
                head = np.flatnonzero(np.diff(block, prepend=-1))
                edge = pa.array(np.append(head, len(v)).astype(np.int32))
                n = len(head)
                yield pa.RecordBatch.from_arrays([
                    batch.column("cube_id").take(pa.array(np.full(n, i))), pa.array(block[head]), *(pa.array(np.full(n, d)) for d in (lines, samples, bands)),
                    pa.ListArray.from_arrays(edge, pa.array(place)), pa.ListArray.from_arrays(edge, pa.array(v[order].astype(np.float32))),
                ], ["cube_id", "block", "lines", "samples", "bands", "place", "v"])

    def together(part: pa.Table) -> pa.Table:
        block, lines, samples, bands = (part.column(c)[0].as_py() for c in ("block", "lines", "samples", "bands"))
        step = max(block_values // bands, 1)
        first = block * step
        n = min(step, lines * samples - first)
        place, v = (pa.concat_arrays(part.column(c).chunks).flatten().to_numpy() for c in ("place", "v"))
        if (np.bincount(place, minlength=n * bands) != 1).any():
            raise ValueError(f"cube {part.column('cube_id')[0].as_py()}: values from pixel {first} on are missing or given twice")
        cells = np.empty(n * bands, np.float32)
        cells[place] = v
        pixel = first + np.arange(n)
        return pa.Table.from_arrays([
            part.column("cube_id").combine_chunks().take(pa.array(np.zeros(n, np.int64))), pa.array(pixel // samples), pa.array(pixel % samples),
            pa.ListArray.from_arrays(np.arange(0, (n + 1) * bands, bands, dtype=np.int32), pa.array(cells)),
        ], ["cube_id", "line", "sample", "spectrum"])

    parts = placed.mapInArrow(deal, f"cube_id {key}, block bigint, lines bigint, samples bigint, bands bigint, place array<int>, v array<float>")
    return parts.groupBy("cube_id", "block").applyInArrow(together, f"cube_id {key}, line bigint, sample bigint, spectrum array<float>")


def guess_roles(variables: DataFrame) -> DataFrame:
    """Which array of a file is the cube and which the wavelength axis (``file, name, shape, pos``), in one aggregate: a
    file has few arrays."""
    entry = F.struct("pos", "name", "shape")
    found = variables.groupBy("file").agg(
        F.min(F.when(F.size("shape") == 3, entry)).alias("cube"), F.collect_list(F.when(F.size("shape") == 2, entry)).alias("flat")
    )
    bands = F.element_at(F.col("cube.shape"), 3)
    axes = F.filter("flat", lambda v: ((v["shape"][0] == 1) & (v["shape"][1] == bands)) | ((v["shape"][1] == 1) & (v["shape"][0] == bands)))
    return found.select("file", F.col("cube.name").alias("cube_name"), F.array_min(axes)["name"].alias("wavelength_name"))


def source_label(path: Column) -> Column:
    """File name without folder and last extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    return F.when(F.length(stem) > 0, stem).otherwise(F.lit("image"))


def source_format(path: Column) -> Column:
    return F.when(F.lower(path).rlike(r"\.tiff?$"), F.lit("geotiff")).otherwise(F.lit("envi"))


def describe_cube(label: Column, bands: Column, wavelengths: Column) -> Column:
    """Provenance text of a cube."""
    span = F.format_string("%.0f–%.0f nm", F.element_at(wavelengths, 1), F.element_at(wavelengths, -1))
    has = F.coalesce(F.size(wavelengths) > 0, F.lit(False))
    head = F.concat(label, F.lit(" · "), bands.cast("string"))
    return F.when(has, F.concat(head, F.lit(" bands @ "), span)).otherwise(
        F.concat(head, F.lit(" bands (no wavelength axis)"))
    )


def axis_error(wavelengths: Column, bands: Column) -> Column:
    """Why an axis cannot be used for rendering, or null: missing, wrong length, or not strictly increasing."""
    n = F.size(wavelengths)
    rising = F.forall(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.coalesce(F.get(wavelengths, i) > F.get(wavelengths, i - 1), F.lit(True)),
    )
    return (
        F.when(wavelengths.isNull() | (n <= 0), F.lit("missing"))
        .when(n != bands, F.lit("count mismatch"))
        .when(~rising, F.lit("not increasing"))
    )


def assign_wavelengths(cubes: DataFrame, presets: DataFrame, preset: Column) -> DataFrame:
    """Give cubes the axis of a named preset; a wrong band count goes to ``axis_error`` and leaves the axis alone.

    ``presets`` is the sensor table (a few rows); Spark broadcasts it by its size.
    """
    named = presets.select(F.col("name").alias("_preset"), F.col("wavelengths_nm").alias("_wl"))
    joined = cubes.withColumn("_preset", preset).join(named, "_preset", "left")
    fits = F.coalesce(F.size("_wl") == F.col("bands"), F.lit(False))
    problem = F.when(F.col("_wl").isNull(), F.lit("unknown preset")).when(~fits, F.lit("count mismatch"))
    return (
        joined.withColumn("axis_error", problem)
        .withColumn("wavelengths", F.when(fits, F.col("_wl")).otherwise(F.col("wavelengths")))
        .drop("_preset", "_wl")
    )


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def assign_typed(cubes: DataFrame, typed: Column) -> DataFrame:
    """Give cubes the axis typed for each as numbers separated by commas. Text that is not such a list, or has another count than the
    cube has bands, goes to ``axis_error`` and leaves the axis alone; so does a null, which is no request and no error."""
    entries = F.transform(F.split(typed, ","), lambda t: F.trim(t))
    numeric = F.forall("_typed", lambda t: t.rlike(_NUMBER))
    asked = cubes.withColumn("_typed", entries)
    problem = F.when(F.col("_typed").isNull(), F.lit(None)).when(~numeric, F.lit("not a list of numbers")).when(F.size("_typed") != F.col("bands"), F.lit("count mismatch"))
    values = F.transform("_typed", lambda t: t.try_cast("double"))
    return (
        asked.withColumn("axis_error", problem.cast("string"))
        .withColumn("wavelengths", F.when(F.col("_typed").isNotNull() & F.col("axis_error").isNull(), values).otherwise(F.col("wavelengths")))
        .drop("_typed")
    )


def sort_bands(pixels: DataFrame, wavelengths, spectrum="spectrum"):
    """Increasing axis and the pixels with their bands in that order, for sensors listed out of order."""
    order = sorted(range(len(wavelengths)), key=lambda i: wavelengths[i])
    picked = F.array(*[F.col(spectrum)[i] for i in order])
    return [float(wavelengths[i]) for i in order], pixels.withColumn(spectrum, picked)


def sample_pixels(pixels: DataFrame, stride: int, samples: int, region: Region | None = None) -> DataFrame:
    """Every ``stride``-th pixel in raster order, of the whole image or of a region. ``samples`` is the width of the image.

    The rank of a pixel is known by arithmetic: from its place in the image, in a rectangle, or in the runs of a polygon on its
    line (``spans.region_spans``), which are a small table that joins by line. Nothing is sorted or counted.
    """
    stride = max(int(stride), 1)
    if region is None:
        return pixels.where((F.col("line") * samples + F.col("sample")) % stride == 0)
    near = pixels.where(in_window(region))
    if region.kind == "rectangle":
        x0, y0, x1, _ = region.bounds
        first, last, top = (max(math.ceil(v - 0.5), 0) for v in (x0, x1, y0))
        place = (F.col("line") - top) * max(min(last, samples) - first, 0) + F.col("sample") - first
        return near.where(contains(region)).where(place % stride == 0)
    runs = region_spans(region_table(pixels.sparkSession, {"": region}), samples, keys=("region_id",)).drop("region_id")
    return on_spans(near, runs, ()).where(F.col("place") % stride == 0).drop("place")


def as_points(wavelengths, spectrum: Column) -> Column:
    """Zip a shared axis with a spectrum column into ``array<struct<wl,v>>``."""
    return F.zip_with(
        F.lit([float(w) for w in wavelengths]), spectrum,
        lambda w, v: F.struct(w.alias("wl"), v.cast("double").alias("v")),
    )


def quantity(kind: str, unit: str | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(unit).cast("string").alias("unit"))


def pixel_curves(pixels: DataFrame, wavelengths, source: str, batch: str) -> DataFrame:
    """Pixels as radiance curves, named after their place and tagged with a batch path."""
    if wavelengths is None:  # no axis, no curves; the columns stay those of a curve
        return pixel_curves(pixels.where(F.lit(False)), (), source, batch)
    name = F.concat(
        F.lit(f"{source} — pixel ("), F.col("line").cast("string"), F.lit(","),
        F.col("sample").cast("string"), F.lit(")"),
    )
    return pixels.select(
        *[c for c in pixels.columns if c != "spectrum"],
        name.alias("name"),
        F.lit("Illumination").alias("curve_type"),
        quantity("Radiance", "relative").alias("quantity"),
        as_points(wavelengths, F.col("spectrum")).alias("points"),
        F.create_map(F.lit("batch"), F.lit(batch)).alias("metadata"),
    )


def region_curves(means: DataFrame, wavelengths, source: str, label: Column, as_light: bool = False) -> DataFrame:
    """Regional mean spectra as curves: a relative radiance when used as a light, else a reflectance."""
    kind = quantity("Radiance", "relative") if as_light else quantity("Reflectance")
    return means.select(
        *[c for c in means.columns if c != "spectrum"],
        F.concat(F.lit(f"{source} — "), label).alias("name"),
        F.lit("Illumination" if as_light else "Reflectance").alias("curve_type"),
        kind.alias("quantity"),
        as_points(wavelengths, F.col("spectrum")).alias("points"),
        F.create_map(
            F.lit("source"), F.concat(F.lit(f'Extracted from "{source}", region '), label)
        ).alias("metadata"),
    )


def import_pixels(pixels: DataFrame, wavelengths, source: str, samples: int, stride: int = 1,
                  region: Region | None = None) -> DataFrame:
    """Every ``stride``-th pixel of an image or region as a curve in the batch ``<source>/<region>``."""
    label = "whole image" if region is None else region.label
    return pixel_curves(sample_pixels(pixels, stride, samples, region), wavelengths, source, f"{source}/{label}")
