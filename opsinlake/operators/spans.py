"""Regions as runs of pixels on image lines, and as quadtree cells for many regions at once.

A line of an image crosses the edges of a region in sorted places; between the first and the second, the third and the
fourth, and so on, lie the pixels whose centres are inside. A span table holds these runs with the number of region
pixels before each, so whether a pixel is inside and which one it is in raster order is arithmetic on its line's runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROWTH = 8  # cells of a level are so many times as wide and high as those below
LEVELS = 7  # of 64 x 8 pixels up to 16.8 million samples
SPLIT = 1 << 20  # cell and edge pairs looked at together


def _first(v: Column) -> Column:
    """The first pixel whose centre is at ``v`` or beyond."""
    return F.ceil(v - 0.5).cast("bigint")


def region_spans(regions: DataFrame, samples: int | None = None, lines: int | None = None, keys=("cube_id", "region_id")) -> DataFrame:
    """(keys.., line, start, stop, before): the runs [start, stop) of every region on every line, and how many pixels of
    the region come before the run in raster order.

    ``regions`` has ``keys``, ``kind`` and ``vertices``. Runs are clipped to an image of ``samples`` by ``lines`` where
    these are known, and at 0. Rows follow the heights of the regions, whatever their widths and numbers of vertices: an edge sends
    one row to each line it crosses, and a line sorts its own crossings.
    """
    keys = list(keys)
    kept = regions.where(F.size("vertices") > 1)
    x, y = F.col("vertices.x"), F.col("vertices.y")
    bottom, end = F.lit(0).cast("bigint"), F.lit(lines if lines is not None else 2**62).cast("bigint")

    def on_lines(low: Column, high: Column) -> Column:
        a, b = F.greatest(_first(low), bottom), F.least(_first(high), end) - 1
        return F.explode(F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>")))

    box = kept.where("kind = 'rectangle'").select(*keys, F.array_min(x).alias("a"), F.array_max(x).alias("b"), on_lines(F.array_min(y), F.array_max(y)).alias("line"))
    rotated = F.concat(F.slice("vertices", -1, 1), F.slice("vertices", 1, F.size("vertices") - 1))
    edges = kept.where("kind <> 'rectangle' and size(vertices) > 2").select(*keys, F.explode(F.arrays_zip(F.col("vertices").alias("i"), rotated.alias("j"))).alias("e"))
    (xi, yi), (xj, yj) = ((F.col(f"e.{s}.x"), F.col(f"e.{s}.y")) for s in "ij")
    met = edges.where(yi != yj).select(*keys, on_lines(F.least(yi, yj), F.greatest(yi, yj)).alias("line"), "e")
    cross = (xj - xi) * ((F.col("line") + 0.5) - yi) / (yj - yi) + xi
    runs = met.select(*keys, "line", cross.alias("x")).groupBy(*keys, "line").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("x") / 2 - 1).cast("int")), lambda k: F.struct(F.get("x", 2 * k).alias("a"), F.get("x", 2 * k + 1).alias("b")))
    runs = runs.where(F.size("x") > 1).select(*keys, "line", F.explode(pairs).alias("p")).select(*keys, "p.a", "p.b", "line")
    last = F.lit(samples if samples is not None else 2**62).cast("bigint")
    out = box.unionByName(runs).select(*keys, "line", F.greatest(_first(F.col("a")), bottom).alias("start"), F.least(_first(F.col("b")), last).alias("stop"))
    earlier = Window.partitionBy(*keys).orderBy("line", "start").rowsBetween(Window.unboundedPreceding, -1)
    return out.where("stop > start").withColumn("before", F.coalesce(F.sum(F.col("stop") - F.col("start")).over(earlier), F.lit(0)).cast("bigint"))


def on_spans(pixels: DataFrame, spans: DataFrame, keys=("cube_id",)) -> DataFrame:
    """Pixels inside the regions of a span table, once per region, with ``place``, their number inside it from 0. Meant for few
    regions; ``match_regions`` is for many."""
    met = pixels.join(spans, [*keys, "line"]).where((F.col("sample") >= F.col("start")) & (F.col("sample") < F.col("stop")))
    return met.withColumn("place", F.col("before") + F.col("sample") - F.col("start")).drop("start", "stop", "before")


# ------------------------------------------------------------------ cells


def _touched(points: np.ndarray, x0, y0, x1, y1) -> np.ndarray:
    """Whether an edge of the polygon may touch each closed cell: their boxes meet and the corners are not all on one
    side of the edge."""
    a, b = points, np.roll(points, 1, axis=0)
    out = np.zeros(len(x0), bool)
    step = max(1, SPLIT // len(points))
    for s in range(0, len(x0), step):
        l, t, r, d = (v[s : s + step, None] for v in (x0, y0, x1, y1))
        near = (np.minimum(a[:, 0], b[:, 0]) <= r) & (np.maximum(a[:, 0], b[:, 0]) >= l) & (np.minimum(a[:, 1], b[:, 1]) <= d) & (np.maximum(a[:, 1], b[:, 1]) >= t)
        dx, dy = b[:, 0] - a[:, 0], b[:, 1] - a[:, 1]
        side = [np.sign(dx * (y - a[:, 1]) - dy * (x - a[:, 0])) for x in (l, r) for y in (t, d)]
        apart = np.abs(sum(side)) == 4
        out[s : s + step] = (near & ~apart).any(axis=1)
    return out


def _inside(points: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Parity of the edges right of each point."""
    a, b = points, np.roll(points, 1, axis=0)
    rise = a[:, 1] != b[:, 1]
    a, b = a[rise], b[rise]
    out = np.zeros(len(x), bool)
    step = max(1, SPLIT // max(len(a), 1))
    for s in range(0, len(x), step):
        u, v = x[s : s + step, None], y[s : s + step, None]
        crossed = ((a[:, 1] > v) != (b[:, 1] > v)) & (u < (b[:, 0] - a[:, 0]) * (v - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])
        out[s : s + step] = crossed.sum(axis=1) % 2 == 1
    return out


def cover(kind: str, points: np.ndarray, width: int, height: int) -> list[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(level, columns, rows, whole) of the cells of a region: a cell that lies inside as a whole is not divided, one that
    the border may cross is divided down to level 0. Level 0 cells are ``width`` by ``height`` pixels."""
    if len(points) < (2 if kind == "rectangle" else 3):
        return []
    lo, hi = np.maximum(points.min(axis=0), 0.0), points.max(axis=0)
    if (hi <= lo).any():
        return []
    level = next((k for k in range(LEVELS) if hi[0] - lo[0] <= width * GROWTH**k and hi[1] - lo[1] <= height * GROWTH**k), LEVELS - 1)
    col = row = None
    out = []
    while level >= 0:
        w, h = width * GROWTH**level, height * GROWTH**level
        c0, c1, r0, r1 = (int(v) for v in (lo[0] // w, np.ceil(hi[0] / w) - 1, lo[1] // h, np.ceil(hi[1] / h) - 1))
        if col is None:
            col, row = (v.ravel() for v in np.meshgrid(np.arange(c0, c1 + 1), np.arange(r0, r1 + 1)))
        else:
            step = np.arange(GROWTH)
            col = (col[:, None, None] * GROWTH + step[None, :, None] + 0 * step[None, None, :]).ravel()
            row = (row[:, None, None] * GROWTH + 0 * step[None, :, None] + step[None, None, :]).ravel()
            near = (col >= c0) & (col <= c1) & (row >= r0) & (row <= r1)
            col, row = col[near], row[near]
        x0, y0 = col * float(w), row * float(h)
        if kind == "rectangle":
            whole = (x0 >= points[:, 0].min()) & (x0 + w <= hi[0]) & (y0 >= points[:, 1].min()) & (y0 + h <= hi[1])
            border = ~whole
        else:
            border = _touched(points, x0, y0, x0 + w, y0 + h)
            whole = ~border
            whole[whole] = _inside(points, x0[whole] + w / 2, y0[whole] + h / 2)
        if whole.any():
            out.append((level, col[whole], row[whole], True))
        if level == 0 and border.any():
            out.append((0, col[border], row[border], False))
        col, row, level = col[border], row[border], level - 1
    return out


def region_cells(regions: DataFrame, width: int, height: int) -> DataFrame:
    """(cube_id, region_id, level, cx, cy, whole, kind, vertices): the cells of every region; the shape only goes with cells
    that need a test."""
    kept = regions.select("cube_id", "region_id", "kind", "vertices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = zip(batch.column("kind").to_pylist(), batch.column("vertices").to_pylist())
            for i, (kind, vertices) in enumerate(shapes):
                points = np.array([(v["x"], v["y"]) for v in vertices or []], float).reshape(-1, 2)
                for level, cx, cy, whole in cover(kind, points, width, height):
                    n = len(cx)
                    at = pa.array(np.full(n, i))
                    shape = [pa.nulls(n, batch.column(c).type) if whole else batch.column(c).take(at) for c in ("kind", "vertices")]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("cube_id").take(at), batch.column("region_id").take(at), pa.array(np.full(n, level, np.int32)), pa.array(cx.astype(np.int64)),
                         pa.array(cy.astype(np.int64)), pa.array(np.full(n, whole)), *shape],
                        ["cube_id", "region_id", "level", "cx", "cy", "whole", "kind", "vertices"],
                    )

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"cube_id {types['cube_id']}, region_id {types['region_id']}, level int, cx bigint, cy bigint, whole boolean, kind string, vertices {types['vertices']}")
