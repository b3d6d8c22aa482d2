"""Runs on image lines and quadtree cells against pixel loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsinlake.operators import cubes, regions, spans

SAMPLES, LINES = 37, 29
SHAPES = {
    "box": regions.rectangle(3, 4, 20, 11), "reversed": regions.rectangle(20.4, 11.6, 3.5, 4.5), "outside": regions.rectangle(-50, -50, 100, 100),
    "off": regions.rectangle(50, 50, 60, 60), "sliver": regions.rectangle(5.6, 2, 5.9, 20), "flat": regions.rectangle(3, 7, 30, 7),
    "triangle": regions.polygon((2, 2), (30, 5), (12, 20)), "cross": regions.polygon((1, 1), (30, 25), (30, 1), (1, 25)),
    "comb": regions.polygon(*[(2 + 3 * i, 2 if i % 2 else 25) for i in range(11)], (33, 27), (1, 27)),
    "circle": regions.polygon(*[(18 + 17 * math.cos(t / 60 * 2 * math.pi), 14 + 13 * math.sin(t / 60 * 2 * math.pi)) for t in range(60)]),
    "line": regions.polygon((1, 1), (9, 9)), "level": regions.polygon((1, 5), (9, 5), (20, 5)), "over": regions.polygon((-30, -4), (90, 10), (-20, 60)),
}


def inside(r, x, y):
    v = r.vertices
    if r.kind == "rectangle":
        x0, y0, x1, y1 = r.bounds
        return x0 <= x < x1 and y0 <= y < y1
    if len(v) < 3:
        return False
    hits = 0
    for (xi, yi), (xj, yj) in zip(v, v[-1:] + v[:-1]):
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            hits += 1
    return hits % 2 == 1


def members(r):
    return [(ln, s) for ln in range(LINES) for s in range(SAMPLES) if inside(r, s + 0.5, ln + 0.5)]


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([("c", ln, s, [float(s)]) for ln in range(LINES) for s in range(SAMPLES)], "cube_id string, line long, sample long, spectrum array<float>")


@pytest.fixture(scope="module")
def table(spark):
    return regions.region_table(spark, SHAPES).withColumn("cube_id", F.lit("c"))


def test_runs_number_the_pixels_of_a_region(spark, grid, table):
    runs = spans.region_spans(table, SAMPLES, LINES)
    got = {n: [] for n in SHAPES}
    for r in spans.on_spans(grid, runs).orderBy("region_id", "line", "sample").collect():
        got[r.region_id].append((r.line, r.sample, r.place))
    for n, r in SHAPES.items():
        assert got[n] == [(*p, i) for i, p in enumerate(members(r))], n
    free = spans.region_spans(table.where("region_id <> 'outside' and region_id <> 'over'"))
    assert free.where("start < 0 or line < 0 or stop <= start").isEmpty()


@pytest.mark.parametrize("name", SHAPES)
def test_stride_is_arithmetic(grid, name):
    got = sorted((r.line, r.sample) for r in cubes.sample_pixels(grid, 3, SAMPLES, SHAPES[name]).collect())
    assert got == members(SHAPES[name])[::3]


def test_stride_of_a_rectangle_needs_no_exchange(grid, capsys):
    cubes.sample_pixels(grid, 3, SAMPLES, SHAPES["box"]).explain()
    assert "Exchange" not in capsys.readouterr().out


@pytest.mark.parametrize("tile", [1, 8, 16, 64])
def test_many_regions(grid, table, tile):
    got = {n: [] for n in SHAPES}
    for r in regions.match_regions(grid, table, tile).orderBy("line", "sample").collect():
        got[r.region_id].append((r.line, r.sample))
    assert got == {n: members(r) for n, r in SHAPES.items()}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("width,height", [(1, 1), (3, 2), (8, 1)])
def test_cells_cover_each_pixel_once(name, width, height):
    r = SHAPES[name]
    seen = {}
    for level, cx, cy, whole in spans.cover(r.kind, np.array(r.vertices), width, height):
        w, h = width * spans.GROWTH**level, height * spans.GROWTH**level
        for a, b in zip(cx.tolist(), cy.tolist()):
            for ln in range(b * h, min((b + 1) * h, LINES)):
                for s in range(a * w, min((a + 1) * w, SAMPLES)):
                    assert (ln, s) not in seen
                    seen[ln, s] = whole
                    if whole:
                        assert inside(r, s + 0.5, ln + 0.5)
    assert set(members(r)) <= set(seen)


def test_a_huge_region_is_a_few_cells():
    box = spans.cover("rectangle", np.array([(10.0, 10.0), (100_000.0, 100_000.0)]), 64, 8)
    count = sum(len(x[1]) for x in box)
    area = sum(len(x[1]) * 64 * 8 * 64 ** x[0] for x in box if x[3])
    assert count < 0.01 * 99_990.0**2 / (64 * 8) and area > 0.99 * 99_990.0**2  # rows under a hundredth of the tiles
    top = spans.cover("rectangle", np.array([(0.0, 0.0), (64.0 * 8**6, 8.0 * 8**6)]), 64, 8)
    assert sum(len(x[1]) for x in top) == 1 and top[0][3]


def test_tags_read_the_boxes_only(grid, capsys):
    tagged = regions.tag_regions(grid, {n: SHAPES[n] for n in ("box", "triangle")})
    tagged.explain("formatted")
    assert "OR" in capsys.readouterr().out.upper()
    assert regions.tag_regions(grid, {}).isEmpty()
