"""Regions, sampling, edges, colours and display ranges on small images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsinlake import constants as C
from opsinlake.functions import color
from opsinlake.operators import cubes, display, regions, render
from opsinlake.plans import kernel as K

SAMPLES, LINES, BANDS = 37, 23, 3

REGIONS = {
    "a": regions.rectangle(3, 4, 20, 11), "b": regions.rectangle(20, 11, 3, 4), "c": regions.rectangle(-5, -5, 100, 100),
    "d": regions.rectangle(30.2, 5.1, 30.4, 5.3), "e": regions.rectangle(50, 50, 60, 60),
    "f": regions.polygon((2, 2), (30, 5), (12, 20)), "g": regions.polygon((18, 1), (34, 12), (18, 22), (3, 12)),
    "h": regions.polygon(*[(18 + 15 * math.cos(t / 40 * 2 * math.pi), 11 + 9 * math.sin(t / 40 * 2 * math.pi)) for t in range(40)]),
    "i": regions.polygon((1, 1), (5, 5)),
}


def value(line, sample, band):
    i = band * LINES * SAMPLES + line * SAMPLES + sample
    return ((i * 7919) % 1013) * 0.37 - 50


@pytest.fixture(scope="module")
def image(spark):
    rows = [("c", ln, s, [value(ln, s, b) for b in range(BANDS)]) for ln in range(LINES) for s in range(SAMPLES)]
    return spark.createDataFrame(rows, "cube_id string, line long, sample long, spectrum array<float>").repartition(4)


def inside(r, s, ln):
    """Slow containment of the pixel centre."""
    x, y = s + 0.5, ln + 0.5
    if r.kind == "rectangle":
        x0, y0, x1, y1 = r.bounds
        return x0 <= x < x1 and y0 <= y < y1
    v, odd = r.vertices, False
    if len(v) < 3:
        return False
    for i in range(len(v)):
        (xi, yi), (xj, yj) = v[i], v[i - 1]
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            odd = not odd
    return odd


def members(r):
    return [(ln, s) for ln in range(LINES) for s in range(SAMPLES) if inside(r, s, ln)]


def test_region_membership_every_way(spark, image):
    rows = [("c", n, r.kind, [{"x": x, "y": y} for x, y in r.vertices]) for n, r in REGIONS.items()]
    table = spark.createDataFrame(rows, "cube_id string, region_id string, kind string, vertices array<struct<x:double,y:double>>")
    joined, tagged = {}, {}
    for r in regions.match_regions(image, table, tile=8).collect():
        joined.setdefault(r["region_id"], set()).add((r["line"], r["sample"]))
    for r in regions.tag_regions(image, REGIONS).collect():
        tagged.setdefault(r["region_id"], set()).add((r["line"], r["sample"]))
    for n, r in REGIONS.items():
        want = set(members(r))
        got = {(p["line"], p["sample"]) for p in regions.select_region(image, r).collect()}
        assert got == want and joined.get(n, set()) == want and tagged.get(n, set()) == want, n


@pytest.mark.parametrize("limit", [20_000, 1])
def test_region_means(image, limit, monkeypatch):
    monkeypatch.setattr(regions, "PARTIAL_GROUPS", limit)
    got = {r["region_id"]: r for r in regions.mean_spectrum(regions.tag_regions(image, REGIONS), BANDS, ("region_id",)).collect()}
    for n, r in REGIONS.items():
        px = members(r)
        if not px:
            assert n not in got
            continue
        want = [np.mean([np.float32(value(ln, s, b)) for ln, s in px], dtype=float) for b in range(BANDS)]
        assert got[n]["spectrum"] == pytest.approx(want, rel=1e-9) and got[n]["pixels"] == len(px)


@pytest.mark.parametrize("stride", [0, 1, 4, 5])
def test_stride(image, stride, monkeypatch):
    for r in (REGIONS["f"], REGIONS["b"]):
        got = [(p["line"], p["sample"]) for p in cubes.sample_pixels(image, stride, SAMPLES, r).collect()]
        assert sorted(got) == members(r)[:: max(stride, 1)]
    whole = [(ln, s) for ln in range(LINES) for s in range(SAMPLES)]
    got = [(p["line"], p["sample"]) for p in cubes.sample_pixels(image, stride, SAMPLES).collect()]
    assert sorted(got) == whole[:: max(stride, 1)]


def test_masked_image_and_ranges(image):
    with pytest.raises(ValueError, match="no pixel centre"):
        regions.mask_region(image, REGIONS["e"], (SAMPLES, LINES))
    sliver = regions.mask_region(image, REGIONS["d"]).withColumn("ch", F.col("spectrum"))
    r = render.channel_ranges(sliver, BANDS, inside=F.col("in_region")).first()
    assert list(r["lo"]) == [0.0] * BANDS and list(r["hi"]) == [0.0] * BANDS


def test_ranges_ignore_nan(spark):
    df = spark.createDataFrame([("c", [1.0, float("nan")]), ("c", [-2.0, float("nan")])], "cube_id string, ch array<float>")
    r = render.channel_ranges(df, 2).first()
    assert (list(r["lo"]), list(r["hi"])) == ([-2.0, 0.0], [1.0, 0.0])


def gradient_kernel(noise):
    n = len(noise)
    return K.Kernel(K.ADAPTED, "s", "r", tuple("abc"[:n]), np.eye(n), np.ones(n), np.full(n, np.inf), np.eye(n), None,
                    np.array(noise), 1.0, True)


@pytest.mark.parametrize("block", [4, 7, 128])
@pytest.mark.parametrize("region", [None, "g"])
def test_edges_match_a_pixel_loop(image, block, region):
    noise = [0.5, 2.0, 1.5]
    r = REGIONS[region] if region else None
    k = gradient_kernel(noise)
    masked = render.render(regions.mask_region(image, r), k)
    got = {(p["line"], p["sample"]): p["magnitude"]
           for p in render.delta_s_gradient(masked, k, inside="in_region", block=block).collect()}
    s0, s1, l0, l1 = regions.pixel_window(r) if r else (0, SAMPLES, 0, LINES)
    keep = {(ln, s) for ln in range(max(l0, 0), min(l1, LINES)) for s in range(s0, min(s1, SAMPLES))}
    assert set(got) == keep

    def ok(p):
        return p in keep and (r is None or inside(r, p[1], p[0]))

    def ds(p, q):
        return sum(((np.float32(value(*p, b)) - float(np.float32(value(*q, b)))) / noise[b]) ** 2 for b in range(3))

    for p in keep:
        total = sum(ds(p, q) for q in ((p[0], p[1] + 1), (p[0] + 1, p[1])) if ok(p) and ok(q))
        assert got[p] == pytest.approx(math.sqrt(total), rel=1e-5)


def test_edges_need_noise_and_adaptation(image):
    k = gradient_kernel([1.0])
    assert render.delta_s_gradient(image, K.Kernel(**{**k.__dict__, "noise": None})) is None
    assert render.delta_s_gradient(image, K.Kernel(**{**k.__dict__, "stage": K.RAW})) is None


def test_ranges_join_spread_over_salts(image):
    ch = image.withColumn("ch", F.col("spectrum"))
    ranges = render.channel_ranges(ch, BANDS)
    joined = display.with_ranges(ch, ranges)
    assert joined.count() == LINES * SAMPLES
    assert joined.select(F.countDistinct("lo")).first()[0] == 1


def test_flat_cube_layouts(spark):
    lines, samples, bands = 2, 3, 4
    cube = np.arange(24.0).reshape(lines, samples, bands)
    forms = {"band": cube.transpose(2, 0, 1).ravel(), "chunky": cube.ravel(), "column": cube.ravel(order="F")}
    for layout, flat in forms.items():
        df = spark.createDataFrame([("c", lines, samples, bands, flat.tolist())], "cube_id string, lines int, samples int, bands int, values array<double>")
        for r in cubes.from_flat(df, layout).collect():
            assert list(r["spectrum"]) == cube[r["line"], r["sample"]].tolist()
    short = spark.createDataFrame([("c", 2, 3, 4, [1.0])], "cube_id string, lines int, samples int, bands int, values array<double>")
    with pytest.raises(Exception, match="one value for every band"):
        cubes.from_flat(short, "band").collect()


@pytest.mark.parametrize("layout", ["band", "chunky", "column"])
@pytest.mark.parametrize("piece,block", [(7, 1), (50, 30), (1000, 64), (13, 10**6)])
def test_cubes_in_pieces(spark, layout, piece, block):
    rng = np.random.default_rng(0)
    want = {f"c{i}": rng.random(shape).astype(np.float32) for i, shape in enumerate([(5, 7, 3), (1, 1, 4), (9, 2, 1)])}  # lines, samples, bands
    rows = []
    for name, cube in want.items():
        flat = {"band": cube.transpose(2, 0, 1).ravel(), "chunky": cube.ravel(), "column": cube.ravel(order="F")}[layout]
        rows += [(name, a, flat[a : a + piece].tolist()) for a in range(0, len(flat), piece)] + [(name, 0, [])]
    sizes = spark.createDataFrame([(n, *c.shape) for n, c in want.items()] + [("none", 2, 2, 2)], "cube_id string, lines int, samples int, bands int")
    pieces = spark.createDataFrame(rows, "cube_id string, offset int, values array<float>")
    got = {(r.cube_id, r.line, r.sample): r.spectrum for r in cubes.from_chunks(pieces, sizes, layout, block_values=block).collect()}
    assert len(got) == sum(c.shape[0] * c.shape[1] for c in want.values())
    assert all(np.array_equal(np.float32(v), want[n][ln, s]) for (n, ln, s), v in got.items())


def test_pieces_must_hold_every_value_once(spark):
    sizes = spark.createDataFrame([(1, 2, 2, 2)], "cube_id int, lines int, samples int, bands int")
    for rows in ([(1, 0, [1.0] * 7)], [(1, 0, [1.0] * 4), (1, 2, [1.0] * 4)], [(1, 4, [1.0] * 8)]):
        with pytest.raises(Exception, match="one value for every band|missing or given twice|outside a cube"):
            cubes.from_chunks(spark.createDataFrame(rows, "cube_id int, offset int, values array<float>"), sizes, "band").collect()
    with pytest.raises(ValueError, match="layout"):
        cubes.from_chunks(spark.createDataFrame(rows, "cube_id int, offset int, values array<float>"), sizes, "rows")


def test_labels_and_axes(spark):
    df = spark.createDataFrame([("/d/My.Scene.HDR", 3, [1.0, 2.0, 3.0]), ("x.TIFF", 2, None), ("/d/raw", 2, [2.0, 2.0])],
                               "path string, bands int, wl array<double>")
    r = df.select(cubes.source_label(F.col("path")).alias("label"), cubes.source_format(F.col("path")).alias("format"),
                  cubes.axis_error(F.col("wl"), F.col("bands")).alias("error"),
                  cubes.describe_cube(F.lit("L"), F.col("bands"), F.col("wl")).alias("text")).collect()
    assert [x["label"] for x in r] == ["My.Scene", "x", "raw"] and [x["format"] for x in r] == ["envi", "geotiff", "envi"]
    assert [x["error"] for x in r] == [None, "missing", "not increasing"]
    assert [x["text"] for x in r][:2] == ["L · 3 bands @ 1–3 nm", "L · 2 bands (no wavelength axis)"]
    wl, sorted_df = cubes.sort_bands(spark.createDataFrame([([1.0, 2.0, 3.0],)], "spectrum array<float>"), [500.0, 700.0, 600.0])
    assert wl == [500.0, 600.0, 700.0] and list(sorted_df.first()[0]) == [1.0, 3.0, 2.0]


def test_colours(spark):
    t = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.25, 0.5, 0.9, 1.0, 2.0)], "t double").withColumn("t", F.col("t").cast("float"))
    rows = t.select(F.array(*color.viridis(F.col("t"))).alias("v"), F.array(*color.blue(F.col("t"))).alias("b"),
                    F.array(*color.grayscale(F.col("t"))).alias("g")).collect()
    assert rows[0]["v"] == list(C.VIRIDIS[0]) == rows[1]["v"] and rows[2]["v"] == list(C.VIRIDIS[1]) and rows[5]["v"] == list(C.VIRIDIS[4])
    assert rows[1]["b"] == [20, 30, 60] and rows[6]["b"] == [200, 220, 255] and rows[3]["g"] == [128, 128, 128]
    flat = spark.range(1).select(*[F.lit(v).cast("float").alias(n) for v, n in ((3.0, "v"), (3.0, "lo"), (3.0, "hi"))])
    u, o = flat.select(color.normalize_unit(F.col("v"), F.col("lo"), F.col("hi")), color.normalize_opponent(F.col("v"), F.col("lo"), F.col("hi"))).first()
    assert (u, o) == (0.0, -1.0)
    g = spark.createDataFrame([(w,) for w in (150.0, 379.999, 380.0, 700.0, 700.001, 1200.0)], "wl double")
    c = [list(r) for r in g.select(*color.wavelength_rgb(F.col("wl"))).collect()]
    assert c[0] == [1.0, 1.0, 1.0] and c[5] == [0.0, 0.0, 0.0]
    assert c[1] == pytest.approx(c[2], abs=1e-4) and c[3] == pytest.approx(c[4], abs=1e-4)


def test_regional_means_with_null_and_integer_keys(spark):
    rows = [(1, None, [1.0, 3.0]), (1, None, [3.0, 5.0]), (2, "a", [4.0, 4.0]), (None, "a", None), (None, None, [7.0, 9.0])]
    df = spark.createDataFrame(rows, "cube_id int, region_id string, spectrum array<double>")
    got = {(r.cube_id, r.region_id): (r.spectrum, r.pixels) for r in regions.mean_spectrum(df, 2).collect()}
    assert got == {(1, None): ([2.0, 4.0], 2), (2, "a"): ([4.0, 4.0], 1), (None, None): ([7.0, 9.0], 1)}
    empty = df.where("spectrum is null").repartition(1)
    assert regions.mean_spectrum(empty, 2).count() == 0


def test_pixel_curves_without_an_axis(spark, image):
    none, some = (cubes.pixel_curves(image, wl, "s", "b") for wl in (None, [float(i) for i in range(BANDS)]))
    assert none.count() == 0 and none.columns == some.columns
