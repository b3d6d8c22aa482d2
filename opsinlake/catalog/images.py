"""Image queries: rendering, ranges, colours, edges, regions, sampling."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsinlake import constants as C
from opsinlake.catalog.base import (
    AXIS, BANDS, PIXELS, SAMPLES, SOLAR, UNIFORM, f32, kernel_sql, num, pixels, query, rnd, rsql, table,
)
from opsinlake.operators import cubes, display, regions, render, spans
from opsinlake.plans import kernel as K
from opsinlake.plans.systems import VisualSystem, builtin
from opsinlake.session import shared_folder
from opsinlake.sources import envi, presets

KEEP = "vec_id, line, sample"

# Named regions in the 25-sample image, with lines in twentieths of its height: ordinary, reversed, off the grid, below a
# pixel, and polygons.
REGIONS = {
    "centre": regions.rectangle(5, 3, 18, 15),
    "reversed": regions.rectangle(20, 12, 2, 4),
    "overhang": regions.rectangle(-6, -6, 4.5, 9.25),
    "sliver": regions.rectangle(7.2, 2.0, 7.9, 9.0),
    "triangle": regions.polygon((1, 1), (22, 4), (9, 18)),
    "diamond": regions.polygon((12, 0), (22, 9), (12, 19), (3, 9)),
    "notch": regions.polygon((2, 2), (23, 2), (23, 17), (12.5, 6), (2, 17)),
}


HEIGHT = f"(SELECT CAST(max(vec_id) // {SAMPLES} + 1 AS DOUBLE) FROM embeddings)"


def height(spark, sf) -> int:
    """Lines of the image."""
    return pixels(spark, sf).agg(F.max("line")).first()[0] + 1


def stretched(spark, sf) -> dict[str, regions.Region]:
    """The named regions over the whole height of the image."""
    h = float(height(spark, sf))
    return {n: regions.Region(r.kind, tuple((x, y * h / 20) for x, y in r.vertices)) for n, r in REGIONS.items()}


def _tall(y: float) -> str:
    return f"({num(y)} * {HEIGHT} / 20)"


@lru_cache(maxsize=None)
def human(stage: str, light: str = "solar") -> K.Kernel:
    return K.compile_regime(builtin("Human"), 0, AXIS, SOLAR if light == "solar" else UNIFORM, stage=stage)


@lru_cache(maxsize=None)
def capped_bee() -> K.Kernel:
    """A honeybee whose receptors saturate, looking at radiance under an adapted stage."""
    bee = builtin("Honeybee")
    pool = tuple(replace(r, saturation=c) for r, c in zip(bee.pool, (0.5, None, 2.0)))
    capped = VisualSystem(bee.name, pool, bee.regimes)
    return K.compile_regime(capped, 0, AXIS, UNIFORM, K.RADIANCE, K.ADAPTED)


@lru_cache(maxsize=None)
def frog_kernels() -> tuple:
    return tuple(K.compile_all(builtin("Frog"), AXIS, UNIFORM * [1, 1e-4], stage=K.PERCEPTUAL))


def _spread(df, n, prefix="c", digits=5):
    return df.select("vec_id", "line", "sample", *[rnd(F.col("ch")[i], digits).alias(f"{prefix}{i}") for i in range(n)])


def _spread_sql(text, n, prefix="c", digits=5):
    cols = ", ".join(f"{rsql(f32(f'ch[{i + 1}]'), digits)} AS {prefix}{i}" for i in range(n))
    return f"SELECT {KEEP}, {cols} FROM ({text})"


def _kernel_sql(k):
    return _spread_sql(kernel_sql(k, "px", PIXELS, KEEP), k.channels)


@query(lambda: _kernel_sql(human(K.RAW)))
def render_raw_human(spark, sf):
    k = human(K.RAW)
    return _spread(render.render(pixels(spark, sf), k), k.channels)


@query(lambda: _kernel_sql(human(K.ADAPTED)))
def render_adapted_human(spark, sf):
    k = human(K.ADAPTED)
    return _spread(render.render(pixels(spark, sf), k), k.channels)


@query(lambda: _kernel_sql(human(K.PERCEPTUAL)))
def render_perceptual_human(spark, sf):
    k = human(K.PERCEPTUAL)
    return _spread(render.render(pixels(spark, sf), k), k.channels)


@query(lambda: _kernel_sql(human(K.PERCEPTUAL)))
def render_perceptual_native(spark, sf):
    """The same picture from array functions only."""
    k = human(K.PERCEPTUAL)
    return _spread(render.render(pixels(spark, sf), k, engine="native"), k.channels)


@lru_cache(maxsize=None)
def mantis() -> K.Kernel:
    return K.compile_pool(builtin("Mantis"), AXIS, SOLAR)


@query(lambda: _kernel_sql(mantis()))
def render_pool_mantis(spark, sf):
    k = mantis()
    return _spread(render.render(pixels(spark, sf), k), k.channels)


@query(lambda: _kernel_sql(capped_bee()))
def render_capped_honeybee(spark, sf):
    k = capped_bee()
    return _spread(render.render(pixels(spark, sf), k), k.channels)


def _frog_sql():
    parts, cols, at = [], [], 0
    for i, k in enumerate(frog_kernels()):
        parts.append(f"t{i} AS ({kernel_sql(k, 'px', PIXELS, KEEP)})")
        for c in range(k.channels):
            cols.append(f"{rsql(f32(f't{i}.ch[{c + 1}]'), 4)} AS c{at}")
            at += 1
    return (
        f"WITH {', '.join(parts)} SELECT t0.vec_id, t0.line, t0.sample, {', '.join(cols)} "
        "FROM t0 JOIN t1 USING (vec_id) JOIN t2 USING (vec_id)"
    )


@query(_frog_sql)
def render_all_regimes_frog(spark, sf):
    ks = list(frog_kernels())
    return _spread(render.render(pixels(spark, sf), ks), sum(k.channels for k in ks), digits=4)


# ------------------------------------------------------------------ ranges and colours


def _channels_sql(k):
    text = kernel_sql(k, "px", PIXELS, KEEP)
    cols = ", ".join(f"{f32(f'ch[{i + 1}]')} AS c{i}" for i in range(k.channels))
    return f"SELECT {KEEP}, {cols} FROM ({text})"


def _ranges_sql():
    k = human(K.PERCEPTUAL)
    cols = ", ".join(
        f"{rsql(f'min(c{i})', 5)} AS lo{i}, {rsql(f'max(c{i})', 5)} AS hi{i}" for i in range(k.channels)
    )
    return f"SELECT 'embeddings' AS cube_id, {cols} FROM ({_channels_sql(k)})"


@query(_ranges_sql)
def channel_ranges(spark, sf):
    k = human(K.PERCEPTUAL)
    r = render.channel_ranges(render.render(pixels(spark, sf), k), k.channels)
    cols = []
    for i in range(k.channels):
        cols += [rnd(F.col("lo")[i], 5).alias(f"lo{i}"), rnd(F.col("hi")[i], 5).alias(f"hi{i}")]
    return r.select("cube_id", *cols)


def _ranged(spark, sf, stage=K.PERCEPTUAL):
    k = human(stage)
    ch = render.render(pixels(spark, sf), k)
    return display.with_ranges(ch, render.channel_ranges(ch, k.channels)), k


def _unit_sql(i):
    span = f"greatest(h{i} - l{i}, {f32(num(C.F32_TINY))})"
    return f"greatest({f32('0')}, least({f32('1')}, {f32(f'(c{i} - l{i}) / {span}')}))"


def _opp_sql(i):
    span = f"greatest(h{i} - l{i}, {f32(num(C.F32_TINY))})"
    return f"{f32(f'(c{i} - l{i}) / {span}')} * {f32('2')} - {f32('1')}"


def _ranged_sql(k):
    r = ", ".join(f"min(c{i}) OVER () AS l{i}, max(c{i}) OVER () AS h{i}" for i in range(k.channels))
    return f"SELECT *, {r} FROM ({_channels_sql(k)})"


def _byte_sql(v):
    return f"CAST(floor({f32(f'greatest({f32(0)}, least({f32(1)}, {v})) * {f32(255)}')} + {f32(0.5)}) AS BIGINT)"


def _normalized_sql():
    k = human(K.PERCEPTUAL)
    cols = ", ".join(f"{rsql(_unit_sql(i), 5)} AS n{i}" for i in range(k.channels))
    return f"SELECT {KEEP}, {cols} FROM ({_ranged_sql(k)})"


@query(_normalized_sql)
def normalized_channels(spark, sf):
    df, k = _ranged(spark, sf)
    return df.select("vec_id", "line", "sample", *[rnd(display.normalized(i), 5).alias(f"n{i}") for i in range(k.channels)])


def _rgb(df, cols, keep=("vec_id", "line", "sample")):
    return df.select(*keep, *[c.cast("long").alias(n) for c, n in zip(cols, "rgb")])


def _lab_sql():
    k = human(K.PERCEPTUAL)
    one = f32("1")
    inner = (
        f"SELECT {KEEP}, {_unit_sql(0)} AS l, greatest(-{one}, least({one}, {_opp_sql(1)})) AS a, "
        f"greatest(-{one}, least({one}, {_opp_sql(2)})) AS b FROM ({_ranged_sql(k)})"
    )
    cols = []
    for name, (x, y, z) in zip("rgb", C.OPPONENT_RGB):
        v = f"l * {f32(x)} + a * {f32(y)} + b * {f32(z)}"
        cols.append(f"{_byte_sql(v)} AS {name}")
    return f"SELECT {KEEP}, {', '.join(cols)} FROM ({inner})"


@query(_lab_sql)
def composite_lab(spark, sf):
    df, k = _ranged(spark, sf)
    return _rgb(df, display.perceptual_rgb(k.channels))


def _rgb_sql():
    k = human(K.RAW)
    cols = ", ".join(f"{_byte_sql(_unit_sql(i))} AS {n}" for n, i in zip("rgb", (2, 1, 0)))
    return f"SELECT {KEEP}, {cols} FROM ({_ranged_sql(k)})"


@query(_rgb_sql)
def composite_rgb(spark, sf):
    df, k = _ranged(spark, sf, K.RAW)
    return _rgb(df, display.three_channel_rgb(k.channels, 2, 1, 0))


def _viridis_sql(t):
    out = []
    for ch, name in enumerate("rgb"):
        stops = [a[ch] for a in C.VIRIDIS]
        cases = " ".join(
            f"WHEN {t} <= {f32(0.25 * (i + 1))} THEN {f32(a)} + {f32(b - a)} * (({t} - {f32(0.25 * i)}) * {f32(4)})"
            for i, (a, b) in enumerate(zip(stops, stops[1:]))
        )
        out.append(f"CAST(floor(CASE {cases} END + {f32(0.5)}) AS BIGINT) AS {name}")
    return ", ".join(out)


def _colormap_sql():
    k = human(K.PERCEPTUAL)
    blue = ", ".join(
        f"CAST(floor({f32(f't * {f32(s)}')} + {f32(b)}) AS BIGINT) AS blue_{n}" for n, (b, s) in zip("rgb", C.BLUE_RAMP)
    )
    return (
        f"SELECT {KEEP}, {_viridis_sql('t')}, {_byte_sql('t')} AS gray, {blue} "
        f"FROM (SELECT {KEEP}, {_unit_sql(0)} AS t FROM ({_ranged_sql(k)}))"
    )


@query(_colormap_sql)
def channel_colormaps(spark, sf):
    df, _ = _ranged(spark, sf)
    v, g, b = (display.channel_rgb(0, m) for m in ("viridis", "grayscale", "blue"))
    named = [c.cast("long").alias(n) for c, n in zip([*v, g[0], *b], ["r", "g", "b", "gray", "blue_r", "blue_g", "blue_b"])]
    return df.select("vec_id", "line", "sample", *named)


def _preview_sql():
    t = f"{f32(f'{f32('v')} - lo')} / greatest({f32('hi - lo')}, {f32(1e-6)})"
    return (
        f"SELECT line, sample, {_byte_sql(t)} AS gray FROM (SELECT line, sample, {f32('px[13]')} AS v, "
        f"min({f32('px[13]')}) OVER () AS lo, max({f32('px[13]')}) OVER () AS hi FROM ({PIXELS}))"
    )


@query(_preview_sql)
def band_preview(spark, sf):
    df = display.band_preview(pixels(spark, sf), 12)
    return df.select("line", "sample", F.col("gray").cast("long").alias("gray"))


# ------------------------------------------------------------------ edges


def _edge_sql(k, member="TRUE"):
    """ΔS to the right and lower neighbour by looking up their position."""
    n = k.channels
    rows = f"SELECT *, {member} AS ok FROM ({_channels_sql(k)})"

    def side(alias):
        terms = " + ".join(
            f"((CAST(p.c{i} AS DOUBLE) - CAST({alias}.c{i} AS DOUBLE)) / {num(e)}) ** 2" for i, e in enumerate(k.noise)
        )
        return f"CASE WHEN p.ok AND coalesce({alias}.ok, FALSE) THEN {terms} ELSE 0.0 END"

    assert n == len(k.noise)
    return (
        f"WITH t AS ({rows}) SELECT p.vec_id, p.line, p.sample, {f32(f'sqrt({side("r")} + {side("d")})')} AS g "
        "FROM t p LEFT JOIN t r ON r.line = p.line AND r.sample = p.sample + 1 "
        "LEFT JOIN t d ON d.line = p.line + 1 AND d.sample = p.sample"
    )


def _gradient_sql():
    return f"SELECT {KEEP}, {rsql('g', 4)} AS magnitude FROM ({_edge_sql(human(K.ADAPTED))})"


@query(_gradient_sql)
def delta_s_gradient(spark, sf):
    k = human(K.ADAPTED)
    g = render.delta_s_gradient(render.render(pixels(spark, sf), k), k, keys=(), block=8)
    return g.select("vec_id", "line", "sample", rnd("magnitude", 4).alias("magnitude"))


def region_sql(r, x="(sample + 0.5)", y="(line + 0.5)") -> str:
    """Containment of the pixel centre in a stretched region, edge by edge."""
    if r.kind == "rectangle":
        x0, y0, x1, y1 = r.bounds
        return f"({x} >= {num(x0)} AND {x} < {num(x1)} AND {y} >= {_tall(y0)} AND {y} < {_tall(y1)})"
    v, terms = r.vertices, []
    for i in range(len(v)):
        (xi, yi), (xj, yj) = v[i], v[i - 1]
        if yi == yj:
            continue
        cut = f"({num(xj)} - {num(xi)}) * ({y} - {_tall(yi)}) / ({_tall(yj)} - {_tall(yi)}) + {num(xi)}"
        terms.append(f"CASE WHEN ({_tall(yi)} > {y}) <> ({_tall(yj)} > {y}) AND {x} < {cut} THEN 1 ELSE 0 END")
    return f"(({' + '.join(terms)}) % 2 = 1)"


def _window_sql(r) -> str:
    x0, y0, x1, y1 = r.bounds
    edge = [f"floor(greatest({v}, 0.0))" for v in (f"{num(x0)} - 0.5", f"{num(x1)} + 0.5", f"{_tall(y0)} - 0.5", f"{_tall(y1)} + 0.5")]
    return f"sample >= {edge[0]} AND sample < {edge[1]} AND line >= {edge[2]} AND line < {edge[3]}"


def _region_gradient_sql():
    r = REGIONS["diamond"]
    text = _edge_sql(human(K.ADAPTED), region_sql(r))
    return f"SELECT {KEEP}, {rsql('g', 4)} AS magnitude FROM ({text}) WHERE {_window_sql(r)}"


@query(_region_gradient_sql)
def delta_s_gradient_region(spark, sf):
    k, r = human(K.ADAPTED), stretched(spark, sf)["diamond"]
    masked = regions.mask_region(pixels(spark, sf), r)
    g = render.delta_s_gradient(render.render(masked, k), k, keys=(), inside="in_region", block=8)
    return g.select("vec_id", "line", "sample", rnd("magnitude", 4).alias("magnitude"))


def _gradient_color_sql():
    t = f"greatest({f32(0)}, least({f32(1)}, {f32(f'(g - lo) / greatest(hi - lo, {f32(num(C.F32_TINY))})')}))"
    inner = f"SELECT *, min(g) OVER () AS lo, max(g) OVER () AS hi FROM ({_edge_sql(human(K.ADAPTED))})"
    return f"SELECT {KEEP}, {_viridis_sql('t')} FROM (SELECT {KEEP}, {t} AS t FROM ({inner}))"


@query(_gradient_color_sql)
def gradient_colors(spark, sf):
    k = human(K.ADAPTED)
    g = render.delta_s_gradient(render.render(pixels(spark, sf), k), k, keys=(), block=8)
    span = g.agg(F.min("magnitude").alias("lo"), F.max("magnitude").alias("hi"))
    df = display.with_ranges(g, span, keys=())
    return _rgb(df, display.gradient_rgb(F.col("magnitude"), F.col("lo"), F.col("hi")))


# ------------------------------------------------------------------ regions and sampling


def _region_means_sql():
    parts = [
        f"SELECT '{n}' AS region_id, i AS band, px[i + 1] AS v FROM ({PIXELS}), range({BANDS}) t(i) WHERE {region_sql(r)}"
        for n, r in REGIONS.items()
    ]
    return (
        f"SELECT region_id, CAST(band AS BIGINT) AS band, {rsql('avg(v)')} AS mean, count(*) AS pixels "
        f"FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"
    )


def region_means(spark, sf):
    """Mean spectra of the named regions (``region_id, spectrum, pixels``)."""
    tagged = regions.tag_regions(pixels(spark, sf), stretched(spark, sf))
    return regions.mean_spectrum(tagged, BANDS, keys=("region_id",))


@query(_region_means_sql)
def region_mean_spectra(spark, sf):
    m = region_means(spark, sf).select("region_id", "pixels", F.posexplode("spectrum").alias("band", "v"))
    return m.select("region_id", F.col("band").cast("long").alias("band"), rnd("v").alias("mean"), "pixels")


def supplier_regions(spark, sf):
    """One region per supplier, scattered over all lines of the image: every third a triangle."""
    s = table(spark, sf, "supplier")
    x, y = (F.col("s_suppkey") * 7) % 20, (F.col("s_suppkey") * 13) % F.lit(height(spark, sf))
    w, h = 3 + F.col("s_nationkey") % 9, 2 + F.col("s_suppkey") % 11

    def v(a, b):
        return F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))

    rect = F.array(v(x + w, y), v(x, y + h))
    tri = F.array(v(x, y), v(x + w + 1.5, y + 1), v(x + 1, y + h + 0.75))
    poly = F.col("s_suppkey") % 3 == 0
    return s.select(
        F.lit("embeddings").alias("cube_id"), F.col("s_suppkey").alias("region_id"),
        F.when(poly, F.lit("polygon")).otherwise(F.lit("rectangle")).alias("kind"),
        F.when(poly, tri).otherwise(rect).alias("vertices"),
    )


_SUPPLIER_REGIONS = f"""SELECT s_suppkey AS region_id, s_suppkey % 3 = 0 AS poly,
    CAST((s_suppkey * 7) % 20 AS DOUBLE) AS x, CAST((s_suppkey * 13) % CAST({HEIGHT} AS BIGINT) AS DOUBLE) AS y,
    CAST(3 + s_nationkey % 9 AS DOUBLE) AS w, CAST(2 + s_suppkey % 11 AS DOUBLE) AS h FROM supplier"""


def _edge_case(ax, ay, bx, by):
    px, py = "(sample + 0.5)", "(line + 0.5)"
    cut = f"(({bx}) - ({ax})) * ({py} - ({ay})) / nullif(({by}) - ({ay}), 0) + ({ax})"
    return f"CASE WHEN (({ay}) > {py}) <> (({by}) > {py}) AND {px} < {cut} THEN 1 ELSE 0 END"


def _join_many_sql():
    a, b, c = ("x", "y"), ("x + w + 1.5", "y + 1"), ("x + 1", "y + h + 0.75")
    parity = " + ".join(_edge_case(*p, *q) for p, q in ((a, c), (b, a), (c, b)))
    hit = (
        f"CASE WHEN poly THEN ({parity}) % 2 = 1 ELSE sample + 0.5 >= x AND sample + 0.5 < x + w "
        "AND line + 0.5 >= y AND line + 0.5 < y + h END"
    )
    return (
        f"SELECT region_id, count(*) AS pixels, min(vec_id) AS first_pixel, {rsql('avg(px[33])')} AS mean_560 "
        f"FROM ({PIXELS}), ({_SUPPLIER_REGIONS}) WHERE {hit} GROUP BY region_id"
    )


@query(_join_many_sql)
def region_join_many(spark, sf):
    at_560 = pixels(spark, sf).select("cube_id", "vec_id", "line", "sample", F.col("spectrum")[32].cast("double").alias("v"))
    hit = regions.match_regions(at_560, supplier_regions(spark, sf))
    return hit.groupBy("region_id").agg(F.count(F.lit(1)).alias("pixels"), F.min("vec_id").alias("first_pixel"), rnd(F.avg("v")).alias("mean_560"))


def _region_labels_sql():
    area = (
        "CASE WHEN poly THEN greatest(w + 1.5, 1) * greatest(h + 0.75, 1) ELSE w * h END"
    )
    return (
        "SELECT region_id, CASE WHEN poly THEN 'polygon (3 vertices)' ELSE "
        "printf('rect (%.0f,%.0f)-(%.0f,%.0f)', x + w, y, x, y + h) END AS label, "
        f"CAST(floor({area} + 0.5) AS BIGINT) AS estimate, x AS x_min, y AS y_min, "
        "CASE WHEN poly THEN x + w + 1.5 ELSE x + w END AS x_max, "
        f"CASE WHEN poly THEN greatest(y + h + 0.75, y + 1) ELSE y + h END AS y_max FROM ({_SUPPLIER_REGIONS})"
    )


@query(_region_labels_sql)
def region_labels(spark, sf):
    r = supplier_regions(spark, sf)
    x0, y0, x1, y1 = regions.table_bounds(F.col("vertices"))
    return r.select(
        "region_id", regions.region_label(F.col("kind"), F.col("vertices")).alias("label"),
        regions.estimated_pixels(F.col("kind"), F.col("vertices")).alias("estimate"),
        x0.alias("x_min"), y0.alias("y_min"), x1.alias("x_max"), y1.alias("y_max"),
    )


def _mask_sql():
    r = REGIONS["notch"]
    return f"SELECT {KEEP}, CAST({region_sql(r)} AS BIGINT) AS inside FROM ({PIXELS}) WHERE {_window_sql(r)}"


@query(_mask_sql)
def region_mask(spark, sf):
    m = regions.mask_region(pixels(spark, sf), stretched(spark, sf)["notch"])
    return m.select("vec_id", "line", "sample", F.col("in_region").cast("long").alias("inside"))


@query(
    lambda: f"WITH first AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL) "
    "SELECT user_id, event_type AS name, event_id AS version, value AS x0 FROM first JOIN events "
    "USING (user_id, event_type, event_id)"
)
def latest_regions(spark, sf):
    """Regions saved again under a name: a user is an image, an event type a name, the event id its version."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("cube_id"), F.col("event_type").alias("name"), F.col("event_id").alias("version"),
        F.col("value").alias("x0"),
    )
    return regions.latest_regions(e).select(F.col("cube_id").alias("user_id"), "name", "version", "x0")


@query(lambda: f"SELECT {KEEP}, {rsql('px[1]')} AS first_band FROM ({PIXELS}) WHERE (line * {SAMPLES} + sample) % 7 = 0")
def stride_pixels(spark, sf):
    kept = cubes.sample_pixels(pixels(spark, sf), 7, SAMPLES)
    return kept.select("vec_id", "line", "sample", rnd(F.col("spectrum")[0]).alias("first_band"))


@query(
    lambda: f"SELECT {KEEP} FROM (SELECT {KEEP}, row_number() OVER (ORDER BY line, sample) - 1 AS k FROM ({PIXELS}) "
    f"WHERE {region_sql(REGIONS['notch'])}) WHERE k % 5 = 0"
)
def stride_pixels_region(spark, sf):
    """Every fifth pixel of a polygon that spans the height of the image."""
    return cubes.sample_pixels(pixels(spark, sf), 5, SAMPLES, stretched(spark, sf)["notch"]).select("vec_id", "line", "sample")


def _places_sql():
    return " UNION ALL ".join(
        f"SELECT '{n}' AS region_id, vec_id, row_number() OVER (ORDER BY line, sample) - 1 AS place FROM ({PIXELS}) WHERE {region_sql(r)}" for n, r in REGIONS.items())


@query(_places_sql)
def region_places(spark, sf):
    """Every pixel of every named region with its number inside the region, from runs on image lines."""
    runs = spans.region_spans(regions.region_table(spark, stretched(spark, sf)), SAMPLES, keys=("region_id",))
    return spans.on_spans(pixels(spark, sf), runs, ()).select("region_id", "vec_id", "place")


@query(lambda: f"SELECT line, sample, {rsql('px[21]')} AS value FROM ({PIXELS})")
def band_slice(spark, sf):
    return cubes.band_slice(pixels(spark, sf), 20).select("line", "sample", rnd("value").alias("value"))


@query(
    lambda: f"SELECT vec_id, 'embeddings — pixel (' || line || ',' || sample || ')' AS name, 'Radiance' AS kind, "
    f"'relative' AS unit, 'embeddings/whole image' AS batch, CAST({len(AXIS)} AS BIGINT) AS knots, 400.0 AS first_nm, "
    f"{rsql('px[1]')} AS first_value FROM ({PIXELS})"
)
def pixel_curves(spark, sf):
    c = cubes.import_pixels(pixels(spark, sf), AXIS, "embeddings", SAMPLES)
    return c.select(
        "vec_id", "name", F.col("quantity.kind").alias("kind"), F.col("quantity.unit").alias("unit"),
        F.element_at("metadata", "batch").alias("batch"), F.size("points").cast("long").alias("knots"),
        F.col("points")[0]["wl"].alias("first_nm"), rnd(F.col("points")[0]["v"]).alias("first_value"),
    )


def _label_sql(r) -> str:
    if r.kind != "rectangle":
        return f"'{r.label}'"
    (x0, y0), (x1, y1) = r.vertices
    return f"printf('rect (%.0f,%.0f)-(%.0f,%.0f)', {num(x0)}, {_tall(y0)}, {num(x1)}, {_tall(y1)})"


def _region_curves_sql():
    parts = [
        f"SELECT 'embeddings — ' || {_label_sql(r)} AS name, 'Reflectance' AS kind, "
        f"'Extracted from \"embeddings\", region ' || {_label_sql(r)} AS source, {rsql('avg(px[64])')} AS last_value "
        f"FROM ({PIXELS}) WHERE {region_sql(r)} HAVING count(*) > 0"
        for r in REGIONS.values()
    ]
    return " UNION ALL ".join(parts)


@query(_region_curves_sql)
def region_curves(spark, sf):
    label = F.lit(None).cast("string")
    for n, r in stretched(spark, sf).items():
        label = F.when(F.col("region_id") == n, F.lit(r.label)).otherwise(label)
    c = cubes.region_curves(region_means(spark, sf), AXIS, "embeddings", label)
    return c.select(
        "name", F.col("quantity.kind").alias("kind"), F.element_at("metadata", "source").alias("source"),
        rnd(F.element_at("points", -1)["v"]).alias("last_value"),
    )


def _flat_sql():
    forms = {"band": "p + 16 * {b}", "chunky": "p * 4 + {b}", "column": "(p // 4) + (p % 4) * 4 + 16 * {b}"}
    parts = []
    for layout, form in forms.items():
        bands = ", ".join(f"{rsql(f'embedding[{form.format(b=b)} + 1]')} AS b{b}" for b in range(4))
        parts.append(f"SELECT vec_id AS cube_id, '{layout}' AS layout, p // 4 AS line, p % 4 AS sample, {bands} "
                     "FROM embeddings, range(16) t(p)")
    return " UNION ALL ".join(parts)


@query(_flat_sql)
def flat_cubes(spark, sf):
    """Each embedding as a 4 x 4 x 4 cube in the three flat layouts."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("cube_id"), F.lit(4).alias("lines"), F.lit(4).alias("samples"), F.lit(4).alias("bands"),
        F.col("embedding").alias("values"),
    )
    out = None
    for layout in ("band", "chunky", "column"):
        part = cubes.from_flat(e, layout).select(
            "cube_id", F.lit(layout).alias("layout"), "line", "sample",
            *[rnd(F.col("spectrum")[b]).alias(f"b{b}") for b in range(4)],
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(lambda: f"SELECT 'c' || vec_id // 100 AS cube_id, vec_id, (row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1) AS line, {rsql('embedding[1]')} AS first_band, {rsql('embedding[64]')} AS last_band FROM embeddings")
def envi_scan(spark, sf):
    """Embeddings written as cubes of a hundred pixels in the three cell orders, then found and read back from their headers. The
    files lie in the folder that driver and executors share."""
    folder = f"{shared_folder(spark)}/envi-{uuid.uuid4().hex}"
    nth = F.row_number().over(Window.partitionBy("cube").orderBy("vec_id")) - 1
    e = table(spark, sf, "embeddings").select("vec_id", F.expr("vec_id div 100").alias("cube"), F.col("embedding").alias("spectrum"))
    e = e.select("vec_id", "cube", F.concat(F.lit("c"), F.col("cube").cast("string")).alias("cube_id"), nth.cast("long").alias("line"), F.lit(0).cast("long").alias("sample"), "spectrum")
    for k, order in enumerate(("bsq", "bil", "bip")):
        envi.write_cubes(e.where(F.col("cube") % 3 == k).drop("vec_id", "cube"), folder, order).count()
    found = envi.scan(envi.cube_table(spark, folder))
    named = e.select("cube_id", "line", "vec_id")
    return found.join(named, ["cube_id", "line"]).select("cube_id", "vec_id", "line", rnd(F.col("spectrum")[0]).alias("first_band"), rnd(F.col("spectrum")[63]).alias("last_band"))


_VARIABLES = """SELECT l_orderkey AS file, 'v' || l_partkey AS name, l_partkey * 100000 + l_suppkey AS pos,
    CASE WHEN l_returnflag = 'A' THEN [l_linenumber, 4, l_suppkey % 4 + 1]
         WHEN l_returnflag = 'N' THEN [1, l_partkey % 4 + 1] ELSE [l_suppkey % 4 + 1, 1] END AS shape FROM lineitem"""


def _chunked_sql():
    at = {"band": ("f // (lines * 4)", "f % (lines * 4) // 4", "f % 4"), "chunky": ("f % 4", "f // 16", "f // 4 % 4"),
          "column": ("f // (lines * 4)", "f % lines", "f % (lines * 4) // lines")}
    flat = """SELECT vec_id // 20 AS cube_id, 4 * count(*) OVER w AS lines, 64 * (row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) - 1) AS first, embedding
        FROM embeddings WINDOW w AS (PARTITION BY vec_id // 20)"""
    long = f"SELECT cube_id, lines, first + i AS f, v FROM (SELECT cube_id, lines, first, unnest(range(64)) AS i, unnest(embedding) AS v FROM ({flat}))"
    bands = ", ".join(f"{rsql(f'max(v) FILTER (band = {b})')} AS b{b}" for b in range(4))
    return " UNION ALL ".join(f"SELECT cube_id, '{name}' AS layout, line, sample, {bands} FROM (SELECT cube_id, {b} AS band, {l} AS line, {s} AS sample, v FROM ({long})) "
                              "GROUP BY cube_id, line, sample" for name, (b, l, s) in at.items())


@query(_chunked_sql)
def flat_cubes_chunked(spark, sf):
    """Cubes of twenty embeddings each, given in pieces of one embedding, in all three layouts."""
    e = table(spark, sf, "embeddings").select(F.expr("vec_id div 20").alias("cube_id"), "vec_id", F.col("embedding").alias("values"))
    nth = F.row_number().over(Window.partitionBy("cube_id").orderBy("vec_id"))
    pieces = e.withColumn("offset", 64 * (nth - 1)).drop("vec_id")
    sizes = e.groupBy("cube_id").agg((4 * F.count("*")).alias("lines")).withColumns({"samples": F.lit(4), "bands": F.lit(4)})
    out = None
    for layout in ("band", "chunky", "column"):
        part = cubes.from_chunks(pieces, sizes, layout, block_values=256).select(
            "cube_id", F.lit(layout).alias("layout"), "line", "sample", *[rnd(F.col("spectrum")[b]).alias(f"b{b}") for b in range(4)])
        out = part if out is None else out.unionByName(part)
    return out


@query(
    lambda: f"""WITH v AS ({_VARIABLES}),
    u AS (SELECT *, row_number() OVER (PARTITION BY file, len(shape) ORDER BY pos) AS rn FROM v),
    c AS (SELECT file, name, shape[3] AS bands FROM u WHERE len(shape) = 3 AND rn = 1),
    w AS (SELECT v.file, arg_min(v.name, v.pos) AS name FROM v JOIN c USING (file) WHERE len(shape) = 2
          AND ((shape[1] = 1 AND shape[2] = bands) OR (shape[2] = 1 AND shape[1] = bands)) GROUP BY v.file)
    SELECT f.file, c.name AS cube_name, w.name AS wavelength_name
    FROM (SELECT DISTINCT file FROM v) f LEFT JOIN c USING (file) LEFT JOIN w USING (file)"""
)
def array_roles(spark, sf):
    """Which line item of an order would be its cube and which its axis, by array shape."""
    li = table(spark, sf, "lineitem")
    n = F.col("l_suppkey") % 4 + 1
    shape = (
        F.when(F.col("l_returnflag") == "A", F.array(F.col("l_linenumber").cast("long"), F.lit(4).cast("long"), n))
        .when(F.col("l_returnflag") == "N", F.array(F.lit(1).cast("long"), F.col("l_partkey") % 4 + 1))
        .otherwise(F.array(n, F.lit(1).cast("long")))
    )
    variables = li.select(
        F.col("l_orderkey").alias("file"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("name"),
        shape.alias("shape"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("pos"),
    )
    return cubes.guess_roles(variables)


@query(
    lambda: """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN bands <> 9 THEN 'count mismatch' END
        ELSE CASE WHEN bands <> 13 THEN 'count mismatch' END END AS axis_error,
        CASE WHEN s_suppkey % 2 = 0 AND bands = 9 THEN 'not increasing'
             WHEN s_suppkey % 2 = 1 AND bands = 13 THEN NULL ELSE 'missing' END AS render_error,
        'S' || s_suppkey || ' · ' || bands || CASE WHEN s_suppkey % 2 = 0 AND bands = 9 THEN ' bands @ 443–590 nm'
             WHEN s_suppkey % 2 = 1 AND bands = 13 THEN ' bands @ 443–2190 nm' ELSE ' bands (no wavelength axis)' END
             AS description
        FROM (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 13 ELSE 7 END AS bands FROM supplier)"""
)
def sensor_axes(spark, sf):
    """A sensor preset applied to one cube per supplier."""
    s = table(spark, sf, "supplier")
    bands = F.when(s.s_nationkey % 3 == 0, 9).when(s.s_nationkey % 3 == 1, 13).otherwise(7)
    c = s.select("s_suppkey", bands.alias("bands"), F.lit(None).cast("array<double>").alias("wavelengths"))
    preset = F.when(F.col("s_suppkey") % 2 == 0, C.SENSORS[0][0]).otherwise(C.SENSORS[1][0])
    done = cubes.assign_wavelengths(c, presets.sensors(spark), preset)
    wl = F.col("wavelengths")
    label = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    return done.select(
        "s_suppkey", "axis_error", cubes.axis_error(wl, F.col("bands")).alias("render_error"),
        cubes.describe_cube(label, F.col("bands"), wl).alias("description"),
    )


@query(lambda: f"""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 IN (1, 2) THEN 'not a list of numbers'
        WHEN p_partkey % 4 + 1 <> p_size % 4 + 1 THEN 'count mismatch' END AS axis_error,
    CASE WHEN p_partkey % 6 > 2 AND p_partkey % 4 = p_size % 4 THEN 400.5 + 7 * (p_partkey % 4) WHEN p_partkey % 5 = 0 THEN 300.0 END AS last_nm FROM part""")
def typed_axes(spark, sf):
    """Wavelengths typed for cubes of one to four bands: lists, lists of another length, text that is none, and nothing."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    listed = F.array_join(F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), lambda i: F.concat(F.lit(" "), (400 + 7 * i).cast("string"), F.lit(".5"))), ",")
    typed = F.when(key % 6 == 1, "400, 4x0").when(key % 6 == 2, "").when(key % 6 > 2, listed)
    given = F.when(key % 5 == 0, F.array(F.lit(300.0)))
    done = cubes.assign_typed(p.select("p_partkey", (F.col("p_size") % 4 + 1).alias("bands"), given.alias("wavelengths"), typed.alias("typed")), F.col("typed"))
    return done.select("p_partkey", "axis_error", F.try_element_at("wavelengths", F.lit(-1)).alias("last_nm"))


@query(lambda: "SELECT p_partkey, 'a.b ' || p_brand AS label, CASE WHEN p_partkey % 4 < 2 THEN 'geotiff' ELSE 'envi' END AS format FROM part")
def source_formats(spark, sf):
    """How a file would be read, and its label, from its name."""
    end = F.element_at(F.array(*map(F.lit, (".tif", ".TIFF", ".hdr", ".Tif.dat"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/data/x.y/a.b "), "p_brand", F.when(F.col("p_partkey") % 4 == 3, F.lit(".img")).otherwise(end))
    p = table(spark, sf, "part")
    return p.select("p_partkey", cubes.source_label(path).alias("label"), cubes.source_format(path).alias("format"))


@query(lambda: f"SELECT vec_id, i AS band, {rsql('px[i + 1]')} AS value FROM ({PIXELS}), range({BANDS}) t(i) WHERE line = CAST({HEIGHT} AS BIGINT) // 2 AND sample = 12")
def one_pixel(spark, sf):
    """The spectrum in the middle of the image."""
    one = cubes.pixel(pixels(spark, sf), height(spark, sf) // 2, 12)
    return one.select("vec_id", F.posexplode("spectrum").alias("band", "v")).select("vec_id", F.col("band").cast("long").alias("band"), rnd("v").alias("value"))
