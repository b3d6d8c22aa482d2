"""Stimulus queries: coordinates, distances, exports, curve algebra, corpus statistics."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from opsinlake import constants as C
from opsinlake.catalog.base import (
    AXIS, BANDS, SLOPES, SOLAR, UNIFORM, curve_kernel_sql, curve_value_sql, dot, num, nums, query, rnd, rsql,
    spectra, table,
)
from opsinlake.functions import color
from opsinlake.functions.monotone import Bundle
from opsinlake.operators import colors, compare, corpus, curves, opponent, regions
from opsinlake.operators.cubes import as_points, quantity
from opsinlake.plans import kernel as K
from opsinlake.plans.systems import builtin, builtin_systems
from opsinlake.session import spread
from opsinlake.sources import text

RED = np.array([(400.0, 0.9), (480.0, 0.2), (560.0, 0.4), (610.0, 1.0), (715.0, 0.7)])  # a lamp with its own knots


@lru_cache(maxsize=None)
def human(kind=K.REFLECTANCE) -> K.CurveKernel:
    return K.compile_curves(builtin("Human"), 0, AXIS, SOLAR, kind)


@lru_cache(maxsize=None)
def all_kernels() -> tuple:
    """Dominant-regime kernels of every system that has a regime, under the uniform light."""
    return tuple(K.compile_curves(s, "dominant", AXIS, UNIFORM) for s in builtin_systems().values() if s.regimes)


@lru_cache(maxsize=None)
def mantis() -> K.CurveKernel:
    return K.compile_curves(builtin("Mantis"), None, AXIS, UNIFORM)


def _cubic(body: str) -> str:
    return f"WITH RECURSIVE {SLOPES} {body}"


def _hues(c, n):
    out = [
        f"atan2(sqrt({' + '.join(f'{c}[{j}] ** 2' for j in range(k + 2, n + 2))}), {c}[{k + 1}])" for k in range(1, n - 1)
    ]
    return out + ([f"atan2({c}[{n + 1}], {c}[{n}])"] if n >= 2 else [])


def _saturation(c, n):
    return f"sqrt({' + '.join(f'{c}[{i + 2}] ** 2' for i in range(n))})"


def _coords_sql():
    k = human()
    n = k.chroma
    cols = [f"{rsql('c[1]')} AS L"] + [f"{rsql(f'c[{i + 2}]')} AS C{i + 1}" for i in range(n)]
    cols.append(f"{rsql(_saturation('c', n))} AS saturation")
    cols += [f"{rsql(h)} AS hue{i + 1}" for i, h in enumerate(_hues("c", n))]
    return _cubic(f"SELECT vec_id, {', '.join(cols)} FROM ({curve_kernel_sql(k, 'cubic', 'vec_id')})")


@query(_coords_sql)
def coordinate_table(spark, sf):
    df = compare.coordinate_table(spectra(spark, sf).drop("label"), human())
    return df.select("vec_id", *[rnd(c).alias(c) for c in df.columns if c != "vec_id"])


def _all_sql():
    parts = []
    for k in all_kernels():
        n = k.chroma
        parts.append(
            f"SELECT vec_id, '{k.system}' AS system, '{k.regime}' AS regime, {rsql('c[1]')} AS luminance, "
            f"{rsql(_saturation('c', n))} AS saturation, CAST({n} AS BIGINT) AS axes, {rsql('q[1]')} AS first_receptor "
            f"FROM ({curve_kernel_sql(k, 'cubic', 'vec_id')})"
        )
    return _cubic(" UNION ALL ".join(parts))


@query(_all_sql)
def coordinates_all_systems(spark, sf):
    df = compare.coordinates(spectra(spark, sf).drop("label"), list(all_kernels()))
    return df.select(
        "vec_id", "system", "regime", rnd("luminance").alias("luminance"), rnd("saturation").alias("saturation"),
        F.size("chroma").cast("long").alias("axes"), rnd(F.col("adapted")[0]).alias("first_receptor"),
    )


def _pool_sql():
    k = mantis()
    cols = ", ".join(f"{rsql(f'q[{i + 1}]')} AS r{i}" for i in range(len(k.gains)))
    return _cubic(f"SELECT vec_id, {cols} FROM ({curve_kernel_sql(k, 'cubic', 'vec_id')})")


@query(_pool_sql)
def receptors_without_regime(spark, sf):
    k = mantis()
    df = compare.pool_responses(spectra(spark, sf).drop("label"), k)
    return df.select("vec_id", *[rnd(F.col(f"`{n}`")).alias(f"r{i}") for i, n in enumerate(k.receptor_names)])


# ------------------------------------------------------------------ distances


def _mean_curves_sql() -> str:
    """``vec_id`` (the label), ``y``, ``m`` of the mean curve of every label, slopes included."""
    one = (f"SELECT label, list(v ORDER BY i) AS y FROM (SELECT label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS v "
           f"FROM embeddings, range({BANDS}) t(i) GROUP BY label, i) GROUP BY label")
    return SLOPES.replace(
        "base AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS y FROM embeddings)",
        f"base AS (SELECT CAST(label AS BIGINT) AS vec_id, CAST(0 AS BIGINT) AS label, y FROM ({one}))",
    )


def _label_coords(spark, sf, kernels):
    """Coordinates of the mean curve of every label, over all rows."""
    means = regions.mean_spectrum(spectra(spark, sf), BANDS, keys=("label",)).select("label", "spectrum")
    return compare.coordinates(means, list(kernels))


def _metric_sql(metric, k, a="a", b="b"):
    if metric == compare.DELTA_S:
        if k.noise is None:
            return "CAST(NULL AS DOUBLE)"
        terms = [f"(({a}.q[{i + 1}] - {b}.q[{i + 1}]) / {num(e)}) ** 2" for i, e in enumerate(k.noise)]
    else:
        first = 0 if metric == compare.EUCLIDEAN else 1
        terms = [f"({a}.c[{i + 1}] - {b}.c[{i + 1}]) ** 2" for i in range(first, k.chroma + 1)]
    return f"sqrt({' + '.join(terms)})"


def _matrix_sql(metric):
    k = human()
    return (
        f"WITH RECURSIVE {_mean_curves_sql()}, t AS ({curve_kernel_sql(k, 'cubic', 'vec_id')}) "
        f"SELECT '{k.system}' AS system, a.vec_id AS a_id, b.vec_id AS b_id, {rsql(_metric_sql(metric, k))} AS distance "
        "FROM t a JOIN t b ON a.vec_id < b.vec_id"
    )


def _matrix(spark, sf, metric):
    k = [human()]
    m = compare.difference_matrix(_label_coords(spark, sf, k), k, metric, "label")
    return m.withColumn("distance", rnd("distance"))


@query(lambda: _matrix_sql(compare.EUCLIDEAN))
def difference_matrix_euclidean(spark, sf):
    return _matrix(spark, sf, compare.EUCLIDEAN)


@query(lambda: _matrix_sql(compare.CHROMA_ONLY))
def difference_matrix_chroma(spark, sf):
    return _matrix(spark, sf, compare.CHROMA_ONLY)


@query(lambda: _matrix_sql(compare.DELTA_S))
def difference_matrix_delta_s(spark, sf):
    return _matrix(spark, sf, compare.DELTA_S)


def _cross_sql():
    ks = all_kernels()
    ctes = [f"t{i} AS ({curve_kernel_sql(k, 'cubic', 'vec_id')})" for i, k in enumerate(ks)]
    cols = [f"{rsql(_metric_sql(compare.DELTA_S, k, f'a{i}', f'b{i}'))} AS s{i}" for i, k in enumerate(ks)]
    joins = " ".join(
        f"JOIN t{i} a{i} ON a{i}.vec_id = a0.vec_id JOIN t{i} b{i} ON b{i}.vec_id = b0.vec_id" for i in range(1, len(ks))
    )
    return (
        f"WITH RECURSIVE {_mean_curves_sql()}, {', '.join(ctes)} SELECT a0.vec_id AS a_id, b0.vec_id AS b_id, "
        f"{', '.join(cols)} FROM t0 a0 JOIN t0 b0 ON a0.vec_id < b0.vec_id {joins}"
    )


@query(_cross_sql)
def cross_species_summary(spark, sf):
    ks = list(all_kernels())
    df = compare.cross_species(_label_coords(spark, sf, ks), ks, "label")
    return df.select("a_id", "b_id", *[rnd(F.col(f"`{k.system}`")).alias(f"s{i}") for i, k in enumerate(ks)])


def _reference_sql():
    k = human()
    t = f"t AS ({curve_kernel_sql(k, 'cubic', 'vec_id, label')})"
    return _cubic(
        f", {t} SELECT a.vec_id, r.vec_id AS ref_id, {rsql(_metric_sql(compare.DELTA_S, k, 'a', 'r'))} AS distance "
        "FROM t a, (SELECT t.* FROM t JOIN (SELECT label, min(vec_id) AS vec_id FROM t GROUP BY label) USING (label, vec_id)) r"
    ).replace(f"{SLOPES} ,", f"{SLOPES},")


@query(_reference_sql)
def distance_to_references(spark, sf):
    """Every stimulus against the first stimulus of each of the ten labels."""
    k = [human()]
    s = spectra(spark, sf)
    first = s.groupBy("label").agg(F.min_by("spectrum", "vec_id").alias("spectrum"), F.min("vec_id").alias("vec_id"))
    refs = compare.coordinates(first.select("vec_id", "spectrum"), k)
    near = compare.distance_to_references(
        compare.coordinates(s.select("vec_id", "spectrum"), k), refs, k, compare.DELTA_S, "vec_id"
    )
    return near.select("vec_id", "ref_id", rnd("distance").alias("distance"))


def _export_sql():
    ks = all_kernels()
    ctes, cols, n = [], [], 0
    for i, k in enumerate(ks):
        ctes.append(f"t{i} AS ({curve_kernel_sql(k, 'cubic', 'vec_id')})")
        for e in [f"t{i}.c[{j + 1}]" for j in range(k.chroma + 1)] + [_saturation(f"t{i}.c", k.chroma)]:
            cols.append(f"{rsql(e)} AS v{n}")
            n += 1
        cols.append(f"{rsql(_metric_sql(compare.EUCLIDEAN, k, f't{i}', f'r{i}'))} AS v{n}")
        n += 1
    joins = " ".join(f"JOIN t{i} USING (vec_id)" for i in range(1, len(ks)))
    refs = ", ".join(f"(SELECT * FROM t{i} WHERE vec_id = 0) r{i}" for i in range(len(ks)))
    return _cubic(
        f", {', '.join(ctes)} SELECT 'stimulus ' || vec_id AS stimulus, {', '.join(cols)} FROM t0 {joins}, {refs}"
    ).replace(f"{SLOPES} ,", f"{SLOPES},").replace("SELECT 'stimulus ' || vec_id", "SELECT 'stimulus ' || t0.vec_id")


@query(_export_sql)
def batch_export(spark, sf):
    """The wide export of every stimulus for every system, with the distance to stimulus 0."""
    s = spectra(spark, sf).withColumn("name", F.concat(F.lit("stimulus "), F.col("vec_id").cast("string")))
    df = compare.batch_export(s, list(all_kernels()), reference=s.where("vec_id = 0"))
    names = df.columns[1:]
    return df.select(F.col("Stimulus").alias("stimulus"), *[rnd(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(names)])


@lru_cache(maxsize=None)
def radiance_kernels() -> tuple:
    return tuple(K.compile_curves(s, "dominant", AXIS, UNIFORM, K.RADIANCE) for s in builtin_systems().values() if s.regimes)


def _mixed_sql():
    ctes, cols, n = [], [], 0
    for i, (lit, raw) in enumerate(zip(all_kernels(), radiance_kernels())):
        ctes.append(f"t{i} AS ({curve_kernel_sql(lit, '(SELECT * FROM cubic WHERE vec_id % 4 = 0)', 'vec_id')}"
                    f" UNION ALL {curve_kernel_sql(raw, '(SELECT * FROM cubic WHERE vec_id % 4 IN (1, 3))', 'vec_id')})")
        for e in [f"t{i}.c[{j + 1}]" for j in range(lit.chroma + 1)] + [_saturation(f"t{i}.c", lit.chroma)]:
            cols.append(f"{rsql(e)} AS v{n}")
            n += 1
        cols.append(f"{rsql(_metric_sql(compare.EUCLIDEAN, lit, f't{i}', f'r{i}'))} AS v{n}")
        n += 1
    joins = " ".join(f"JOIN t{i} USING (vec_id)" for i in range(1, len(ctes)))
    refs = ", ".join(f"(SELECT * FROM t{i} WHERE vec_id = 0) r{i}" for i in range(len(ctes)))
    return _cubic(
        f", {', '.join(ctes)} SELECT 'stimulus ' || t0.vec_id AS stimulus, {', '.join(cols)} FROM t0 {joins}, {refs}"
    ).replace(f"{SLOPES} ,", f"{SLOPES},")


@query(_mixed_sql)
def batch_export_mixed(spark, sf):
    """The wide export of reflectances (lit), radiances and curves without a kind (as they are); absorption curves are
    left out."""
    m = F.col("vec_id") % 4
    kind = F.when(m == 0, "Reflectance").when(m == 1, "Radiance").when(m == 2, "Absorption").otherwise("Unspecified")
    s = spectra(spark, sf).withColumns({"name": F.concat(F.lit("stimulus "), F.col("vec_id").cast("string")), "kind": kind})
    df = compare.batch_export(s, list(all_kernels()), reference=s.where("vec_id = 0"), kind="kind", radiance=list(radiance_kernels()))
    names = df.columns[1:]
    return df.select(F.col("Stimulus").alias("stimulus"), *[rnd(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(names)])


# ------------------------------------------------------------------ curve algebra


def curve_table(spark, sf):
    """Embeddings as curves: every third a reflectance, then a radiance, then a radiance in another unit or an
    absorption curve; a batch path per label."""
    s = spread(spectra(spark, sf))
    m = F.col("vec_id") % 4
    kind = F.when(m == 0, quantity("Reflectance")).when(m == 1, quantity("Radiance", "relative")).when(
        m == 2, quantity("Radiance", "W/m2/nm")).otherwise(quantity("Absorption"))
    batch = F.concat(F.lit(" embeddings // "), F.col("label").cast("string"), F.lit("/"))
    meta = F.when(F.col("vec_id") % 10 == 9, F.expr("cast(map() as map<string,string>)")).otherwise(
        F.map_from_arrays(F.array(F.lit("batch")), F.array(batch)))
    return s.select(
        "vec_id", "label", F.concat(F.lit("stimulus "), F.col("vec_id").cast("string")).alias("name"),
        kind.alias("quantity"), as_points(AXIS, F.col("spectrum")).alias("points"), meta.alias("metadata"),
    )


_KIND = "CASE vec_id % 4 WHEN 0 THEN 'Reflectance' WHEN 1 THEN 'Radiance' WHEN 2 THEN 'Radiance' ELSE 'Absorption' END"


def _on_grid_sql(grid, keep="vec_id"):
    """Values of every cubic on a literal grid, as rows ``keep, wl, v``."""
    return f"SELECT {keep}, x.wl, {curve_value_sql('x.wl')} AS v FROM cubic, (SELECT unnest({nums(grid)}) AS wl) x"


_ONE_NM = np.arange(400.0, 716.0)


@query(lambda: _cubic(
    f"SELECT vec_id, {rsql('sum(CASE WHEN wl = 400 OR wl = 715 THEN v / 2 ELSE v END)')} AS area "
    f"FROM ({_on_grid_sql(_ONE_NM)}) GROUP BY vec_id"))
def curve_integrals(spark, sf):
    c = curve_table(spark, sf)
    return c.select("vec_id", rnd(curves.curve_integral(F.col("points"))).alias("area"))


@query(lambda: _cubic(
    f"SELECT vec_id, CASE WHEN area > 0 THEN {rsql('y[1] * 100.0 / area', 2)} END AS first_value, "
    f"CASE WHEN area > 0 THEN {rsql('y[64] * 100.0 / area', 2)} END AS last_value FROM cubic JOIN (SELECT vec_id, "
    f"sum(CASE WHEN wl = 400 OR wl = 715 THEN v / 2 ELSE v END) AS area FROM ({_on_grid_sql(_ONE_NM)}) GROUP BY vec_id) "
    "USING (vec_id)"))
def light_power_scaling(spark, sf):
    """Each spectrum as a light brought to 100 W/m2; one without positive power cannot be."""
    from opsinlake.functions.lights import power_factor, scale_points

    c = curve_table(spark, sf).withColumn("f", power_factor(curves.curve_integral(F.col("points")), F.lit(100.0)))
    p = scale_points(F.col("points"), F.col("f"))
    return c.select("vec_id", rnd(p[0]["v"], 2).alias("first_value"), rnd(p[63]["v"], 2).alias("last_value"))


_FINE = np.array([400.0, 401.0, 402.5, 407.25, 455.0, 499.9, 533.333, 600.1, 712.5, 714.0, 715.0])


@query(lambda: _cubic(f"SELECT vec_id, wl, {rsql('v')} AS v FROM ({_on_grid_sql(_FINE)})"))
def monotone_resample(spark, sf):
    c = curve_table(spark, sf).select("vec_id", "points").withColumn("wl", F.lit([float(x) for x in _FINE]))
    both = c.withColumn("v", curves.values_at(F.col("points"), F.col("wl")))
    return both.select("vec_id", F.inline(F.arrays_zip("wl", "v"))).withColumn("v", rnd("v"))


@query(lambda: _cubic(f"SELECT vec_id, wl, {rsql('v')} AS v FROM ({_on_grid_sql(_FINE)})"))
def monotone_resample_native(spark, sf):
    """The same values from array functions only."""
    c = curves.native_segments(curve_table(spark, sf).select("vec_id", "points"))
    grid = F.lit([float(x) for x in _FINE])
    cells = F.transform(grid, lambda x: F.struct(x.alias("wl"), curves.native_value(F.col("segments"), x).alias("v")))
    return c.select("vec_id", F.inline(cells)).withColumn("v", rnd("v"))


def _light_sql(grid):
    v = Bundle.of(RED).resample(grid)[0]
    pairs = ", ".join(f"({float(w)!r}, {float(x)!r})" for w, x in zip(grid, v))
    return f"(SELECT CAST(col0 AS DOUBLE) AS wl, CAST(col1 AS DOUBLE) AS light FROM (VALUES {pairs}))"


def _point_stats(df, extra=()):
    p = F.col("points")
    return df.select(
        "vec_id", *extra, F.size(p).cast("long").alias("knots"), p[0]["wl"].alias("first_nm"),
        rnd(p[100]["v"]).alias("v100"),
        rnd(F.aggregate(p, F.lit(0.0), lambda s, q: s + q["v"])).alias("total"),
    )


def _stats_sql(value, where="TRUE", extra=""):
    return (
        f"SELECT vec_id, {extra} count(*) AS knots, min(wl) AS first_nm, "
        f"{rsql(f'max(CASE WHEN wl = 500 THEN {value} END)')} AS v100, {rsql(f'sum({value})')} AS total "
        f"FROM ({_on_grid_sql(_ONE_NM)}) JOIN {_light_sql(_ONE_NM)} USING (wl) WHERE {where} GROUP BY vec_id"
    )


@query(lambda: _cubic(_stats_sql(
    "v / light", "vec_id % 4 = 1",
    "'stimulus ' || vec_id || ' (reflectance)' AS name, 'Reflectance' AS kind, CASE WHEN vec_id % 10 = 9 THEN NULL ELSE "
    "(SELECT ' embeddings // ' || label || '/' || '/reflectance' FROM base b WHERE b.vec_id = vec_id LIMIT 1) END AS batch,",
).replace("(SELECT ' embeddings // ' || label || '/' || '/reflectance' FROM base b WHERE b.vec_id = vec_id LIMIT 1)",
          "' embeddings // ' || any_value(label) || '/' || '/reflectance'").replace(
    "SELECT vec_id, x.wl,", "SELECT vec_id, label, x.wl,")))
def radiance_to_reflectance(spark, sf):
    good, _ = curves.derive_reflectance(curve_table(spark, sf), RED)
    extra = ("name", F.col("quantity.kind").alias("kind"), F.element_at("metadata", "batch").alias("batch"))
    return _point_stats(good, extra)


@query(lambda: "SELECT count(*) FILTER (vec_id % 4 = 1) AS converted, count(*) FILTER (vec_id % 4 <> 1) AS skipped FROM embeddings")
def conversion_tally(spark, sf):
    return curves.conversion_tally(curve_table(spark, sf))


@query(lambda: "SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 4 = 2 THEN 'unit mismatch' ELSE 'wrong quantity kind' END AS error "
       "FROM embeddings WHERE vec_id % 4 <> 1")
def conversion_rejects(spark, sf):
    _, bad = curves.derive_reflectance(curve_table(spark, sf), RED)
    return bad.select("vec_id", "error")


@query(lambda: _cubic(_stats_sql("v * light", "vec_id % 4 = 0",
       "'reflectance of \"stimulus ' || vec_id || '\" under illuminant \"red lamp\"' AS note, 'relative' AS unit,")))
def predict_under_light(spark, sf):
    c = curve_table(spark, sf).where("quantity.kind = 'Reflectance'")
    out = curves.predict_under_light(c, RED, "red lamp")
    return _point_stats(out, (F.element_at("metadata", "derived").alias("note"), F.col("quantity.unit").alias("unit")))


_NOTCH = np.column_stack([[500.0, 510.2, 520.0, 530.4, 540.0], [1.0, 0.6, -0.2, 0.5, 1.3]])
_NOTCH_GRID = np.unique(np.concatenate([_ONE_NM, _NOTCH[:, 0]]))


def _absorbed_sql():
    t = np.nan_to_num(Bundle.of(_NOTCH).resample(_NOTCH_GRID)[0], nan=1.0).clip(0, 1) ** 1.5
    pairs = ", ".join(f"({float(w)!r}, {float(x)!r})" for w, x in zip(_NOTCH_GRID, t))
    light = f"(SELECT CAST(col0 AS DOUBLE) AS wl, CAST(col1 AS DOUBLE) AS t FROM (VALUES {pairs}))"
    return _cubic(
        f"SELECT vec_id, count(*) AS knots, {rsql('sum(v * t)')} AS total, "
        f"{rsql('max(CASE WHEN wl = 510.2 THEN v * t END)')} AS at_knot, 'weight 1.5' AS note "
        f"FROM ({_on_grid_sql(_NOTCH_GRID)}) JOIN {light} USING (wl) GROUP BY vec_id"
    )


@query(_absorbed_sql)
def apply_absorption(spark, sf):
    out = curves.apply_absorption(curve_table(spark, sf), _NOTCH, 1.5, "notch")
    p = F.col("points")
    at = F.element_at(F.filter(p, lambda q: q["wl"] == 510.2), 1)["v"]
    return out.select(
        "vec_id", F.size(p).cast("long").alias("knots"),
        rnd(F.aggregate(p, F.lit(0.0), lambda s, q: s + q["v"])).alias("total"), rnd(at).alias("at_knot"),
        F.element_at("metadata", "absorption: notch").alias("note"),
    )


def _seen_sql():
    k = K.compile_curves(builtin("Human"), None, AXIS, UNIFORM, K.RADIANCE)
    cols = ", ".join(
        f"{rsql(f'{dot("y", v)} + {dot("m", s)}')} AS e{i}"
        for i, (v, s) in enumerate(zip(k.value_weights, k.slope_weights))
    )
    return _cubic(f"SELECT vec_id, {cols} FROM cubic")


@query(_seen_sql)
def seen_irradiance(spark, sf):
    """What each human receptor absorbs of every spectrum used as a light, through the point-curve path."""
    c = curve_table(spark, sf)
    e = c.withColumn("e", curves.product_integrals(F.col("points"), [r.points for r in builtin("Human").pool]))
    return e.select("vec_id", *[rnd(F.col("e")[i]).alias(f"e{i}") for i in range(3)])


def _point_coords_sql():
    out = []
    for m, kind in ((0, K.REFLECTANCE), (1, K.RADIANCE), (2, K.RADIANCE)):
        k = K.compile_curves(builtin("Human"), 0, AXIS, SOLAR, kind)
        text_ = curve_kernel_sql(k, f"SELECT * FROM cubic WHERE vec_id % 4 = {m}", "vec_id")
        out.append(
            f"SELECT vec_id, {rsql('c[1]')} AS luminance, {rsql('c[2]')} AS c1, {rsql('c[3]')} AS c2, "
            f"{rsql(_saturation('c', 2))} AS saturation FROM ({text_})"
        )
    return _cubic(" UNION ALL ".join(out))


@query(_point_coords_sql)
def point_coordinates(spark, sf):
    """Mixed kinds of stimuli with their own points: reflectances lit by the sun, absorption curves left out."""
    s = builtin("Human")
    df = compare.point_coordinates(curve_table(spark, sf), s.name, K.regime_state(s, s.regimes[0], SOLAR), SOLAR)
    return df.select(
        "vec_id", rnd("luminance").alias("luminance"), rnd(F.col("chroma")[0]).alias("c1"),
        rnd(F.col("chroma")[1]).alias("c2"), rnd("saturation").alias("saturation"),
    )


@query(lambda: f"SELECT CAST(vec_id AS BIGINT) AS vec_id, {_KIND} AS kind, CAST(vec_id % 4 IN (0, 3) AND len([v FOR v IN embedding IF v < 0 OR v > 1]) > 0 AS BIGINT) "
       "AS outside FROM embeddings")
def unit_range_flags(spark, sf):
    c = curve_table(spark, sf)
    flag = curves.out_of_unit_range(F.col("quantity.kind"), F.col("points"))
    return c.select("vec_id", F.col("quantity.kind").alias("kind"), flag.cast("long").alias("outside"))


# ------------------------------------------------------------------ display colour


def _srgb_sql(x, y, z):
    lin = [f"greatest({a} * {x} + ({b}) * {y} + ({c}) * {z}, 0.0)" for a, b, c in C.XYZ_TO_SRGB]
    peak = f"greatest({', '.join(lin)})"
    out = []
    for v in lin:
        u = f"(CASE WHEN {peak} > 0 THEN {v} / {peak} ELSE 0.0 END)"
        out.append(f"(CASE WHEN {u} <= 0.0031308 THEN 12.92 * {u} ELSE 1.055 * pow({u}, 1 / 2.4) - 0.055 END)")
    return out


def _display_sql():
    cmf = color.color_matching_table(_ONE_NM)
    rows = ", ".join(f"({float(w)!r}, {a!r}, {b!r}, {c!r})" for w, (a, b, c) in zip(_ONE_NM, cmf.T.tolist()))
    fit = f"(SELECT CAST(col0 AS DOUBLE) AS wl, CAST(col1 AS DOUBLE) AS xb, CAST(col2 AS DOUBLE) AS yb, CAST(col3 AS DOUBLE) AS zb FROM (VALUES {rows}))"
    peak = "list_max([abs(v) FOR v IN y])"
    inner = (
        f"SELECT vec_id, sum(v / p * xb) AS x, sum(v / p * yb) AS yy, sum(v / p * zb) AS z FROM "
        f"({_on_grid_sql(_ONE_NM, f'vec_id, {peak} AS p')}) JOIN {fit} USING (wl) GROUP BY vec_id"
    )
    cols = ", ".join(f"{rsql(e, 4)} AS {n}" for e, n in zip(_srgb_sql("x", "yy", "z"), "rgb"))
    return _cubic(f"SELECT vec_id, {cols} FROM ({inner})")


@query(_display_sql)
def curve_display_color(spark, sf):
    c = colors.with_display_color(curve_table(spark, sf))
    return c.select("vec_id", *[rnd(F.col("rgb")[n], 4).alias(n) for n in "rgb"])


# ------------------------------------------------------------------ corpus


_BATCH = "CASE WHEN vec_id % 10 = 9 THEN NULL ELSE label END"


@query(
    lambda: "SELECT 'embeddings' AS node, 1 AS level, count(*) AS curves, 0 AS direct_curves FROM embeddings WHERE vec_id % 10 <> 9 "
    "UNION ALL SELECT 'embeddings/' || label, 2, count(*), count(*) FROM embeddings WHERE vec_id % 10 <> 9 GROUP BY label"
)
def corpus_tree_counts(spark, sf):
    return corpus.corpus_counts(curve_table(spark, sf), F.element_at("metadata", "batch"))


@query(lambda: "SELECT CAST(vec_id AS BIGINT) AS vec_id FROM embeddings WHERE vec_id % 10 <> 9 AND label = 3")
def corpus_members(spark, sf):
    return corpus.under(curve_table(spark, sf), F.element_at("metadata", "batch"), "embeddings / 3").select("vec_id")


def _covariance_sql():
    k = opponent.ungated(human())
    t = f"SELECT vec_id % 3 + 1 AS w, q FROM ({curve_kernel_sql(k, 'cubic', 'vec_id')})"
    m = ", ".join(f"sum(w * q[{i + 1}]) / sum(w) AS m{i}" for i in range(3))
    cols = [f"{rsql(f'any_value(m{i})')} AS mean{i}" for i in range(3)]
    cols += [
        f"{rsql(f'sum(w * (q[{i + 1}] - m{i}) * (q[{j + 1}] - m{j})) / sum(w)')} AS cov{i}_{j}"
        for i in range(3) for j in range(i, 3)
    ]
    return _cubic(
        f", t AS ({t}), mm AS (SELECT {m} FROM t) SELECT count(*) AS n, CAST(sum(w) AS DOUBLE) AS weight, {', '.join(cols)} FROM t, mm"
    ).replace(f"{SLOPES} ,", f"{SLOPES},")


@query(_covariance_sql)
def corpus_covariance(spark, sf):
    df = opponent.corpus_covariance(spectra(spark, sf), opponent.ungated(human()), F.col("vec_id") % 3 + 1)
    return df.select("n", "weight", *[rnd(c).alias(c) for c in df.columns if c[0] in "mc"])


def _contrasts_sql():
    """Eigenvalues of the symmetric 3 x 3 covariance by the trigonometric formula, eigenvectors as the longest cross
    product of two rows of A - eI."""
    k = opponent.ungated(human())
    t = f"SELECT vec_id % 3 + 1 AS w, q FROM ({curve_kernel_sql(k, 'cubic', 'vec_id')})"
    mean = ", ".join(f"sum(w * q[{i + 1}]) / sum(w) AS m{i}" for i in range(3))
    cov = ", ".join(f"sum(w * (q[{i + 1}] - m{i}) * (q[{j + 1}] - m{j})) / sum(w) AS a{i}{j}" for i in range(3) for j in range(i, 3))
    row = lambda i: [f"a{min(i, j)}{max(i, j)}" + (" - e" if i == j else "") for j in range(3)]

    def cross(x, y):
        return "[" + ", ".join(f"({x[(c + 1) % 3]}) * ({y[(c + 2) % 3]}) - ({x[(c + 2) % 3]}) * ({y[(c + 1) % 3]})" for c in range(3)) + "]"

    crosses = ", ".join(cross(row(i), row(j)) for i, j in ((0, 1), (0, 2), (1, 2)))
    return _cubic(
        f""", t AS ({t}), mm AS (SELECT {mean} FROM t), c AS (SELECT {cov} FROM t, mm),
        p AS (SELECT *, (a00 + a11 + a22) / 3 AS q FROM c),
        r AS (SELECT *, sqrt(((a00 - q) ** 2 + (a11 - q) ** 2 + (a22 - q) ** 2 + 2 * (a01 ** 2 + a02 ** 2 + a12 ** 2)) / 6) AS s FROM p),
        f AS (SELECT *, acos(greatest(-1, least(1, (
            (a00 - q) * ((a11 - q) * (a22 - q) - a12 ** 2) - a01 * (a01 * (a22 - q) - a12 * a02) + a02 * (a01 * a12 - (a11 - q) * a02)
            ) / (2 * s ** 3)))) / 3 AS phi FROM r),
        v AS (SELECT *, unnest([1, 2, 3]) AS k, unnest([q + 2 * s * cos(phi), q + 2 * s * cos(phi + 4 * pi() / 3), q + 2 * s * cos(phi + 2 * pi() / 3)]) AS e FROM f),
        x AS (SELECT k, e, list_sort([[list_inner_product(u, u), u[1], u[2], u[3]] FOR u IN [{crosses}]], 'DESC')[1] AS b FROM v),
        y AS (SELECT k, e, [z / sqrt(b[1]) FOR z IN b[2:4]] AS u FROM x),
        z AS (SELECT k, e, [g * CASE WHEN list_max(u) >= -list_min(u) THEN 1 ELSE -1 END FOR g IN u] AS u FROM y)
        SELECT 'Natural-scene PC' || k AS name, {", ".join(rsql(f"u[{i + 1}]", 4) + f" AS w{i}" for i in range(3))}, {rsql("e", 5)} AS variance FROM z"""
    ).replace(f"{SLOPES} ,", f"{SLOPES},")


@query(_contrasts_sql)
def corpus_contrasts(spark, sf):
    """Principal opponent axes of the weighted corpus."""
    rows = opponent.corpus_contrasts(spectra(spark, sf), opponent.ungated(human()), F.col("vec_id") % 3 + 1)
    return rows.select(F.split("name", " \\(")[0].alias("name"), *[rnd(F.col("weights")[i], 4).alias(f"w{i}") for i in range(3)], rnd("variance", 5).alias("variance"))


# ------------------------------------------------------------------ text


def text_files(spark, sf):
    """One text per stimulus: comments, a header, sentinels, blank lines, a field with a suffix, a line with a leading
    comma; every fourth in micrometres."""
    s = spectra(spark, sf)
    micro = F.col("vec_id") % 4 == 0
    unit = F.when(micro, F.lit(1000.0)).otherwise(F.lit(1.0))
    body = F.transform(
        as_points(AXIS, F.col("spectrum")),
        lambda p: F.concat((p["wl"] / unit).cast("string"), F.lit(", "), F.round(p["v"] * 1000).cast("int").cast("string")),
    )
    return spread(s).select(
        F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("file"),
        F.concat(
            F.lit("# measured\n! note\nwavelength value\n"), F.array_join(body, "\n"),
            F.lit("\n\n  720   -1.23e34\nnan 3\n7 inf\n9\n5d 3\n,"), (F.lit(410.0) / unit).cast("string"), F.lit(",2\n"),
        ).alias("text"),
    )


@query(
    lambda: "WITH p AS (SELECT 'f' || vec_id AS file, i + 3 AS line, 400.0 + 5 * i AS wl, "
    f"round(CAST(embedding[i + 1] AS DOUBLE) * 1000) AS v FROM embeddings, range({BANDS}) t(i) "
    f"UNION ALL SELECT 'f' || vec_id, {BANDS + 9}, 410.0, 2.0 FROM embeddings) "
    f"SELECT file, CAST(line AS BIGINT) AS line, round(wl, 6) AS wl, {rsql('v', 3)} AS v FROM p"
)
def text_spectra(spark, sf):
    rows = text.parse_spectra(text_files(spark, sf))
    return rows.select("file", "line", rnd("wl").alias("wl"), rnd("v", 3).alias("v"))


_LINE_NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


@query(
    lambda: f"""WITH l AS (SELECT doc_id, unnest(ls) AS t, unnest(range(len(ls))) AS line
        FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents)),
    f AS (SELECT doc_id, line, regexp_split_to_array(regexp_replace(trim(t, ' '), '^[,\\s]+', ''), '[,\\s]+') AS x FROM l),
    p AS (SELECT doc_id, line, CAST(x[1] AS DOUBLE) AS wl, CAST(x[2] AS DOUBLE) AS v FROM f
        WHERE regexp_full_match(x[1], '{_LINE_NUMBER}') AND regexp_full_match(x[2], '{_LINE_NUMBER}')),
    g AS (SELECT *, max(wl) OVER (PARTITION BY doc_id) AS top FROM p WHERE abs(v) < 1e30),
    n AS (SELECT doc_id, count(*) AS points, {rsql('sum(wl * CASE WHEN top > 0 AND top < 50 THEN 1000.0 ELSE 1.0 END)')} AS wl FROM g GROUP BY doc_id)
    SELECT doc_id, coalesce(points, 0) AS points, wl FROM documents LEFT JOIN n USING (doc_id)"""
)
def document_points(spark, sf):
    """Every document read as a text spectrum, as it is: its number of points (lines whose first two fields are numbers) and
    the sum of their wavelengths. Prose has none."""
    rows = table(spark, sf, "documents").select("doc_id", text.parse_points(F.col("text")).alias("p"))
    total = F.aggregate(F.transform("p", lambda p: p["wl"]), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.size("p").cast("long").alias("points"), F.when(F.size("p") > 0, rnd(total)).alias("wl"))


@query(lambda: f"SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(i AS BIGINT) AS pos, 400.0 + 5 * i AS wavelength_nm, {rsql('embedding[i + 1]')} AS value "
       f"FROM embeddings, range({BANDS}) t(i)")
def curve_rows(spark, sf):
    """The rows of a curve export."""
    r = text.curve_rows(curve_table(spark, sf).select("vec_id", "points"))
    return r.select("vec_id", F.col("pos").cast("long").alias("pos"), "wavelength_nm", rnd("value").alias("value"))
