"""Stimuli on axes off the nanometre grid and with knots of their own, for all systems. The SQL fits, lights and
integrates every curve itself, from the knots of stimuli, light and receptors."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from opsinlake.catalog.base import BANDS, SOLAR, mul, num, nums, query, rnd, rsql, spectra
from opsinlake.functions.monotone import Bundle
from opsinlake.operators import compare, opponent
from opsinlake.operators.cubes import quantity
from opsinlake.plans import kernel as K
from opsinlake.plans import observers as O
from opsinlake.plans.systems import builtin, builtin_systems
from opsinlake.session import spread

SENSOR = tuple(397.32 + 5.0 * b for b in range(BANDS))
UNEVEN = tuple(400.0 + 4.6 * b + 0.01 * b * b for b in range(BANDS))
LOW, HIGH = 300.0, 750.0  # the receptors' and the light's domain, with a knot at every nanometre


@lru_cache(maxsize=None)
def odd_kernel(axis: tuple) -> K.CurveKernel:
    return K.compile_curves(builtin("Human"), 0, axis, SOLAR)


@lru_cache(maxsize=None)
def everyone() -> O.Panel:
    """Every system that has a regime, in its dominant one under the sun."""
    return O.panel([s for s in builtin_systems().values() if s.regimes], SOLAR)


# ------------------------------------------------------------------ cubics in SQL


def cubic_ctes(source: str, name: str) -> str:
    """CTEs ending in ``name(id, x0, x1, y0, y1, m0, m1, last)``: the limited cubic segments of the curves ``source(id, i,
    x, y)``, one recursion step per knot."""

    def limited(m0: str, m1: str, m: str) -> str:
        r = f"(({m0}) / d) ** 2 + (({m1}) / d) ** 2"
        return f"CASE WHEN d = 0 THEN 0.0 WHEN {r} > 9 THEN 3 / sqrt({r}) * ({m}) ELSE {m} END"

    step = f"{limited('m', 'nxt', 'm')} AS ml, {limited('m', 'nxt', 'nxt')} AS mr"
    return f"""
    {name}_knots AS (SELECT id, i, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM {source} WINDOW w AS (PARTITION BY id ORDER BY i)),
    {name}_d AS (SELECT *, (y1 - y0) / (x1 - x0) AS d FROM {name}_knots WHERE x1 IS NOT NULL),
    {name}_n AS (SELECT *, coalesce((d + lead(d) OVER (PARTITION BY id ORDER BY i)) / 2, d) AS nxt FROM {name}_d),
    {name}_walk(id, i, ml, mr) AS (
        SELECT id, i, {step} FROM (SELECT *, d AS m FROM {name}_n WHERE i = 1)
        UNION ALL
        SELECT id, i, {step} FROM (SELECT s.*, w.mr AS m FROM {name}_walk w JOIN {name}_n s ON s.id = w.id AND s.i = w.i + 1)),
    {name} AS (SELECT id, x0, x1, y0, y1, ml AS m0, coalesce(lead(ml) OVER v, mr) AS m1, lead(ml) OVER v IS NULL AS last
        FROM {name}_n JOIN {name}_walk USING (id, i) WINDOW v AS (PARTITION BY id ORDER BY i))"""


def value_sql(c: str, x: str) -> str:
    t, h = f"(({x} - {c}.x0) / ({c}.x1 - {c}.x0))", f"({c}.x1 - {c}.x0)"
    return (f"((1 + 2 * {t}) * (1 - {t}) ** 2 * {c}.y0 + {t} * (1 - {t}) ** 2 * {h} * {c}.m0"
            f" + {t} * {t} * (3 - 2 * {t}) * {c}.y1 + {t} * {t} * ({t} - 1) * {h} * {c}.m1)")


def at_sql(c: str, x: str) -> str:
    return f"({x} >= {c}.x0 AND ({x} < {c}.x1 OR ({c}.last AND {x} = {c}.x1)))"


def seen_ctes(stimuli: str, receptors: list) -> str:
    """CTEs ending in ``whole(id, v)``: what an eye gets of ``stimuli(id, reflects, i, x, y)`` at every nanometre of the
    receptors, reflectances under the sun; and ``sense(id, w)``: the receptors there, times trapezoid widths."""
    sun, all_of = Bundle.of(SOLAR), [Bundle.of(r) for r in receptors]
    assert all(b.lo[0] == LOW and b.hi[0] == HIGH for b in all_of)
    knots = " UNION ALL ".join(f"SELECT {n} AS id, unnest(range(1, {b.n[0] + 1})) AS i, unnest({nums(b.x[0])}) AS x, unnest({nums(b.y[0])}) AS y" for n, b in enumerate(all_of))
    return f"""
    nm AS (SELECT CAST({LOW} + i AS DOUBLE) AS x FROM range(0, {int(HIGH - LOW) + 1}) t(i)),
    pigment AS ({knots}),
    {cubic_ctes('pigment', 'receptor')},
    sense AS (SELECT id, list({value_sql('r', 'nm.x')} * CASE WHEN nm.x IN ({LOW}, {HIGH}) THEN 0.5 ELSE 1.0 END ORDER BY nm.x) AS w
        FROM receptor r JOIN nm ON {at_sql('r', 'nm.x')} GROUP BY id),
    sun AS (SELECT 0 AS id, unnest(range(1, {sun.x.shape[1] + 1})) AS i, unnest({nums(sun.x[0])}) AS x, unnest({nums(sun.y[0])}) AS y),
    {cubic_ctes('sun', 'shine')},
    stim AS ({stimuli}),
    {cubic_ctes('(SELECT id, i, x, y FROM stim WHERE reflects)', 'own')},
    span AS (SELECT id, greatest(min(x), {num(sun.lo[0])}) AS a, least(max(x), {num(sun.hi[0])}) AS b FROM stim WHERE reflects GROUP BY id),
    grid AS (SELECT id, j, a + j AS x FROM span, range(0, {BANDS * 10}) t(j) WHERE j <= greatest(floor(b - a + 0.5), 1) AND a + j <= b),
    lit AS (SELECT g.id, CAST(g.j + 1 AS BIGINT) AS i, g.x, {value_sql('o', 'g.x')} * {value_sql('s', 'g.x')} AS y
        FROM grid g JOIN own o ON o.id = g.id AND {at_sql('o', 'g.x')} JOIN shine s ON {at_sql('s', 'g.x')}),
    {cubic_ctes('(SELECT * FROM lit UNION ALL SELECT id, i, x, y FROM stim WHERE NOT reflects)', 'eye')},
    part AS (SELECT id, list({value_sql('e', 'nm.x')} ORDER BY nm.x) AS v, min(nm.x) AS first FROM eye e JOIN nm ON {at_sql('e', 'nm.x')} GROUP BY id),
    whole AS (SELECT id, list_concat(list_concat([0.0::DOUBLE FOR z IN range(CAST(first - {LOW} AS BIGINT))], v),
        [0.0::DOUBLE FOR z IN range({int(HIGH - LOW) + 1} - CAST(first - {LOW} AS BIGINT) - len(v))]) AS v FROM part)"""


def observed_sql(k, first: int, source: str, keep: str) -> str:
    """Rows ``keep, q, c`` of an observer over the lists of ``whole``; its receptors in ``sense`` begin at ``first``."""
    rows = []
    for n, (gain, cap) in enumerate(zip(k.gains, k.caps)):
        q = f"list_inner_product(v, (SELECT w FROM sense WHERE id = {first + n})) * {num(gain)}"
        rows.append(f"least({q}, {num(cap)})" if np.isfinite(cap) else q)
    text = f"SELECT {keep}, [{', '.join(rows)}] AS q FROM {source}"
    text = f"SELECT {keep}, {mul('q', k.adaptation)} AS q FROM ({text})"
    return f"SELECT {keep}, q, {mul('q', k.opponent)} AS c FROM ({text})"


def _saturation(c: str, k) -> str:
    return f"sqrt({' + '.join(f'{c}[{i + 2}] ** 2' for i in range(k.chroma))})"


# ------------------------------------------------------------------ any axis


def _odd_sql() -> str:
    k = O.observe(builtin("Human"), SOLAR, 0)
    stimuli = " UNION ALL ".join(
        f"SELECT vec_id * 2 + {a} AS id, TRUE AS reflects, unnest(range(1, {BANDS + 1})) AS i, unnest({nums(axis)}) AS x, "
        "unnest(CAST(embedding AS DOUBLE[])) AS y FROM embeddings" for a, axis in enumerate((SENSOR, UNEVEN)))
    cols = f"{rsql('c[1]')} AS luminance, {rsql('c[2]')} AS c1, {rsql('c[3]')} AS c2, {rsql(_saturation('c', k))} AS saturation"
    return f"WITH RECURSIVE {seen_ctes(stimuli, list(k.receptors))} SELECT id // 2 AS vec_id, id % 2 AS axis, {cols} FROM ({observed_sql(k, 0, 'whole', 'id')})"


@query(_odd_sql)
def coordinates_odd_axis(spark, sf):
    """Every spectrum read on a sensor's axis that starts off the nanometre, and on an uneven one."""
    s = spectra(spark, sf).drop("label")
    both = [compare.coordinates(s, odd_kernel(axis)).withColumn("axis", F.lit(a)) for a, axis in enumerate((SENSOR, UNEVEN))]
    return both[0].unionByName(both[1]).select(
        "vec_id", F.col("axis").cast("long").alias("axis"), rnd("luminance").alias("luminance"), rnd(F.col("chroma")[0]).alias("c1"),
        rnd(F.col("chroma")[1]).alias("c2"), rnd("saturation").alias("saturation"),
    )


# ------------------------------------------------------------------ points of their own


def _knot(b):
    """Wavelength of band ``b`` of a stimulus: three kinds of axis, the third in seven variants."""
    m = F.col("vec_id") % 3
    return F.when(m == 0, 397.32 + 5.0 * b).when(m == 1, 400.0 + 4.6 * b + 0.01 * b * b).otherwise(301.5 + 6.9 * b + 0.25 * (F.col("vec_id") % 7))


_KNOT = ("CASE vec_id % 3 WHEN 0 THEN 397.32::DOUBLE + 5.0::DOUBLE * b WHEN 1 THEN 400.0::DOUBLE + 4.6::DOUBLE * b + 0.01::DOUBLE * b * b "
         "ELSE 301.5::DOUBLE + 6.9::DOUBLE * b + 0.25::DOUBLE * (vec_id % 7) END")


def own_points(spark, sf):
    """Embeddings as curves of four kinds, each with knots of its own."""
    s = spread(spectra(spark, sf))
    m = F.col("vec_id") % 4
    kind = F.when(m == 0, quantity("Reflectance")).when(m == 1, quantity("Radiance", "relative")).when(m == 2, quantity("Absorption")).otherwise(quantity("Unspecified"))
    points = F.transform("spectrum", lambda v, b: F.struct(_knot(b.cast("double")).alias("wl"), v.cast("double").alias("v")))
    return s.select("vec_id", "label", F.concat(F.lit("stimulus "), F.col("vec_id").cast("string")).alias("name"), kind.alias("quantity"), points.alias("points"))


_OWN = (f"SELECT id, reflects, b + 1 AS i, {_KNOT} AS x, y FROM (SELECT vec_id AS id, vec_id, vec_id % 4 = 0 AS reflects, unnest(range({BANDS})) AS b, "
        "unnest(CAST(embedding AS DOUBLE[])) AS y FROM embeddings WHERE vec_id % 4 <> 2)")


def _observed(select: str) -> str:
    """SQL over one table ``t<i>(vec_id, q, c)`` per observer."""
    ks = everyone().observers
    first = np.cumsum([0, *(len(k.receptors) for k in ks)])
    tables = ", ".join(f"t{i} AS ({observed_sql(k, first[i], '(SELECT id AS vec_id, v FROM whole)', 'vec_id')})" for i, k in enumerate(ks))
    return f"WITH RECURSIVE {seen_ctes(_OWN, [r for k in ks for r in k.receptors])}, {tables} {select}"


def _panel_sql() -> str:
    return _observed(" UNION ALL ".join(
        f"SELECT vec_id, '{k.system}' AS system, '{k.regime}' AS regime, {rsql('c[1]')} AS luminance, {rsql(_saturation('c', k))} AS saturation, "
        f"CAST({k.chroma} AS BIGINT) AS axes, {rsql('q[1]')} AS first_receptor FROM t{i}" for i, k in enumerate(everyone().observers)))


@query(_panel_sql)
def point_coordinates_all_systems(spark, sf):
    """Stimuli with their own knots as every system sees them, in one pass."""
    df = compare.panel_coordinates(own_points(spark, sf), everyone())
    return df.select(
        "vec_id", "system", "regime", rnd("luminance").alias("luminance"), rnd("saturation").alias("saturation"),
        F.size("chroma").cast("long").alias("axes"), rnd(F.col("adapted")[0]).alias("first_receptor"),
    )


def _distance(metric: str, k, a: str, b: str) -> str:
    if metric == compare.DELTA_S:
        if k.noise is None:
            return "CAST(NULL AS DOUBLE)"
        return f"sqrt({' + '.join(f'(({a}.q[{i + 1}] - {b}.q[{i + 1}]) / {num(e)}) ** 2' for i, e in enumerate(k.noise))})"
    return f"sqrt({' + '.join(f'({a}.c[{i + 1}] - {b}.c[{i + 1}]) ** 2' for i in range(k.chroma + 1))})"


def _export_sql() -> str:
    cols, ks = [], everyone().observers
    for i, k in enumerate(ks):
        cols += [f"t{i}.c[{j + 1}]" for j in range(k.chroma + 1)] + [_saturation(f"t{i}.c", k), _distance(compare.EUCLIDEAN, k, f"t{i}", f"r{i}")]
    joins = " ".join(f"JOIN t{i} USING (vec_id)" for i in range(1, len(ks))) + "".join(f" JOIN t{i} r{i} ON r{i}.vec_id = 0" for i in range(len(ks)))
    return _observed(f"SELECT 'stimulus ' || t0.vec_id AS stimulus, {', '.join(f'{rsql(c)} AS v{n}' for n, c in enumerate(cols))} FROM t0 {joins}")


@query(_export_sql)
def point_batch_export(spark, sf):
    """The wide export from stimuli with their own knots, with the distance to stimulus 0."""
    s = own_points(spark, sf)
    df = compare.batch_export(s, everyone(), spectrum="points", reference=s.where("vec_id = 0"))
    return df.select(F.col("Stimulus").alias("stimulus"), *[rnd(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(df.columns[1:])])


_FIRSTS = "(SELECT min(vec_id) AS vec_id FROM embeddings WHERE vec_id % 4 <> 2 GROUP BY label)"


def _first_of_labels(s):
    """The first stimulus of every label that can be seen."""
    seen = s.where("quantity.kind <> 'Absorption'")
    return seen.groupBy("label").agg(F.min_by(F.struct("vec_id", "quantity", "points"), "vec_id").alias("s")).select("s.*")


def _references_sql() -> str:
    return _observed(" UNION ALL ".join(
        f"SELECT a.vec_id, '{k.system}' AS system, r.vec_id AS ref_id, {rsql(_distance(compare.DELTA_S, k, 'a', 'r'))} AS distance "
        f"FROM t{i} a, t{i} r WHERE r.vec_id IN {_FIRSTS}" for i, k in enumerate(everyone().observers)))


@query(_references_sql)
def point_reference_distances(spark, sf):
    """Receptor-noise distances of every stimulus to the first of each label, for every system."""
    s, panel = own_points(spark, sf).drop("name"), everyone()
    here = compare.panel_coordinates(s, panel)
    refs = compare.panel_coordinates(_first_of_labels(s), panel)
    near = compare.distance_to_references(here, refs, panel.observers, compare.DELTA_S, "vec_id")
    return near.select("vec_id", "system", "ref_id", rnd("distance").alias("distance"))


def _summary_sql() -> str:
    return _observed(" UNION ALL ".join(
        f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, '{k.system}' AS system, '{k.regime}' AS regime, CAST({k.noise is not None} AS BIGINT) AS complete, "
        f"{rsql(_distance(compare.DELTA_S, k, 'a', 'b'))} AS delta_s FROM t{i} a JOIN t{i} b ON a.vec_id < b.vec_id "
        f"WHERE a.vec_id IN {_FIRSTS} AND b.vec_id IN {_FIRSTS}" for i, k in enumerate(everyone().observers)))


@query(_summary_sql)
def point_species_summary(spark, sf):
    """Pairs of the labels' first stimuli by species: dominant regime, whether its noise data are complete, distance."""
    coords = compare.panel_coordinates(_first_of_labels(own_points(spark, sf)), everyone())
    df = compare.species_summary(coords, everyone().observers, "vec_id")
    return df.select("a_id", "b_id", "system", "regime", F.col("has_complete_noise_data").cast("long").alias("complete"), rnd("delta_s").alias("delta_s"))


# ------------------------------------------------------------------ corpora


def _covariance_sql() -> str:
    parts, first, ks = [], 0, everyone().observers
    for k in ks:
        rows = []
        for n, cap in enumerate(k.caps):
            q = f"list_inner_product(v, (SELECT w FROM sense WHERE id = {first + n}))"
            rows.append(f"least({q}, {num(cap)})" if np.isfinite(cap) else q)
        parts.append(f"SELECT id, '{k.system}' AS system, [{', '.join(rows)}] AS q FROM whole")
        first += len(k.receptors)
    return f"""WITH RECURSIVE {seen_ctes(_OWN, [r for k in ks for r in k.receptors])},
    r AS (SELECT system, id % 3 + 1 AS w, q FROM ({" UNION ALL ".join(parts)})),
    l AS (SELECT system, w, i, q[i] AS x, q FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM r)),
    m AS (SELECT system, i, sum(w * x) / sum(w) AS mean FROM l GROUP BY system, i),
    p AS (SELECT l.system, l.w, l.i, j, x, q[j] AS y FROM (SELECT *, unnest(range(i, len(q) + 1)) AS j FROM l) l)
    SELECT p.system, p.i - 1 AS i, p.j - 1 AS j, count(*) AS n, CAST(sum(w) AS DOUBLE) AS weight, {rsql('any_value(a.mean)')} AS mean,
        {rsql('sum(w * (x - a.mean) * (y - b.mean)) / sum(w)')} AS cov
    FROM p JOIN m a ON a.system = p.system AND a.i = p.i JOIN m b ON b.system = p.system AND b.i = p.j GROUP BY ALL"""


@query(_covariance_sql)
def point_corpus_covariance(spark, sf):
    """Response covariance of every system over a weighted corpus of curves with their own knots, in one scan."""
    corpus = own_points(spark, sf).where("quantity.kind <> 'Absorption'")
    df = opponent.panel_covariance(corpus, everyone(), F.col("vec_id") % 3 + 1)
    size = F.size("mean")
    long = F.flatten(F.transform("mean", lambda m, i: F.transform(F.sequence(i, size - 1), lambda j: F.struct(
        i.cast("long").alias("i"), j.cast("long").alias("j"), m.alias("m"), F.get("cov", i * size - (i * (i - 1) / 2).cast("int") + j - i).alias("c")))))
    return df.select("system", "n", "weight", F.inline(long)).select("system", "i", "j", "n", "weight", rnd("m").alias("mean"), rnd("c").alias("cov"))
