"""Pigment and light generator queries, swept over part, line-item and order attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsinlake import constants as C
from opsinlake.catalog.base import SOLAR, query, rnd, rsql, table
from opsinlake.functions import color, lights, pigment
from opsinlake.operators import colors, curves, opponent
from opsinlake.plans.adaptation import common_grid
from opsinlake.plans.systems import builtin
from opsinlake.session import spread

PEAK_SQL = "CAST(340 + 6 * p_size AS DOUBLE)"


def _peaks(spark, sf):
    p = spread(table(spark, sf, "part"))
    return p.select("p_partkey", "p_size", "p_retailprice", "p_brand", (340.0 + 6.0 * F.col("p_size")).alias("peak"))


def template_sql(chromophore: str, peak: str, wl: str) -> str:
    x = f"(({peak}) / ({wl}))"
    if chromophore == "A1":
        a = f"(0.8795 + 0.0459 * exp(-pow(({peak}) - 300.0, 2) / 11940.0))"
        amp, centre, width = "0.26", f"(189.0 + 0.315 * ({peak}))", f"(-40.5 + 0.195 * ({peak}))"
    else:
        g = f"exp((({peak}) - 665.0) / 40.7)"
        a, amp = f"(0.875 + 0.0268 * {g})", f"(0.26 + 0.0215 * {g})"
        centre = f"(216.7 + 0.368 * ({peak}))"
        width = f"(317.0 - 1.149 * ({peak}) + 0.00124 * pow({peak}, 2))"
    alpha = f"1.0 / (exp(69.7 * ({a} - {x})) + exp(28.0 * (0.922 - {x})) + exp(-14.9 * (1.104 - {x})) + 0.674)"
    return f"({alpha} + {amp} * exp(-pow((({wl}) - {centre}) / {width}, 2)))"


def _templates_sql():
    def tops(c):
        return f"SELECT p_size, max({template_sql(c, 'peak', 'peak - 5 + 0.05 * i')}) AS top FROM peaks, range(201) t(i) GROUP BY p_size"

    wls = (350.0, 450.0, 550.0, 650.0)
    cols = []
    for c in ("A1", "A2"):
        for w in wls:
            value = f"{template_sql(c, 'peak', str(w))} / {c}.top"
            cols.append(f"{rsql(value, 7)} AS {c.lower()}_{int(w)}")
    return (
        f"WITH peaks AS (SELECT DISTINCT p_size, {PEAK_SQL} AS peak FROM part), a AS ({tops('A1')}), b AS ({tops('A2')}), "
        f"v AS (SELECT p_size, {', '.join(cols)} FROM peaks JOIN a A1 USING (p_size) JOIN b A2 USING (p_size)) "
        "SELECT p_partkey, v.* EXCLUDE (p_size) FROM part JOIN v USING (p_size)"
    )


@query(_templates_sql)
def pigment_templates(spark, sf):
    """Both chromophore templates of one pigment per part, on the receptor grid."""
    p = _peaks(spark, sf)
    cols = []
    for c in ("A1", "A2"):
        p = p.withColumn(f"_{c}", pigment.template_peak(c, F.col("peak")))
        for w in (350.0, 450.0, 550.0, 650.0):
            v = pigment.template_raw(c, F.col("peak"), F.lit(w), F.exp) / F.col(f"_{c}")
            cols.append(rnd(v, 7).alias(f"{c.lower()}_{int(w)}"))
    return p.select("p_partkey", *cols)


def _curves_sql():
    top = f"SELECT p_size, max({template_sql('A1', 'peak', 'peak - 5 + 0.05 * i')}) AS top FROM peaks, range(201) t(i) GROUP BY p_size"
    raw = f"SELECT p_size, 300.0 + 5.0 * i AS wl, {template_sql('A1', 'peak', '(300.0 + 5.0 * i)')} / top AS v FROM peaks JOIN tops USING (p_size), range(91) t(i)"
    return (
        f"WITH peaks AS (SELECT DISTINCT p_size, {PEAK_SQL} AS peak FROM part), tops AS ({top}), c AS ({raw}), "
        f"s AS (SELECT p_size, count(*) AS knots, {rsql('sum(v)')} AS total, {rsql('max(v)')} AS highest FROM c GROUP BY p_size) "
        "SELECT p_partkey, knots, total, highest FROM part JOIN s USING (p_size)"
    )


@query(_curves_sql)
def pigment_curves(spark, sf):
    """Whole template curves, 300-750 nm in 5 nm steps."""
    c = _peaks(spark, sf).withColumn("points", pigment.template_points("A1", F.col("peak"), 300.0, 750.0, 5.0))
    v = F.transform("points", lambda q: q["v"])
    return c.select(
        "p_partkey", F.size("points").cast("long").alias("knots"),
        rnd(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total"), rnd(F.array_max(v)).alias("highest"),
    )


def _droplet_sql():
    top = f"SELECT p_size, max({template_sql('A1', 'peak', 'peak - 5 + 0.05 * i')}) AS top FROM peaks, range(201) t(i) GROUP BY p_size"
    drop = "1.0 / (1.0 + exp(-(wl - cut) / 8.0))"
    return (
        f"WITH peaks AS (SELECT DISTINCT p_size, {PEAK_SQL} AS peak FROM part), tops AS ({top}), "
        f"c AS (SELECT p_size, 300.0 + 5.0 * i AS wl, {template_sql('A1', 'peak', '(300.0 + 5.0 * i)')} / top AS v "
        "FROM peaks JOIN tops USING (p_size), range(91) t(i)), "
        "d AS (SELECT p_partkey, p_size, 200.0 + p_retailprice % 400 AS cut FROM part) "
        f"SELECT p_partkey, count(*) AS knots, {rsql(f'sum(v * {drop})')} AS total, {rsql(f'max(v * {drop})')} AS highest "
        "FROM d JOIN c USING (p_size) GROUP BY p_partkey"
    )


@query(_droplet_sql)
def droplet_effective(spark, sf):
    """Each pigment behind an oil droplet of its own cut-off: two curve columns multiplied on their common domain."""
    p = _peaks(spark, sf)
    cut = 200.0 + F.col("p_retailprice") % 400
    grid = F.sequence(F.lit(0), F.lit(90))
    droplet = F.transform(grid, lambda i: F.struct(
        (300.0 + i * F.lit(5.0)).alias("wl"),
        pigment.droplet_transmittance(300.0 + i * F.lit(5.0), cut, F.lit(C.DROPLET_STEEPNESS_NM)).alias("v"),
    ))
    c = p.withColumn("opsin", pigment.template_points("A1", F.col("peak"), 300.0, 750.0, 5.0))
    c = c.withColumn("droplet", droplet)
    both = curves.multiply_curves(c, "opsin", "droplet", 5.0, "points")
    v = F.transform("points", lambda q: q["v"])
    return both.select(
        "p_partkey", F.size("points").cast("long").alias("knots"),
        rnd(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total"), rnd(F.array_max(v)).alias("highest"),
    )


def planck_sql(wl: str, t: str) -> str:
    h, c, k = C.PLANCK_H, C.LIGHT_C, C.BOLTZMANN_K
    m = f"(({wl}) * 1e-9)"
    return f"(2.0 * {h!r} * pow({c!r}, 2) / (pow({m}, 5) * (exp({h!r} * {c!r} / ({m} * {k!r} * ({t}))) - 1)) * 1e-9)"


def _blackbody_sql():
    notch = " * ".join(
        f"(1.0 - {d!r} * exp(-0.5 * pow((wl - {c!r}) / {w!r}, 2)))" for _, c, w, d in C.NOTCHES
    )
    raw = f"SELECT p_partkey, t, wl, {planck_sql('wl', 't')} AS b FROM (SELECT p_partkey, 1500.0 + 4 * p_retailprice AS t FROM part), (SELECT 300.0 + 20.0 * i AS wl FROM range(46) r(i))"
    top = f"SELECT *, b / max(b) OVER (PARTITION BY p_partkey) * {notch} AS v FROM ({raw})"
    return (
        f"SELECT p_partkey, count(*) AS knots, {rsql('sum(v)')} AS total, {rsql('max(CASE WHEN wl = 560 THEN v END)')} AS at_560, "
        f"{rsql('max(CASE WHEN wl = 760 THEN v END)')} AS at_760 FROM ({top}) GROUP BY p_partkey"
    )


@query(_blackbody_sql)
def blackbody_lights(spark, sf):
    """One black body per part, with every atmospheric notch."""
    p = table(spark, sf, "part").select("p_partkey", (1500.0 + 4 * F.col("p_retailprice")).alias("t"))
    notches = [n[1:] for n in C.NOTCHES]
    c = p.withColumn("points", lights.blackbody_points(F.col("t"), 300.0, 1200.0, 20.0, notches))

    def at(w):
        return F.element_at(F.filter("points", lambda q: q["wl"] == w), 1)["v"]

    total = F.aggregate("points", F.lit(0.0), lambda s, q: s + q["v"])
    return c.select("p_partkey", F.size("points").cast("long").alias("knots"), rnd(total).alias("total"),
                    rnd(at(560.0)).alias("at_560"), rnd(at(760.0)).alias("at_760"))


def _composite_sql():
    g = "l_tax * (l_quantity / 50) * exp(-0.5 * pow((wl - (300 + l_partkey % 450)) / (2 + l_discount * 300), 2))"
    return (
        f"SELECT l_orderkey, CAST(wl AS BIGINT) AS wl, {rsql(f'sum({g})')} AS v FROM lineitem, "
        "(SELECT 300.0 + 50.0 * i AS wl FROM range(10) r(i)) GROUP BY ALL"
    )


@query(_composite_sql)
def composite_lights(spark, sf):
    """Order = light, line items = its weighted Gaussian peaks, summed on a shared grid."""
    li = table(spark, sf, "lineitem")
    parts = li.select(
        F.col("l_orderkey").alias("light"), (300 + F.col("l_partkey") % 450).cast("double").alias("centre_nm"),
        (F.col("l_quantity") / 50).alias("amplitude"), (2 + F.col("l_discount") * 300).alias("bandwidth_nm"),
        F.col("l_tax").alias("weight"),
    )
    sums = lights.composite_lights(parts, 300.0, 750.0, 50.0)
    return sums.select(F.col("light").alias("l_orderkey"), F.col("wl").cast("long").alias("wl"), rnd("v").alias("v"))


def _notch_sql():
    wl = "(c - half + i * step)"
    t = f"1.0 - d * exp(-0.5 * pow(({wl} - c) / w, 2))"
    src = (
        "SELECT *, 5.0 * greatest(w, 0.001) AS half, least(greatest(w / 4.0, 0.01), 1.0) AS step FROM "
        "(SELECT p_partkey, 400.0 + p_partkey % 300 AS c, p_size / 10.0 AS w, (p_size % 10) / 10.0 AS d FROM part)"
    )
    return (
        f"SELECT p_partkey, count(*) AS knots, {rsql(f'min({wl})')} AS first_nm, {rsql(f'max({wl})')} AS last_nm, "
        f"{rsql(f'min({t})')} AS deepest, {rsql(f'sum({t})')} AS total FROM ({src}), "
        "range(1001) r(i) WHERE i <= ceil(2.0 * half / step) GROUP BY p_partkey"
    )


@query(_notch_sql)
def notch_absorption(spark, sf):
    """One absorption notch per part as a curve."""
    p = table(spark, sf, "part")
    c = p.select("p_partkey", lights.notch_points(
        400.0 + F.col("p_partkey") % 300, F.col("p_size") / 10.0, (F.col("p_size") % 10) / 10.0).alias("points"))
    wl, v = F.transform("points", lambda q: q["wl"]), F.transform("points", lambda q: q["v"])
    return c.select(
        "p_partkey", F.size("points").cast("long").alias("knots"), rnd(F.array_min(wl)).alias("first_nm"),
        rnd(F.array_max(wl)).alias("last_nm"), rnd(F.array_min(v)).alias("deepest"),
        rnd(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total"),
    )


def _gradient_sql(wl):
    def vis(n):
        return {
            "r": f"CASE WHEN {wl} < 440 THEN -({wl} - 440.0) / 60 WHEN {wl} < 510 THEN 0 WHEN {wl} < 580 THEN ({wl} - 510.0) / 70 ELSE 1 END",
            "g": f"CASE WHEN {wl} < 440 THEN 0 WHEN {wl} < 490 THEN ({wl} - 440.0) / 50 WHEN {wl} < 580 THEN 1 WHEN {wl} < 645 THEN -({wl} - 645.0) / 65 ELSE 0 END",
            "b": f"CASE WHEN {wl} < 490 THEN 1 WHEN {wl} < 510 THEN -({wl} - 510.0) / 20 ELSE 0 END",
        }[n]

    dim = f"CASE WHEN {wl} < 420 THEN greatest(0.3, least(1.0, 0.3 + 0.7 * ({wl} - 380.0) / 40)) ELSE 1.0 END"
    out = []
    for n, v in zip("rgb", (0.3, 0.0, 0.3)):
        red = 1.0 if n == "r" else 0.0
        out.append(
            f"CASE WHEN {wl} < 380 THEN {v} + {1 - v} * least(1.0, (380.0 - {wl}) / 180) "
            f"WHEN {wl} > 700 THEN {red} * (1 - least(1.0, ({wl} - 700.0) / 300)) "
            f"ELSE greatest(0.0, least(1.0, ({vis(n)}) * ({dim}))) END"
        )
    return out


def _fit_sql(wl, lobes):
    return " + ".join(
        f"{w!r} * exp(-0.5 * pow(({wl} - {m!r}) / (CASE WHEN {wl} < {m!r} THEN {a!r} ELSE {b!r} END), 2))" for w, m, a, b in lobes
    )


_WL = "(150.0 + o_totalprice % 1000)"


def _spectral_sql():
    g = ", ".join(f"{rsql(e)} AS {n}" for n, e in zip("rgb", _gradient_sql("wl")))
    c = ", ".join(f"{rsql(_fit_sql('wl', lobes))} AS {n}bar" for n, lobes in zip("xyz", (C.CIE_X, C.CIE_Y, C.CIE_Z)))
    return f"SELECT o_orderkey, {g}, {c} FROM (SELECT o_orderkey, {_WL} AS wl FROM orders)"


@query(_spectral_sql)
def spectral_colors(spark, sf):
    """Physical gradient and colour-matching values at one wavelength per order."""
    o = table(spark, sf, "orders").select("o_orderkey", (150.0 + F.col("o_totalprice") % 1000).alias("wl"))
    wl = F.col("wl")
    return o.select(
        "o_orderkey", *[rnd(c).alias(n) for n, c in zip("rgb", color.wavelength_rgb(wl))],
        *[rnd(c).alias(f"{n}bar") for n, c in zip("xyz", color.color_matching(wl))],
    )


def _subjective_sql():
    top = f"SELECT p_size, max({template_sql('A1', 'peak', 'peak - 5 + 0.05 * i')}) AS top FROM peaks, range(201) t(i) GROUP BY p_size"
    resp = f"SELECT p_size, 350.0 + 50.0 * i AS wl, peak, {template_sql('A1', 'peak', '(350.0 + 50.0 * i)')} / top AS v FROM peaks JOIN tops USING (p_size), range(9) t(i)"
    col = [f"floor(({e}) * 255 + 0.5)" for e in _gradient_sql("peak")]
    cols = ", ".join(f"{e} AS {n}" for e, n in zip(col, ("red", "green", "blue")))
    inner = f"SELECT p_brand, wl, v * (p_retailprice / 1000) AS s, {cols} FROM part JOIN c USING (p_size)"
    sums = "SELECT p_brand, wl, sum(s) AS t, sum(red * s) AS red, sum(green * s) AS green, sum(blue * s) AS blue FROM m GROUP BY ALL"
    out = ", ".join(
        f"CAST(round(least(255.0, {n} / t * t / max(t) OVER (PARTITION BY p_brand)), 3) AS DOUBLE) AS {n[0]}" for n in ("red", "green", "blue")
    )
    return (
        f"WITH peaks AS (SELECT DISTINCT p_size, {PEAK_SQL} AS peak FROM part), tops AS ({top}), c AS ({resp}), "
        f"m AS ({inner}), s AS ({sums}) SELECT p_brand, CAST(wl AS BIGINT) AS wl, {out} FROM s"
    )


@query(_subjective_sql)
def subjective_spectrum(spark, sf):
    """Brand = system, part = receptor with its own peak, colour and weight: how each system colours the spectrum."""
    p = _peaks(spark, sf).withColumn("top", pigment.template_peak("A1", F.col("peak")))
    rgb = [F.floor(c * 255 + 0.5).cast("double") for c in color.wavelength_rgb(F.col("peak"))]
    wide = p.select("p_brand", "peak", "top", (F.col("p_retailprice") / 1000).alias("weight"),
                    *[c.alias(n) for n, c in zip(("red", "green", "blue"), rgb)])
    rows = wide.withColumn("wl", F.explode(F.lit([350.0 + 50.0 * i for i in range(9)]))).withColumn(
        "response", pigment.template_raw("A1", F.col("peak"), F.col("wl"), F.exp) / F.col("top"))
    out = colors.subjective_spectrum(rows, ("p_brand",), whole=False)
    return out.select("p_brand", F.col("wl").cast("long").alias("wl"), *[rnd(n, 3).alias(n) for n in "rgb"])


_SMOOTH_STEP = 10.0


def _smooth_sql():
    cells = common_grid([*[r.points for r in builtin("Human").pool], SOLAR], _SMOOTH_STEP)
    t = cells[:-1] * cells[-1]
    keep = [i for i in range(t.shape[1]) if t[:, i].any()]
    rows = ", ".join("(" + ", ".join(repr(float(x)) for x in (i, *t[:, i])) + ")" for i in keep)
    grid = f"(SELECT col0 AS a, CAST(col1 AS DOUBLE) AS t0, CAST(col2 AS DOUBLE) AS t1, CAST(col3 AS DOUBLE) AS t2 FROM (VALUES {rows}))"
    cov = ", ".join(
        f"{rsql(f'{_SMOOTH_STEP ** 2} * sum(x.t{i} * y.t{j} * exp(-abs(x.a - y.a) * {_SMOOTH_STEP} / l))', 4)} AS cov{i}_{j}"
        for i in range(3) for j in range(i, 3)
    )
    return (
        f"WITH g AS {grid}, s AS (SELECT p_size, {cov} FROM (SELECT DISTINCT p_size, 4.0 * p_size AS l FROM part), g x, g y GROUP BY p_size) "
        "SELECT p_partkey, s.* EXCLUDE (p_size) FROM part JOIN s USING (p_size)"
    )


@query(_smooth_sql)
def smooth_scene_covariance(spark, sf):
    """Covariance of human receptors over smooth random reflectances, one correlation length per part."""
    p = spread(table(spark, sf, "part")).select("p_partkey", (4.0 * F.col("p_size")).alias("l"))
    cov = opponent.smooth_covariance([r.points for r in builtin("Human").pool], SOLAR, F.col("l"), _SMOOTH_STEP)
    rows = p.withColumn("cov", cov)
    return rows.select(
        "p_partkey", *[rnd(F.col(f"cov.cov{i}_{j}"), 4).alias(f"cov{i}_{j}") for i in range(3) for j in range(i, 3)]
    )


@query(lambda: f"""WITH o AS (SELECT o_orderkey, len(x) AS n, x FROM (SELECT o_orderkey,
    [o_totalprice / 1000, o_custkey % 97 - 48, o_orderkey % 31 - 15, o_custkey % 5 - 2]::DOUBLE[] AS x FROM orders))
    SELECT o_orderkey, {rsql('atan2(sqrt(x[2] ** 2 + x[3] ** 2 + x[4] ** 2), x[1])')} AS a1,
    {rsql('atan2(sqrt(x[3] ** 2 + x[4] ** 2), x[2])')} AS a2, {rsql('atan2(x[4], x[3])')} AS a3 FROM o""")
def hue_angles(spark, sf):
    """Hyperspherical angles of a four-axis chroma vector per order."""
    from opsinlake.operators.compare import hue_angles as angles

    o = table(spark, sf, "orders")
    x = [F.col("o_totalprice") / 1000, F.col("o_custkey") % 97 - 48, F.col("o_orderkey") % 31 - 15, F.col("o_custkey") % 5 - 2]
    cols = angles([c.cast("double") for c in x])
    return o.select("o_orderkey", *[rnd(a).alias(f"a{i + 1}") for i, a in enumerate(cols)])

