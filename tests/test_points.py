"""Stimuli on any axis and with points of their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsinlake.catalog.base import SOLAR, UNIFORM
from opsinlake.functions.monotone import Bundle, tangents
from opsinlake.operators import compare, moments, opponent
from opsinlake.operators.cubes import quantity
from opsinlake.plans import kernel as K
from opsinlake.plans import observers as O
from opsinlake.plans.systems import builtin, product_integral

POINTS = "id long, kind string, points array<struct<wl:double,v:double>>"
AXES = {
    "sensor": np.arange(397.32, 720, 5), "uneven": np.sort(np.random.default_rng(1).uniform(310, 740, 40)), "beyond": np.arange(280.5, 790, 7.3),
    "aligned": np.arange(400.0, 720, 5), "below": np.arange(200.0, 290, 10), "short": np.array([400.2, 400.5]), "two": np.array([350.0, 700.0]),
}


def lit_points(axis, row, light):
    """Product with a light by the definition: whole steps from the lower end of the common domain."""
    own, lamp = Bundle.of(np.column_stack([axis, row])), Bundle.of(light)
    lo, hi = max(own.lo[0], lamp.lo[0]), min(own.hi[0], lamp.hi[0])
    if not hi > lo:
        return np.zeros((0, 2))
    grid = lo + np.arange(max(math.floor(hi - lo + 0.5), 1) + 1)
    v = own.resample(grid)[0] * lamp.resample(grid)[0]
    return np.column_stack([grid, v])[~np.isnan(v)]


@pytest.mark.parametrize("name", AXES)
@pytest.mark.parametrize("light", [SOLAR, UNIFORM, ((410.3, 1.0), (433.0, 2.0), (555.5, 0.5), (690.0, 1.0))])
def test_integrals_on_any_axis(name, light):
    axis, system = AXES[name], builtin("Human")
    y = np.random.default_rng(0).random((3, len(axis)))
    stack = O.ReceptorStack([r.points for r in system.pool], light)
    want = np.array([[product_integral(r.points, lit_points(axis, row, light)) for r in system.pool] for row in y])
    raw = np.array([[product_integral(r.points, np.column_stack([axis, row])) for r in system.pool] for row in y])
    same, own = Bundle.on(axis, y), Bundle(np.tile(axis, 3), y.ravel(), [len(axis)] * 3)
    for curves in (same, own):
        assert np.allclose(stack.seen(curves, np.ones(3, bool)), want, atol=1e-10)
        assert np.allclose(stack.seen(curves, np.zeros(3, bool)), raw, atol=1e-10)
    k = K.compile_curves(system, 0, axis, light)
    m = tangents(np.broadcast_to(axis, y.shape), y, np.full(3, len(axis)))
    if k.lit is not None:
        y = k.lit.products(y, m)
        m = tangents(np.broadcast_to(k.lit.grid, y.shape), y, np.full(3, y.shape[1]))
    n = len(k.gains)
    assert np.allclose(y @ k.value_weights.T + m @ k.slope_weights.T, want[:, :n], atol=1e-10)


def test_curves_of_different_knots_in_one_batch():
    rng = np.random.default_rng(5)
    knots = [np.sort(rng.uniform(250, 800, n)) for n in (0, 1, 2, 5, 5, 90)] + [AXES["sensor"], AXES["sensor"]]
    values = [rng.random(len(x)) for x in knots]
    curves = Bundle(np.concatenate(knots), np.concatenate(values), [len(x) for x in knots])
    receptors = [r.points for r in builtin("Swallowtail").pool]
    reflects = np.arange(len(knots)) % 2 == 0
    got = O.ReceptorStack(receptors, SOLAR).seen(curves, reflects)
    for row, x, y, lit in zip(got, knots, values, reflects):
        points = lit_points(x, y, SOLAR) if lit and len(x) else np.column_stack([x, y])
        assert np.allclose(row, [product_integral(r, points) for r in receptors], atol=1e-10)


def table_of(spark, rows):
    df = spark.createDataFrame(rows, POINTS)
    of = F.lit(None)
    for name in ("Reflectance", "Absorption", "Radiance", "Unspecified"):
        of = F.when(F.col("kind") == name, quantity(name)).otherwise(of)
    return df.withColumn("quantity", of)


def test_panel_agrees_with_single_systems(spark):
    rng = np.random.default_rng(2)
    kinds = ["Reflectance", "Radiance", "Absorption", "Unspecified", None]
    rows = [(i, kinds[i % 5], [(float(x), float(v)) for x, v in zip(np.sort(rng.uniform(290, 780, 20)), rng.random(20))]) for i in range(20)]
    rows += [(100, "Reflectance", []), (101, "Radiance", None), (102, "Reflectance", [(100.0, 1.0), (120.0, 1.0)])]
    s = table_of(spark, rows)
    systems = [builtin("Human"), builtin("Honeybee"), builtin("Mantis")]
    got = {(r.id, r.system): r for r in compare.panel_coordinates(s, O.panel(systems, SOLAR)).collect()}
    assert {k[0] for k in got} == {r[0] for r in rows if r[1] != "Absorption"} and {k[1] for k in got} == {x.name for x in systems[:2]}
    for system in systems[:2]:
        one = compare.point_coordinates(s.where("quantity is not null and points is not null"), system.name, K.regime_state(system, system.regimes[0], SOLAR), SOLAR)
        for r in one.collect():
            near = got[r.id, system.name]
            assert np.allclose([near.luminance, near.saturation, *near.chroma, *near.adapted], [r.luminance, r.saturation, *r.chroma, *r.adapted], atol=1e-9)
    assert got[101, systems[0].name].luminance is None and got[100, systems[0].name].luminance == 0.0


def test_export_is_checked_before_it_is_written(spark, tmp_path):
    s = table_of(spark, [(1, "Reflectance", [(400.0, 0.1), (700.0, 0.9)]), (2, "Absorption", [(400.0, 0.1), (700.0, 0.9)])]).withColumn("name", F.lit("a"))
    panel, out = O.panel([builtin("Human")], SOLAR), str(tmp_path / "out")
    with pytest.raises(ValueError, match="no stimulus"):
        compare.write_export(out, s.where("id = 2"), panel, spectrum="points")
    with pytest.raises(ValueError, match="exactly one reference"):
        compare.write_export(out, s, panel, spectrum="points", reference=s.where("id = 2"))
    with pytest.raises(ValueError, match="colour space"):
        compare.write_export(out, s, O.panel([builtin("Mantis")], SOLAR), spectrum="points")
    assert not (tmp_path / "out").exists()
    compare.write_export(out, s, panel, spectrum="points", reference=s.where("id = 1"))
    rows = spark.read.option("header", True).csv(out).collect()
    assert len(rows) == 1 and rows[0].Stimulus == "a" and float(rows[0][-1]) == 0.0


def test_species_summary_names_regime_and_completeness(spark):
    s = table_of(spark, [(i, "Reflectance", [(400.0, 0.1 * i), (700.0, 0.9)]) for i in range(3)])
    panel = O.panel([builtin("Human"), builtin("Swallowtail")], SOLAR)
    complete = {o.system: o.noise is not None for o in panel.observers}
    got = compare.species_summary(compare.panel_coordinates(s, panel), panel.observers).collect()
    assert len(got) == 6
    for r in got:
        assert r.has_complete_noise_data == complete[r.system] == (r.delta_s is not None)
        assert r.regime == next(o.regime for o in panel.observers if o.system == r.system)


# ------------------------------------------------------------------ moments


@pytest.mark.parametrize("mean", [0.0, 1e6, 1e9])
def test_moments_of_large_means(spark, mean):
    rng = np.random.default_rng(4)
    x = mean + rng.normal(size=(2000, 3)) @ rng.normal(size=(3, 3))
    w, g = rng.integers(0, 4, 2000).astype(float), rng.integers(0, 3, 2000)
    rows = [(int(a), float(b), c.tolist()) for a, b, c in zip(g, w, x)] + [(9, 1.0, [1.0, 2.0, 3.0]), (8, 0.0, [1.0] * 3), (8, 0.0, [2.0] * 3), (7, None, None), (None, 1.0, [1.0] * 3), (None, 1.0, [3.0] * 3)]
    df = spark.createDataFrame(rows, "g int, w double, v array<double>").repartition(7)
    got = {r.g: r for r in moments.co_moments(df, "v", "w", ["g"]).collect()}
    assert set(got) == {0, 1, 2, 8, 9, None} and got[9].mean is None and got[8].cov is None and got[9].n == 1
    assert got[None].mean == [2.0] * 3 and got[None].cov == [1.0] * 6
    for k in range(3):
        a, b = x[g == k], w[g == k]
        cov = np.cov(a.T, aweights=b, bias=True)[np.triu_indices(3)]
        assert got[k].n == len(a) and got[k].weight == b.sum()
        assert np.allclose(got[k].mean, np.average(a, axis=0, weights=b), rtol=1e-12) and np.allclose(got[k].cov, cov, rtol=1e-6)
    all_of = moments.co_moments(df.where("g < 3"), "v", "w").first()
    assert np.allclose(all_of.cov, np.cov(x.T, aweights=w, bias=True)[np.triu_indices(3)], rtol=1e-6)
    assert moments.co_moments(df.limit(0), "v", "w", ["g"]).count() == 0


def test_panel_covariance_scans_once(spark, capsys):
    s = table_of(spark, [(i, "Reflectance", [(400.0, 0.1 * i), (550.0, 0.5), (700.0, 0.9 - 0.1 * i)]) for i in range(6)])
    panel = O.panel([builtin("Human"), builtin("Honeybee")], SOLAR)
    df = opponent.panel_covariance(s, panel, F.col("id") + 1)
    df.explain()
    assert capsys.readouterr().out.count("Scan") == 1
    got = {r.system: r for r in df.collect()}
    for o in panel.observers:
        q = np.array([[product_integral(p, lit_points([400.0, 550.0, 700.0], [0.1 * i, 0.5, 0.9 - 0.1 * i], SOLAR)) for p in o.receptors] for i in range(6)])
        q = np.fmin(q, o.caps)
        n = len(o.receptors)
        assert np.allclose(got[o.system].cov, np.cov(q.T, aweights=np.arange(6) + 1.0, bias=True)[np.triu_indices(n)])


def test_ungated_kernels_still_resample():
    k = opponent.ungated(K.compile_curves(builtin("Human"), 0, AXES["sensor"], SOLAR))
    assert k.lit is not None and k.opponent is None and (k.gains == 1).all()
