"""Kernels, adaptation and gains against hand-made cases and slow recomputation."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsinlake.functions.gain import gain_value, operating_gain
from opsinlake.functions.monotone import Bundle
from opsinlake.functions.pigment import template_curve
from opsinlake.operators import render
from opsinlake.plans import adaptation as A
from opsinlake.plans import kernel as K
from opsinlake.plans.systems import (
    Receptor, Regime, VisualSystem, builtin, builtin_systems, curve_integral, generic_candidates, luminance_weights,
    product_integral, receptor_noise, resolve,
)

AXIS = tuple(400.0 + 50 * i for i in range(7))
FLAT = ((300.0, 1.0), (750.0, 1.0))


def gaussian(name, mu, sigma, **kw):
    pts = tuple((400.0 + i, math.exp(-0.5 * ((400.0 + i - mu) / sigma) ** 2)) for i in range(301))
    return Receptor(name, pts, **kw)


def trichromat(**kw):
    pool = tuple(gaussian(n, m, s, **kw) for n, m, s in (("S", 440, 35), ("M", 530, 40), ("L", 570, 45)))
    return VisualSystem("test", pool, (Regime("Photopic", (0, 1, 2)),))


def cube(spark, lines=4, samples=5, value=lambda b, r, c: (b * 3 + r * 2 + c) * 0.125):
    rows = [("c", r, c, [value(b, r, c) for b in range(7)]) for r in range(lines) for c in range(samples)]
    return spark.createDataFrame(rows, "cube_id string, line long, sample long, spectrum array<float>")


def test_eleven_systems():
    s = builtin_systems()
    assert len(s) == 11 and [len(x.pool) for x in s.values()] == [3, 2, 3, 3, 12, 4, 3, 2, 6, 5, 12]
    for x in s.values():
        for r in x.pool:
            if len(r.points) == 91 and r.kind == "Sensitivity" and "effective" not in r.name:
                assert 0.95 < max(v for _, v in r.points) <= 1.0 + 1e-9
    with_noise = [n.split(" ")[0] for n, x in s.items() if x.regimes and resolve(x, x.regimes[0]).noise is not None]
    assert with_noise == ["Human", "Honeybee"]


def test_human_noise_and_weights():
    rr = resolve(builtin("Human"), builtin("Human").regimes[0])
    assert rr.noise == pytest.approx([0.05 / math.sqrt(e / 49) for e in (1, 16, 32)])
    assert rr.weights.tolist() == [0.0, 0.4, 0.6]
    bee = builtin("Honeybee").pool
    area = [curve_integral(r.points) for r in bee]
    assert luminance_weights(bee) == pytest.approx([area[0] / sum(area), area[1] / sum(area), 0.8])
    assert receptor_noise([replace(bee[0], eta=None), bee[1]]) is None


def test_template_peak_is_one():
    for c, peak in (("A1", 420.0), ("A1", 560.0), ("A2", 625.0)):
        fine = template_curve(c, peak, peak - 5, peak + 5, 0.05)
        assert fine[:, 1].max() == pytest.approx(1.0, abs=1e-6)


def test_generic_candidates():
    assert generic_candidates(1).tolist() == [[1.0]] and generic_candidates(0).shape == (0, 0)
    assert generic_candidates(3)[1].tolist() == [-0.5, 1.0, -0.5]


def test_chroma_axes_orthonormal():
    for n in range(1, 6):
        w = np.arange(1, n + 1) / n
        axes = K.chroma_axes(generic_candidates(n), w)
        assert axes.shape == (n - 1, n)
        assert np.allclose(axes @ axes.T, np.eye(n - 1), atol=1e-9) and np.allclose(axes @ w, 0, atol=1e-9)


def test_sharpening_invariants():
    for name in ("Dog", "Human", "Pigeon"):
        curves = [r.points for r in resolve(builtin(name), builtin(name).regimes[0]).members]
        m, inv, lam, dominant = A.sharpen(A.gram(curves)[None])
        assert dominant[0] and (np.abs(m[0] - np.eye(len(curves))) < 1).all() and (np.diag(m[0]) == 1).all()
        assert np.allclose(m[0] @ inv[0], np.eye(len(curves)), atol=1e-9)


def test_sharpening_gradient_and_batch():
    curves = [r.points for r in builtin("Honeybee").pool]
    g = A.gram(curves)
    sampled = A.common_grid(curves)

    def objective(m, lam):
        t = m @ sampled
        o = t @ t.T
        return sum(o[i, j] ** 2 for i in range(3) for j in range(i + 1, 3)) + lam * ((m - np.eye(3)) ** 2).sum()

    m = A.descend(g[None], 10.0)[0]
    best = objective(m, 10.0)
    for i in range(3):
        for j in range(3):
            if i != j:
                for d in (-1e-3, 1e-3):
                    trial = m.copy()
                    trial[i, j] += d
                    assert objective(trial, 10.0) >= best - 1e-9 * best
    other = A.gram(curves[:2] + curves[:1])
    both = A.descend(np.stack([g, other, g]), 10.0)
    assert np.array_equal(both[0], m) and np.array_equal(both[2], m) and np.allclose(both[1], A.descend(other[None], 10.0)[0], atol=1e-12)


def test_gain_values(spark):
    cases = [(1.0, None, None, 0.5, 1.0), (0.01, 0.01, None, 0.5, 0.5), (0.01, None, 0.01, 0.5, 0.5),
             (1.0, 5.0, 2.0, 0.5, 1.0), (1.0, -1.0, None, 0.5, 1.0), (0.0, 1e-3, None, 0.5, 0.0),
             (math.nan, 1e-3, None, 0.5, 0.0), (0.0, None, 1e-3, 0.5, 1.0), (1.0, 1.0, None, 0.0, 1.0),
             (0.99, 1.0, None, 0.0, 0.0), (100.0, 1.0, 10.0, 0.25, None)]
    for level, lo, hi, soft, want in cases:
        if want is not None:
            assert gain_value(level, lo, hi, soft) == pytest.approx(want, abs=1e-12)
    df = spark.createDataFrame([(float(a), b, c, d) for a, b, c, d, _ in cases], "e double, lo double, hi double, s double")
    got = df.select("*", operating_gain(F.col("e"), F.col("lo"), F.col("hi"), F.col("s")).alias("g")).collect()
    for r in got:
        assert r["g"] == pytest.approx(gain_value(r["e"], r["lo"], r["hi"], r["s"]), abs=1e-12)


def test_frog_regime_switches():
    frog, total = builtin("Frog"), {}
    for scale in (1e-7, 1e-3, 1.0):
        states = K.regime_states(frog, [(300.0, scale), (750.0, scale)])
        total[scale] = states[K.dominant_regime(states)].resolved.name
    assert total == {1e-7: "Scotopic", 1e-3: "Photopic", 1.0: "Photopic"} or total[1e-7] == "Scotopic"
    assert total[1.0] == "Photopic"


def test_equal_regimes_last_wins():
    s = trichromat()
    twin = VisualSystem(s.name, s.pool, (Regime("a", (0, 1, 2)), Regime("b", (0, 1, 2))))
    assert K.dominant_regime(K.regime_states(twin, FLAT)) == 1


def slow_pixel(system, spectrum, light, kind, stage):
    """One pixel through the pipeline by plain loops."""
    wl = AXIS
    half = [0.5 * ((wl[min(i + 1, 6)] - wl[i]) + (wl[i] - wl[max(i - 1, 0)])) for i in range(7)]
    st = K.regime_state(system, system.regimes[0], light)
    q = []
    for r, g in zip(system.pool, st.gains):
        at = Bundle.of(r.points, light)
        total = 0.0
        for b, w in enumerate(wl):
            v = np.nan_to_num(at.at([0, 1], [w, w]))
            total += v[0] * half[b] * np.float32(spectrum[b]) * (v[1] if kind == K.REFLECTANCE else 1.0)
        total *= g
        q.append(total if r.saturation is None else min(total, r.saturation))
    q = np.array(q)
    if stage != K.RAW:
        q = st.adaptation @ q
    return st.opponent @ q if stage == K.PERCEPTUAL else q


@pytest.mark.parametrize("engine", ["arrow", "native"])
@pytest.mark.parametrize("stage", [K.RAW, K.ADAPTED, K.PERCEPTUAL])
@pytest.mark.parametrize("kind", [K.REFLECTANCE, K.RADIANCE])
@pytest.mark.parametrize("cap", [None, 40.0])
def test_render_matches_pixel_loop(spark, engine, stage, kind, cap):
    s = trichromat(saturation=cap)
    k = K.compile_regime(s, 0, AXIS, FLAT, kind, stage)
    got = render.render(cube(spark, 2, 3), k, engine=engine).collect()
    for r in got:
        spectrum = [(b * 3 + r["line"] * 2 + r["sample"]) * 0.125 for b in range(7)]
        assert r["ch"] == pytest.approx(slow_pixel(s, spectrum, FLAT, kind, stage), rel=2e-6, abs=1e-6)


def test_reflectance_equals_premultiplied_radiance(spark):
    light = [(350.0, 0.4), (560.0, 1.7), (760.0, 0.9)]
    s = trichromat()
    a = K.compile_regime(s, 0, AXIS, light, K.REFLECTANCE, K.RAW)
    b = K.compile_regime(s, 0, AXIS, light, K.RADIANCE, K.RAW)
    at = Bundle.of(light).resample(np.array(AXIS))[0]
    assert np.allclose(a.response, b.response * at)


def test_kernel_errors(spark):
    s = trichromat()
    for wl in (None, (), (400, 400), (500, 400)):
        with pytest.raises(K.KernelError):
            K.compile_regime(s, 0, wl, FLAT)
    with pytest.raises(K.KernelError, match="light is required"):
        K.compile_regime(s, 0, AXIS, None, K.REFLECTANCE, K.RAW)
    with pytest.raises(K.KernelError, match="light is required"):
        K.compile_regime(s, 0, AXIS, None, K.RADIANCE, K.ADAPTED)
    with pytest.raises(K.KernelError, match="no receptor belongs"):
        K.compile_regime(s, Regime("x", (7,)), AXIS, FLAT)
    with pytest.raises(K.KernelError, match="pool is empty"):
        K.compile_pool(VisualSystem("e", ()), AXIS)
    with pytest.raises(K.KernelError, match="limit"):
        K.compile_pool(VisualSystem("many", s.pool * 22), AXIS)
    assert K.compile_regime(s, 0, AXIS, None, K.RADIANCE, K.RAW).gains.tolist() == [1, 1, 1]
    k = K.compile_regime(s, 0, AXIS[:6], FLAT)
    with pytest.raises(Exception, match="of 7 values meets a kernel for 6"):
        render.render(cube(spark, 1, 1), k).collect()


def test_gain_before_cap():
    s = trichromat(saturation=5.0, illumination_min=1e3, illumination_softness=0.25)
    st = K.regime_state(s, s.regimes[0], FLAT)
    assert (st.gains < 0.5).all() and st.active in (True, False)
    seen = np.array([product_integral(r.points, FLAT) for r in s.pool])
    assert st.seen == pytest.approx(seen)


def test_override_of_wrong_length_is_ignored():
    s = trichromat()
    r = Regime("x", (0, 9, 2), luminance_weights=(1.0, 2.0, 3.0), contrasts=(("c", (1.0, -1.0, 0.0)),))
    rr = resolve(s, r)
    assert len(rr.members) == 2 and rr.weights.sum() == pytest.approx(1.0)
    assert rr.candidates.tolist() == [[1.0, -1.0], [-1.0, 1.0]]


def test_level_columns_match_single_gains(spark):
    from opsinlake.operators import light_levels

    windows = [(None, None, None), (1e-2, None, 0.5), (None, 1e-2, 0.25), (1.0, 1e-3, None), (-1.0, 5.0, 0.0), (1e-3, 1e1, None)]
    base = trichromat().pool[0]
    pool = tuple(replace(base, illumination_min=a, illumination_max=b, illumination_softness=c) for a, b, c in windows)
    for defaults in ({}, {"illumination_min": 0.1, "illumination_softness": 0.75}):
        s = VisualSystem("w", pool, (Regime("a b", (0, 1)), Regime("c", (2, 3, 4, 5))), **defaults)
        levels = [0.0, 1e-9, 1e-4, 0.01, 1.0, math.nan, math.inf, -1.0]
        df = spark.createDataFrame([(v,) for v in levels], "f double")
        e = K.seen_irradiance(pool, FLAT)
        d = (s.illumination_min, s.illumination_max, s.illumination_softness)
        for r in df.select("f", *light_levels.receptor_gains(s, FLAT, "f")).collect():
            want = K.window_gains(pool, e * r["f"] if not math.isnan(r["f"]) else e * math.nan, d)
            assert list(r)[1:] == pytest.approx(want.tolist(), abs=1e-12)
        both = light_levels.with_regimes(df, s, FLAT, F.col("f"))
        for r in both.where("not isnan(f)").collect():
            g = K.window_gains(pool, e * r["f"], d)
            a, c = g[0] * g[1], g[2] * g[3] * g[4] * g[5]
            assert (r["a b"], r["c"]) == pytest.approx((a, c), abs=1e-12)
            assert r["dominant_regime"] == ("c" if c >= a else "a b")
            assert r["active"] == bool((g[2:] > 0.1).any() if c >= a else (g[:2] > 0.1).any())
