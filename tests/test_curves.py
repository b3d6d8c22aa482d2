"""Curves, integrals and curve algebra."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsinlake.functions import monotone
from opsinlake.functions.monotone import Bundle
from opsinlake.operators import colors, curves
from opsinlake.plans.systems import curve_integral, product_integral


def slow_cubic(points):
    """Straightforward single-curve reference: (knots, value function)."""
    seen = {}
    for x, y in points:
        seen.setdefault(x, y)
    xs = sorted(seen)
    ys = [seen[x] for x in xs]
    n = len(xs)
    d = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(n - 1)]
    m = [0.0] * n
    if n > 1:
        m = [d[0]] + [(d[i - 1] + d[i]) / 2 for i in range(1, n - 1)] + [d[-1]]
    for i in range(n - 1):
        if d[i] == 0:
            m[i] = m[i + 1] = 0.0
        else:
            a, b = m[i] / d[i], m[i + 1] / d[i]
            if a * a + b * b > 9:
                t = 3 / math.hypot(a, b)
                m[i], m[i + 1] = t * m[i], t * m[i + 1]

    def at(x):
        if n == 0 or x < xs[0] or x > xs[-1]:
            return math.nan
        if x in seen:
            return seen[x]
        i = max(k for k in range(n - 1) if xs[k] <= x)
        h = xs[i + 1] - xs[i]
        t = (x - xs[i]) / h
        return ((2 * t**3 - 3 * t**2 + 1) * ys[i] + (t**3 - 2 * t**2 + t) * h * m[i]
                + (-2 * t**3 + 3 * t**2) * ys[i + 1] + (t**3 - t**2) * h * m[i + 1])

    return xs, at


point = st.tuples(st.integers(300, 340).map(float), st.integers(-8, 8).map(float))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(point, max_size=9), min_size=1, max_size=5))
def test_bundle_matches_single_curves(batch):
    b = Bundle.of(*batch)
    xs = np.arange(298.0, 343.0, 0.37)
    got = b.resample(xs)
    for row, pts in zip(got, batch):
        _, at = slow_cubic(pts)
        np.testing.assert_allclose(row, [at(x) for x in xs], rtol=1e-9, atol=1e-9)


def test_duplicate_and_single_knots():
    b = Bundle.of([(500, 1.0), (400, 0.5), (500, 9.0)], [(450, 2.0)], [])
    assert b.at([0, 0, 1, 1, 2], [500, 400, 450, 451, 450])[:3].tolist() == [1.0, 0.5, 2.0]
    assert np.isnan(b.at([1, 2], [451, 450])).all()


def test_monotone_data_stays_monotone():
    b = Bundle.of([(0, 0), (1, 0.01), (2, 5), (3, 5), (4, 9)])
    v = b.resample(np.linspace(0, 4, 400))[0]
    assert (np.diff(v) >= -1e-12).all() and v.max() <= 9 + 1e-12


def test_box_product_integral():
    a, b = [(100, 2.0), (200, 2.0)], [(150, 3.0), (250, 3.0)]
    assert abs(product_integral(a, b, 0.01) - 300) < 0.1
    assert product_integral([], []) == 0.0
    assert curve_integral([(500, 3.0)]) == 0.0


CURVES = [
    (1, [(400.0, 0.2), (455.5, 0.9), (520.25, 0.1), (700.0, 0.4)]),
    (2, [(410.0, -0.3), (430.0, -0.3), (640.0, 0.8)]),
    (3, [(500.0, 1.0)]),
    (4, []),
    (5, None),
    (6, [(620.0, 0.5), (401.0, 0.1), (401.0, 7.0), (500.5, 0.7)]),
]
LIGHT = [(300.0, 1.0), (480.0, 2.0), (600.0, 0.0), (650.0, 0.0), (750.0, 3.0)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(CURVES, "id int, points array<struct<wl:double,v:double>>")


def test_column_integrals(table):
    fixed = [LIGHT, [(350.0, 1.0), (420.0, 0.3)]]
    rows = table.select("id", curves.curve_integral(F.col("points")).alias("a"),
                        curves.product_integrals(F.col("points"), fixed).alias("p")).collect()
    for r in rows:
        pts = dict(CURVES)[r["id"]]
        assert r["a"] == pytest.approx(curve_integral(pts or []), abs=1e-9)
        if pts is None:
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx([product_integral(pts, f) for f in fixed], abs=1e-9)


def test_native_values_agree(table):
    xs = [400.0, 401.0, 430.0, 433.3, 500.5, 560.0, 640.0, 700.0, 701.0]
    grid = F.lit(xs)
    seg = curves.native_segments(table.where("points is not null"))
    both = seg.select("id", curves.values_at(F.col("points"), grid).alias("a"),
                      F.transform(grid, lambda x: curves.native_value(F.col("segments"), x)).alias("b"))
    for r in both.collect():
        if r["id"] == 3:
            continue  # a single knot has no segment
        for a, b in zip(r["a"], r["b"]):
            assert (a is None) == (b is None)
            assert a is None or a == pytest.approx(b, abs=1e-12)


def test_reflectance_round_trip(spark):
    smooth = [(400.0 + 10 * i, 0.5 + 0.3 * math.sin(i / 5)) for i in range(31)]
    light = [(380.0, 1.0), (560.0, 2.0), (720.0, 1.5)]
    df = spark.createDataFrame(
        [("m", ("Radiance", "relative"), smooth, {"batch": "b"})],
        "name string, quantity struct<kind:string,unit:string>, points array<struct<wl:double,v:double>>, metadata map<string,string>",
    )
    good, bad = curves.derive_reflectance(df, light)
    back = curves.predict_under_light(good, light, "lamp").first()
    assert bad.count() == 0
    want = Bundle.of(smooth)
    for p in back["points"]:
        assert p["v"] == pytest.approx(want.at([0], [p["wl"]])[0], abs=1e-9)
    assert back["name"] == "m (reflectance) (predicted)" and back["quantity"]["unit"] == "relative"
    assert good.first()["metadata"] == {"batch": "b/reflectance"}


def test_division_skips_dark_wavelengths(table):
    out = {r["id"]: r["points"] for r in curves.divide_by_light(table.where("id < 5"), LIGHT).collect()}
    assert all(not 600 <= p["wl"] <= 650 for p in out[1]) and len(out[1]) > 100
    assert out[3] == [] and out[4] == []


def test_unit_errors_in_order(spark):
    rows = [(1, ("Unspecified", None)), (2, ("Reflectance", None)), (3, ("Radiance", "W")), (4, ("Radiance", "relative"))]
    df = spark.createDataFrame(rows, "id int, quantity struct<kind:string,unit:string>")
    e = curves.unit_error(F.col("quantity.kind"), F.col("quantity.unit"), "Radiance", "relative")
    assert [r[0] for r in df.orderBy("id").select(e).collect()] == [
        "missing quantity kind", "wrong quantity kind", "unit mismatch", None]


def test_absorption_keeps_narrow_notch(spark):
    df = spark.createDataFrame([([(400.0, 1.0), (410.0, 1.0)], {})], "points array<struct<wl:double,v:double>>, metadata map<string,string>")
    notch = [(404.4, 1.0), (404.5, 0.0), (404.6, 1.0)]
    out = curves.apply_absorption(df, notch, 2.0, "n").first()
    values = {p["wl"]: p["v"] for p in out["points"]}
    assert values[404.5] == 0.0 and values[404.0] == pytest.approx(1.0) and 410.0 in values
    assert out["metadata"] == {"absorption: n": "weight 2"}
    none = curves.apply_absorption(df, notch, 0.0, "n").first()
    assert [p["v"] for p in none["points"]] == pytest.approx([1.0] * len(none["points"]))


def test_display_color(spark):
    rows = [("red", [(600.0, 0.0), (640.0, 1.0), (680.0, 0.0)]), ("uv", [(300.0, 1.0), (340.0, 1.0)]),
            ("flat", [(400.0, 0.0), (700.0, 0.0)]), ("none", [])]
    df = spark.createDataFrame(rows, "name string, points array<struct<wl:double,v:double>>")
    c = {r["name"]: r["rgb"] for r in colors.with_display_color(df).collect()}
    assert c["red"]["r"] == pytest.approx(1.0) and c["red"]["g"] < 0.5
    assert c["flat"] is None and c["none"] is None
    # a curve outside the visible range takes the gradient's colour only
    assert c["uv"]["r"] == pytest.approx(np.mean([0.3 + 0.7 * (380 - w) / 180 for w in range(300, 341)]), abs=1e-9)


def test_filters_pass_below_curve_functions(spark, tmp_path, capfd):
    """A filter on another column reaches the scan, so other curves are never fitted."""
    path = str(tmp_path / "curves")
    spark.range(10).selectExpr("id", "array(named_struct('wl', 400.0D, 'v', 1.0D), named_struct('wl', 500.0D, 'v', 2.0D)) AS points").write.parquet(path)
    df = spark.read.parquet(path)
    grid = F.array(F.lit(450.0), F.lit(470.0))
    for made in (curves.curve_integral(F.col("points")), curves.values_at(F.col("points"), grid)):
        plan = df.withColumn("x", made).where("id = 3")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(id,3)" in plan
    with_area = df.withColumn("x", curves.curve_integral(F.col("points"))).select((F.col("x") + F.col("x")).alias("y"), "x")
    assert with_area._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_memory_of_a_worker_follows_slices(monkeypatch):
    """Beside its result, evaluating a batch takes what one slice takes."""
    rng, n, k, g = np.random.default_rng(5), 6000, 16, 250
    knots = np.sort(rng.uniform(400, 700, n * k).reshape(n, k)).ravel()
    cells = pa.StructArray.from_arrays([pa.array(knots), pa.array(rng.random(n * k))], names=["wl", "v"])
    points = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), cells)
    xs = np.tile(np.linspace(390, 710, g), n)
    grid = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * g), pa.array(xs))
    fixed, peaks, got = Bundle.of([(400.0, 0.9), (480.0, 0.2), (560.0, 0.4), (715.0, 0.7)]), [], []
    for run in (lambda: curves._evaluate(points, grid).flatten().to_numpy(zero_copy_only=False), lambda: fixed.at(np.zeros(len(xs), dtype=np.int64), xs)):
        tracemalloc.start()
        got.append(run())
        peaks.append(tracemalloc.get_traced_memory()[1] / xs.nbytes)
        tracemalloc.stop()
    assert max(peaks) < 6, peaks
    monkeypatch.setattr(monotone, "AT_ONCE", 7)
    monkeypatch.setattr(curves, "BATCH_ROWS", 3)
    few = slice(0, 40 * g)
    assert np.array_equal(got[0][few], curves._evaluate(points[:40], grid[:40]).flatten().to_numpy(zero_copy_only=False), equal_nan=True)
    assert np.array_equal(got[1][few], fixed.at(np.zeros(40 * g, dtype=np.int64), xs[few]), equal_nan=True)
