"""Files in and out: ENVI cubes, text spectra, libraries, exports, streams."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsinlake import constants as C
from opsinlake.functions import lights
from opsinlake.operators import compare, light_levels, opponent, validate
from opsinlake.plans import adaptation as A
from opsinlake.plans import kernel as K
from opsinlake.plans.systems import Receptor, Regime, VisualSystem, builtin, builtin_systems
from opsinlake.sources import envi, library, presets, text
from opsinlake.streaming import live


def write_envi(folder, name, cube, interleave="bsq", code=4, order=0, offset=0, ext=".dat", header=".hdr", axis=True, cut=0):
    """``cube`` is (line, sample, band)."""
    kinds = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4"}
    turned = {"bsq": cube.transpose(2, 0, 1), "bil": cube.transpose(0, 2, 1), "bip": cube}[interleave]
    raw = b"x" * offset + turned.astype((">" if order else "<") + kinds[code]).tobytes()
    (folder / f"{name}{ext}").write_bytes(raw[: len(raw) - cut])
    lines, samples, bands = cube.shape
    wl = ",\n  ".join(str(400.0 + 50 * b) for b in range(bands))
    h = (f"ENVI\n; a comment = 3\nSamples = {samples}\nlines = {lines}\nbands = {bands}\nheader offset = {offset}\n"
         f"data type = {code}\ninterleave = {interleave.upper()}\nbyte order = {order}\n")
    (folder / f"{name}{header}").write_text(h + (f"wavelength = {{ {wl} }}\n" if axis else "wavelength = {a, b}\n"))


def cube_of(lines=3, samples=4, bands=5):
    b, ln, s = np.meshgrid(np.arange(bands), np.arange(lines), np.arange(samples), indexing="ij")
    return (b * 100 + ln * 10 + s).transpose(1, 2, 0)


def test_envi_layouts(spark, tmp_path):
    cube = cube_of()
    cases = [("bsq", 4, 0, 0), ("bil", 2, 1, 16), ("bip", 5, 1, 0), ("bsq", 12, 0, 7), ("bil", 13, 1, 0), ("bip", 3, 0, 0)]
    for i, (inter, code, order, offset) in enumerate(cases):
        write_envi(tmp_path, f"c{i}", cube, inter, code, order, offset, axis=i % 2 == 0)
    envi.register(spark)
    df = spark.read.format("envi").option("blockValues", 25).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 18
    rows = df.collect()
    assert len(rows) == 6 * 12
    for r in rows:
        assert list(r["spectrum"]) == cube[r["line"], r["sample"]].tolist()
        even = int(r["cube_id"][1:]) % 2 == 0
        assert r["wavelengths"] == ([400.0, 450.0, 500.0, 550.0, 600.0] if even else None)


def test_envi_scan_as_a_job(spark, tmp_path):
    cube = cube_of()
    cases = [("bsq", 4, 0, 0), ("bil", 2, 1, 16), ("bip", 5, 1, 0), ("bsq", 12, 0, 7), ("bil", 13, 1, 0), ("bip", 3, 0, 0)]
    for i, (inter, code, order, offset) in enumerate(cases):
        write_envi(tmp_path, f"c{i}", cube, inter, code, order, offset, axis=i % 2 == 0, ext=".img" if i == 2 else ".dat", header=".img.hdr" if i == 2 else ".hdr")
    write_envi(tmp_path, "plain", cube, ext="", header=".hdr")
    write_envi(tmp_path, "short", cube, cut=1)
    (tmp_path / "alone.hdr").write_text("ENVI\n")
    (tmp_path / "odd.hdr").write_text("ENVI\nsamples = x\n")
    (tmp_path / "odd.dat").write_bytes(b"1")
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        cubes = envi.cube_table(spark, folder)
        found = {r["cube_id"]: r for r in cubes.collect()}
        assert "bytes expected" in found["short"]["error"] and "without a data file" in found[None]["error"] and "whole number" in found["odd"]["error"]
        assert found["c0"]["wavelengths"] == [400.0, 450.0, 500.0, 550.0, 600.0] and found["c1"]["wavelengths"] is None
        rows = envi.scan(cubes, block_values=25).collect()
        assert len(rows) == 7 * 12 and all(list(r["spectrum"]) == cube[r["line"], r["sample"]].tolist() for r in rows)
    assert envi.blocks_of(cubes.where("cube_id = 'c1'"), (1, 2), 25).select("first", "last").collect() == [(1, 2)]
    some = envi.scan(cubes, (1, 3), block_values=25).collect()
    assert {r["line"] for r in some} == {1, 2} and len(some) == 7 * 8
    assert envi.scan(cubes, (5, 9)).count() == 0


def test_envi_filters_leave_out_blocks(spark, tmp_path):
    for name in ("a", "b"):
        write_envi(tmp_path, name, cube_of(lines=12))
    envi.register(spark)
    df = spark.read.format("envi").option("blockValues", 20).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 24
    for text_, parts, rows in (("line = 3", 2, 8), ("line >= 10 and cube_id = 'a'", 2, 8), ("line < 2", 4, 16), ("cube_id in ('b', 'z') and line > 9 and line <= 10", 1, 4), ("line = 50", 1, 0)):
        some = df.where(text_)
        assert some.rdd.getNumPartitions() == parts and some.count() == rows


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_envi_round_trip(spark, tmp_path, interleave):
    pixels = spark.createDataFrame([(f"c{c}", ln, s, [float(c), float(ln), float(s)]) for c in range(3) for ln in range(c + 1) for s in range(4)], "cube_id string, line long, sample long, spectrum array<float>")
    assert envi.write_cubes(pixels, str(tmp_path / "out"), interleave).count() == 3
    back = envi.scan(envi.cube_table(spark, str(tmp_path / "out"))).collect()
    assert sorted(back) == sorted(pixels.collect())
    with pytest.raises(Exception, match="pixels expected"):
        envi.write_cubes(pixels.where("line <> 0 or sample <> 1"), str(tmp_path / "bad"), interleave).count()


def test_envi_pairs_and_errors(tmp_path):
    cube = cube_of()
    write_envi(tmp_path, "plain", cube, ext="", header=".hdr")
    write_envi(tmp_path, "both", cube, ext=".img", header=".img.hdr")
    assert envi.describe(str(tmp_path / "plain.hdr")).data.endswith("plain")
    assert envi.describe(str(tmp_path / "both.img")).header.endswith("both.img.hdr")
    with pytest.raises(envi.EnviError, match="without a header"):
        envi.describe(str(tmp_path / "lost.dat"))
    (tmp_path / "alone.hdr").write_text("ENVI\n")
    with pytest.raises(envi.EnviError, match="without a data file"):
        envi.describe(str(tmp_path / "alone.hdr"))
    (tmp_path / "alone.dat").write_bytes(b"")
    with pytest.raises(envi.EnviError, match="is not given"):
        envi.describe(str(tmp_path / "alone.hdr"))
    write_envi(tmp_path, "short", cube, cut=1)
    with pytest.raises(envi.EnviError, match="bytes expected"):
        envi.describe(str(tmp_path / "short.dat"))
    for field, bad in (("data type = 4", "data type = 6"), ("interleave = BSQ", "interleave = bsx"), ("bands = 5", "bands = five")):
        write_envi(tmp_path, "bad", cube)
        h = (tmp_path / "bad.hdr").read_text().replace(field, bad)
        (tmp_path / "bad.hdr").write_text(h)
        with pytest.raises(envi.EnviError):
            envi.describe(str(tmp_path / "bad.hdr"))


def test_text_spectra(spark, tmp_path):
    (tmp_path / "nm.txt").write_text("# c\r\nwl, v\r\n 400\t0.5\r\n401 ,0.25, 9\r\n\r\n402 -1.23e34\r\n403 nan\r\n! x\r\n404\r\n")
    (tmp_path / "um.csv").write_text("0.35,1\n2.5,2\n")
    (tmp_path / "zero.csv").write_text("0,1\n-3,2\n")
    got = {r["file"].rsplit("/", 1)[1]: [tuple(p) for p in r["points"]] for r in text.read_spectra(spark, str(tmp_path)).collect()}
    assert got["nm.txt"] == [(400.0, 0.5), (401.0, 0.25)]
    assert got["um.csv"] == [(350.0, 1.0), (2500.0, 2.0)]
    assert got["zero.csv"] == [(0.0, 1.0), (-3.0, 2.0)]


def test_curve_and_table_export(spark, tmp_path):
    c = spark.createDataFrame([([(1.5, 0.25), (0.5, 1.0)],)], "points array<struct<wl:double,v:double>>")
    text.write_curve(c, str(tmp_path / "c"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*"))).splitlines()
    assert lines == ["wavelength_nm,value", "1.5,0.25", "0.5,1.0"]
    t = spark.createDataFrame([('a "b", c', 1.0, None)], "Stimulus string, `Human L` double, d double")
    text.write_table(t.coalesce(1), str(tmp_path / "t"))
    out = next((tmp_path / "t").glob("part-*")).read_text().splitlines()
    assert out == ["Stimulus,Human L,d", '"a ""b"", c",1.0,']


def test_of_two_names_with_one_slug_the_last_stays(spark, tmp_path):
    dog = library.shipped_systems(spark).where("name like 'Dog%'")
    both = dog.withColumns({"name": F.lit("Mine / 2"), "at": F.lit(1)}).unionByName(dog.withColumns({"name": F.lit("mine 2"), "at": F.lit(2)}))
    library.write_library(both, str(tmp_path / "a"), "at")
    assert [r["name"] for r in library.load_library(spark, str(tmp_path / "a")).collect()] == ["mine 2"]
    library.write_library(both.withColumn("at", -F.col("at")), str(tmp_path / "a"), "at")
    assert [r["name"] for r in library.load_library(spark, str(tmp_path / "a")).collect()] == ["Mine / 2"]


def test_snapshots(spark, tmp_path):
    path, shipped = str(tmp_path / "lib"), library.shipped_systems(spark)
    assert library.read_version(spark, path).count() == 0 and library.latest_version(spark, path) == 0
    assert library.upsert_library(shipped, path) == 1
    old = library.read_version(spark, path)
    mine = shipped.where("name like 'Dog%' or name like 'Cat%'").withColumns({"name": F.upper("name"), "at": F.lit(1)})
    assert library.upsert_library(mine, path, "at") == 2
    assert old.count() == 11 and old.where("name = upper(name)").isEmpty()  # a reader keeps its version
    assert library.read_version(spark, path).count() == 11 and library.read_version(spark, path).where("name = upper(name)").count() == 2
    (tmp_path / "lib" / "version=3").mkdir()  # a writer that died
    assert library.latest_version(spark, path) == 2
    with pytest.raises(Exception, match="(?i)exists"):
        library.upsert_library(mine, path, "at")
    back = {x.name: x for x in library.systems_of(library.read_version(spark, path, 1))}
    assert set(back) == set(builtin_systems())


def test_reconciled_defaults_are_written_back(spark, tmp_path):
    path = str(tmp_path / "lib")
    cols = library.shipped_systems(spark).columns
    dated = library.stamped(library.shipped_systems(spark).withColumn("illumination_max", F.lit(5.0)))
    edited = F.when(F.col("name").like("Cat%"), F.lit(7.0)).otherwise(F.col("illumination_max"))
    library.write_library(dated.withColumn("illumination_max", edited).where("name not like 'Dog%'").select(*cols), path)
    assert library.open_library(spark, path).count() == 10
    found = {r["name"][:3]: r["illumination_max"] for r in library.load_library(spark, path).collect()}
    assert found.pop("Cat") == 7.0 and set(found.values()) == {None} and "Dog" not in found


def test_library_round_trip(spark, tmp_path):
    path = str(tmp_path / "lib")
    first = library.open_library(spark, path)
    assert first.count() == 11
    back = {s.name: s for s in library.systems_of(first)}
    for name, s in builtin_systems().items():
        b = back[name]
        assert [r.points for r in b.pool] == [r.points for r in s.pool] and b.regimes == s.regimes
        assert [(r.omega, r.eta, r.luminance_weight, r.illumination_min) for r in b.pool] == [
            (r.omega, r.eta, r.luminance_weight, r.illumination_min) for r in s.pool]
    mine = first.where("name like 'Dog%'").withColumn("name", F.lit("Mine / 2"))
    library.write_library(mine, path)
    again = library.open_library(spark, path)
    assert again.count() == 12 and library.delete_system(again, "Mine / 2").count() == 11
    assert "slug=mine_2" in {p.name for p in (tmp_path / "lib").iterdir()}


def test_reference_documents(spark, tmp_path):
    curve = {"name": "a", "curve_type": "sensitivity", "points": [[400.0, 0.0], [500.0, 1.0]]}
    docs = {
        "current.json": {"name": "Now", "curves": [dict(curve, quantity={"radiance": {"unit": "W"}}), dict(curve, curve_type={"other": "Odd"})]},
        "legacy.json": {"name": "Then", "colorspace_curves": [curve, curve], "isolated_curves": [curve],
                        "opponent_contrasts": [{"name": "o", "weights": [1, -1]}], "illumination_min": 0.5},
        "lone.json": {"name": "Lone", "colorspace_curves": [], "isolated_curves": [curve]},
    }
    for n, d in docs.items():
        (tmp_path / n).write_text(json.dumps(d, indent=2))
    (tmp_path / "broken.json").write_text("{not json")
    got = {r["name"]: r for r in library.load_library(spark, str(tmp_path)).collect()}
    assert set(got) == {"Now", "Then", "Lone"}
    assert got["Now"]["regimes"] == [] and got["Now"]["curves"][0]["quantity"]["unit"] == "W"
    assert got["Now"]["curves"][1]["curve_type"] == "Odd" and got["Now"]["curves"][1]["quantity"]["kind"] == "Unspecified"
    then = got["Then"]["regimes"]
    assert len(then) == 1 and then[0]["name"] == "Colorspace" and then[0]["members"] == [0, 1]
    assert then[0]["contrasts"][0]["weights"] == [1.0, -1.0] and got["Then"]["illumination_min"] == 0.5
    assert got["Lone"]["regimes"] == [] and len(got["Lone"]["curves"]) == 1


def test_shipped_flags(spark):
    s = library.shipped_systems(spark)
    pool, members = validate.pool_rows(s), validate.member_rows(s)
    flags = {r["system"]: r for r in validate.pool_flags(pool).collect()}
    assert not any(r["invalid_window"] or r["partial_eta"] or r["too_many_receptors"] for r in flags.values())
    loose = {r["system"].split(" ")[0] for r in validate.unaffiliated(pool, members).select("system").distinct().collect()}
    assert loose == {"Pigeon", "Swallowtail", "Mantis"}
    bands = {r["regime"]: (r["band_min"], r["band_max"], r["disjoint"]) for r in validate.regime_bands(members).where("system like 'Frog%'").collect()}
    assert bands == {"Scotopic": (1e-6, 3e-2, False), "Mesopic": (1e-2, 3e-2, False), "Photopic": (1e-2, None, False)}


def test_sharpening_of_a_library_matches_the_driver(spark):
    members = validate.member_rows(library.shipped_systems(spark))
    got = {(r["system"], r["regime"]): r for r in opponent.sharpen_systems(members).collect()}
    assert len(got) == 12
    for name in ("Dog", "Honeybee", "Pigeon", "Swallowtail"):
        s = builtin(name)
        m, inv, lam, dominant = A.sharpen(A.gram([s.pool[i].points for i in s.regimes[0].members])[None])
        r = got[s.name, s.regimes[0].name]
        assert list(r["matrix"]) == pytest.approx(m[0].ravel().tolist(), abs=1e-9)
        assert list(r["inverse"]) == pytest.approx(inv[0].ravel().tolist(), abs=1e-9)
        assert r["lambda"] == lam[0] and r["dominant"] == dominant[0]


def test_presets(spark):
    assert [presets.sensors(spark).count(), presets.notches(spark).count(), presets.light_sources(spark).count()] == [2, 11, 12]
    names = [r["name"] for r in presets.seed_stimuli(spark).collect()]
    assert names == ["Reddish", "Greenish", "Blueish"]
    sun = presets.seed_lights(spark).where("name like 'Daytime%'").first()
    assert len(sun["points"]) == 1111 and sun["quantity"]["unit"] == "relative"
    led = lights.composite_lights(presets.light_sources(spark), 300.0, 750.0, 1.0, key="name")
    at = {(r["name"], r["wl"]): r["v"] for r in led.where("wl in (450.0, 546.0)").collect()}
    want = lights.composite_curve([(c, 1.0) for c in C.SOURCES[3][1]], 300.0, 750.0, 1.0)
    assert at["Cool white LED", 450.0] == pytest.approx(want[150, 1], rel=1e-12)


def test_corpus_contrasts_are_orthonormal(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([([float(v) for v in rng.random(64)], float(w)) for w in range(1, 40)], "spectrum array<double>, w double")
    k = opponent.ungated(K.compile_curves(builtin("Human"), 0, [400.0 + 5 * i for i in range(64)], [(300.0, 1.0), (750.0, 1.0)]))
    rows = opponent.corpus_contrasts(df, k, F.col("w")).collect()
    axes = np.array([r[1] for r in rows])
    assert np.allclose(axes @ axes.T, np.eye(3), atol=1e-9)
    assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
    assert all(max(a, key=abs) > 0 for a in axes.tolist())
    assert opponent.corpus_contrasts(df.limit(1), k, F.col("w")).count() == 0
    assert opponent.corpus_contrasts(df, k, F.lit(0.0)).count() == 0
    far = df.select(F.transform("spectrum", lambda v: v + 1e7).alias("spectrum"), "w")
    near, moved = (opponent.corpus_covariance(d, k, F.col("w")).first() for d in (df, far))
    assert moved["cov0_1"] == pytest.approx(near["cov0_1"], rel=1e-3)
    assert opponent.contrasts_from_covariance([[2.0]])[0][:2] == ("Natural-scene PC1", [1.0])


def test_fork_without_middle_cone(spark):
    frog = library.shipped_systems(spark).where("name like 'Frog%'")
    v = frog.select("name", F.lit("Frog 2").alias("new_name"), F.lit(3).alias("drop_position"))
    r = library.fork(frog, v).first()
    assert r["name"] == "Frog 2" and [c["name"] for c in r["curves"]] == ["Green rod", "Red rod", "Blue cone", "Red cone"]
    assert [g["members"] for g in r["regimes"]] == [[0, 1], [0, 1, 2, 3], [2, 3]]


def test_distances(spark):
    rows = [(0, "s", 0.0, [0.0, 0.0], [0.0, 0.0, 0.0]), (1, "s", 3.0, [4.0, 0.0], [1.0, 2.0, 3.0]), (2, "s", 0.0, [0.0, 5.0], [0.0] * 3)]
    df = spark.createDataFrame(rows, "id int, system string, luminance double, chroma array<double>, adapted array<double>")
    df = df.withColumn("regime", F.lit("r"))
    k = K.CurveKernel("s", "r", np.zeros(0), np.zeros((3, 0)), np.zeros((3, 0)), np.ones(3), np.full(3, np.inf), np.eye(3),
                      np.eye(3), np.array([1.0, 2.0, 0.5]), 1.0, ("a", "b", "c"))
    def d(metric):
        return {(r["a_id"], r["b_id"]): r["distance"] for r in compare.difference_matrix(df, [k], metric).collect()}
    assert d(compare.EUCLIDEAN) == pytest.approx({(0, 1): 5.0, (0, 2): 5.0, (1, 2): 50**0.5})
    assert d(compare.CHROMA_ONLY)[(0, 1)] == 4.0
    assert d(compare.DELTA_S)[(0, 1)] == pytest.approx(38**0.5)
    quiet = K.CurveKernel(**{**k.__dict__, "noise": None})
    assert compare.difference_matrix(df, [quiet], compare.DELTA_S).where("distance is not null").count() == 0
    full = compare.mirrored(compare.difference_matrix(df, [k], compare.EUCLIDEAN))
    assert full.count() == 9 and full.where("a_id = b_id and distance = 0").count() == 3
    odd = df.union(spark.createDataFrame([(3, "s", 0.0, [1.0], [0.0] * 3, "r")], df.schema))
    with pytest.raises(Exception, match="unequal numbers"):
        compare.difference_matrix(odd, [k], compare.EUCLIDEAN).collect()


def test_batch_export_rules(spark):
    axis = [400.0 + 5 * i for i in range(64)]
    light = [(300.0, 1.0), (750.0, 1.0)]
    pool_only = K.compile_curves(builtin("Mantis"), "dominant", axis, light)
    dog = K.compile_curves(builtin("Dog"), "dominant", axis, light)
    df = spark.createDataFrame([("x", [0.5] * 64), ("y", [0.2] * 64)], "name string, spectrum array<float>")
    out = compare.batch_export(df, [pool_only, dog], reference=df.where("name = 'x'"), metric=compare.DELTA_S)
    dog_name = "Dog (Canis lupus familiaris)"
    assert out.columns == ["Stimulus", f"{dog_name} L", f"{dog_name} C1", f"{dog_name} Saturation", f"{dog_name} Distance-to-ref"]
    assert [r[4] for r in out.collect()] == [None, None]
    with pytest.raises(ValueError, match="no|none"):
        compare.batch_export(df, [pool_only])
    with pytest.raises(Exception, match="exactly one"):
        compare.batch_export(df, [dog], reference=df).collect()
    radiance = K.compile_curves(builtin("Dog"), "dominant", axis, light, K.RADIANCE)
    kinds = df.withColumn("kind", F.when(F.col("name") == "x", "Absorption").otherwise("Radiance"))
    mixed = compare.batch_export(kinds, [pool_only, dog], kind="kind", radiance=[pool_only, radiance]).collect()
    plain = compare.batch_export(df.where("name = 'y'"), [radiance]).collect()
    assert [tuple(r) for r in mixed] == [tuple(r) for r in plain]
    with pytest.raises(ValueError, match="radiance kernel"):
        compare.batch_export(kinds, [dog], kind="kind")


def test_streams_match_batches(spark, tmp_path):
    rows = [("c", i // 5, i % 5, [float((i * 7 + b) % 11) for b in range(64)]) for i in range(60)]
    df = spark.createDataFrame(rows, "cube_id string, line long, sample long, spectrum array<float>")
    path, check = str(tmp_path / "px"), str(tmp_path / "check")
    df.repartition(3).write.parquet(path)
    axis = [400.0 + 5 * i for i in range(64)]
    k = K.compile_regime(builtin("Dog"), 0, axis, [(300.0, 1.0), (750.0, 1.0)])
    q = (live.render_stream(live.pixel_stream(spark, path, 1), k).writeStream.format("memory").queryName("px")
         .option("checkpointLocation", check).trigger(availableNow=True).start())
    q.awaitTermination(120)
    from opsinlake.operators import render
    want = sorted(map(str, render.render(df, k).collect()))
    assert sorted(map(str, spark.table("px").collect())) == want


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "value")
    path = str(tmp_path / "ev")
    events.repartition(2).write.parquet(path)
    frog, light = builtin("Frog"), [(300.0, 1.0), (750.0, 1.0)]
    factor = F.pow(F.lit(10.0), F.least(F.col("value"), F.lit(200.0)) / 25.0 - 8.0)
    stream = spark.readStream.schema(events.schema).parquet(path)
    n = live.windowed_dominance(live.light_stream(stream, frog, light, factor), width="1 day", late="40 days")
    q = (n.writeStream.outputMode("complete").format("memory").queryName("lv")
         .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    batch = light_levels.hourly_dominance(
        light_levels.with_regimes(events.withColumn("ts", F.col("ts").cast("timestamp")), frog, light, factor), width="1 day")
    assert sorted(map(str, spark.table("lv").collect())) == sorted(map(str, batch.collect()))


def test_point_coordinates_match_axis_kernel(spark):
    axis = [400.0 + 5 * i for i in range(64)]
    light = [(300.0, 1.0), (520.0, 1.8), (750.0, 0.6)]
    spectrum = [float(0.3 + 0.2 * np.sin(i / 6)) for i in range(64)]
    s = builtin("Honeybee")
    k = K.compile_curves(s, 0, axis, light)
    a = compare.coordinates(spark.createDataFrame([(1, spectrum)], "id int, spectrum array<double>"), k).first()
    pts = spark.createDataFrame([(1, "n", ("Reflectance", None), [(w, float(v)) for w, v in zip(axis, spectrum)])],
                                "id int, name string, quantity struct<kind:string,unit:string>, points array<struct<wl:double,v:double>>")
    b = compare.point_coordinates(pts, s.name, K.regime_state(s, s.regimes[0], light), light).first()
    assert b["luminance"] == pytest.approx(a["luminance"], rel=1e-9)
    assert list(b["chroma"]) == pytest.approx(list(a["chroma"]), rel=1e-7, abs=1e-9)


def test_regime_defaults_apply():
    r = Receptor("r", ((400.0, 1.0), (700.0, 1.0)))
    s = VisualSystem("s", (r,), (Regime("g", (0,)),), illumination_min=1e6, illumination_softness=0.25)
    st = K.regime_state(s, s.regimes[0], [(300.0, 1.0), (750.0, 1.0)])
    assert st.gains[0] < 1e-6 and not st.active


def test_text_lines_with_separators_and_suffixes(spark):
    df = spark.createDataFrame([("f", "400 1\n,410,2\n5d 3\n 420\t.5 x\n430f 1\n1e2,-3.\n")], "file string, text string")
    got = [(r.line, r.wl, r.v) for r in text.parse_spectra(df).orderBy("line").collect()]
    assert got == [(0, 400.0, 1.0), (1, 410.0, 2.0), (3, 420.0, 0.5), (5, 100.0, -3.0)]


def test_ill_typed_documents_are_skipped(spark):
    good = '{"name": "g", "curves": [{"name": "c", "curve_type": "x", "quantity": "sensitivity", "points": [[1, 2]]}], "regimes": []}'
    docs = [good, good.replace("[[1, 2]]", '"oops"').replace('"g"', '"bad"'), "[]", "{", good.replace('"g"', "null")]
    df = spark.createDataFrame([(d,) for d in docs], "text string")
    assert [r["name"] for r in library.parse_systems(df).collect()] == ["g"]


def test_many_receptors_and_stimuli(spark):
    """No limit on the members of a system or the stimuli of a matrix."""
    samples = spark.createDataFrame([("s", i, [float(i % 7), 1.0, float(i % 3)]) for i in range(70)], "system string, receptor int, values array<double>")
    got = opponent.gram_pairs(samples, 2.0).collect()
    assert len(got) == 70 * 71 // 2
    for r in got[::97]:
        assert r["overlap"] == 2.0 * ((r["k"] % 7) * (r["l"] % 7) + 1 + (r["k"] % 3) * (r["l"] % 3)) and r["k"] <= r["l"]
    coords = spark.range(600).selectExpr("'s' AS system", "id", "0.0D AS luminance", "array(double(id)) AS chroma", "array(0.0D) AS adapted")
    m = compare.difference_matrix(coords, [], compare.CHROMA_ONLY)
    assert m.count() == 600 * 599 // 2 and m.where("distance <> b_id - a_id").count() == 0


def _shuffled_records(spark):
    store, gw = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(params=["-1", "10m"])
def broadcast(spark, request):
    key = "spark.sql.autoBroadcastJoinThreshold"
    limit = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield
    spark.conf.set(key, limit)


def test_receptors_of_small_systems_are_shuffled_once(spark, broadcast):
    n = 40_000
    samples = spark.range(n).selectExpr("id div 4 AS system", "id % 4 AS receptor", "array(double(id % 7), 1.0D) AS values")
    before = _shuffled_records(spark)
    assert len(opponent.gram_pairs(samples, 1.0).collect()) == n // 4 * 10
    assert n <= _shuffled_records(spark) - before <= 1.5 * n  # the rows, and a count per system


@pytest.mark.parametrize("near", [3, 4, 256])
def test_pairs_of_crowded_systems(spark, monkeypatch, broadcast, near):
    """Systems of 1 to 11 receptors and a large one, rows that repeat, one name with several curves, no name, no system."""
    monkeypatch.setattr(opponent, "NEAR", near)
    rows = [(s, i // 2 if s % 3 else i, [float(i // 2 % 5), 1.0]) for s in range(1, 12) for i in range(s)]
    rows += [(7, 0, [9.0, 2.0]), (7, None, [3.0, 3.0]), (7, None, [4.0, 4.0]), (None, 1, [1.0, 1.0]), (None, 2, [1.0, 1.0])]
    rows += [(99, i % 550, [float(i % 550 % 11), 2.0]) for i in range(600 if near == 256 else 60)]
    want = Counter()
    for s in {r[0] for r in rows} - {None}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        for a, x in enumerate(mine):
            want.update((s, x[1], y[1], 2.0 * sum(p * q for p, q in zip(x[2], y[2]))) for y in mine[a:])
    got = opponent.gram_pairs(spark.createDataFrame(rows, "system int, receptor int, values array<double>"), 2.0).collect()
    assert Counter((r["system"], r["k"], r["l"], r["overlap"]) for r in got) == want
