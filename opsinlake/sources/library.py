"""Libraries of visual systems: JSON documents in and out, defaults, forks.

A document is one JSON object. The current layout has ``curves`` and ``regimes``; the older one has
``colorspace_curves``, ``isolated_curves`` and set-level ``opponent_contrasts``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsinlake import constants as C
from opsinlake import schema as S
from opsinlake.plans.systems import Receptor, Regime, VisualSystem, builtin_systems

MARKER = "builtin_hash"

_CURVE = (
    "array<struct<name:string,curve_type:string,quantity:string,points:array<array<double>>,"
    "metadata:map<string,string>,omega:double,eta:double,luminance_weight:double,saturation:double,"
    "illumination_min:double,illumination_max:double,illumination_softness:double>>"
)
_CONTRAST = "array<struct<name:string,weights:array<double>>>"
_DOCUMENT = (
    f"struct<name:string,curves:{_CURVE},metadata:map<string,string>,"
    f"regimes:array<struct<name:string,curves:array<bigint>,luminance_weights:array<double>,"
    f"opponent_contrasts:{_CONTRAST}>>,colorspace_curves:{_CURVE},isolated_curves:{_CURVE},"
    f"opponent_contrasts:{_CONTRAST},illumination_min:double,illumination_max:double,illumination_softness:double,_corrupt:string>"
)
# Tagged names in documents (fixed values).
_KINDS = ("Sensitivity", "Radiance", "Reflectance", "Absorption", "Transmittance", "Unspecified")


def _ddl(t) -> str:
    return t.simpleString()


def _quantity(raw: Column) -> Column:
    unit = F.get_json_object(raw, "$.radiance.unit")
    kind = F.when(unit.isNotNull(), F.lit("Radiance"))
    for k in _KINDS:
        kind = kind.when(raw == k.lower(), F.lit(k))
    return F.struct(kind.otherwise(F.lit("Unspecified")).alias("kind"), unit.alias("unit"))


def _curve(c: Column) -> Column:
    other = F.get_json_object(c["curve_type"], "$.other")
    fields = [c[f].alias(f) for f in ("omega", "eta", "luminance_weight", "saturation", "illumination_min",
                                      "illumination_max", "illumination_softness")]
    return F.struct(
        c["name"].alias("name"),
        F.coalesce(other, c["curve_type"]).alias("curve_type"),
        _quantity(c["quantity"]).alias("quantity"),
        F.transform(c["points"], lambda p: F.struct(p[0].alias("wl"), p[1].alias("v"))).alias("points"),
        F.coalesce(c["metadata"], F.expr("cast(map() as map<string,string>)")).alias("metadata"),
        *fields,
    )


def parse_systems(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents to system rows; text that is not a system document is skipped. Other columns are kept."""
    none = F.expr(f"cast(array() as {_CURVE})")
    d = F.col("_d")
    parsed = documents.withColumn("_d", F.from_json(text, _DOCUMENT, {"columnNameOfCorruptRecord": "_corrupt"}))
    current = d["curves"].isNotNull()
    space = F.coalesce(d["colorspace_curves"], none)
    curves = F.when(current, d["curves"]).otherwise(F.concat(space, F.coalesce(d["isolated_curves"], none)))
    regime = _ddl(T.ArrayType(S.REGIME))
    kept = F.transform(d["regimes"], lambda r: F.struct(
        r["name"].alias("name"), r["curves"].alias("members"), r["luminance_weights"].alias("luminance_weights"),
        r["opponent_contrasts"].alias("contrasts"),
    ))
    old = d["opponent_contrasts"]
    anonymous = F.array(F.struct(
        F.lit(C.LEGACY_REGIME).alias("name"),
        F.transform(F.sequence(F.lit(0), F.size(space) - 1), lambda i: i.cast("bigint")).alias("members"),
        F.lit(None).cast("array<double>").alias("luminance_weights"),
        F.when(F.size(old) > 0, old).alias("contrasts"),
    ))
    nothing = F.expr(f"cast(array() as {regime})")
    regimes = (
        F.when(current, F.coalesce(kept.cast(regime), nothing))
        .when(F.size(space) > 0, anonymous.cast(regime))
        .otherwise(nothing)
    )
    rest = [c for c in documents.columns if c != text]
    whole = d["_corrupt"].isNull()  # a field of the wrong type makes the document unreadable
    readable = parsed.where(d.isNotNull() & whole & d["name"].isNotNull() & (current | d["colorspace_curves"].isNotNull()
                                                                    | d["isolated_curves"].isNotNull()))
    return readable.select(
        *rest, d["name"].alias("name"),
        F.transform(curves, _curve).cast(_ddl(T.ArrayType(S.CURVE))).alias("curves"),
        regimes.alias("regimes"),
        F.coalesce(d["metadata"], F.expr("cast(map() as map<string,string>)")).alias("metadata"),
        *[d[f].alias(f) for f in ("illumination_min", "illumination_max", "illumination_softness")],
    )


def load_library(spark: SparkSession, path: str) -> DataFrame:
    """Every readable system document under a folder, one file per system; ``path`` orders them."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    named = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return parse_systems(named)


def _curve_document(c: Column) -> Column:
    kind, unit = c["quantity"]["kind"], c["quantity"]["unit"]
    return F.struct(
        c["name"].alias("name"),
        F.lower(c["curve_type"]).alias("curve_type"),
        F.when(kind == "Radiance", F.to_json(F.struct(F.struct(unit.alias("unit")).alias("radiance"))))
        .otherwise(F.lower(kind)).alias("quantity"),
        F.transform(c["points"], lambda p: F.array(p["wl"], p["v"])).alias("points"),
        c["metadata"].alias("metadata"),
        *[c[f].alias(f) for f in ("omega", "eta", "luminance_weight", "saturation", "illumination_min",
                                  "illumination_max", "illumination_softness")],
    )


def system_json(marker: bool = True) -> Column:
    """A system row as its document text, with metadata keys in order so equal content gives equal text."""
    meta = F.sort_array(F.map_entries("metadata"))
    if not marker:
        meta = F.filter(meta, lambda e: e["key"] != MARKER)
    regimes = F.transform("regimes", lambda r: F.struct(
        r["name"].alias("name"), r["members"].alias("curves"), r["luminance_weights"].alias("luminance_weights"),
        r["contrasts"].alias("opponent_contrasts"),
    ))
    return F.to_json(F.struct(
        "name", F.transform("curves", _curve_document).alias("curves"),
        F.map_from_entries(meta).alias("metadata"), regimes.alias("regimes"),
        "illumination_min", "illumination_max", "illumination_softness",
    ))


def content_hash() -> Column:
    """Fingerprint of a system without its own marker."""
    return F.sha2(system_json(marker=False), 256)


def slug(name: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "_")), F.lit("_"))


def last_per_slug(systems: DataFrame, order: str | None = None) -> DataFrame:
    """One system a document name: of systems whose names give the same slug the one with the largest ``order`` stays. Without
    an order, or between equals, it is the one with the largest name and then content, so that the choice repeats."""
    arrival = [F.col(order).alias("at")] if order else []
    rank = F.struct(*arrival, F.col("name").alias("name"), content_hash().alias("hash"))
    rows = systems.select(slug(F.col("name")).alias("slug"), F.struct(*systems.columns).alias("_s"), rank.alias("_k"))
    return rows.groupBy("slug").agg(F.max_by("_s", "_k").alias("_s")).select("slug", "_s.*")


def upsert(stored: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """A library after ``incoming`` was written to it: the last written system of every slug replaces the stored one of that
    slug, whatever its name; the others stay. ``order`` is a column of ``incoming`` that grows with time."""
    cols = S.SYSTEM.fieldNames()
    new = last_per_slug(incoming.select(*cols, *([order] if order else [])), order)
    kept = stored.select(*cols).join(new.select(F.col("slug").alias("_slug")), slug(F.col("name")) == F.col("_slug"), "left_anti")
    return kept.unionByName(new.select(*cols))


def write_library(systems: DataFrame, path: str, order: str | None = None) -> None:
    """One document folder per system, named by slug; a system of the same slug is replaced, others stay. Of several
    in ``systems`` the last by ``order`` is written."""
    docs = last_per_slug(systems, order).select("slug", system_json().alias("value"))
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").text(path)


# ------------------------------------------------------------------ snapshots: readers see a whole version or the one before


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the newest complete snapshot under ``path``; 0 if there is none."""
    try:
        return spark.read.schema("version bigint").parquet(f"{path}/log").agg(F.max("version")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def publish(systems: DataFrame, path: str) -> int:
    """Write a whole library as the next snapshot and return its number. The log names it only once all of it is written, so
    a writer that fails leaves no trace for readers, and of two writers of one number the second fails."""
    version = latest_version(systems.sparkSession, path) + 1
    systems.select(system_json().alias("value")).write.mode("error").text(f"{path}/version={version}")
    systems.sparkSession.range(1).select(F.lit(version).cast("bigint").alias("version")).write.mode("append").parquet(f"{path}/log")
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The systems of a snapshot, of the newest one if none is named; none where nothing was published."""
    version = latest_version(spark, path) if version is None else version
    if not version:
        return spark.createDataFrame([], S.SYSTEM)
    return parse_systems(spark.read.text(f"{path}/version={version}").withColumnRenamed("value", "text"))


def upsert_library(incoming: DataFrame, path: str, order: str | None = None) -> int:
    """``upsert`` into the newest snapshot, published as the next."""
    return publish(upsert(read_version(incoming.sparkSession, path), incoming, order), path)


def delete_system(systems: DataFrame, name: str) -> DataFrame:
    return systems.where(F.col("name") != name)


def stamped(systems: DataFrame) -> DataFrame:
    """Shipped systems carrying the fingerprint of their content."""
    mark = F.map_from_arrays(F.array(F.lit(MARKER)), F.array(content_hash()))
    plain = F.map_filter("metadata", lambda k, v: k != MARKER)
    return systems.withColumn("metadata", F.map_concat(plain, mark))


def reconcile(stored: DataFrame, shipped: DataFrame) -> DataFrame:
    """Bring unedited defaults up to date: a stored row is replaced only when its marker still matches its own
    content and the shipped content differs. Deleted defaults stay deleted; custom rows are untouched."""
    cols = [c for c in S.SYSTEM.fieldNames()]
    new = stamped(shipped.select(*cols)).select("name", F.struct(*cols).alias("_new"), content_hash().alias("_new_hash"))
    now = stored.withColumn("_hash", content_hash()).withColumn("_marker", F.element_at("metadata", MARKER))
    joined = now.join(new, "name", "left")
    stale = F.coalesce((F.col("_marker") == F.col("_hash")) & (F.col("_hash") != F.col("_new_hash")), F.lit(False))
    picked = [F.when(stale, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    rest = [c for c in stored.columns if c not in cols]
    return joined.select(*rest, *picked, stale.alias("updated"))


def restore_defaults(stored: DataFrame, shipped: DataFrame) -> DataFrame:
    """Every shipped system as shipped, every other stored system as it is."""
    cols = S.SYSTEM.fieldNames()
    kept = stored.join(shipped.select("name"), "name", "left_anti").select(*cols)
    return kept.unionByName(stamped(shipped.select(*cols)))


def open_library(spark: SparkSession, path: str) -> DataFrame:
    """Load a library folder, filling an empty one with the defaults and reconciling a filled one. Defaults that were brought up to date
    are written back, so the next reader finds them."""
    try:
        stored = load_library(spark, path)
        empty = stored.isEmpty()
    except Exception as e:  # a folder that does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        empty = True
    if empty:
        write_library(stamped(shipped_systems(spark)), path)
        return load_library(spark, path)
    stale = reconcile(stored, shipped_systems(spark)).where("updated")
    if not stale.isEmpty():
        write_library(stale.select(*S.SYSTEM.fieldNames()), path)
    return load_library(spark, path)


def fork(systems: DataFrame, variants: DataFrame) -> DataFrame:
    """Copies under new names, each optionally without one receptor (``name, new_name, drop_position``).

    Dropping shifts later pool positions and removes the receptor's slot from every regime that held it.
    """
    k = F.col("drop_position")
    joined = systems.join(variants.select("name", "new_name", "drop_position"), "name")

    def cut(values, at):
        return F.when(at >= 0, F.filter(values, lambda v, i: i != at)).otherwise(values)

    def regime(r):
        at = F.array_position(r["members"], k.cast("bigint")).cast("int") - 1
        members = F.transform(
            F.filter(r["members"], lambda i: i != k), lambda i: F.when(i > k, i - 1).otherwise(i)
        )
        contrasts = F.transform(r["contrasts"], lambda c: F.struct(
            c["name"].alias("name"), cut(c["weights"], at).alias("weights")
        ))
        return F.struct(
            r["name"].alias("name"), members.alias("members"),
            cut(r["luminance_weights"], at).alias("luminance_weights"), contrasts.alias("contrasts"),
        )

    curves = F.when(k.isNull(), F.col("curves")).otherwise(F.filter("curves", lambda c, i: i != k))
    regimes = F.when(k.isNull(), F.col("regimes")).otherwise(F.transform("regimes", regime))
    return joined.withColumn("curves", curves).withColumn("regimes", regimes).withColumn("name", F.col("new_name")).drop(
        "new_name", "drop_position"
    )


# ------------------------------------------------------------------ driver-side objects and rows


def system_row(s: VisualSystem) -> tuple:
    def curve(r: Receptor):
        return (r.name, r.curve_type, (r.kind, None), [(float(a), float(b)) for a, b in r.points], dict(r.metadata),
                r.omega, r.eta, r.luminance_weight, r.saturation, r.illumination_min, r.illumination_max,
                r.illumination_softness)

    def regime(g: Regime):
        c = None if g.contrasts is None else [(n, [float(x) for x in w]) for n, w in g.contrasts]
        w = None if g.luminance_weights is None else [float(x) for x in g.luminance_weights]
        return (g.name, [int(i) for i in g.members], w, c)

    return (s.name, [curve(r) for r in s.pool], [regime(g) for g in s.regimes], dict(s.metadata), s.illumination_min,
            s.illumination_max, s.illumination_softness)


def shipped_systems(spark: SparkSession) -> DataFrame:
    """The shipped systems as rows."""
    return spark.createDataFrame([system_row(s) for s in builtin_systems().values()], S.SYSTEM)


def systems_of(systems: DataFrame) -> Iterator[VisualSystem]:
    """Library rows as objects for kernel compilation, one partition at a time, so a library of any size can be walked."""

    def receptor(c):
        return Receptor(c["name"], tuple((p["wl"], p["v"]) for p in c["points"]), c["omega"], c["eta"],
                        c["luminance_weight"], c["saturation"], c["illumination_min"], c["illumination_max"],
                        c["illumination_softness"], c["curve_type"], c["quantity"]["kind"],
                        tuple(sorted((c["metadata"] or {}).items())))

    def regime(g):
        w = None if g["luminance_weights"] is None else tuple(g["luminance_weights"])
        c = None if g["contrasts"] is None else tuple((x["name"], tuple(x["weights"])) for x in g["contrasts"])
        return Regime(g["name"], tuple(g["members"]), w, c)

    for r in systems.select(*S.SYSTEM.fieldNames()).toLocalIterator():
        yield VisualSystem(
            r["name"], tuple(receptor(c) for c in r["curves"]), tuple(regime(g) for g in r["regimes"] or ()),
            r["illumination_min"], r["illumination_max"], r["illumination_softness"], tuple(sorted((r["metadata"] or {}).items())),
        )
