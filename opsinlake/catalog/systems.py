"""Visual-system queries: line items as receptors of one system per order, suppliers as whole library documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsinlake import constants as C
from opsinlake import schema as S
from opsinlake.catalog.base import query, rnd, rsql, table
from opsinlake.catalog.lights import template_sql
from opsinlake.functions import pigment
from opsinlake.operators import opponent, validate
from opsinlake.plans.adaptation import MAX_ITERATIONS
from opsinlake.session import spread
from opsinlake.sources import library

# ------------------------------------------------------------------ long receptor tables

RECEPTORS = """SELECT l_orderkey AS system, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS receptor,
    l_returnflag AS regime, l_linestatus = 'F' AS member,
    CASE WHEN l_discount >= 0.01 THEN l_discount END AS omega, CASE WHEN l_tax >= 0.01 THEN l_quantity END AS eta,
    CASE WHEN l_linenumber = 7 THEN 0.5 END AS luminance_weight,
    CASE WHEN l_linenumber >= 3 THEN l_discount - 0.02 END AS lo, CASE WHEN l_tax >= 0.02 THEN l_tax END AS hi,
    l_extendedprice / 1000 AS area FROM lineitem"""


def receptors(spark, sf):
    li = table(spark, sf, "lineitem")
    d, t, n = F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("system"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + n).alias("receptor"),
        F.col("l_returnflag").alias("regime"), (F.col("l_linestatus") == "F").alias("member"),
        F.when(d >= 0.01, d).alias("omega"), F.when(t >= 0.01, F.col("l_quantity")).alias("eta"),
        F.when(n == 7, F.lit(0.5)).alias("luminance_weight"),
        F.when(n >= 3, d - 0.02).alias("illumination_min"), F.when(t >= 0.02, t).alias("illumination_max"),
        (F.col("l_extendedprice") / 1000).alias("area"),
    )


def members(spark, sf):
    return receptors(spark, sf).where("member")


@query(lambda: f"""SELECT system, count(*) AS receptors,
    CAST(bool_or(coalesce(lo <= 0, FALSE) OR coalesce(hi <= 0, FALSE) OR coalesce(lo >= hi, FALSE)) AS BIGINT) AS invalid_window,
    CAST(count(eta) > 0 AND count(eta) < count(*) AS BIGINT) AS partial_eta, CAST(count(*) > 64 AS BIGINT) AS too_many
    FROM ({RECEPTORS}) GROUP BY system""")
def system_flags(spark, sf):
    f = validate.pool_flags(receptors(spark, sf))
    return f.select("system", "receptors", *[F.col(c).cast("long").alias(c) for c in ("invalid_window", "partial_eta")],
                    F.col("too_many_receptors").cast("long").alias("too_many"))


@query(lambda: f"""SELECT system, regime, {rsql('max(lo)')} AS band_min, {rsql('min(hi)')} AS band_max,
    CAST(coalesce(max(lo) > min(hi), FALSE) AS BIGINT) AS disjoint
    FROM ({RECEPTORS}) WHERE member GROUP BY system, regime""")
def regime_bands(spark, sf):
    b = validate.regime_bands(members(spark, sf))
    return b.select("system", "regime", rnd("band_min").alias("band_min"), rnd("band_max").alias("band_max"),
                    F.col("disjoint").cast("long").alias("disjoint"))


@query(lambda: f"""SELECT system, receptor FROM ({RECEPTORS}) r WHERE NOT EXISTS (SELECT 1 FROM ({RECEPTORS}) m
    WHERE m.member AND m.system = r.system AND m.receptor = r.receptor)""")
def unaffiliated_receptors(spark, sf):
    return validate.unaffiliated(receptors(spark, sf), members(spark, sf)).select("system", "receptor")


@query(lambda: f"""SELECT system, regime, receptor, {rsql('coalesce(luminance_weight, area / sum(area) OVER (PARTITION BY system, regime))')}
    AS weight FROM ({RECEPTORS}) WHERE member""")
def luminance_weights(spark, sf):
    w = validate.luminance_weights(members(spark, sf))
    return w.select("system", "regime", "receptor", rnd("weight").alias("weight"))


@query(lambda: f"""SELECT system, regime, receptor, CASE WHEN count(*) OVER g = count(omega) OVER g AND count(*) OVER g = count(eta) OVER g
    THEN {rsql('omega / sqrt(eta / sum(eta) OVER g)')} END AS noise FROM ({RECEPTORS}) WHERE member
    WINDOW g AS (PARTITION BY system, regime)""")
def receptor_noise(spark, sf):
    n = validate.receptor_noise(members(spark, sf))
    return n.select("system", "regime", "receptor", rnd("noise").alias("noise"))


_TIES = "CASE WHEN l_discount < 0.05 THEN 0.25 ELSE 0.75 END"


@query(lambda: f"""SELECT system, max(regime) AS regime, any_value(best) AS regime_gain FROM (
    SELECT system, regime, g, max(g) OVER (PARTITION BY system) AS best FROM (
        SELECT l_orderkey AS system, l_returnflag AS regime, product({_TIES}) AS g FROM lineitem GROUP BY ALL))
    WHERE g = best GROUP BY system""")
def dominant_regimes(spark, sf):
    """Most active regime per order; equal activities go to the later regime."""
    gain = F.when(F.col("l_discount") < 0.05, 0.25).otherwise(0.75)
    g = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("system"), F.col("l_returnflag").alias("regime"), gain.alias("gain"))
    return validate.dominant(validate.regime_activity(g)).select("system", "regime", "regime_gain")


_GRID = [400.0 + 40.0 * i for i in range(8)]


@query(lambda: f"""WITH r AS (SELECT system, receptor, row_number() OVER (PARTITION BY system ORDER BY receptor) AS k,
        [exp(-0.5 * pow((w - c) / 30, 2)) FOR w IN {_GRID}::DOUBLE[]] AS v
    FROM (SELECT *, 400.0 + (receptor // 1000000) % 280 AS c FROM ({RECEPTORS})))
    SELECT a.system, a.receptor AS k, b.receptor AS l, {rsql('40.0 * list_inner_product(a.v, b.v)')} AS overlap
    FROM r a JOIN r b ON a.system = b.system AND a.k <= b.k""")
def receptor_overlap(spark, sf):
    """Gram entries of the receptors of every order."""
    r = receptors(spark, sf)
    centre = F.expr("400.0 + (receptor div 1000000) % 280").cast("double")
    values = F.array(*[F.exp(F.lit(-0.5) * F.pow((F.lit(w) - centre) / 30.0, F.lit(2.0))) for w in _GRID])
    g = opponent.gram_pairs(r.select("system", "receptor", values.alias("values")), 40.0)
    return g.select("system", "k", "l", rnd("overlap").alias("overlap"))


@query()
def adaptation_sweep(spark, sf):
    """Sharpening matrix of one trichromat per supplier, its receptor peaks shifted by the supplier's nation and key."""
    s = spread(table(spark, sf, "supplier"))
    shift = [F.col("s_nationkey") * 1.0, F.col("s_suppkey") % 17 * 1.0, F.col("s_suppkey") % 23 + 15.0]
    peaks = s.select("s_suppkey", *[(F.lit(b) + d).alias(f"p{i}") for i, (b, d) in enumerate(zip((415.0, 515.0, 560.0), shift))])
    grid = [300.0 + 5.0 * i for i in range(91)]
    for i in range(3):
        peaks = peaks.withColumn(f"v{i}", pigment.template_values("A1", F.col(f"p{i}"), grid))
    peaks = peaks.withColumn("gram", opponent.gram_column(F.array("v0", "v1", "v2"), 5.0))
    solved = peaks.select("s_suppkey", opponent.sharpen_column(F.col("gram")).alias("r"))
    return solved.select("s_suppkey", F.col("r.lambda").alias("strength"), F.col("r.dominant").alias("dominant"),
                         F.inline(F.transform("r.matrix", lambda v, i: F.struct(i.alias("cell"), v.alias("value")))))


_PEAKS = {"p": ("420.0 + s_nationkey", lambda: 420.0 + F.col("s_nationkey")), "q": ("480.0 + (s_suppkey * 7) % 90", lambda: 480.0 + F.col("s_suppkey") * 7 % 90)}


def _pairs_sql():
    """Gradient descent with step halving as a recursion: a row is one trial step of one receptor pair at one strength. The
    free cells are a and b of [[1, a], [b, 1]]; the overlap is o = [1, a] G [b, 1]'."""
    tops = ", ".join(f"(SELECT max({template_sql('A1', peak, f'({peak}) - 5 + 0.05 * i')}) FROM range(201) t(i)) AS top_{x}" for x, (peak, _) in _PEAKS.items())
    value = {x: f"{template_sql('A1', peak, '(300.0 + 5.0 * i)')} / top_{x}" for x, (peak, _) in _PEAKS.items()}
    o = lambda a, b: f"(g11 * ({b}) + g12 + ({a}) * (g12 * ({b}) + g22))"
    cost = lambda a, b: f"({o(a, b)} ** 2 + lam * (({a}) ** 2 + ({b}) ** 2))"
    grads = f"2 * ({o('a', 'b')} * (g12 * b + g22) + lam * a) AS ga, 2 * ({o('a', 'b')} * (g11 + a * g12) + lam * b) AS gb"
    keep = "s_suppkey, g11, g12, g22, lam"
    return f"""WITH RECURSIVE s AS (SELECT s_suppkey, s_nationkey, {tops} FROM supplier),
    v AS (SELECT s_suppkey, {value['p']} AS x, {value['q']} AS y FROM s, range(91) t(i)),
    g AS (SELECT s_suppkey, 5.0 * sum(x * x) AS g11, 5.0 * sum(x * y) AS g12, 5.0 * sum(y * y) AS g22 FROM v GROUP BY s_suppkey),
    w({keep}, n, step, a, b, f, ga, gb, moving) AS (
        SELECT {keep}, 0, 0.5::DOUBLE, a, b, {cost('a', 'b')}, {grads}, TRUE FROM (SELECT *, unnest({list(C.SHARPEN_LAMBDAS)}::DOUBLE[]) AS lam, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM g)
        UNION ALL
        SELECT {keep}, n, step, a, b, f, ga, gb, n < {MAX_ITERATIONS} AND sqrt(ga ** 2 + gb ** 2) >= 1e-10 FROM (
            SELECT {keep}, n + CAST(taken AS INT) AS n, CASE WHEN taken THEN step * 1.2 ELSE step * 0.5 END AS step, a, b, f, {grads} FROM (
                SELECT {keep}, n, step, taken, CASE WHEN taken THEN a2 ELSE a END AS a, CASE WHEN taken THEN b2 ELSE b END AS b, CASE WHEN taken THEN f2 ELSE f END AS f FROM (
                    SELECT *, f2 < f OR step < 1e-8 AS taken FROM (
                        SELECT *, {cost('a2', 'b2')} AS f2 FROM (SELECT *, a - step * ga AS a2, b - step * gb AS b2 FROM w WHERE moving)))))),
    e AS (SELECT *, greatest(abs(a), abs(b)) AS worst FROM w WHERE NOT moving),
    r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY worst >= 1, CASE WHEN worst < 1 THEN lam ELSE worst END, lam) AS k FROM e)
    SELECT s_suppkey, lam AS strength, CAST(worst < 1 AS BIGINT) AS dominant, {rsql('a', 5)} AS a, {rsql('b', 5)} AS b,
        {rsql('1 / (1 - a * b)', 5)} AS inverse_first, {rsql('-b / (1 - a * b)', 5)} AS inverse_third FROM r WHERE k = 1"""


@query(_pairs_sql)
def adaptation_pairs(spark, sf):
    """Sharpening matrix of one dichromat per supplier, against a descent that SQL makes itself."""
    s = spread(table(spark, sf, "supplier")).select("s_suppkey", *[peak().alias(x) for x, (_, peak) in _PEAKS.items()])
    grid = [300.0 + 5.0 * i for i in range(91)]
    for x in _PEAKS:
        s = s.withColumn(f"v_{x}", pigment.template_values("A1", F.col(x), grid))
    r = s.select("s_suppkey", opponent.sharpen_column(opponent.gram_column(F.array("v_p", "v_q"), 5.0)).alias("r"))
    cell = [rnd(F.get(F.col(f"r.{m}"), i), 5) for m, i in (("matrix", 1), ("matrix", 2), ("inverse", 0), ("inverse", 2))]
    return r.select("s_suppkey", F.col("r.lambda").alias("strength"), F.col("r.dominant").cast("long").alias("dominant"),
                    *(c.alias(n) for c, n in zip(cell, ("a", "b", "inverse_first", "inverse_third"))))


# ------------------------------------------------------------------ library documents


def supplier_systems(spark, sf, bump=0.0):
    """One nested system per supplier: three receptors with three-point curves, two regimes, some fields absent."""
    s = table(spark, sf, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    none = F.lit(None).cast("double")

    def curve(i):
        peak = 430.0 + 60.0 * i + nation
        pts = F.array(*[F.struct(x.cast("double").alias("wl"), F.lit(v).alias("v"))
                        for x, v in ((F.lit(380.0), 0.0), (peak, 1.0), (F.lit(720.0), 0.0))])
        radiance = F.lit(i == 2)
        return F.struct(
            F.lit(f"receptor {i}").alias("name"), F.lit("sensitivity").alias("curve_type"),
            F.struct(F.when(radiance, "Radiance").otherwise("Sensitivity").alias("kind"),
                     F.when(radiance, "W/m2/nm").alias("unit")).alias("quantity"),
            pts.alias("points"), F.expr("cast(map() as map<string,string>)").alias("metadata"),
            F.lit(0.05).alias("omega"), F.when(key % 5 != i, F.lit(float(i + 1)) + bump).alias("eta"),
            none.alias("luminance_weight"), none.alias("saturation"),
            F.when(key % 7 == i, F.lit(1e-3)).alias("illumination_min"), none.alias("illumination_max"),
            none.alias("illumination_softness"),
        )

    def regime(name, member, weights, contrasts):
        return F.struct(F.lit(name).alias("name"), F.array(*[F.lit(m).cast("bigint") for m in member]).alias("members"),
                        weights.alias("luminance_weights"), contrasts.alias("contrasts"))

    weights = F.when(key % 2 == 0, F.lit([0.2, 0.3, 0.5]))
    contrast = F.array(F.struct(F.lit("c").alias("name"), F.lit([1.0, -1.0, 0.0]).alias("weights")))
    regimes = F.array(
        regime("day", (0, 1, 2), weights, F.when(key % 3 == 0, contrast)),
        regime("night", (1, 5, 2), F.lit(None).cast("array<double>"), F.lit(None).cast(S.REGIME["contrasts"].dataType)),
    )
    return s.select(
        "s_suppkey", F.col("s_name").alias("name"), F.array(*[curve(i) for i in range(3)]).alias("curves"),
        regimes.alias("regimes"),
        F.map_from_arrays(F.array(F.lit("nation")), F.array(nation.cast("string"))).alias("metadata"),
        F.when(key % 4 == 0, F.lit(1e-5)).alias("illumination_min"), none.alias("illumination_max"),
        none.alias("illumination_softness"),
    ).select("s_suppkey", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.SYSTEM.fields])


@query(lambda: """SELECT p_partkey, trim(lower(regexp_replace(p_name || ' (' || p_brand || ') ' || p_type || '!', '[^A-Za-z0-9]+', '_', 'g')), '_')
    AS slug FROM part""")
def library_slugs(spark, sf):
    """Document names of systems."""
    p = table(spark, sf, "part")
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "), "p_type", F.lit("!"))
    return p.select("p_partkey", library.slug(name).alias("slug"))


def documents(spark, sf):
    """Supplier systems as text: the current layout, every third in the older one, every tenth unreadable."""
    current = supplier_systems(spark, sf).select("s_suppkey", library.system_json().alias("text"))
    old = F.concat(
        F.lit('{"name": "'), F.get_json_object("text", "$.name"), F.lit('", "colorspace_curves": '),
        F.when(F.col("s_suppkey") % 2 == 0, F.get_json_object("text", "$.curves")).otherwise(F.lit("[]")),
        F.lit(', "isolated_curves": '), F.get_json_object("text", "$.curves"),
        F.lit(', "opponent_contrasts": [{"name": "o", "weights": [1, 2, 3]}]}'),
    )
    pick = F.when(F.col("s_suppkey") % 10 == 9, F.lit("{broken")).when(F.col("s_suppkey") % 3 == 0, old).otherwise(
        F.col("text"))
    return current.select("s_suppkey", pick.alias("text"))


@query(lambda: """SELECT s_suppkey, s_name AS name, CAST(CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 6 ELSE 3 END AS BIGINT) AS curves,
    CAST(CASE WHEN s_suppkey % 3 <> 0 THEN 2 WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS regimes,
    CASE WHEN s_suppkey % 3 <> 0 THEN 'day' WHEN s_suppkey % 2 = 0 THEN 'Colorspace' END AS first_regime,
    CASE WHEN s_suppkey % 3 <> 0 THEN 3.0 WHEN s_suppkey % 2 = 0 THEN 3.0 END::DOUBLE AS slots,
    CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'o' END AS first_contrast,
    CASE WHEN s_suppkey % 5 <> 1 THEN 2.0 END AS eta, 'Radiance' AS last_kind, 'W/m2/nm' AS last_unit,
    CAST(490 + s_nationkey AS DOUBLE) AS peak,
    CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 4 = 0 THEN 1e-5 END AS set_min FROM supplier WHERE s_suppkey % 10 <> 9""")
def library_documents(spark, sf):
    """Both document layouts parsed; unreadable text is skipped."""
    d = library.parse_systems(documents(spark, sf))
    first = F.get("regimes", 0)
    second = F.get("curves", 1)
    return d.select(
        "s_suppkey", "name", F.size("curves").cast("long").alias("curves"), F.size("regimes").cast("long").alias("regimes"),
        first["name"].alias("first_regime"), F.when(first.isNotNull(), F.size(first["members"])).cast("double").alias("slots"),
        F.get(first["contrasts"], 0)["name"].alias("first_contrast"), second["eta"].alias("eta"),
        F.element_at("curves", -1)["quantity"]["kind"].alias("last_kind"),
        F.element_at("curves", -1)["quantity"]["unit"].alias("last_unit"),
        F.get(second["points"], 1)["wl"].alias("peak"), F.col("illumination_min").alias("set_min"),
    )


@query(lambda: """SELECT s_suppkey, CAST(s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 3 AND s_suppkey % 5 <> 0 AS BIGINT) AS updated,
    CASE WHEN s_suppkey % 3 = 0 THEN 9.0 WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 4 = 3 THEN 1.0 ELSE 2.0 END AS eta
    FROM supplier WHERE s_suppkey % 6 <> 5""")
def library_reconcile(spark, sf):
    """Stored defaults against newer ones: every third was edited, some have no newer content, some were deleted."""
    key = F.col("s_suppkey")
    old = supplier_systems(spark, sf)
    first_eta = F.transform("curves", lambda c, i: F.when(i == 0, c.withField("eta", F.lit(9.0))).otherwise(c))
    stored = library.stamped(old.where(key % 6 != 5)).withColumn(
        "curves", F.when(key % 3 == 0, first_eta).otherwise(F.col("curves")))
    # every fourth and every fifth supplier ships the content it had before
    same = (key % 4 == 3) | (key % 5 == 0)
    newer = supplier_systems(spark, sf, bump=1.0).where(~same)
    shipped = newer.unionByName(old.where(same)).drop("s_suppkey")
    out = library.reconcile(stored, shipped)
    return out.select("s_suppkey", F.col("updated").cast("long").alias("updated"), F.get("curves", 0)["eta"].alias("eta"))


@query(lambda: """SELECT s_name AS name, CAST(s_suppkey % 2 AS BIGINT) AS marked, CASE WHEN s_suppkey % 5 = 1 THEN NULL
    WHEN s_suppkey % 2 = 0 THEN 2.0 ELSE 3.0 END AS eta FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 3 <> 0""")
def library_restore(spark, sf):
    """Defaults (odd suppliers) restored over a library that misses some and has others edited."""
    stored = supplier_systems(spark, sf).where("s_suppkey % 3 != 0").drop("s_suppkey")
    shipped = supplier_systems(spark, sf, bump=1.0).where("s_suppkey % 2 = 1").drop("s_suppkey")
    out = library.restore_defaults(stored, shipped)
    marked = F.map_contains_key("metadata", library.MARKER).cast("long")
    return out.select("name", marked.alias("marked"), F.get("curves", 1)["eta"].alias("eta"))


def _document_sql():
    """Text of an incoming system as ``library.system_json`` writes it, from columns ``name``, ``k`` and ``nation``."""
    def curve(i):
        kind = r'"{\"radiance\":{\"unit\":\"W/m2/nm\"}}"' if i == 2 else '"sensitivity"'
        return (f"""'{{"name":"receptor {i}","curve_type":"sensitivity","quantity":{kind},"points":[[380.0,0.0],[' || ({430 + 60 * i} + nation) || '.0,1.0],[720.0,0.0]],'
        || '"metadata":{{}},"omega":0.05' || CASE WHEN k % 5 <> {i} THEN ',"eta":{i + 2}.0' ELSE '' END || CASE WHEN k % 7 = {i} THEN ',"illumination_min":0.001' ELSE '' END || '}}'""")

    return r"""'{"name":"' || replace(replace(name, '\', '\\'), '"', '\"') || '","curves":[' || """ + " || ',' || ".join(curve(i) for i in range(3)) + """
        || '],"metadata":{"fresh":"1","nation":"' || nation || '"},"regimes":[{"name":"day","curves":[0,1,2]' || CASE WHEN k % 2 = 0 THEN ',"luminance_weights":[0.2,0.3,0.5]' ELSE '' END
        || CASE WHEN k % 3 = 0 THEN ',"opponent_contrasts":[{"name":"c","weights":[1.0,-1.0,0.0]}]' ELSE '' END || '},{"name":"night","curves":[1,5,2]}]}'"""


# of systems that came at one time the largest name stays, then the largest fingerprint of the content
@query(lambda: f"""WITH old AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 5 <> 1 THEN 2.0 END AS eta FROM supplier),
    new AS (SELECT s_suppkey AS k, s_nationkey AS nation, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN lower(replace(s_name, '#', ' -- ')) ELSE 'Group / ' || s_suppkey % 7 END AS name,
        CASE WHEN s_suppkey % 5 <> 1 THEN 3.0 END AS eta, (s_suppkey * 37) % 1009 AS came FROM supplier WHERE s_suppkey % 4 <> 0),
    slugged AS (SELECT *, trim(lower(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g')), '_') AS slug, sha256({_document_sql()}) AS content FROM new),
    last AS (SELECT slug, name, eta FROM slugged QUALIFY row_number() OVER (PARTITION BY slug ORDER BY came DESC, name DESC, content DESC) = 1)
    SELECT slug, name, eta, CAST(1 AS BIGINT) AS fresh FROM last UNION ALL
    SELECT s, name, eta, 0 FROM (SELECT *, trim(lower(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g')), '_') AS s FROM old) WHERE s NOT IN (SELECT slug FROM last)""")
def library_upsert(spark, sf):
    """Systems written over a library in order of arrival: some keep their names, some spell them otherwise, and many share
    a few names of which the last written stays."""
    key = F.col("s_suppkey")
    stored = supplier_systems(spark, sf)
    name = F.when(key % 3 == 0, F.col("name")).when(key % 3 == 1, F.lower(F.replace("name", F.lit("#"), F.lit(" -- ")))).otherwise(
        F.concat(F.lit("Group / "), (key % 7).cast("string")))
    mark = F.map_concat("metadata", F.create_map(F.lit("fresh"), F.lit("1")))
    incoming = supplier_systems(spark, sf, bump=1.0).where(key % 4 != 0).withColumns({"name": name, "metadata": mark, "at": (key * 37) % 1009})
    out = library.upsert(stored, incoming, "at")
    return out.select(library.slug(F.col("name")).alias("slug"), "name", F.get("curves", 1)["eta"].alias("eta"),
                      F.map_contains_key("metadata", "fresh").cast("long").alias("fresh"))


@query(lambda: """SELECT s_suppkey, s_name || ' variant' AS name, CAST(CASE WHEN s_suppkey % 4 = 3 THEN 3 ELSE 2 END AS BIGINT) AS curves,
    CASE s_suppkey % 4 WHEN 0 THEN '0,1' WHEN 1 THEN '0,1' WHEN 2 THEN '0,1' ELSE '0,1,2' END AS day,
    CASE s_suppkey % 4 WHEN 0 THEN '0,4,1' WHEN 1 THEN '4,1' WHEN 2 THEN '1,4' ELSE '1,5,2' END AS night,
    CASE WHEN s_suppkey % 2 = 1 THEN NULL WHEN s_suppkey % 4 = 0 THEN '0.3,0.5' ELSE '0.2,0.3' END AS day_weights,
    CASE WHEN s_suppkey % 3 <> 0 THEN NULL ELSE CASE s_suppkey % 4 WHEN 0 THEN '-1.0,0.0' WHEN 1 THEN '1.0,0.0'
        WHEN 2 THEN '1.0,-1.0' ELSE '1.0,-1.0,0.0' END END AS day_contrast FROM supplier""")
def library_fork(spark, sf):
    """A variant of every system, three out of four without one of its receptors."""
    s = supplier_systems(spark, sf)
    drop = F.when(F.col("s_suppkey") % 4 < 3, (F.col("s_suppkey") % 4).cast("int"))
    v = s.select("name", F.concat("name", F.lit(" variant")).alias("new_name"), drop.alias("drop_position"))
    f = library.fork(s, v)

    def text(values):
        return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")

    day, night = F.get("regimes", 0), F.get("regimes", 1)
    return f.select(
        "s_suppkey", "name", F.size("curves").cast("long").alias("curves"), text(day["members"]).alias("day"),
        text(night["members"]).alias("night"), text(day["luminance_weights"]).alias("day_weights"),
        text(F.get(day["contrasts"], 0)["weights"]).alias("day_contrast"),
    )


@query(lambda: """SELECT s_suppkey, 'day' AS regime, i AS slot, i AS receptor, CASE WHEN s_suppkey % 2 = 0 THEN [0.2, 0.3, 0.5][i + 1] END AS weight,
        CASE WHEN s_suppkey % 4 = 0 THEN 1e-5 END AS set_min FROM supplier, range(3) t(i)
    UNION ALL SELECT s_suppkey, 'night', i, i + 1, NULL, CASE WHEN s_suppkey % 4 = 0 THEN 1e-5 END FROM supplier, range(2) t(i)""")
def regime_members(spark, sf):
    """Memberships of nested systems: positions outside the pool are skipped and weights follow their slot."""
    m = validate.member_rows(supplier_systems(spark, sf).drop("s_suppkey"))
    key = F.regexp_extract("system", r"(\d+)$", 1).cast("long")
    return m.select(key.alias("s_suppkey"), "regime", F.col("slot").cast("long").alias("slot"),
                    F.col("receptor").cast("long").alias("receptor"), F.col("luminance_weight").alias("weight"), "set_min")


@query(lambda: """SELECT s_suppkey, 'night' AS regime FROM supplier WHERE s_suppkey % 3 < 2 UNION ALL SELECT s_suppkey, 'day' FROM supplier WHERE s_suppkey % 3 = 0""")
def empty_regimes(spark, sf):
    """Regimes that have lost all their members, in systems whose pools were cut to none, one or two receptors."""
    s = supplier_systems(spark, sf)
    pool = F.slice("curves", 1, (F.col("s_suppkey") % 3).cast("int"))
    found = validate.empty_regimes(validate.regime_rows(s.withColumn("curves", pool).drop("s_suppkey")))
    return found.select(F.regexp_extract("system", r"(\d+)$", 1).cast("long").alias("s_suppkey"), "regime")


@query(lambda: "SELECT s_suppkey, s_name AS name FROM supplier WHERE s_suppkey <> (SELECT min(s_suppkey) FROM supplier)")
def library_delete(spark, sf):
    """A library without one system, named exactly."""
    s = supplier_systems(spark, sf)
    name = s.agg(F.min_by("name", "s_suppkey")).first()[0]
    return library.delete_system(library.delete_system(s, name), name.lower()).select("s_suppkey", "name")
