"""Light-level queries over the event log read as a log of measured light."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsinlake.catalog.base import LIGHT_FACTOR, UNIFORM, light_factor, num, query, rnd, rsql, table
from opsinlake.operators import light_levels
from opsinlake.plans import kernel as K
from opsinlake.plans.systems import builtin, curve_integral

FROG = builtin("Frog")


def gain_sql(level: str, lower, upper, softness: float) -> str:
    """Operating gain with fixed bounds; only positive, uncrossed bounds appear here."""
    def rise(bound):
        t = f"(log10({level}) - log10({num(bound)}))"
        return f"CASE WHEN {level} > 0 THEN 1 / (1 + pow(10.0, -{t} / {num(softness)})) ELSE 0.0 END"

    parts = []
    if lower is not None:
        parts.append(f"({rise(lower)})")
    if upper is not None:
        parts.append(f"(1 - {rise(upper)})")
    return f"greatest(0.0, least(1.0, {' * '.join(parts) or '1.0'}))"


def _gains_sql(factor: str) -> list[str]:
    seen = K.seen_irradiance(FROG.pool, UNIFORM)
    return [
        gain_sql(f"({factor} * {num(e)})", r.illumination_min, r.illumination_max, r.illumination_softness)
        for r, e in zip(FROG.pool, seen)
    ]


def _regimes_sql(source: str, factor: str, keep: str) -> str:
    """``keep, g0..g4, Scotopic, Mesopic, Photopic, dominant_regime``."""
    gains = ", ".join(f"{g} AS g{i}" for i, g in enumerate(_gains_sql(factor)))
    activity = ", ".join(f"{' * '.join(f'g{i}' for i in r.members)} AS {r.name}" for r in FROG.regimes)
    best = (
        "CASE WHEN Photopic >= greatest(Scotopic, Mesopic) THEN 'Photopic' WHEN Mesopic >= Scotopic THEN 'Mesopic' "
        "ELSE 'Scotopic' END AS dominant_regime"
    )
    return f"SELECT *, {best} FROM (SELECT *, {activity} FROM (SELECT {keep}, {gains} FROM {source}))"


def _log(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "value")


def _gain_log_sql():
    cols = ", ".join(f"{rsql(f'g{i}', 9)} AS g{i}" for i in range(5))
    return f"SELECT event_id, {cols} FROM ({_regimes_sql('events', LIGHT_FACTOR, 'event_id')})"


@query(_gain_log_sql)
def operating_gain_log(spark, sf):
    gains = light_levels.receptor_gains(FROG, UNIFORM, "f")
    return _log(spark, sf).withColumn("f", light_factor(F.col("value"))).select("event_id", *[rnd(g, 9).alias(f"g{i}") for i, g in enumerate(gains)])


def _dominant_sql():
    on = "CASE dominant_regime " + " ".join(
        f"WHEN '{r.name}' THEN {' OR '.join(f'g{i} > 0.1' for i in r.members)}" for r in FROG.regimes
    ) + " END"
    acts = ", ".join(f"{rsql(r.name, 9)} AS {r.name}" for r in FROG.regimes)
    return (
        f"SELECT event_id, {acts}, dominant_regime, CAST({on} AS BIGINT) AS active "
        f"FROM ({_regimes_sql('events', LIGHT_FACTOR, 'event_id')})"
    )


@query(_dominant_sql)
def dominant_regime_log(spark, sf):
    df = light_levels.with_regimes(_log(spark, sf), FROG, UNIFORM, light_factor(F.col("value")))
    return df.select(
        "event_id", *[rnd(r.name, 9).alias(r.name) for r in FROG.regimes], "dominant_regime",
        F.col("active").cast("long").alias("active"),
    )


@query(
    lambda: "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_start, dominant_regime, count(*) AS n FROM "
    f"({_regimes_sql('events', LIGHT_FACTOR, 'event_id, ts')}) GROUP BY ALL"
)
def hourly_dominance(spark, sf):
    log = light_levels.with_regimes(_log(spark, sf), FROG, UNIFORM, light_factor(F.col("value")))
    n = light_levels.hourly_dominance(log)
    return n.select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("hour_start"), "dominant_regime", "n")


def _sweep_sql():
    factor = "(pow(10.0, -24.0 + step * 0.5) * pow(10.0, s_acctbal / 5000.0))"
    source = "(SELECT s_suppkey, s_acctbal, CAST(step AS BIGINT) AS step FROM supplier, range(97) t(step))"
    acts = ", ".join(f"{rsql(r.name, 9)} AS {r.name}" for r in FROG.regimes)
    total = num(curve_integral(UNIFORM))
    return (
        f"SELECT s_suppkey, step, {rsql(f'log10({factor} * {total})')} AS log_level, {acts} "
        f"FROM ({_regimes_sql(source, factor, 's_suppkey, s_acctbal, step')})"
    )


@query(_sweep_sql)
def dominance_sweep(spark, sf):
    """The 97-level sweep for one light per supplier."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    scale = F.pow(F.lit(10.0), F.col("s_acctbal") / 5000.0)
    df = light_levels.dominance_sweep(s, FROG, UNIFORM, scale)
    return df.select(
        "s_suppkey", F.col("step").cast("long").alias("step"), rnd("log_level").alias("log_level"),
        *[rnd(r.name, 9).alias(r.name) for r in FROG.regimes],
    )


def _report_sql():
    factor = "pow(10.0, c_acctbal / 1000.0 - 6)"
    seen = K.seen_irradiance(FROG.pool, UNIFORM)
    regimes = [", ".join(r.name for r in FROG.regimes if i in r.members) for i in range(len(FROG.pool))]
    return " UNION ALL ".join(
        f"SELECT c_custkey, '{r.name}' AS receptor, '{m}' AS regimes, {rsql(f'{factor} * {num(e)}')} AS seen, "
        f"{rsql(g, 9)} AS gain FROM customer"
        for r, m, e, g in zip(FROG.pool, regimes, seen, _gains_sql(factor))
    )


@query(_report_sql)
def operating_report(spark, sf):
    """Receptor states of the frog under one light per customer."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    factor = F.pow(F.lit(10.0), F.col("c_acctbal") / 1000.0 - 6)
    df = light_levels.operating_report(c, FROG, UNIFORM, factor)
    return df.select("c_custkey", "receptor", "regimes", rnd("seen").alias("seen"), rnd("gain", 9).alias("gain"))


def _free_gain_sql():
    lo = "CASE WHEN l_discount < 0.01 THEN NULL WHEN l_discount < 0.03 THEN -1.0 ELSE l_discount END"
    hi = "CASE WHEN l_tax < 0.01 THEN NULL ELSE l_tax * 2 END"
    soft = "CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 0.0 ELSE l_linenumber / 8.0 END"
    level = "CASE WHEN l_quantity < 3 THEN 0.0 ELSE l_quantity / 500.0 END"
    inner = f"SELECT l_orderkey, l_linenumber, l_partkey, {lo} AS lo, {hi} AS hi, coalesce({soft}, 0.5) AS s, {level} AS e FROM lineitem"
    valid = "SELECT *, CASE WHEN lo > 0 THEN lo END AS a, CASE WHEN hi > 0 THEN hi END AS b"
    open_ = f"SELECT *, a IS NOT NULL AND b IS NOT NULL AND a >= b AS crossed FROM ({valid} FROM ({inner}))"

    def rise(bound):
        t = f"(log10(e) - log10({bound}))"
        return (
            f"(CASE WHEN s > 1e-9 THEN CASE WHEN e > 0 THEN 1 / (1 + pow(10.0, -{t} / s)) ELSE 0.0 END "
            f"WHEN e > 0 AND {t} >= 0 THEN 1.0 ELSE 0.0 END)"
        )

    g = (
        f"(CASE WHEN a IS NULL OR crossed THEN 1.0 ELSE {rise('a')} END) * "
        f"(CASE WHEN b IS NULL OR crossed THEN 1.0 ELSE 1 - {rise('b')} END)"
    )
    return (
        f"SELECT l_orderkey, count(*) AS receptors, {rsql('product(g)', 9)} AS regime_gain, "
        f"CAST(bool_or(g > 0.1) AS BIGINT) AS active FROM (SELECT *, {g} AS g FROM ({open_})) GROUP BY l_orderkey"
    )


@query(_free_gain_sql)
def regime_activity(spark, sf):
    """Order = visual system, line item = receptor with its own window, every kind of bound included."""
    from opsinlake.functions.gain import window_gain
    from opsinlake.operators import validate

    li = table(spark, sf, "lineitem")
    d, t, n, q = (F.col(c) for c in ("l_discount", "l_tax", "l_linenumber", "l_quantity"))
    null = F.lit(None).cast("double")
    lo = F.when(d < 0.01, null).when(d < 0.03, F.lit(-1.0)).otherwise(d)
    hi = F.when(t < 0.01, null).otherwise(t * 2)
    soft = F.when(n == 1, null).when(n == 2, F.lit(0.0)).otherwise(n / 8.0)
    level = F.when(q < 3, F.lit(0.0)).otherwise(q / 500.0)
    g = li.select(F.col("l_orderkey").alias("system"), F.lit("all").alias("regime"),
                  window_gain(level, lo, hi, soft).alias("gain"))
    return validate.regime_activity(g).select(
        F.col("system").alias("l_orderkey"), "receptors", rnd("regime_gain", 9).alias("regime_gain"),
        F.col("active").cast("long").alias("active"),
    )
