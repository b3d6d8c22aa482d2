"""Checks and grouped figures over tables of visual systems.

Two long tables describe any number of systems: ``pool`` (``system, receptor`` and the nullable receptor fields)
and ``members`` (the same plus ``regime``), one row per regime membership. Everything is a grouped aggregate with
map-side combination, or an anti-join; no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsinlake import constants as C
from opsinlake.functions.gain import noise_term

FIELDS = ("omega", "eta", "luminance_weight", "saturation", "illumination_min", "illumination_max",
          "illumination_softness")


def pool_rows(systems: DataFrame) -> DataFrame:
    """Long pool of nested system rows, with set-level window defaults as ``set_*`` columns."""
    return systems.select(
        F.col("name").alias("system"),
        *[F.col(f"illumination_{k}").alias(f"set_{k}") for k in ("min", "max", "softness")],
        F.posexplode("curves").alias("receptor", "_c"),
    ).select("system", "receptor", "set_min", "set_max", "set_softness", F.col("_c.name").alias("receptor_name"),
             F.col("_c.points").alias("points"), *[F.col(f"_c.{f}").alias(f) for f in FIELDS])


def regime_rows(systems: DataFrame) -> DataFrame:
    """One row per regime; contrasts and weights of the wrong length become null."""
    per = systems.select(
        F.col("name").alias("system"), F.size("curves").alias("_n"), F.posexplode("regimes").alias("regime_pos", "_r")
    )
    valid = F.filter("_r.members", lambda i: (i >= 0) & (i < F.col("_n")))
    base = per.withColumn("members", valid)
    k = F.size("members")
    own = F.col("_r.luminance_weights")
    rows = F.col("_r.contrasts")
    usable = (F.size(rows) > 0) & F.forall(rows, lambda c: F.size(c["weights"]) == k)
    return base.select(
        "system", "regime_pos", F.col("_r.name").alias("regime"), "members",
        F.when(F.size(own) == k, own).alias("luminance_weights"), F.when(usable, rows).alias("contrasts"),
    )


def member_rows(systems: DataFrame) -> DataFrame:
    """Long memberships: pool fields per regime slot, with the slot's weight override where the regime has one."""
    slots = regime_rows(systems).select(
        "system", "regime", "regime_pos", "luminance_weights", F.posexplode("members").alias("slot", "_m")
    )
    override = F.get("luminance_weights", F.col("slot"))
    slots = slots.select("system", "regime", "regime_pos", "slot", F.col("_m").cast("int").alias("receptor"),
                         override.alias("_override"))
    joined = slots.join(pool_rows(systems), ["system", "receptor"])
    return joined.withColumn("luminance_weight", F.coalesce("_override", "luminance_weight")).drop("_override")


def _bound(side: str, with_set: bool) -> Column:
    own = F.col(f"illumination_{side}")
    return F.coalesce(own, F.col(f"set_{side}")) if with_set else own


def _has_set(df: DataFrame) -> bool:
    return "set_min" in df.columns


def invalid_window(with_set: bool = False) -> Column:
    """A bound that is not positive, or bounds that cross (also after falling back to the set defaults)."""
    lo, hi = F.col("illumination_min"), F.col("illumination_max")
    bad = F.coalesce(lo <= 0, F.lit(False)) | F.coalesce(hi <= 0, F.lit(False)) | F.coalesce(lo >= hi, F.lit(False))
    if with_set:
        bad = bad | F.coalesce(_bound("min", True) >= _bound("max", True), F.lit(False))
        bad = bad | F.coalesce(F.col("set_min") <= 0, F.lit(False)) | F.coalesce(F.col("set_max") <= 0, F.lit(False))
        bad = bad | F.coalesce(F.col("set_min") >= F.col("set_max"), F.lit(False))
    return bad


def pool_flags(pool: DataFrame) -> DataFrame:
    """Per system: receptor count, malformed windows, partly known densities, too many receptors."""
    known = F.count("eta")
    total = F.count(F.lit(1))
    return pool.groupBy("system").agg(
        total.alias("receptors"),
        F.bool_or(invalid_window(_has_set(pool))).alias("invalid_window"),
        ((known > 0) & (known < total)).alias("partial_eta"),
        (total > C.MAX_RECEPTORS).alias("too_many_receptors"),
    )


def unaffiliated(pool: DataFrame, members: DataFrame) -> DataFrame:
    """Receptors of the pool that belong to no regime."""
    return pool.join(members.select("system", "receptor"), ["system", "receptor"], "left_anti")


def affiliated(pool: DataFrame, members: DataFrame) -> DataFrame:
    return pool.join(members.select("system", "receptor"), ["system", "receptor"], "left_semi")


def empty_regimes(regimes: DataFrame) -> DataFrame:
    """Regimes without a usable member."""
    return regimes.where(F.size("members") == 0).select("system", "regime")


def regime_bands(members: DataFrame) -> DataFrame:
    """Light band of each regime: the intersection of its members' windows; null means unbounded on that side."""
    s = _has_set(members)
    return (
        members.groupBy("system", "regime")
        .agg(F.max(_bound("min", s)).alias("band_min"), F.min(_bound("max", s)).alias("band_max"))
        .withColumn("disjoint", F.coalesce(F.col("band_min") > F.col("band_max"), F.lit(False)))
    )


def regime_activity(gains: DataFrame, gain: str = "gain") -> DataFrame:
    """Product of member gains per regime, whether any member operates, and the number of members."""
    return gains.groupBy("system", "regime").agg(
        F.count(F.lit(1)).alias("receptors"), F.product(gain).alias("regime_gain"), F.bool_or(F.col(gain) > C.ACTIVE_GAIN).alias("active")
    )


def luminance_weights(members: DataFrame, area: str = "area") -> DataFrame:
    """Weight of every member: the override, else its share of the regime's curve areas (not renormalised)."""
    total = F.sum(area).over(Window.partitionBy("system", "regime"))
    share = F.when(F.col("_total") > 0, F.col(area) / F.col("_total")).otherwise(F.lit(0.0))
    return members.withColumn("_total", total).withColumn("weight", F.coalesce("luminance_weight", share)).drop("_total")


def receptor_noise(members: DataFrame) -> DataFrame:
    """Noise of every member, null for the whole regime when any member lacks data or densities do not add up."""
    regime = Window.partitionBy("system", "regime")
    n = F.count(F.lit(1)).over(regime)
    whole = (F.count("omega").over(regime) == n) & (F.count("eta").over(regime) == n)
    summed = members.withColumn("_eta", F.when(whole, F.sum("eta").over(regime)))
    return summed.withColumn("noise", noise_term(F.col("omega"), F.col("eta"), F.col("_eta"))).drop("_eta")


def dominant(activity: DataFrame, order: str = "regime") -> DataFrame:
    """Most active regime per system; among equals the one that sorts last by ``order``."""
    return activity.groupBy("system").agg(
        F.max_by("regime", F.struct("regime_gain", order)).alias("regime"), F.max("regime_gain").alias("regime_gain")
    )
