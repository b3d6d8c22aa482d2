"""The registered queries of this subpackage, each over its whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsinlake.llm import codes, decontaminate, language, lines, minhash, mixing, pii, preferences, quality, rules, search, simhash, substrings

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: Target weights of the production mix; every other source weighs 1.
MIX = {"src0": 2.0, "src1": 1.5, "src2": 0.5}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("op1_quality_rules")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    judged = rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op2_substring_dedup", substrings.sql())
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op3_preference_format", preferences.sql())
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return preferences.format_pairs(preferences.diverging(table(spark, sf, "conversations")))


@register("op4_poisson_mixing", mixing.sql(MIX))
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.replicate(table(spark, sf, "documents"), MIX)


@register("op5_minhash_near_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


@register("op6_language_id")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


@register("op7_quality_classifier")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op8_line_dedup", lines.sql())
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf, "documents"))


@register("op9_personal_data")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf, "documents")).drop("base_spans")


@register("op10_decontamination", decontaminate.sql())
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.flag_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op11_ranked_search", search.sql())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return search.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op12_vector_codes", codes.sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return codes.compress(table(spark, sf, "embeddings")).drop("label")


@register("op13_simhash_near_dedup")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")
