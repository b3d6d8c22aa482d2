"""A training corpus from raw documents, in stages that are each written before the next reads them.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsinlake.llm import decontaminate, lines, minhash, mixing, rules
from opsinlake.llm.queries import MIX
from opsinlake.llm.scratch import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return rules.kept_rows(docs, rules.fit(docs, _table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted from the texts, and n_chars follows. A document that loses all its lines
    goes."""
    changed = lines.edited(docs)
    return changed.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id. Rows with a null doc_id stay;
    rows that repeat a doc_id and its text count once."""
    later = cut(minhash.near_duplicates(docs).where("doc_id <> class_id").select("doc_id").distinct())
    twice = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    first = docs.join(later, "doc_id", "left_anti")
    repeated = first.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return first.join(twice, "doc_id", "left_anti").unionByName(repeated).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = cut(decontaminate.leaks(docs, _table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak_id"), F.col("text_key").alias("leak_key")))
    same = (F.col("row.doc_id") == F.col("leak_id")) & (F.xxhash64("row.text") == F.col("leak_key"))
    return docs.select(F.struct("*").alias("row")).join(found, same, "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in its mixed order, each document as often as its source's target weight drew it."""
    return mixing.replicate(docs, MIX)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
]
ORACLE_SQL = None  # SQL cannot express the learned rules and the sketches; tests hold every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
