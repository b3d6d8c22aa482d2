"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is its target share of the corpus over its present share. Every document draws its number of copies from a
Poisson distribution with that mean, by inverting the distribution at a uniform number taken from a hash of seed and
doc_id, so the draw needs no state, is the same on every run and survives lost executors. Copies are then spread over the
whole corpus by a sort on another hash, whose first digits name the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsinlake.llm.scratch import cut

SEED = "mix-1"
BROADCAST_BYTES = 16 << 20  # a table of rates up to this size is broadcast, a larger one joins by shuffle
TAIL = 40  # inverted as far as rate + 12 sqrt(rate) + TAIL copies; beyond lie fewer than 1e-16 of the draws


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) from the first 52 bits of an md5, so that any SQL engine can repeat it."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0) -> DataFrame:
    """(source, n, rate): documents of every source and its mean number of copies, so that the expected total stays as it
    is and sources stand in the ratio of their weights. A source without a weight has ``default``; null is a source."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    weight = F.lit(default)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighted = cut(counts.withColumn("weight", weight))
    total = weighted.agg(F.sum("n").alias("docs"), F.sum("weight").alias("weights")).first()  # two numbers
    share = F.col("weight") / F.lit(float(total["weights"] or 1.0))
    return weighted.select("source", "n", (share * F.lit(float(total["docs"] or 0)) / F.col("n")).alias("rate"))


def _table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... copies. Rates above 700 (where exp underflows) are split by the caller."""
    top = (F.ceil(rate + 12 * F.sqrt(rate)) + TAIL).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"])


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, seed: str = SEED) -> DataFrame:
    """All columns of ``docs`` with ``mix_copy`` (0, 1, ...) and ``mix_key``, each document as often as it was drawn, in the
    global order of mix_key.

    A mean above 500 is drawn as the sum of equal parts of at most 500, which is again Poisson. Weights of 0 drop a source;
    a null source has the weight ``default``. Rows with a null doc_id draw as one document named null. Repeated rows draw alike. Text may be null, empty or long: it is not looked at. Without documents
    there are no rows. Columns named mix_copy or mix_key are replaced; all others stay, whatever their names.
    """
    table = rates(docs, weights, default).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / 500)).cast("int"))
    table = cut(table.select(F.col("source").alias("mix_source"), "parts", _table(F.col("rate") / F.col("parts")).alias("cdf")))
    table = table.select("mix_source", F.struct("parts", "cdf").alias("mix_draw"))
    size = table.agg(F.sum(F.size("mix_draw.cdf") * 8 + F.coalesce(F.octet_length("mix_source"), F.lit(0)) + 64)).first()[0] or 0
    table = F.broadcast(table) if size <= BROADCAST_BYTES else table
    name = F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))
    uniforms = F.transform(F.sequence(F.lit(1), F.col("mix_draw.parts")), lambda i: uniform(F.lit(seed), name, i))
    drawn = F.aggregate(uniforms, F.lit(0), lambda acc, u: acc + _copies("mix_draw.cdf", u))
    rows = docs.select(F.struct("*").alias("row")).join(table, F.col("row.source").eqNullSafe(F.col("mix_source")))
    rows = rows.select("row", drawn.alias("n")).where("n > 0").select("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("mix_copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), name, F.col("mix_copy").cast("string")))
    kept = (F.col("row")[c].alias(c) for c in docs.columns if c not in ("mix_copy", "mix_key"))
    return in_key_order(rows.withColumn("mix_key", key)).select(*kept, "mix_copy", "mix_key")


def _copies(cdf: str, u: Column) -> Column:
    """How many of the cumulative probabilities are at most ``u``, by bisection."""
    steps = F.lit([2**k for k in range(9, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda lo, step: lo + F.when(F.get(cdf, lo + step - 1) <= u, step).otherwise(0))


def in_key_order(rows: DataFrame) -> DataFrame:
    """The rows in the global order of mix_key. Keys are evenly spread, so the first digits of a key tell its partition,
    and no pass over the rows is needed to find the borders."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.conv(F.substring("mix_key", 1, 7), 16, 10).cast("bigint")
    return rows.repartitionById(parts, (first * parts / F.lit(16**7)).cast("int")).sortWithinPartitions("mix_key", "row.doc_id", "mix_copy")


def sql(weights: dict[str, float] | None = None, default: float = 1.0, seed: str = SEED) -> str:
    """The same draw for rates up to 500."""
    cases = " ".join(f"WHEN source = '{k}' THEN {float(v)}::DOUBLE" for k, v in (weights or {}).items())
    weight = f"CASE {cases} ELSE {default}::DOUBLE END" if cases else f"{default}::DOUBLE"
    return f"""
    WITH RECURSIVE n AS (SELECT source, count(*) AS n, {weight} AS w FROM documents GROUP BY source),
    r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
    c(source, rate, k, p, c) AS (
        SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
        UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate)) + {TAIL}),
    u AS (SELECT *, CAST(('0x' || substr(md5('{seed}:' || doc_id || ':1'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
    d AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.c <= u.u) AS n FROM u)
    SELECT doc_id, text, lang, source, n_chars, mix_copy, md5('{seed}:order:' || doc_id || ':' || mix_copy) AS mix_key
    FROM (SELECT *, CAST(unnest(range(n)) AS INTEGER) AS mix_copy FROM d)"""
