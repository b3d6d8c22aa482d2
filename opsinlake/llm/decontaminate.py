"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a mask over ``SPAN`` consecutive tokens; tokens under a 0 are ignored, the others are hashed together. The masks
are chosen so that any ``WINDOW`` aligned tokens with up to ``SUBSTITUTIONS`` changed ones agree in at least one seed, so
joining seed hashes of benchmark and documents finds every overlap of that kind. A hit names an alignment (document,
item, shift); the aligned tokens around it are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsinlake.llm.scratch import cut

WINDOW = 13
SUBSTITUTIONS = 2
MASKS = ("1011111", "1110001101")  # any 2 changes of 13 tokens leave a seed of one of them whole (see the tests)
BROADCAST_ROWS = 1_000_000  # benchmark seeds or hit documents up to this number are sent to all executors


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if its counted rows are few enough; else Spark joins it by shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _offsets(masks) -> list[int]:
    return sorted({i for m in masks for i, c in enumerate(m) if c == "1"})


def seeds(rows: DataFrame, keep: list[str], masks=MASKS) -> DataFrame:
    """(keep..., place, seed): every mask at every place of ``hashes`` (token hashes) where it fits.

    The token hashes are zipped with shifted copies of themselves, so that all masks of a place are hashed from one row in
    generated code."""
    span = max(map(len, masks))
    shift = [F.slice("hashes", i + 1, F.greatest(F.size("hashes") - i, F.lit(0))).alias(f"t{i}") for i in _offsets(masks)]
    placed = rows.select(*keep, F.posexplode(F.arrays_zip(*shift)).alias("place", "t")).select(*keep, "place", "t.*")
    one = [F.xxhash64(F.lit(m), *(F.col(f"t{i}") for i, c in enumerate(mask) if c == "1")) for m, mask in enumerate(masks)]
    fits = [F.when(F.col(f"t{len(mask) - 1}").isNotNull(), h) for mask, h in zip(masks, one)]
    assert span == max(_offsets(masks)) + 1
    return placed.select(*keep, "place", F.explode(F.array(*fits)).alias("seed")).where("seed is not null")


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda x: F.xxhash64(x))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, masks=MASKS) -> DataFrame:
    """(doc_id, text_key, item_id, shift, matched): alignments with ``window`` consecutive aligned tokens of which at most
    ``substitutions`` differ; ``matched`` is the largest number of equal tokens in such a window."""
    items = benchmark.where("item_id is not null").select("item_id", F.xxhash64("text").alias("item_key"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    item_seeds = seeds(items.select("item_id", "item_key", _hashes(F.col("text")).alias("hashes")), ["item_id", "item_key"], masks)
    item_seeds = sized(item_seeds.select("item_id", "item_key", F.col("place").alias("item_place"), "seed"))
    keep = ["doc_id", "text_key"]
    doc_seeds = seeds(docs.select(*keep, _hashes(F.col("text")).alias("hashes")), keep, masks)
    hits = doc_seeds.join(item_seeds, "seed").select(*keep, "item_id", "item_key", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    hits = sized(hits)
    item_tokens = items.select("item_id", "item_key", tokens(F.col("text")).alias("item_tokens"))
    doc_tokens = docs.join(hits.select(*keep).distinct(), keep, "left_semi").dropDuplicates(keep).select(*keep, tokens(F.col("text")).alias("doc_tokens"))
    aligned = hits.join(item_tokens, ["item_id", "item_key"]).join(doc_tokens, keep)
    begin = F.greatest(F.lit(0), -F.col("shift"))
    end = F.least(F.size("item_tokens"), F.size("doc_tokens") - F.col("shift"))
    aligned = aligned.withColumn("begin", begin).withColumn("width", end - begin).where(f"width >= {window}")
    theirs, ours = F.slice("item_tokens", F.col("begin") + 1, F.col("width")), F.slice("doc_tokens", F.col("begin") + F.col("shift") + 1, F.col("width"))
    equal = F.zip_with(theirs, ours, lambda x, y: (x == y).cast("int"))
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.size("equal") - window + 1),
        lambda i: F.aggregate(F.slice("equal", i, window), F.lit(0), lambda a, x: a + x),
    ))
    return aligned.withColumn("equal", equal).select(*keep, "item_id", "shift", best.alias("matched")).where(F.col("matched") >= window - substitutions)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """(doc_id, text_key, n_items, items, matched) of the documents that hold a benchmark passage: the number and the
    sorted item_ids of the items, and the most equal tokens in a window."""
    found = matches(keyed(docs), benchmark, window, substitutions).groupBy("doc_id", "text_key", "item_id").agg(F.max("matched").alias("matched"))
    return found.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"), F.max("matched").cast("bigint").alias("matched"),
    )


def flag_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """(doc_id, leaked, n_items, items, matched) of every row of ``docs``.

    leaked: ``window`` consecutive tokens of some benchmark item stand in the text with at most ``substitutions`` of them
    changed. Tokens are lower-case runs of letters and digits, so punctuation and spacing do not matter. Items with fewer
    than ``window`` tokens cannot be found, nor can null or empty texts or items; rows with a null doc_id are not leaked.
    Rows of one doc_id are judged each by its own text. items is empty and matched 0 where nothing was found.
    An empty table on either side finds nothing. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    out = rows.join(leaks(docs, benchmark, window, substitutions), ["doc_id", "text_key"], "left")
    return out.select(
        "doc_id", F.col("n_items").isNotNull().alias("leaked"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"), F.coalesce("matched", F.lit(0)).alias("matched"),
    )


def sql(window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> str:
    """The same by brute force: alignments from runs of equal tokens that any such window must hold."""
    run = -(-(window - substitutions) // (substitutions + 1))
    toks = "[x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> '']"
    return f"""
    WITH d AS (SELECT doc_id, {toks} AS ts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    i AS (SELECT item_id, {toks} AS ts FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    dg AS (SELECT doc_id, p, ts[p:p + {run - 1}] AS g FROM (SELECT doc_id, ts, unnest(range(1, len(ts) - {run - 2})) AS p FROM d)),
    ig AS (SELECT item_id, p, ts[p:p + {run - 1}] AS g FROM (SELECT item_id, ts, unnest(range(1, len(ts) - {run - 2})) AS p FROM i)),
    a AS (SELECT DISTINCT doc_id, item_id, dg.p - ig.p AS shift FROM dg JOIN ig USING (g)),
    e AS (SELECT doc_id, item_id, shift, [CAST(i.ts[k] = d.ts[k + shift] AS INT) FOR k IN range(greatest(1, 1 - shift), least(len(i.ts), len(d.ts) - shift) + 1)] AS eq
          FROM a JOIN d USING (doc_id) JOIN i USING (item_id)),
    m AS (SELECT doc_id, item_id, max(list_max([list_sum(eq[k:k + {window - 1}]) FOR k IN range(1, len(eq) - {window - 2})])) AS matched
          FROM e WHERE len(eq) >= {window} GROUP BY ALL HAVING matched >= {window - substitutions}),
    r AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(matched) AS matched FROM m GROUP BY doc_id)
    SELECT documents.doc_id, r.doc_id IS NOT NULL AS leaked, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items,
        CAST(coalesce(matched, 0) AS BIGINT) AS matched FROM documents LEFT JOIN r USING (doc_id)"""
