"""Line deduplication over runs of lines, by a suffix array of line IDs built with distributed prefix doubling.

Every text is a sequence of line IDs (ranks of its lines). Level k of the doubling ranks the suffixes by their first 2^k
lines: the pairs (rank at p, rank at p + 2^(k-1)) are counted, sorted over range partitions and numbered by running
sums. A set of suffixes that agree in their first lines is an interval of the suffix array; its first member in document
order stays, and the lines it shares are deleted at all others.

A run qualifies with ``min_words`` words or more. Call a qualifying run tight if it no longer qualifies without its first
or without its last line. Every line of a repeated run lies in a tight run inside it (the one that starts at the line if
enough words follow, else the one that ends there if enough stand before, else the one that starts with the run), so only
tight runs are compared. They have at most ``min_words`` lines (blank lines are left out): levels deeper than
log2(min_words) would not delete another line. A line that occurs once ends every run, so only repeated lines are ranked,
and a level only ranks suffixes that were still shared on the level before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsinlake.llm.scratch import cut

MIN_WORDS = 8
DOC = ["doc_id", "text_key"]


def ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """``keys`` with ``rank``: how many suffixes (column ``n``, per key) have a smaller key.

    Keys are sorted over range partitions; one sum per partition gives the partition's offset, and a running sum inside
    the partition the rest."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(keys.repartitionByRange(parts, *columns).withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("part").agg(F.sum("n").alias("total"))  # one row a partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return running.join(before, "part").select(*columns, (F.col("base") + F.col("inside")).alias("rank"))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, h1, h2, words): the lines with a word, numbered from 0; two hashes stand for a line."""
    words = F.size(F.array_remove(F.split("value", "[ \\t-\\r]+"), ""))
    return (
        docs.select(*DOC, F.posexplode(solid_lines()).alias("line", "value"))
        .select(*DOC, "line", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(7), "value").alias("h2"), words.alias("words"))
    )


def solid_lines() -> Column:
    """Lines of ``text`` that have a word."""
    return F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))


def suffix_levels(lines: DataFrame, levels: int) -> DataFrame:
    """The repeated lines with their ranks ``r0 .. r<levels>``: ``rk`` orders suffixes by their first 2^k lines and is
    null where fewer repeated lines follow or no other suffix starts with the same 2^k lines."""
    ids = cut(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"))
    ranks = ranked(ids, ["h1", "h2"]).withColumnRenamed("rank", "r0")
    rows = lines.join(ranks, ["h1", "h2"]).select(*DOC, "line", "words", "r0")
    rows = cut(rows.repartition(*DOC).groupBy(*DOC, "line").agg(F.min("words").alias("words"), F.min("r0").alias("r0")))
    for k in range(1, levels + 1):
        step = 2 ** (k - 1)
        ahead = Window.partitionBy(*DOC).orderBy("line").rangeBetween(step, step)
        rows = cut(rows.withColumn("next", F.first(f"r{k - 1}").over(ahead)))
        pair = [f"r{k - 1}", "next"]
        keys = cut(rows.where(f"r{k - 1} is not null and next is not null").groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1"))
        rows = rows.join(ranked(keys, pair).withColumnRenamed("rank", f"r{k}"), pair, "left").drop("next")
    return rows


def tight_runs(rows: DataFrame, levels: int, min_words: int) -> DataFrame:
    """(doc_id, text_key, line, lines, head, tail): the tight runs that start at each line, and the ranks that name them. A
    run of 2^k to 2^(k+1) - 1 lines is two overlapping blocks of 2^k lines, ranked on level k."""
    ahead = Window.partitionBy(*DOC).orderBy("line").rangeBetween(0, min_words - 1)
    ranks = [f"r{k}" for k in range(levels + 1)]
    near = rows.select(*DOC, "line", F.collect_list(F.struct("line", "words", *ranks)).over(ahead).alias("run"))
    total = "aggregate(slice(run, 1, l), 0L, (a, x) -> a + x.words)"
    tight = f"run[l - 1].line = line + l - 1 and {total} >= {min_words} and {total} - greatest(run[0].words, run[l - 1].words) < {min_words}"
    each = near.select(*DOC, "line", "run", F.explode(F.expr(f"filter(sequence(1, size(run)), l -> {tight})")).alias("lines"))
    head, tail = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for k in range(levels + 1):
        at = (F.col("lines") >= 2**k) & (F.col("lines") < 2 ** (k + 1))
        head = F.when(at, F.col("run")[0][f"r{k}"]).otherwise(head)
        tail = F.when(at, F.get("run", F.col("lines") - 2**k)[f"r{k}"]).otherwise(tail)
    return each.select(*DOC, "line", "lines", head.alias("head"), tail.alias("tail")).where("head is not null and tail is not null")


def later_copies(rows: DataFrame, levels: int, min_words: int) -> DataFrame:
    """(doc_id, text_key, removed): numbers of the lines that belong to a later copy of a run."""
    starts = cut(tight_runs(rows, levels, min_words))
    interval = ["lines", "head", "tail"]
    # written, so that both sides of the join are dealt anew and a run in very many documents can be split
    first = cut(starts.groupBy(*interval).agg(F.min(F.struct(*DOC, "line")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = starts.join(first, interval).where(F.struct(*DOC, "line") > F.col("first"))
    covered = copies.select(*DOC, F.explode(F.sequence("line", F.col("line") + F.col("lines") - 1)).alias("gone"))
    return covered.groupBy(*DOC).agg(F.collect_set("gone").alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): every text without the lines of later copies of repeated line runs.

    A run is one or more consecutive lines (lines without a word are passed over) with ``min_words`` words or more in
    all; lines are equal if all their characters are. The copy with the smallest (doc_id, place) stays. A text that
    loses lines is its remaining lines with a word, joined by newlines; every other text is returned as it is.
    Null texts stay null and have no lines; empty texts stay empty. A row with a null doc_id takes no part. Rows with one doc_id
    are ordered by a hash of their texts; identical rows count once. An empty table gives no rows. Other columns are ignored.
    """
    rows = _stripped(docs.select("doc_id", "text"), min_words)
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"), F.col("new_text").alias("text"),
    )


def edited(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, and their texts as ``dedup_lines`` leaves them. Rows that lose every
    line go."""
    rows = _stripped(docs, min_words).where("removed is null or new_text <> ''")
    return rows.select(*(F.col("new_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def _stripped(docs: DataFrame, min_words: int) -> DataFrame:
    """row, doc_id, lines, removed and new_text of every row of ``docs``."""
    levels = max(min_words, 1).bit_length() - 1
    keyed = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.xxhash64("row.text").alias("text_key"))
    table = line_table(keyed.where("doc_id is not null and row.text is not null").select(*DOC, "row.text"))
    removed = later_copies(suffix_levels(table, levels), levels, min_words)
    out = keyed.join(removed, DOC, "left").withColumn("text", F.col("row.text"))
    out = out.withColumn("lines", F.coalesce(solid_lines(), F.array().cast("array<string>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    text = F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n")
    return out.withColumn("new_text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(text)).drop("text")


def sql(min_words: int = MIN_WORDS) -> str:
    return f"""
    WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS all_lines, text FROM documents),
    solid AS (SELECT doc_id, text, [x FOR x IN all_lines IF regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')] AS lines FROM raw),
    l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM solid),
    w AS (SELECT doc_id, n, list(line) OVER f AS ls,
            list(len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+'))) OVER f AS ws FROM l
          WINDOW f AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING)),
    b AS (SELECT doc_id, n, ls, ws, unnest(range(1, len(ws) + 1)) AS k, list_sum(ws[1:k]) AS words FROM w),
    c AS (SELECT doc_id, n, k, row_number() OVER (PARTITION BY ls[1:k] ORDER BY doc_id, n) AS nth FROM b
          WHERE words >= {min_words} AND words - greatest(ws[1], ws[k]) < {min_words}),
    gone AS (SELECT doc_id, list(DISTINCT g) AS gs FROM (SELECT doc_id, unnest(range(n, n + k)) AS g FROM c WHERE nth > 1) GROUP BY doc_id)
    SELECT s.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gs), 0) AS BIGINT) AS n_removed,
        CASE WHEN gs IS NULL THEN text ELSE array_to_string([lines[i + 1] FOR i IN range(len(lines)) IF NOT list_contains(gs, i)], chr(10)) END AS text
    FROM solid s LEFT JOIN gone USING (doc_id)"""
