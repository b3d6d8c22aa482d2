"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

Both conversations of a pair are arrays of turns. Their longest common prefix of turns is rendered once as the prompt; what
follows in each is rendered as its completion, with the character ranges that carry loss (the texts of assistant turns and the mark
that ends them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def gather(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation as one array of (turn, role, text), in order. A null role or text is an
    empty one; rows with a null conv_id are left out; null turn numbers come first; turns with one number are ordered
    by role and text, and fully repeated rows count once."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_set(turn)).alias("turns"))


def common(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    return F.when(first > 0, first.cast("int") - 1).otherwise(F.size(equal))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))))


def mask(turns: Column) -> Column:
    """Ranges ``start:end`` in characters of the rendered turns that carry loss, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("ranges"))

    def step(acc, t):
        begin = acc["at"] + len(OPEN) + F.length(t["role"]) + len(MIDDLE)
        end = begin + F.length(t["text"]) + len(CLOSE)
        one = F.array(F.concat(begin.cast("string"), F.lit(":"), end.cast("string")))
        none = F.array().cast("array<string>")
        return F.struct(end.alias("at"), F.concat(acc["ranges"], F.when(t["role"] == TRAINED, one).otherwise(none)).alias("ranges"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["ranges"]), ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Columns of ``pairs`` except its arrays ``chosen_turns`` and ``rejected_turns`` (of turn, role, text), and n_common, prompt, chosen,
    rejected, chosen_mask, rejected_mask.

    prompt + chosen is the chosen conversation, prompt + rejected the rejected one. If one conversation is the beginning of the other, its completion
    is empty, and equal conversations have two empty completions. A null array is an empty conversation.
    """
    turns = {x: F.coalesce(F.col(x), F.array().cast(pairs.schema[x].dataType)) for x in ("chosen_turns", "rejected_turns")}
    keep = [c for c in pairs.columns if c not in (*turns, "n_common", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")]
    rows = pairs.select(*keep, *(c.alias(x) for x, c in turns.items())).withColumn("n_common", common(F.col("chosen_turns"), F.col("rejected_turns")))
    after = lambda x: F.slice(x, F.col("n_common") + 1, F.greatest(F.size(x) - F.col("n_common"), F.lit(0)))
    return rows.select(
        *keep, "n_common", render(F.slice("chosen_turns", 1, F.col("n_common"))).alias("prompt"),
        render(after("chosen_turns")).alias("chosen"), render(after("rejected_turns")).alias("rejected"),
        mask(after("chosen_turns")).alias("chosen_mask"), mask(after("rejected_turns")).alias("rejected_mask"),
    )


def swapped_replies(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen_turns, rejected_turns): preference pairs from plain conversations.

    Conversations 2i and 2i + 1 are partners. The chosen side is a conversation up to and with its last assistant turn; the
    rejected side is the same with the last assistant text of the partner in place of that turn's. A conversation
    without a partner, or a pair of which one has no assistant turn, gives no row.
    """
    place = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)))
    ready = gather(turns).withColumn("last", place).where("last is not null")
    reply = ready.select(F.col("conv_id").alias("rejected_id"), F.col("turns")[F.col("last")]["text"].alias("reply"))
    both = ready.withColumn("rejected_id", F.col("conv_id").bitwiseXOR(F.lit(1).cast("bigint"))).join(reply, "rejected_id")
    before, final = F.slice("turns", 1, F.col("last")), F.col("turns")[F.col("last")]
    other = F.struct(final["turn"].alias("turn"), final["role"].alias("role"), F.col("reply").alias("text"))
    return both.select(F.col("conv_id").alias("chosen_id"), "rejected_id", F.concat(before, F.array(final)).alias("chosen_turns"), F.concat(before, F.array(other)).alias("rejected_turns"))


def divergence(conv_id: Column, size: Column) -> Column:
    """Turn from 0 at which a conversation of ``size`` turns is left, by a hash of its id that any SQL engine can repeat."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", conv_id.cast("string"), F.lit("turn"))), 1, 7), 16, 10).cast("bigint")
    return F.when(size > 0, F.pmod(number, size)).otherwise(F.lit(0)).cast("int")


def diverging(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen_turns, rejected_turns): preference pairs from plain conversations, one for each.

    Conversations 2i and 2i + 1 are partners. The chosen side is the whole conversation. The rejected side follows it up to a
    hashed turn and goes on with the turns of the partner from that place, so sides part at any turn and end with any role.
    Where the partner is missing, or has no turn there, the rejected side ends at that turn, so its completion is empty; rejected_id is
    null without a partner. No turns, no rows.
    """
    ready = gather(turns)
    other = ready.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("theirs"))
    both = ready.join(other, F.col("rejected_id") == F.col("conv_id").bitwiseXOR(F.lit(1).cast("bigint")), "left")
    both = both.withColumn("at", divergence(F.col("conv_id"), F.size("turns")))
    rest = F.slice("theirs", F.col("at") + 1, F.greatest(F.size("theirs") - F.col("at"), F.lit(0)))
    rejected = F.concat(F.slice("turns", 1, F.col("at")), F.coalesce(rest, F.slice("turns", 1, 0)))
    return both.select(F.col("conv_id").alias("chosen_id"), "rejected_id", F.col("turns").alias("chosen_turns"), rejected.alias("rejected_turns"))


def sql() -> str:
    turn = f"'{OPEN}' || role || chr(10) || text || '{CLOSE[:-1]}' || chr(10)"

    def side(rows: str, name: str) -> str:
        ranges = f"CASE WHEN role = '{TRAINED}' THEN (before + {len(OPEN) + len(MIDDLE)} + length(role)) || ':' || (before + length({turn})) END"
        return f"""
    {name}_t AS (SELECT chosen_id, i, {turn} AS turn, role, text, i >= n_common AS own,
        coalesce(sum(CASE WHEN i >= n_common THEN length({turn}) END) OVER (PARTITION BY chosen_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {rows} JOIN n USING (chosen_id)),
    {name}_s AS (SELECT chosen_id, string_agg(turn, '' ORDER BY i) FILTER (NOT own) AS prompt, string_agg(turn, '' ORDER BY i) FILTER (own) AS rest,
        string_agg({ranges}, ',' ORDER BY i) FILTER (own) AS mask FROM {name}_t GROUP BY chosen_id)"""

    return f"""
    WITH v AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
    k AS (SELECT conv_id AS chosen_id, count(*) AS turns, CAST('0x' || substr(md5(conv_id || ':turn'), 1, 7) AS BIGINT) % count(*) AS place FROM v GROUP BY conv_id),
    a AS (SELECT conv_id AS chosen_id, i, role, text FROM v),
    b AS (SELECT chosen_id, i, role, text FROM v JOIN k ON conv_id = chosen_id WHERE i < place
        UNION ALL SELECT chosen_id, i, role, text FROM v JOIN k ON conv_id = xor(chosen_id, 1) WHERE i >= place),
    d AS (SELECT a.chosen_id, min(a.i) FILTER (b.i IS NULL OR a.role <> b.role OR a.text <> b.text) AS first FROM a LEFT JOIN b ON a.chosen_id = b.chosen_id AND a.i = b.i GROUP BY a.chosen_id),
    n AS (SELECT chosen_id, coalesce(first, turns) AS n_common FROM d JOIN k USING (chosen_id)),
    {side('a', 'c')}, {side('b', 'r')},
    o AS (SELECT DISTINCT conv_id FROM v)
    SELECT n.chosen_id, o.conv_id AS rejected_id, CAST(n_common AS INTEGER) AS n_common, coalesce(c_s.prompt, '') AS prompt, coalesce(c_s.rest, '') AS chosen,
        coalesce(r_s.rest, '') AS rejected, coalesce(c_s.mask, '') AS chosen_mask, coalesce(r_s.mask, '') AS rejected_mask
    FROM n JOIN c_s USING (chosen_id) LEFT JOIN r_s USING (chosen_id) LEFT JOIN o ON o.conv_id = xor(n.chosen_id, 1)"""
