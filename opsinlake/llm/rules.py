"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditional expressions.

Every text becomes a few whole-number statistics (Arrow batches, no shuffle). Sequential covering then works on the
statistics of at most ``train_rows`` labelled rows: a rule is grown, one threshold at a time, on two thirds of the rows
until it covers no good document, pruned on the other third, and kept while it is precise; covered rows leave and the next
rule is grown. The rules are emitted in order as ``WHEN a >= x AND b <= y THEN false``, with true as default.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsinlake.llm.scratch import hashed_sample
from opsinlake.llm.words import blocks, mix, offsets, split_words, utf8

TRAIN_ROWS = 20_000  # bound of the labelled sample that comes to the driver: a dozen numbers a row
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_seen", "n_upper", "n_letters", "n_distinct_words", "n_lines")
#: Statistics in thousandths, so that thresholds are whole numbers: numerator, denominator.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "chars_per_word": ("word_chars", "n_words"), "distinct_share": ("n_distinct_words", "n_words"), "upper_share": ("n_upper", "n_letters"),
    "letter_share": ("n_letters", "word_chars"), "words_per_line": ("n_words", "n_lines"),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = np.ones(256, bool)  # bytes that begin a character
_HEAD[0x80:0xC0] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER | np.roll(_UPPER, 32)
_LETTER[0xC3:0xF5] = True  # a character beyond ASCII counts as a letter here


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact number of each pair of small non-negative numbers."""
    return pd.factorize(a.astype(np.int64) * (int(b.max()) + 1) + b)[0] if len(a) else a


def _repeats(ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that lie in a 3-word window which the row holds twice or more."""
    if len(ids) < 3:
        return np.zeros(n, np.int64)
    inside = row[2:] == row[:-2]
    window = _pairs(_pairs(_pairs(ids[:-2], ids[1:-1]), ids[2:]), row[2:])[inside]
    again = np.bincount(window)[window] > 1 if len(window) else np.zeros(0, bool)
    at = np.flatnonzero(inside)[again]
    covered = np.zeros(len(ids), bool)
    for j in range(3):
        covered[at + j] = True
    return np.bincount(row[covered], minlength=n)


def _dup_lines(texts: pa.Array, data: np.ndarray, at: np.ndarray, has_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier one) of each row."""
    n = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([at[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.concatenate([starts[1:], [len(data)]])
    ends = ends - (data[ends - 1] == 10)
    words = np.concatenate([[0], np.cumsum(has_word)])
    solid = words[ends] > words[starts]
    starts, ends = starts[solid], ends[solid]
    row = np.searchsorted(at, starts, side="right") - 1
    text = data.tobytes()
    ids = pd.factorize(np.array([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())], object))[0] if len(starts) else starts
    key = _pairs(ids, row)
    _, first = np.unique(key, return_index=True)
    repeated = np.ones(len(key), bool)
    repeated[first] = False
    return np.bincount(row, minlength=n), np.bincount(row[repeated], minlength=n)


def measure(texts: pa.Array) -> list[np.ndarray]:
    """``COUNTS`` of every text."""
    data, at = offsets(texts)
    n = len(at) - 1
    w = split_words(texts)
    starts = np.zeros(len(data) + 1, bool)
    starts[w.start] = True
    size = w.end - w.start + 0
    solid_at = np.zeros(len(data) + 1, np.int8)
    np.add.at(solid_at, w.start, 1)
    np.add.at(solid_at, w.end, -1)
    solid = np.cumsum(solid_at[:-1]).astype(bool)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64).tobytes()), pa.py_buffer(data[solid].tobytes())])
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    distinct = np.bincount(w.row[np.unique(_pairs(ids, w.row), return_index=True)[1]], minlength=n) if len(ids) else np.zeros(n, np.int64)
    lines, dup = _dup_lines(texts, data, at, starts[:-1])
    return [
        np.diff(w.first), _sums(_HEAD[data] & solid, at), _sums(_SYMBOL[data], at), dup, _repeats(ids, w.row, n),
        _sums(_HEAD[data], at), _sums(_UPPER[data], at), _sums(_LETTER[data], at), distinct, lines,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field("text")], ["row", "text"])
        for part in blocks(texts):
            counts = [pa.array(c, pa.int64()) for c in measure(utf8(part.column("text")))]
            yield pa.RecordBatch.from_arrays([part.column("row"), *counts], ["row", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), ``COUNTS`` and ``RATIOS`` of every row. A ratio over nothing is 0."""
    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    ratios = {name: F.when(F.col(b) > 0, F.expr(f"(1000 * {a}) div {b}")).otherwise(F.lit(0)) for name, (a, b) in RATIOS.items()}
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.mapInArrow(_measure, schema).withColumns(ratios).withColumn("base_failed", base)


class Condition(NamedTuple):
    name: str
    sign: str  # ">=" or "<="
    value: int


def _holds(x: dict[str, np.ndarray], rule) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= x[c.name] >= c.value if c.sign == ">=" else x[c.name] <= c.value
    return out


def _gain(p, n, p0, n0):
    """Information gained on the positives kept."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _best(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best: tuple[float, Condition | None] = (1e-9, None)
    for name, v in x.items():
        values, where = np.unique(v, return_inverse=True)
        p, n = np.bincount(where, bad, len(values)), np.bincount(where, ~bad, len(values))
        for sign, cp, cn in ((">=", p[::-1].cumsum()[::-1], n[::-1].cumsum()[::-1]), ("<=", p.cumsum(), n.cumsum())):
            gain = _gain(cp, cn, p0, n0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                step = -1 if sign == ">=" else 1
                near = int(values[i + step]) if 0 <= i + step < len(values) else int(values[i])
                middle = (int(values[i]) + near + (1 if sign == ">=" else 0)) // 2  # half way to the next value seen
                best = (float(gain[i]), Condition(name, sign, middle))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most: int = 4, seed: int = 7) -> list[tuple[Condition, ...]]:
    """Ordered rules for ``bad`` rows, by sequential covering with reduced-error pruning. No rules without bad rows."""
    rules: list[tuple[Condition, ...]] = []
    bad = np.asarray(bad, bool)
    grow = mix(np.arange(len(bad), dtype=np.uint64) + np.uint64(seed)) % np.uint64(3) != 0 if len(bad) else bad
    left = np.ones(len(bad), bool)

    def worth(rule, on) -> float:
        hit = _holds(x, rule) & on
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while (left & bad & grow).any():
        rule: list[Condition] = []
        inside = left & grow
        while len(rule) < most and (inside & ~bad).any():
            _, found = _best({k: v[inside] for k, v in x.items()}, bad[inside])
            if found is None:
                break
            rule.append(found)
            inside &= _holds(x, [found])
        while len(rule) > 1 and worth(rule[:-1], left & ~grow) >= worth(rule, left & ~grow):
            rule.pop()
        hit = _holds(x, rule) & left if rule else np.zeros(len(bad), bool)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not rule or p == 0 or p / (p + n) < precision:
            break
        rules.append(tuple(rule))
        left &= ~hit
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The decision list: false for the first rule that holds, true if none does."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = F.lit(True)
        for c in rule:
            holds = holds & (F.col(c.name) >= c.value if c.sign == ">=" else F.col(c.name) <= c.value)
        out = F.when(holds, F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> list[tuple[Condition, ...]]:
    """Rules from a sample of at most ``train_rows`` labelled documents, taken by a hash of doc_id. Rows that fail the base
    rules are left out: they need no further rule. Of the other rows of a doc_id the one with the smallest text hash counts, so
    a doc_id with very many rows is one row before anything reaches the driver."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    sample = hashed_sample(marked, train_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    passed = statistics(texts).where("not base_failed").select("row.doc_id", "row.quality", F.xxhash64("row.text").alias("text_key"), *RATIOS)
    one = passed.groupBy("doc_id").agg(F.min(F.struct("text_key", "quality", *RATIOS)).alias("of"))
    rows = one.select("doc_id", "of.quality", *(f"of.{name}" for name in RATIOS)).toPandas().sort_values(["doc_id", *RATIOS])
    return learn({name: rows[name].to_numpy(np.int64) for name in RATIOS}, rows["quality"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Statistics of every row with base_failed (fewer than 50 words, or over half of them in repeated windows) and kept
    (not base_failed, and no learned rule holds).

    Null texts count as empty: no words, so they fail the base rules. Labels that are null are passed over, of several
    labels of a document the worst counts, and without labels of both kinds nothing is learned and the base rules alone
    decide. Every input row gives one row; a null doc_id is kept. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    judged = statistics(rows).withColumn("kept", ~F.col("base_failed") & verdict(fit(docs, labels, train_rows)))
    return judged.select("row.doc_id", *COUNTS, *RATIOS, "base_failed", "kept")


def kept_rows(docs: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """The rows of ``docs``, with all their columns, that neither the base rules nor a learned rule rejects."""
    return statistics(docs).where(~F.col("base_failed")).where(verdict(rules)).select("row.*")
