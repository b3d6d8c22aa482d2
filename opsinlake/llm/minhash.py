"""Near-duplicate documents by ProbMinHash: signatures of weighted shingles, banding, verification, components.

A shingle weighs 1 + log2 of its occurrences in the text. It sends arrivals of a Poisson process whose rate is that
weight; every arrival falls into one of ``registers`` registers and a register keeps its earliest arrival. Two texts agree in a
register with the probability Jaccard similarity of their weights. A shingle stops as soon as its next arrival is later
than the latest register, so long documents cost about one arrival per shingle.

A text has two views, each signed: its weighted shingles, and the same shingles with equal weights, for which the
probability Jaccard is that of the sets. They differ only where a shingle repeats. Two texts are near copies if either
view reaches ``threshold``: a passage that one copy repeats does not hide the rest, and what texts repeat counts for
more than what they say once. Search and verification use exactly this measure: candidates share a band
of one view and agree in enough registers of one view (four bits of each register are kept for that), and both
similarities are then computed exactly from the texts.

Only links that can change a group are verified: first every member of a band bucket against the bucket's hub; then,
where the members around a hub still lie in several groups, the members of different groups. They meet in cells of
bounded size, at first as register bits only; texts are brought only to the members that have a candidate there. The
largest group of a hub meets only the sides where others are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsinlake.llm.graph import components
from opsinlake.llm.keyed import borders, lookup, whole_groups
from opsinlake.llm.scratch import cut
from opsinlake.llm.words import blocks, mix, shingles, utf8

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 160
BAND = 4  # registers of a band
BANDS = 25  # a pair at 0.8 shares none of them with probability 2e-6
CELL = 256  # members of a side of a cell
SLACK = 4.0  # candidates agree in the registers expected at the threshold, less this many standard deviations

_U = np.uint64
_STEP = _U(0xD1B54A32D192ED03)
_WORDS = REGISTERS // 16  # 64-bit numbers that hold four bits of every register


def weighted_shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of the distinct shingles of every row."""
    row, value = shingles(texts, k)
    _, at, n = np.unique(mix(value + row.astype(np.uint64) * _STEP), return_index=True, return_counts=True)
    return row[at], value[at], 1.0 + np.log2(n)


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """``n`` x ``m`` winning shingles. Rows without shingles keep zeros."""
    time = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    row, t, j, width = row.copy(), np.zeros(len(row)), 0, 1
    while len(row):
        draw = mix(value[:, None] + (np.arange(j + 1, j + width + 1, dtype=np.uint64) * _STEP)[None, :])
        gap = -np.log(((draw >> _U(24)).astype(np.float64) + 0.5) * 2.0**-40) / weight[:, None]
        at = t[:, None] + np.cumsum(gap, axis=1)
        register = (((draw & _U(0xFFFFFF)) * _U(m)) >> _U(24)).astype(np.int64)
        slot, when = (row[:, None] * m + register).ravel(), at.ravel()
        np.minimum.at(time, slot, when)
        won = when == time[slot]
        winner[slot[won]] = np.repeat(value, width)[won]
        latest = time.reshape(n, m).max(axis=1)
        t, j = at[:, -1], j + width
        go = t < latest[row]
        row, value, weight, t = row[go], value[go], weight[go], t[go]
        width = 1 if len(row) * 8 > n * m else 32  # few rows left: several arrivals in one step
    return winner.reshape(n, m)


def bands(winner: np.ndarray, r: int = BAND, count: int = BANDS) -> np.ndarray:
    """``n`` x ``count`` hashes of ``r`` registers each."""
    n = len(winner)
    out = np.zeros((n, count), np.uint64)
    parts = winner[:, : count * r].reshape(n, count, r)
    for j in range(r):
        out = out * _STEP + parts[:, :, j]
    return mix(out + np.arange(count, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15))


def nibbles(winner: np.ndarray) -> np.ndarray:
    """Four bits of every register, 16 registers to a 64-bit number."""
    n, m = winner.shape
    four = (mix(winner) & _U(15)).reshape(n, m // 16, 16)
    return (four << (np.arange(16, dtype=np.uint64) * _U(4))).sum(axis=2, dtype=np.uint64)


def enough(threshold: float, m: int = REGISTERS) -> int:
    """Agreeing four-bit registers that a pair at ``threshold`` has but for 3 cases in 100,000."""
    p = threshold + (1 - threshold) / 16
    return max(0, math.ceil(m * p - SLACK * math.sqrt(m * p * (1 - p))))


def agreeing(a: str, b: str, m: int = REGISTERS) -> Column:
    """Number of registers whose four bits are equal, in the view where more are."""
    views = []
    for view in range(2):
        out = F.lit(m)
        for i in range(view * m // 16, (view + 1) * m // 16):
            x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
            folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
            out = out - F.bit_count(folded.bitwiseAND(F.lit(0x1111111111111111)))
        views.append(out)
    return F.greatest(*views)


def _agreeing(bits: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The same for one member against rows of ``bits``."""
    x = bits ^ one
    x |= (x >> _U(1)) | (x >> _U(2)) | (x >> _U(3))
    apart = np.bitwise_count(x & _U(0x1111111111111111)).reshape(len(bits), 2, _WORDS).sum(axis=2, dtype=np.int64)
    return REGISTERS - apart.min(axis=1)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat.view(np.int64)))


def both_views(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winning shingles of the weighted and of the equal view, and which rows repeat a shingle (elsewhere both are one)."""
    weighted = signatures(row, value, weight, n)
    equal, repeats = weighted.copy(), np.zeros(n, bool)
    repeats[row[weight > 1]] = True
    number = np.cumsum(repeats) - 1
    again = repeats[row]
    if again.any():
        equal[repeats] = signatures(number[row[again]], value[again], np.ones(again.sum()), int(repeats.sum()))
    return weighted, equal, repeats


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                row, value, weight = weighted_shingles(utf8(part.column("text")), k)
                has = np.bincount(row, minlength=part.num_rows) > 0
                weighted, equal, repeats = (x[has] for x in both_views(row, value, weight, part.num_rows))
                kept = part.select(["doc_id", "copy_key"]).filter(pa.array(has))
                named = np.stack([bands(weighted), bands(equal)], axis=1)
                used = np.stack([np.ones(len(repeats), bool), repeats], axis=1)
                bits = np.concatenate([nibbles(weighted), nibbles(equal)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, _lists(named[used].ravel(), used.sum(axis=1) * BANDS), _lists(bits.ravel(), np.full(len(bits), 2 * _WORDS))],
                    ["doc_id", "copy_key", "bands", "bits"],
                )

    return run


def similarities(pair: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The larger of both probability Jaccard similarities of ``n`` pairs of texts, from one entry a pair and shingle with
    its weights in the two texts (0: not there).

    The probability Jaccard is the sum over shared shingles i of 1 / sum over all j of max(x_j / x_i, y_j / y_i). In order of x_j / y_j
    the maximum is the second term before i and the first from i on, so running sums give every inner sum."""
    shared = (x > 0) & (y > 0)
    union, both = np.bincount(pair, minlength=n), np.bincount(pair[shared], minlength=n)
    order = np.lexsort((np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0), pair))
    p, x, y, shared = pair[order], x[order], y[order], shared[order]
    head = borders([p])
    count = np.diff(np.append(head, len(p)))

    def before(v: np.ndarray) -> np.ndarray:
        run = np.cumsum(v) - v
        return run - np.repeat(run[head], count)

    total = np.repeat(np.add.reduceat(x, head), count) if len(head) else x
    inner = (total - before(x))[shared] / x[shared] + before(y)[shared] / y[shared]
    weighted = np.bincount(p[shared], 1 / inner, minlength=n)
    return np.maximum(weighted, both / np.maximum(union, 1))


def _entries(pair: np.ndarray, value: np.ndarray, weight: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of both sides of pairs to one entry a pair and shingle: (pair, weight left, weight right)."""
    key = mix(value + pair.astype(np.uint64) * _STEP)
    order = np.argsort(key, kind="stable")
    key, pair, weight, right = key[order], pair[order], weight[order], right[order]
    head = borders([key])
    if not len(head):
        return pair, weight, weight
    return pair[head], np.add.reduceat(np.where(right, 0.0, weight), head), np.add.reduceat(np.where(right, weight, 0.0), head)


def similarity(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """``similarities`` of two text columns, row by row (0 where neither has a shingle)."""
    sides = [weighted_shingles(texts, k) for texts in (a, b)]
    pair, value, weight = (np.concatenate(x) for x in zip(*sides))
    right = np.repeat([False, True], [len(s[0]) for s in sides])
    return similarities(*_entries(pair, value, weight, right), len(a))


def _verify(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outer in blocks(batch, "text_a"):
                for part in blocks(outer, "text_b"):
                    ok = similarity(utf8(part.column("text_a")), utf8(part.column("text_b")), k) >= threshold
                    yield part.select(["a", "b"]).filter(pa.array(ok))

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, k: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) whose texts are similar enough. The text of ``b`` joins first, that of ``a`` (which may be a hub)
    last, so a text is moved once per pair and a hub is split by the skew join."""
    sided = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    sided = sided.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return sided.select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, threshold), "a bigint, b bigint")


def _around_hubs(members: DataFrame) -> DataFrame:
    """(hub, hub_bits, node, bits): the members of every bucket under its hub, the member that shares most buckets with
    most others."""
    hub = members.groupBy("band").agg(F.max(F.struct("score", F.negative("node").alias("minus"), F.col("bits").alias("bits"))).alias("h"))
    return members.join(hub.select("band", F.negative("h.minus").alias("hub"), F.col("h.bits").alias("hub_bits")), "band").select("hub", "hub_bits", "node", "bits")


_CELL_ROW = "hub bigint, i int, j int, side int, node bigint, root bigint, bits array<bigint>"
_CELL_KEY = ["hub", "i", "j"]


def _members(cell: pa.Table) -> tuple[np.ndarray, ...]:
    """(root, side, bits, whether pairs of one side count, members outside the largest group) of a cell."""
    root, side = cell.column("root").to_numpy(), cell.column("side").to_numpy()
    bits = pa.concat_arrays(cell.column("bits").chunks).flatten().to_numpy().view(np.uint64).reshape(len(root), -1)
    names, size = np.unique(root, return_counts=True)
    return root, side, bits, cell.column("i")[0] == cell.column("j")[0], np.flatnonzero(root != names[size.argmax()])


def _candidates(root, side, bits, inside, a: int, least: int) -> np.ndarray:
    return (_agreeing(bits, bits[a]) >= least) & (root != root[a]) & ((side != side[a]) | inside)


def _cell_by_cell(handle):
    """Apply ``handle`` to every cell of sorted batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _CELL_KEY):
            head = borders([table.column(c).to_numpy() for c in _CELL_KEY])
            for a, b in zip(head, [*head[1:], len(table)]):
                yield from handle(table.slice(a, b - a)).to_batches()

    return run


def _involved(least: int):
    """The members of a cell that have a candidate in another group there."""

    def handle(cell: pa.Table) -> pa.Table:
        root, side, bits, inside, outer = _members(cell)
        has = np.zeros(len(root), bool)
        for a in outer.tolist():
            near = _candidates(root, side, bits, inside, a, least)
            has |= near
            has[a] |= near.any()
        return cell.filter(pa.array(has))

    return _cell_by_cell(handle)


def _links(least: int, k: int, threshold: float):
    """(a, b): roots of groups that a verified pair of a cell links; a pair whose groups are linked already is passed over."""

    def handle(cell: pa.Table) -> pa.Table:
        root, side, bits, inside, outer = _members(cell)
        row, value, weight = weighted_shingles(utf8(cell.column("text")), k)
        order = np.argsort(row, kind="stable")
        value, weight, edge = value[order], weight[order], np.searchsorted(row[order], np.arange(len(root) + 1))
        over: dict[int, int] = {}

        def top(r: int) -> int:
            while r in over:
                r = over[r]
            return r

        found = []
        for a in outer.tolist():
            for b in np.flatnonzero(_candidates(root, side, bits, inside, a, least)).tolist():
                x, y = sorted((top(int(root[a])), top(int(root[b]))))
                if x == y:
                    continue
                mine, other = slice(edge[a], edge[a + 1]), slice(edge[b], edge[b + 1])
                sizes = [mine.stop - mine.start, other.stop - other.start]
                right = np.repeat([False, True], sizes)
                entries = _entries(np.zeros(len(right), np.int64), np.concatenate([value[mine], value[other]]), np.concatenate([weight[mine], weight[other]]), right)
                if similarities(*entries, 1)[0] >= threshold:
                    over[y] = x
                    found.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return _cell_by_cell(handle)


def _cross_links(around: DataFrame, known: DataFrame, groups: DataFrame, least: int, threshold: float, k: int) -> DataFrame:
    """(a, b): roots of groups that a pair of members around one hub links.

    Members around a hub are dealt into sides of about ``CELL`` members; two sides meet in one cell, so a task holds two
    sides however many members there are, and no pair becomes a row unless it is a link. Members of the hub's
    largest group go only to cells where another group is; texts follow where registers agree."""
    at = cut(around.select("hub", "node").distinct().join(groups, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("root")))
    sizes = at.groupBy("hub", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("hub").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.max_by("root", F.struct("n", "root")).alias("main"))
    mixed = cut(mixed.where("groups > 1").select("hub", "n", "main", F.ceil(F.col("n") / CELL).cast("int").alias("sides")))
    dealt = cut(lookup(at, mixed, ["hub"]).drop("n").withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int")))
    outer = dealt.where("root <> main").groupBy("hub").agg(F.collect_set("side").alias("outer"))  # at most ``sides`` numbers
    outer = cut(outer.join(mixed.select("hub", "n"), "hub"))
    met = F.when(F.col("root") == F.col("main"), F.col("outer")).otherwise(F.sequence(F.lit(0), F.col("sides") - 1))
    rows = lookup(dealt, outer, ["hub"]).join(known.select("node", "bits"), "node").withColumn("other", F.explode(met))
    rows = rows.select("hub", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "root", "bits")
    near = cut(rows.repartition(*_CELL_KEY).sortWithinPartitions(*_CELL_KEY).mapInArrow(_involved(least), _CELL_ROW))
    told = near.join(known.select("node", "text"), "node").select(*_CELL_KEY, "side", "node", "root", "bits", "text")
    placed = told.repartition(*_CELL_KEY).sortWithinPartitions(*_CELL_KEY)
    return placed.mapInArrow(_links(least, k, threshold), "a bigint, b bigint").distinct()


def _groups(members: DataFrame, known: DataFrame, threshold: float, k: int) -> DataFrame:
    """(node, root) of every text that is alike another. The hub round settles most groups with one pair per member; the
    second round compares all that could still join two groups."""
    least = enough(threshold)
    around = cut(_around_hubs(members))
    pairs = around.where("node <> hub").where(agreeing("bits", "hub_bits") >= least).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    groups = cut(components(verified(pairs, known, threshold, k)))
    more = cut(_cross_links(around, known, groups, least, threshold, k))
    if more.isEmpty():
        return groups
    joined = cut(components(more))
    moved = groups.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    alone = joined.join(groups.select("node"), "node", "left_anti").select("node", "root")
    return moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(alone)


def _one_document(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``texts`` with the groups of texts that stand under one doc_id joined."""
    placed = rows.join(texts.select("copy_key", "root"), "copy_key").select("doc_id", "root").distinct()
    several = placed.groupBy("doc_id").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("doc_id", "low")
    joined = components(placed.join(several, "doc_id").select(F.col("low").alias("a"), F.col("root").alias("b")))
    return texts.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, copies_of) for every row of ``docs(doc_id, text, ...)``.

    class_id is the smallest doc_id of the group, groups being what exact copies and near copies connect. Near copies are
    texts whose word ``k``-shingles have a probability Jaccard similarity of ``threshold`` or more, either weighted by
    1 + log2 of their occurrences or all alike (then it is the Jaccard similarity of the sets); copies_of is the smallest
    doc_id with the same text. A row without words (null, empty, blanks only) is alike to no other; a row with a null doc_id takes no part
    and only shows the class of its text, if the text has one (else class_id is null). Every distinct text is compared, also where a doc_id has several; rows that share a
    doc_id are one document, in the group of each of its texts. Every input row gives one output row. Texts are read whole. Other columns are
    ignored, whatever their names. An empty table gives no rows.

    Exact copies meet in a partial aggregate on the md5 of the text before anything else, so a text that fills a third
    of the table is one row from there on.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    worded = F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))
    keyed = docs.where(worded & F.col("doc_id").isNotNull()).select("doc_id", F.unhex(F.md5("text")).alias("copy_key"), "text")
    rows = cut(docs.select("doc_id", F.unhex(F.md5("text")).alias("copy_key"), worded.alias("worded")))
    known = rows.where("worded and doc_id is not null").select("doc_id", "copy_key")
    nameless = rows.where("worded and doc_id is null").select("doc_id", "copy_key")
    signed = keyed.mapInArrow(_sign(k), "doc_id bigint, copy_key binary, bands array<bigint>, bits array<bigint>")
    distinct = signed.groupBy("copy_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()))  # written, so a text has one number from here on
    entries = distinct.select("node", F.explode(F.array_distinct("bands")).alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    found = cut(entries.join(shared, "band"))
    score = found.groupBy("node").agg(F.sum("n").alias("score"))
    near = cut(distinct.select("node", "copy_key", "first_id", "bits").join(score, "node"))  # texts that share a bucket with another
    members = found.select("node", "band").join(near.select("node", "score", "bits"), "node")
    wanted = near.select(F.col("first_id").alias("doc_id"), "copy_key", "node", "bits")
    texts = keyed.join(wanted, ["doc_id", "copy_key"]).groupBy("node").agg(F.first("text").alias("text"), F.first("bits").alias("bits"))
    groups = _groups(members, cut(texts), threshold, k)
    grouped = cut(distinct.select("copy_key", "first_id", "n", "node").join(groups, "node", "left").select("copy_key", "first_id", "n", F.coalesce("root", "node").alias("root")))
    grouped = cut(_one_document(grouped, known))
    classes = grouped.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n"))
    named = lookup(grouped.withColumnRenamed("n", "rows"), cut(classes), ["root"])
    classes = cut(named.select("copy_key", "first_id", "class_id", F.col("rows").alias("n")))
    out = lookup(known, classes, ["copy_key"]).select("doc_id", "class_id", F.col("first_id").alias("copies_of"))
    held = nameless.groupBy("copy_key").agg(F.count("*").alias("n")).join(classes.drop("n"), "copy_key", "left")
    named = lookup(nameless, cut(held), ["copy_key"]).select("doc_id", "class_id", F.col("first_id").alias("copies_of"))
    out = out.unionByName(named)
    rest = rows.where("not worded").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copies_of"))
    return out.unionByName(rest)
