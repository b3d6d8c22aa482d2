"""Near-duplicate documents by SimHash: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint bit is set where more than half of the hashes of a text's shingles have it. Two fingerprints that differ in
at most d bits agree in one of any d + 1 blocks the bits are split into, so pairs are sought among fingerprints that
share a block. A block value with more than ``SPLIT`` fingerprints is split by the same argument once more: the bits
outside the block are dealt into d + 1 smaller blocks, one of which a close pair shares as well; and again after that.
What is still crowded then is compared in cells of two times about ``CELL`` fingerprints.

Rows with one fingerprint are one node from the start (a partial aggregate), so copies cost nothing. A group of
fingerprints gives back a spanning forest of its links, never all its pairs; every link of it is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from opsinlake.llm.graph import components
from opsinlake.llm.keyed import borders, lookup, whole_groups
from opsinlake.llm.scratch import cut
from opsinlake.llm.substrings import joined
from opsinlake.llm.words import ascii_lower, blocks, split_words, utf8

SHINGLE = 3
SEED = 42
DISTANCE = 3
SPLIT = 512  # fingerprints of a block value that are compared at once
CELL = 4096  # fingerprints of a side of a cell
LEVELS = 3  # 16, 28 and 37 bits for a distance of 3
_PIECE = 1 << 17  # shingles hashed at a time
_SMALL = 64  # groups of up to this many fingerprints are compared together


# ------------------------------------------------------------------ fingerprints


def _spans(first: np.ndarray, at: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of every ``k``-word shingle in the joined text, rows in order; a row of fewer words has one."""
    n = len(row)
    head = np.flatnonzero(row[: n - k + 1] == row[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    rows = np.concatenate([row[head], short])
    begin = np.concatenate([at[head], at[first[short]]])
    end = np.concatenate([at[head + k], at[first[short + 1]]]) - 1
    order = np.argsort(rows, kind="stable")
    return rows[order], begin[order], end[order]


def fingerprints(texts: pa.Array, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprint of every text; 0 for a text without words."""
    w = split_words(ascii_lower(texts))
    text, at = joined(w)
    rows, begin, end = _spans(w.first, at, w.row, k)
    ones = np.zeros((len(texts), 64), np.int64)
    for p in range(0, len(rows), _PIECE):
        part = rows[p : p + _PIECE]
        spans = zip(begin[p : p + _PIECE].tolist(), end[p : p + _PIECE].tolist())
        h = np.fromiter((xxh64_intdigest(text[a:b], seed) for a, b in spans), np.uint64, len(part))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        head = borders([part])
        ones[part[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    total = np.bincount(rows, minlength=len(texts))
    majority = (ones * 2 > total[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64)


def _sign(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                value = fingerprints(utf8(part.column("text")), k, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value)], ["doc_id", "fp"])

    return run


# ------------------------------------------------------------------ blocks


def block_masks(distance: int, levels: int) -> list[dict[int, list[int]]]:
    """For every level the masks that a mask of the level before is split into (level 0: of the mask 0). A mask marks
    the bits on which a pair agrees; its free bits are dealt into ``distance`` + 1 blocks."""
    out, parents = [], [0]
    for _ in range(levels):
        table = {}
        for parent in parents:
            free = [b for b in range(64) if not parent >> b & 1]
            parts = np.array_split(np.array(free), distance + 1)
            table[parent] = [parent | sum(1 << int(b) for b in part) for part in parts]
        out.append(table)
        parents = [m for masks in table.values() for m in masks]
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split_by(table: dict[int, list[int]]) -> Column:
    """The masks that the column ``mask`` is split into, as rows."""
    lists = {m: F.array(*(F.lit(_signed(x)).cast("bigint") for x in masks)) for m, masks in table.items()}
    if len(lists) == 1:
        return F.explode(next(iter(lists.values())))
    cases = reduce(lambda c, kv: c.when(F.col("mask") == F.lit(_signed(kv[0])), kv[1]), lists.items(), F)
    return F.explode(cases)


# ------------------------------------------------------------------ links inside groups


def _forest(fp: np.ndarray, side: np.ndarray, crossing: bool, distance: int) -> list[tuple[int, int]]:
    """Links (positions) that connect what close pairs connect: a search that looks from every member once at those not
    yet reached. With ``crossing`` only pairs of different sides count."""
    left = [np.flatnonzero(side == s) for s in np.unique(side)] if crossing else [np.arange(len(fp))]
    out: list[tuple[int, int]] = []

    def reach(a: int, s: int) -> list[tuple[int, int]]:
        found = []
        for other in range(len(left)):
            if crossing and other == s:
                continue
            near = np.bitwise_count(fp[left[other]] ^ fp[a]) <= distance
            if near.any():
                found += [(int(b), other) for b in left[other][near]]
                left[other] = left[other][~near]
        return found

    for s in range(len(left)):
        while len(left[s]):
            start, left[s] = int(left[s][0]), left[s][1:]
            frontier = [(start, s)]
            while frontier:
                a, own = frontier.pop()
                new = reach(a, own)
                out += [(a, b) for b, _ in new]
                frontier += new
    return out


def _links(keys: list[str], distance: int):
    """Spanning links (a, b) of every group of equal ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            fp = table.column("fp").to_numpy().view(np.uint64)
            node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
            crossing = table.column("i").to_numpy() != table.column("j").to_numpy()
            head = borders([table.column(k).to_numpy() for k in keys])
            size = np.diff(np.append(head, len(fp)))
            group = np.repeat(np.arange(len(head)), size)
            pairs: list[np.ndarray] = []
            at, shift = np.flatnonzero(size[group] <= _SMALL), 1
            while len(at):  # members of all small groups against those ``shift`` places on
                at = at[at + shift < len(fp)]
                at = at[group[at] == group[at + shift]]
                near = (np.bitwise_count(fp[at] ^ fp[at + shift]) <= distance) & (~crossing[at] | (side[at] != side[at + shift]))
                pairs.append(np.stack([at[near], at[near] + shift]))
                shift += 1
            found = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
            many = np.bincount(group[found[0]], minlength=len(head)) >= size  # more links than a forest needs
            searched = np.flatnonzero(many | (size > _SMALL))
            found = found[:, ~many[group[found[0]]]]
            more = [(head[g] + a, head[g] + b) for g in searched.tolist() for a, b in _forest(*(x[head[g] : head[g] + size[g]] for x in (fp, side)), bool(crossing[head[g]]), distance)]
            if more:
                found = np.concatenate([found, np.array(more, np.int64).T], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node[found[0]]), pa.array(node[found[1]])], ["a", "b"])

    return run


def close_links(nodes: DataFrame, distance: int = DISTANCE, levels: int = LEVELS, split: int = SPLIT, cell: int = CELL) -> DataFrame:
    """(a, b): links between nodes whose fingerprints differ in at most ``distance`` bits. They connect all that such pairs
    connect. ``nodes`` has one row a fingerprint: fp and node."""
    key = ["mask", "block"]
    rows, cells = nodes.select("fp", "node", F.lit(0).cast("bigint").alias("mask")), []
    for level, table in enumerate(block_masks(distance, levels)):
        rows = rows.select("fp", "node", _split_by(table).alias("mask")).withColumn("block", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = cut(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
        crowded = sizes.where(F.col("n") > split)
        last = level == levels - 1 or crowded.isEmpty()
        shared = lookup(rows, sizes, key)
        sides = F.ceil(F.col("n") / F.lit(cell)).cast("int")
        compared = shared if last else shared.where(F.col("n") <= split)
        compared = compared.withColumns({"sides": sides, "side": F.pmod(F.xxhash64("fp"), sides).cast("int")})
        compared = compared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        cells.append(compared.select(*key, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "fp", "node"))
        if last:
            break
        rows = cut(lookup(rows, crowded, key).select("fp", "node", "mask"))
    place = [*key, "i", "j"]
    placed = reduce(DataFrame.unionByName, cells).repartition(*place).sortWithinPartitions(*place)
    return placed.mapInArrow(_links(place, distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, k: int = SHINGLE, seed: int = SEED, **bounds: int) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text, ...)``; fp is the fingerprint as a bigint.

    Texts have A to Z lower-cased; words are runs of anything but the six ASCII blanks; shingles are ``k`` words joined by a
    space, repeats included; a text of fewer words is one shingle. Null, empty and blank texts have the fingerprint 0 and
    are linked like any other. Documents are linked if their fingerprints differ in at most ``distance`` bits;
    component_id is the smallest doc_id that links reach. Rows that share a doc_id are one document, linked by the
    fingerprint of each. A row with a null doc_id takes no part: its component_id is null. Texts are read whole,
    in pieces. An empty table gives no rows. Other columns are ignored, whatever their names. ``bounds`` are the limits
    of ``close_links``; they do not change the result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(rows.mapInArrow(_sign(k, seed), "doc_id bigint, fp bigint"))
    known = rows.where("doc_id is not null")
    nodes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    several = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id", "low")
    same = known.distinct().join(several, "doc_id").where("fp <> low").select("low", "fp").distinct()
    same = same.join(nodes.select("fp", F.col("node").alias("b")), "fp").join(nodes.select(F.col("fp").alias("low"), F.col("node").alias("a")), "low")
    linked = components(close_links(nodes, distance, **bounds).unionByName(same.select("a", "b")))
    roots = nodes.join(linked, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component_id"))
    out = lookup(known, cut(roots), ["fp"]).select("doc_id", "fp", "component_id")
    return out.unionByName(rows.where("doc_id is null").withColumn("component_id", F.lit(None).cast("bigint")))


def hexadecimal(fp: str) -> Column:
    """A bigint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
