"""Vector compression to product codes: Lloyd's rounds over members that stay where their entry lives.

A vector is cut into equal parts, and every part position has a codebook. The parts lie partitioned by (position, entry,
salt). An owner of such a group sends the sums of its resident members, from which the codebooks follow; then every
member is compared with the new codebook where it lies, and only those that change their entry go through the next
shuffle, the others are written in place. Equal parts of a group are one member with a count, so a vector that fills a
third of the table costs one member; the salt, a hash of the part, spreads an entry that many different parts share.

All numbers are integers, so the result does not depend on the order of sums. What reaches the driver are the codebooks:
at most ``entries`` vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsinlake.llm.keyed import lookup
from opsinlake.llm.scratch import cut

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SALTS = 64
SCALE = 256
_ROWS = 1 << 14  # parts compared with a codebook at a time
_COMPONENTS = 1 << 21
_MEMBER = "position int, entry int, salt int, part array<int>, n bigint"
_MOST = 2**63 - 1


def limit(width: int) -> int:
    """Largest magnitude of a component for which the squared distance of two vectors of ``width`` stays below 2^62."""
    return min(2**30, math.isqrt(2**60 // max(width, 1)))


def whole(vectors: np.ndarray) -> np.ndarray:
    """Components floor(SCALE * x), held inside ``limit``."""
    most = limit(vectors.shape[1])
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def bounds(width: int, parts: int) -> list[int]:
    """Where the parts begin and end; equal if ``width`` is a multiple of ``parts``."""
    return [p * width // parts for p in range(parts + 1)]


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of ``book`` for every row of ``part``; ties go to the lower index."""
    entry, far = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for a in range(0, len(part), _ROWS):
        rows = part[a : a + _ROWS]
        d = np.zeros((len(rows), len(book)), np.int64)
        for j in range(part.shape[1]):
            d += (rows[:, j, None] - book[None, :, j]) ** 2
        best = d.argmin(axis=1)
        entry[a : a + _ROWS], far[a : a + _ROWS] = best, d[np.arange(len(rows)), best]
    return entry, far


def _matrix(lists) -> np.ndarray:
    """A list column with lists of one length, as a matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of vectors in pieces of a bounded number of components, with their whole numbers."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = max(1, _COMPONENTS // len(batch.column("vector")[at]))
            piece = batch.slice(at, step)
            yield piece, whole(_matrix(piece.column("vector")))
            at += step


def _salt(part: np.ndarray, salts: int) -> np.ndarray:
    h = np.zeros(len(part), np.uint64)
    for j in range(part.shape[1]):
        h = (h ^ part[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(salts)).astype(np.int32)


def _members(position: np.ndarray, entry: np.ndarray, part: np.ndarray, n: np.ndarray, salts: int) -> pa.RecordBatch:
    flat = pa.array(part.astype(np.int32).ravel())
    lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1], flat)
    return pa.RecordBatch.from_arrays(
        [pa.array(position.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(_salt(part, salts)), lists, pa.array(n.astype(np.int64))],
        ["position", "entry", "salt", "part", "n"],
    )


def _deal(books: list[np.ndarray], salts: int):
    """Vectors to members with the entries of ``books``; equal parts of a batch are one member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _pieces(batches):
            at = bounds(rows.shape[1], len(books))
            for p, book in enumerate(books):
                part, n = np.unique(rows[:, at[p] : at[p + 1]], axis=0, return_counts=True)
                yield _members(np.full(len(part), p), nearest(part, book)[0], part, n, salts)

    return run


def _assign(books: list[np.ndarray], salts: int):
    """Members with ``moved``: whether the nearest entry of ``books`` is another than before, and with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column("position").to_numpy()
            for p in np.unique(position).tolist():  # parts of one position have one length
                mine = batch.filter(pa.array(position == p))
                part = _matrix(mine.column("part")).astype(np.int64)
                entry = nearest(part, books[p])[0]
                out = _members(np.full(len(part), p), entry, part, mine.column("n").to_numpy(), salts)
                yield out.append_column("moved", pa.array(entry != mine.column("entry").to_numpy()))

    return run


def _placed(members: DataFrame) -> DataFrame:
    """Members at their owners, equal ones merged."""
    owner = ["position", "entry", "salt"]
    return members.repartition(*owner).groupBy(*owner, "part").agg(F.sum("n").alias("n"))


def _updated(members: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks of the floored means of resident members; an entry without members stays."""
    width = max((b.shape[1] for b in books), default=0)
    sums = [F.sum(F.col("n") * F.get("part", F.lit(j))).alias(f"s{j}") for j in range(width)]
    rows = members.groupBy("position", "entry").agg(F.sum("n").alias("n"), *sums).collect()  # entries x parts rows
    out = [b.copy() for b in books]
    for r in rows:
        for j in range(out[r["position"]].shape[1]):
            out[r["position"]][r["entry"], j] = r[f"s{j}"] // r["n"]
    return out


def kept_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector): rows whose vector is not null or empty, holds finite numbers only, and is as long as that
    of the row with the smallest vec_id among them."""
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    first = rows.agg(F.min_by(F.size("vector"), F.struct("vec_id", "vector")).alias("width")).first()["width"]
    return rows.where(F.size("vector") == F.lit(first or 0))


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, salts: int = SALTS) -> list[np.ndarray]:
    """One codebook a part position after ``rounds`` of Lloyd, from the vectors with the ``entries`` smallest vec_ids."""
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not seeds:
        return []
    first = whole(np.array([r["vector"] for r in seeds], np.float64))
    at = bounds(first.shape[1], parts)
    books = [first[:, a:b] for a, b in zip(at[:-1], at[1:])]
    if rounds <= 0:
        return books
    members = cut(_placed(kept.select("vector").mapInArrow(_deal(books, salts), _MEMBER)))
    books = _updated(members, books)
    for _ in range(rounds - 1):
        judged = cut(members.mapInArrow(_assign(books, salts), f"{_MEMBER}, moved boolean"))  # written where it lies
        arrived = cut(_placed(judged.where("moved")))
        members = judged.where("not moved").drop("moved").select(arrived.columns).unionByName(arrived)
        books = _updated(members, books)
    return books


def _encode(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _pieces(batches):
            at = bounds(rows.shape[1], len(books))
            code, error = np.empty((len(rows), len(books)), np.int64), np.zeros(len(rows), np.int64)
            for p, book in enumerate(books):
                code[:, p], far = nearest(rows[:, at[p] : at[p + 1]], book)
                error += far
            digits = max(2, (max(map(len, books)) - 1).bit_length() + 3 >> 2)
            text = ["".join(f"{x:0{digits}x}" for x in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by position, entry, place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, salts: int = SALTS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row of ``rows(vec_id, label, <vector>, ...)``
    with a usable vector.

    Components become floor(256 * x). ``code`` has two hexadecimal digits for each part's entry, in part order (more if
    there are more than 256 entries); ``error`` is the squared distance to the coded vector; ``label_error`` its sum over
    rows with the same label, null being a label. Rows whose vector is null or empty, or holds a null or a number that is not finite, go;
    so do vectors of another length than that of the smallest kept vec_id. A length that 16 does not divide
    is cut as evenly as can be. Components beyond ``limit`` (for 64 components, |x| above 524,288) count as that limit, so that
    errors fit 64 bits; a label's sum beyond 2^63 - 1 is 2^63 - 1. Rows that repeat a vec_id count each; a null vec_id comes last.
    With fewer rows than entries there are as many entries as rows. No usable row, no result. Other columns are ignored.
    """
    kept = cut(kept_vectors(rows, vector))
    books = train(kept, parts, entries, rounds, salts)
    coded = cut(kept.mapInArrow(_encode(books), "vec_id bigint, label bigint, code string, error bigint") if books else kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")))
    name = F.struct(F.coalesce("label", F.lit(0)).alias("label"), F.col("label").isNull().alias("none"))
    coded = coded.withColumn("name", name)
    sums = cut(coded.groupBy("name").agg(F.coalesce(F.try_sum("error"), F.lit(_MOST)).alias("label_error"), F.count("*").alias("n")))
    out = lookup(coded, sums, ["name"])
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same with joins of all parts and all entries."""
    ctes = [f"""
    k AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    p AS (SELECT vec_id, label, pos, v[pos * len(v) // {parts} + 1 : (pos + 1) * len(v) // {parts}] AS part FROM (SELECT *, unnest(range({parts})) AS pos FROM k)),
    s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}),
    c0 AS (SELECT pos, entry, part AS mean FROM p JOIN s USING (vec_id))"""]
    for r in range(rounds + 1):
        ctes.append(f"""
    a{r} AS (SELECT vec_id, label, pos, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
        SELECT vec_id, label, p.pos, part, entry, list_sum([(part[i] - mean[i]) * (part[i] - mean[i]) FOR i IN range(1, len(part) + 1)]) AS d
        FROM p JOIN c{r} ON p.pos = c{r}.pos) GROUP BY ALL)""")
        if r < rounds:
            ctes.append(f"""
    m{r} AS (SELECT pos, entry, list(m ORDER BY i) AS mean FROM (
        SELECT pos, best.entry AS entry, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS m
        FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM a{r}) GROUP BY pos, best.entry, i) GROUP BY pos, entry),
    c{r + 1} AS (SELECT pos, entry, coalesce(m{r}.mean, c{r}.mean) AS mean FROM c{r} LEFT JOIN m{r} USING (pos, entry))""")
    return f"""
    WITH {",".join(ctes)},
    h AS (SELECT sha256(string_agg(array_to_string(mean, ','), ',' ORDER BY pos, entry)) AS h FROM c{rounds}),
    e AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best.entry), '' ORDER BY pos) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM e, h"""
