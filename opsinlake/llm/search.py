"""Ranked lexical search over an inverted index in shards of documents, evaluated by hybrid TAAT-DAAT.

Building the index needs no shuffle: every block of documents becomes a shard with one posting list a term (places of the
documents in the shard and term frequencies) and a directory (doc_ids and lengths). An index for known queries leaves out
the lists of all other terms before anything is written. Searching takes the posting
lists of the queries' terms to where the shard is evaluated. There a query's short lists are summed term at a time into one
accumulator list; from then on that list is one iterator with a bound, its largest sum, beside the long lists and their
bounds. Documents are then visited in order, a step of them in one array of sums: only those that an essential iterator holds
(without the essential ones the bounds cannot reach the k-th best score so far) can enter, and a document is given up as soon
as what is left cannot lift it there. The other lists are added to a step in which many documents are left, and only looked up
for the few left of another. A task keeps the best k of a query from shard to shard.

Everything is exact: a document is skipped only if its score would be below the k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsinlake.llm.keyed import borders, whole_groups
from opsinlake.llm.scratch import cut
from opsinlake.llm.words import blocks, offsets, utf8

TOP = 50
SHARD_BYTES = 16 << 20  # text of a shard; a longer text is a shard of its own
SHORT = 16  # lists of up to 1/SHORT of the shard's documents are summed into the accumulators
MANY = 8  # lists of at least 1/MANY of the shard's documents are also kept by place
STEP = 1024  # documents visited between two looks at the k-th best score
QUERIES = 2048  # queries that are evaluated together in a shard
TERM_BYTES = 4 << 20  # query terms that are sent to every task; beyond it the index has all terms
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_FOLD = np.arange(256, dtype=np.uint8)  # A to Z in lower case, blanks between terms
_FOLD[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)]
_SHARD = "shard bigint, term string, ids array<bigint>, doc array<int>, n array<int>"


# ------------------------------------------------------------------ index


def _lists(values: np.ndarray, head: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.append(head, len(values)).astype(np.int32), pa.array(values))


def postings(texts: pa.Array, wanted: pa.Array | None = None) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """(terms, places of the texts that hold each, occurrences there, number of terms of every text). Only the ``wanted`` terms
    have lists; all are counted."""
    data, at = offsets(texts)
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_FOLD[data]))
    parts = pc.ascii_split_whitespace(folded)
    term, row = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    full = pc.not_equal(term, "")  # a text that begins or ends with a blank has an empty part there
    size = np.bincount(row[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    wanted = term.filter(full).unique() if wanted is None else wanted
    code = pc.index_in(term, wanted)
    known = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
    key = code.drop_null().to_numpy().astype(np.int64) * max(len(texts), 1) + row[known]
    key, times = np.unique(key, return_counts=True)
    of, doc = np.divmod(key, max(len(texts), 1))
    head = borders([of])
    return wanted.take(pa.array(of[head])).cast(pa.string()), _lists(doc.astype(np.int32), head), _lists(times.astype(np.int32), head), size


def _build(wanted: pa.Array | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in blocks(batch, limit=SHARD_BYTES):
                terms, doc, times, size = postings(utf8(part.column("text")), wanted)
                m = len(terms)
                one = pa.ListArray.from_arrays(np.array([0, part.num_rows], np.int32), pa.array(size.astype(np.int32)))
                ids = pa.ListArray.from_arrays(np.array([0, part.num_rows], np.int32), part.column("doc_id"))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m + 1, shard)), pa.concat_arrays([pa.nulls(1, pa.string()), terms]), pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
                    pa.concat_arrays([pa.nulls(1, doc.type), doc]), pa.concat_arrays([one, times]),
                ], ["shard", "term", "ids", "doc", "n"])
                shard += 1

    return run


def build_index(docs: DataFrame, wanted: pa.Array | None = None) -> DataFrame:
    """(shard, term, ids, doc, n): the posting lists of every shard, of the ``wanted`` terms or of all, and its directory where
    term is null. Written."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cut(rows.mapInArrow(_build(wanted), _SHARD))


# ------------------------------------------------------------------ evaluation


class Best:
    """The k best (score, doc_id) so far, equal scores by ascending doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score that a document must reach to enter."""
        return int(self.score[-1]) if len(self.score) >= self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


class Postings:
    """A list in a shard of ``size`` documents: places ascending, scores above 0. What is needed of it is made once for all queries."""

    def __init__(self, doc: np.ndarray, score: np.ndarray, size: int):
        self.doc, self.score, self.size, self.short = doc, score, size, len(doc) * SHORT <= size

    @cached_property
    def bound(self) -> int:
        return int(self.score.max())

    @cached_property
    def edges(self) -> list[int]:
        """Where the steps begin."""
        return np.searchsorted(self.doc, np.arange(0, self.size + STEP, STEP)).tolist()

    @cached_property
    def every(self) -> np.ndarray | None:
        """The scores of all documents, if the list holds many: a step of it is a slice."""
        if len(self.doc) * MANY < self.size:
            return None
        every = np.zeros(self.size, np.int64)
        every[self.doc] = self.score
        return every

    def add(self, total: np.ndarray, step: int) -> None:
        """To the sums of the documents of a step."""
        begin = step * STEP
        if self.every is not None:
            total += self.every[begin : begin + len(total)]
        else:
            own = slice(self.edges[step], self.edges[step + 1])
            total[self.doc[own] - begin] += self.score[own]

    def look_up(self, total: np.ndarray, step: int, at: np.ndarray) -> None:
        """The same for a few documents of the step."""
        begin, own = step * STEP, slice(self.edges[step], self.edges[step + 1])
        if self.every is not None:
            total[at] += self.every[begin + at]
        elif own.stop > own.start:
            i = own.start + np.minimum(np.searchsorted(self.doc[own], begin + at), own.stop - own.start - 1)
            total[at] += np.where(self.doc[i] == begin + at, self.score[i], 0)


def accumulate(lists: list[Postings]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: (places, summed scores) of all lists together."""
    doc, score = np.concatenate([x.doc for x in lists]), np.concatenate([x.score for x in lists])
    order = np.argsort(doc, kind="stable")
    doc, score = doc[order], score[order]
    head = borders([doc])
    return doc[head], np.add.reduceat(score, head)


def evaluate(lists: list[Postings | tuple[np.ndarray, np.ndarray]], ids: np.ndarray, best: Best) -> None:
    """Add the best documents of a shard. ``lists`` are those of a query's terms, or their (places ascending, scores above 0)."""
    size = len(ids)
    lists = [x if isinstance(x, Postings) else Postings(*x, size) for x in lists]
    iterators, short = [x for x in lists if not x.short], [x for x in lists if x.short]
    if short:
        iterators.append(Postings(*accumulate(short), size))
    iterators.sort(key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in iterators])  # what the first lists can give together
    for step in range(-(-size // STEP)):
        least = best.least
        free = int(np.searchsorted(reach, least))  # lists that cannot lift a document to ``least`` on their own
        if free == len(iterators):
            return
        total = np.zeros(min(STEP, size - step * STEP), np.int64)
        for x in iterators[free:]:
            x.add(total, step)
        at = np.flatnonzero(total)
        for x, most in zip(iterators[:free][::-1], reach[:free][::-1]):
            at = at[total[at] + most >= least]
            if not len(at):
                break
            if len(at) * SHORT > x.edges[step + 1] - x.edges[step]:
                x.add(total, step)
            else:
                x.look_up(total, step, at)
        at = at[total[at] >= least]
        if len(at):
            best.add(total[at], ids[step * STEP + at])


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column without nulls."""
    lists = pa.concat_arrays(lists.chunks)
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64), lists.flatten().to_numpy().astype(np.int64)


def _search(k: int, documents: int, length: int):
    def visit(shard: pa.Table, ids: np.ndarray, size: np.ndarray, bests: dict[int, Best]) -> None:
        m = 50 + (50 * size * documents) // max(length, 1)
        edge, place = _flat(shard.column("doc"))
        _, times = _flat(shard.column("n"))
        use, items = _flat(shard.column("items"))
        shares = (1_000_000_000 * times) // (1000 * times + 20 * m[place])
        lists: dict[int, list] = {}
        for t, w in enumerate(shard.column("weight").to_pylist()):
            if w > 0:
                own = Postings(place[edge[t] : edge[t + 1]], w * shares[edge[t] : edge[t + 1]], len(ids))
                for item in items[use[t] : use[t + 1]].tolist():
                    lists.setdefault(item, []).append(own)
        for item, own in lists.items():
            evaluate(own, ids, bests.setdefault(item, Best(k)))

    def out(bests: dict[int, Best]) -> pa.RecordBatch:
        sizes = [len(b.doc) for b in bests.values()]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array(list(bests), np.int64), sizes)),
            pa.array(np.concatenate([np.zeros(0, np.int64), *(b.doc for b in bests.values())])),
            pa.array(np.concatenate([np.zeros(0, np.int64), *(b.score for b in bests.values())])),
        ], ["item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bests = None, {}
        for table in whole_groups(batches, ["block", "shard"]):
            head = borders([table.column("block").to_numpy(), table.column("shard").to_numpy()])
            for a, b in zip(head, [*head[1:], table.num_rows]):
                if table.column("block")[a].as_py() != block:
                    if bests:
                        yield out(bests)
                    block, bests = table.column("block")[a].as_py(), {}
                if b == a + 1:
                    continue  # a directory without lists
                ids, size = (np.array(table.column(c)[a].as_py(), np.int64) for c in ("ids", "n"))
                visit(table.slice(a + 1, b - a - 1), ids, size, bests)
        if bests:
            yield out(bests)

    return run


# ------------------------------------------------------------------ queries


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(PATTERN), F.lit(0))))
    return queries.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), terms.alias("term")).distinct()


def few_terms(terms: DataFrame) -> pa.Array | None:
    """The distinct query terms, unless they are too many to be sent to every task."""
    distinct = terms.select("term").distinct()
    size = distinct.agg(F.sum(F.octet_length("term")).alias("bytes")).first()["bytes"] or 0
    return distinct.toArrow().column("term").combine_chunks().cast(pa.large_string()) if size <= TERM_BYTES else None


def search(index: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every query, see ``rank``. The index has all terms."""
    terms = cut(query_terms(queries))
    lists = index.where("term is not null").select("shard", "term", "doc", "n").join(terms.select("term").distinct(), "term", "left_semi")
    return _ranked(index, cut(lists), terms, k)


def _ranked(index: DataFrame, lists: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """From the directories of an index, and ``lists`` of the terms of the queries."""
    directory = index.where("term is null")
    counts = directory.select(F.size(F.filter("n", lambda x: x > 0)).alias("docs"), F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("terms"))
    total = counts.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()  # two numbers
    documents, length = total["docs"] or 0, total["terms"] or 0
    df = lists.groupBy("term").agg(F.sum(F.size("doc")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("bigint").alias("weight")
    parts = -(-terms.select("item_id").distinct().count() // QUERIES) or 1
    users = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("bigint")).groupBy("term", "block").agg(F.collect_list("item_id").alias("items"))
    users = cut(users.join(df, "term").select("term", "block", "items", weight))
    none = F.lit(None)
    wanted = lists.join(users, "term").select("shard", "block", "term", none.cast("array<bigint>").alias("ids"), "doc", "n", "items", "weight")
    every = directory.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("block"), "term", "ids", "doc", "n", none.cast("array<bigint>").alias("items"), none.cast("bigint").alias("weight"))
    placed = wanted.unionByName(every).repartition("shard", "block").sortWithinPartitions("block", "shard", F.col("term").asc_nulls_first())
    found = placed.mapInArrow(_search(k, documents, length), "item_id bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for every query the ``k`` documents with the highest scores above 0.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, with A to Z lower-cased. Scores are sums over the
    query's distinct terms of weight * ((10^9 tf) div (1000 tf + 20 m)), see ``sql``. Equal scores rank by ascending doc_id.
    Null and empty texts have no term. Rows of ``docs`` with a null doc_id take no part; rows that share a doc_id are documents of their own. Queries that share an item_id are one query
    with the terms of all; a null item_id is no query. A query without a match, or an empty table on either
    side, gives no rows. Other columns are ignored, whatever their names.
    """
    terms = cut(query_terms(queries))
    wanted = few_terms(terms)
    if wanted is None:
        return search(build_index(docs), queries, k)
    index = build_index(docs, wanted)
    return _ranked(index, index.where("term is not null"), terms, k)


def sql(k: int = TOP) -> str:
    terms = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')"
    return f"""
    WITH t AS (SELECT doc_id, unnest({terms}) AS term FROM documents),
    n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, docs),
    q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
    s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id),
    r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= {k}"""
