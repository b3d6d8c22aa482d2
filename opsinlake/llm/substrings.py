"""Exact substring deduplication by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the smallest hash of the ``m``-word grams in it; consecutive
windows with the same minimiser form a super-k-mer, which travels as one string of words to the bucket its minimiser
names. Equal windows have equal minimisers, so they meet in one bucket, where windows are sorted and counted exactly.

Before anything travels a task drops what it can decide alone: of equal super-k-mers in one block of text only those of
the smallest doc_id are sent, the others are removed at once. A passage that a third of all documents share costs a
bucket one string per block, so no bucket follows the number of copies. The strings of one block and bucket are packed
and compressed together.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsinlake.llm.words import Words, blocks, grams, mix, split_words, utf8, word_hashes

WINDOW = 13
GRAM = 3
BLOCK = 4 << 20
BUCKET_BYTES = 2 << 20  # text of the input for each bucket
PARTITION_BUCKETS = 4

_RANGES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
_PACKED = pa.schema([("bucket", pa.int64()), ("packed", pa.binary())])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def super_kmers(w: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, minimiser) of every super-k-mer, in order of the text."""
    n = len(w.start) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding_min(grams(word_hashes(w), m), k - m + 1)[:n]
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 : k - 1 + n])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (w.row[at[1:]] != w.row[at[:-1]])])
    head = np.flatnonzero(new)
    return at[head], np.diff(np.concatenate([head, [len(at)]])), least[at[head]]


def joined(w: Words) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each word starts in that."""
    size = w.end - w.start + 1
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(starts[-1]), 32, np.uint8)
    inside = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    keep = np.ones(len(out), bool)
    keep[starts[1:] - 1] = False
    out[keep] = w.data[np.cumsum(inside[:-1]).astype(bool)]
    return out.tobytes(), starts


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=6)


def _pack(docs, keys, starts, counts, strings) -> bytes:
    head = struct.pack("<qq", len(docs), sum(map(len, strings)))
    body = b"".join([head, np.array(docs, np.int64).tobytes(), np.array(keys, np.int64).tobytes(), np.array(starts, np.int32).tobytes(), np.array(counts, np.int32).tobytes(), *strings])
    return struct.pack("<q", len(body)) + _codec().compress(body, asbytes=True)


def _unpack(blob: bytes):
    (size,) = struct.unpack_from("<q", blob)
    body = _codec().decompress(blob[8:], size, asbytes=True)
    n, text = struct.unpack_from("<qq", body)
    at, out = 16, []
    for kind, width in ((np.int64, 8), (np.int64, 8), (np.int32, 4), (np.int32, 4)):
        out.append(np.frombuffer(body, kind, n, at))
        at += n * width
    return *out, body[at : at + text]


def _split(k: int, m: int, buckets: int):
    """Blocks of documents to packed super-k-mers. A blob with text goes to its bucket; one without holds word ranges
    that the task has already found to be later copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=BLOCK):
                docs = part.column("doc_id").to_numpy(zero_copy_only=False)
                keys = part.column("text_key").to_numpy(zero_copy_only=False)
                w = split_words(utf8(part.column("text")))
                first, count, least = super_kmers(w, k, m)
                if not len(first):
                    continue
                text, at = joined(w)
                row = w.row[first]
                doc, start = docs[row], first - w.first[row]
                ranked = np.argsort(doc, kind="stable")
                begin, end = at[first].tolist(), at[first + count + k - 1].tolist()
                doc_list = doc.tolist()
                smallest: dict[bytes, int] = {}
                sent, dropped = [], []
                for i in ranked.tolist():
                    string = text[begin[i] : end[i]]
                    if smallest.setdefault(string, doc_list[i]) == doc_list[i]:
                        sent.append((i, string))
                    else:
                        dropped.append(i)
                where = (mix(least) % np.uint64(buckets)).astype(np.int64)
                index = np.array([i for i, _ in sent])
                order = np.argsort(where[index], kind="stable")
                edges = np.flatnonzero(np.diff(where[index][order])) + 1
                names, blobs = [], []
                for group in np.split(order, edges):
                    at_group = index[group]
                    names.append(int(where[at_group[0]]))
                    blobs.append(_pack(doc[at_group], keys[row[at_group]], start[at_group], count[at_group], [sent[g][1] for g in group.tolist()]))
                if dropped:
                    index = np.array(dropped)
                    names.append(int(mix(np.array([doc[index[0]]], np.int64).view(np.uint64))[0] % np.uint64(buckets)))
                    blobs.append(_pack(doc[index], keys[row[index]], start[index], count[index] + k - 1, []))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], schema=_PACKED)

    return run


def count_windows(docs, keys, starts, counts, text: bytes, k: int) -> list[np.ndarray]:
    """Windows of one bucket that also start in a document with a smaller doc_id: arrays (doc_id, key, word)."""
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 32) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text)])
    ids = words.dictionary_encode().indices.to_numpy().astype(np.uint64)
    size = counts.astype(np.int64) + k - 1
    base = np.repeat(np.cumsum(size) - size, counts)
    step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts, dtype=np.int64) - counts, counts)
    at, entry = base + step, np.repeat(np.arange(len(docs)), counts)
    value = grams(mix(ids + np.uint64(1)), k)[at]
    order = np.argsort(value, kind="stable")
    value, at, entry = value[order], at[order], entry[order]
    twin = np.flatnonzero(value[1:] == value[:-1])
    near = np.zeros(len(value), bool)  # windows whose hash is not alone
    near[twin], near[twin + 1] = True, True
    at, entry, step, value = at[near], entry[near], step[order][near], value[near]
    if not len(at):
        return [np.zeros(0, np.int64)] * 3
    same = value[1:] == value[:-1]
    for j in range(k):  # neighbours with one hash must be the same words
        same &= ids[at[1:] + j] == ids[at[:-1] + j]
    if (same != (value[1:] == value[:-1])).any():  # two different windows with one hash: sort by the words themselves
        columns = np.stack([ids[at + j] for j in range(k)])
        order = np.lexsort(columns)
        at, entry, step, columns = at[order], entry[order], step[order], columns[:, order]
        same = (columns[:, 1:] == columns[:, :-1]).all(axis=0)
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    doc = docs[entry]
    smallest = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.concatenate([head, [len(doc)]])))
    later = doc > smallest
    return [doc[later], keys[entry[later]], starts[entry[later]].astype(np.int64) + step[later]]


def _ranges(doc, key, start, stop) -> pa.RecordBatch:
    """Word ranges, with touching ones of a document merged."""
    order = np.lexsort([start, key, doc])
    doc, key, start, stop = doc[order], key[order], start[order], stop[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > stop[:-1])]) if len(doc) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    end = np.maximum.reduceat(stop, head) if len(head) else stop
    return pa.RecordBatch.from_arrays([pa.array(doc[head], pa.int64()), pa.array(key[head], pa.int64()), pa.array(start[head].astype(np.int32)), pa.array(end.astype(np.int32))], schema=_RANGES)


def _count(k: int):
    def one(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(b) for b in blobs]
        for docs, keys, starts, counts, text in parts:
            if not text:
                start = starts.astype(np.int64)
                yield _ranges(docs, keys, start, start + counts)
        parts = [p for p in parts if p[4]]
        if parts:
            docs, keys, starts, counts = (np.concatenate([p[j] for p in parts]) for j in range(4))
            doc, key, word = count_windows(docs, keys, starts, counts, b"".join(p[4] for p in parts), k)
            yield _ranges(doc, key, word, word + k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            for name, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed")):
                if name != bucket and blobs:
                    yield from one(blobs)
                    blobs = []
                bucket = name
                blobs.append(blob.as_py())
        if blobs:
            yield from one(blobs)

    return run


def repeated_ranges(docs: DataFrame, k: int = WINDOW, m: int = GRAM, buckets: int | None = None) -> DataFrame:
    """(doc_id, text_key, start, stop): word ranges covered by windows that also start under a smaller doc_id. Ranges of
    one document may overlap. ``docs`` has doc_id, text_key, text. The number of buckets, and of the tasks that count them, follows the bytes
    of all texts."""
    kept = docs.where("doc_id is not null and text is not null")
    if buckets is None:
        size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * PARTITION_BUCKETS, -(-size // BUCKET_BYTES))
    packed = kept.mapInArrow(_split(k, m, buckets), "bucket bigint, packed binary")
    placed = packed.repartition(-(-buckets // PARTITION_BUCKETS), "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(_count(k), "doc_id bigint, text_key bigint, start int, stop int")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            w = split_words(utf8(part.column("text")))
            text, at = joined(w)
            n = np.diff(w.first)
            gone = np.zeros(len(w.start) + 1, np.int64)
            lists = part.column("ranges")
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            inner = lists.flatten()
            if len(inner):
                np.add.at(gone, w.first[owner] + inner.field("start").to_numpy(), 1)
                np.add.at(gone, w.first[owner] + inner.field("stop").to_numpy(), -1)
            stays = np.cumsum(gone[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(stays)])
            left = kept[w.first[1:]] - kept[w.first[:-1]]
            texts = []
            for r in range(part.num_rows):
                a, b = int(w.first[r]), int(w.first[r + 1])
                if left[r] == b - a:
                    texts.append(text[at[a] : at[b]][:-1])
                elif not left[r]:
                    texts.append(b"")
                else:
                    index = np.flatnonzero(np.diff(np.concatenate([[False], stays[a:b], [False]]).astype(np.int8)))
                    texts.append(b"".join(text[at[a + i] : at[a + j]] for i, j in zip(index[::2], index[1::2]))[:-1])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(n - left, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )


def dedup_substrings(docs: DataFrame, k: int = WINDOW, m: int = GRAM, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256): every text without the words covered by a window of ``k`` words that
    also starts in a document with a smaller doc_id. Windows are judged on the input.

    Words are runs of anything but the six ASCII blanks; ``kept`` joins them by one space. Null and empty texts have no
    words. A row with a null doc_id takes no part and keeps its words. Rows that share a doc_id never remove each other
    and each loses the words it shares with smaller doc_ids. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))
    ranges = repeated_ranges(docs, k, m, buckets).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return docs.join(ranges, ["doc_id", "text_key"], "left").select("doc_id", "text", "ranges").mapInArrow(
        _strip, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")


def sql(k: int = WINDOW) -> str:
    return f"""
    WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'), []) AS ws FROM documents),
    g AS (SELECT doc_id, p, array_to_string(ws[p:p + {k - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS p FROM d)),
    later AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE doc_id > first),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {k})) AS i FROM later),
    w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)"""
