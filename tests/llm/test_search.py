"""Ranked search, product codes and SimHash against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsinlake.llm import codes, search, simhash
from opsinlake.llm.keyed import lookup, whole_groups

WORD = re.compile(r"[^ \t-\r]+")
TERM = re.compile(search.PATTERN)
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ helpers


def test_whole_groups_cut_at_borders_only():
    keys = [0, 0, 1, 1, 1, 2, 3, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64())], ["k"]) for a, b in ((0, 1), (1, 4), (4, 4), (4, 5), (5, 8), (8, 11))]
    got = [t.column("k").to_pylist() for t in whole_groups(iter(batches), ["k"])]
    assert [k for g in got for k in g] == keys
    assert all(a[-1] != b[0] for a, b in zip(got, got[1:])) and len(got) > 2


def test_lookup_is_a_join(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([7] * 3000 + list(range(2000)))], "k long, i long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")).where("k % 3 = 1")
    got = lookup(rows, table, ["k"]).select("k", "i", "top").collect()
    assert sorted(got) == sorted(rows.join(table, "k").select("k", "i", "top").collect()) and len(got) > 3000


# ------------------------------------------------------------------ ranked search


def ranked(docs, queries, k):
    bags = [(d, TERM.findall((t or "").translate(A_Z))) for d, t in docs if d is not None]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    wanted = {}
    for item, text in queries:
        if item is not None:
            wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(A_Z)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for d, bag in bags:
            s = 0
            for t in terms & set(bag):
                df = sum(t in b for _, b in bags)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                s += w * (10**9 * bag.count(t) // (1000 * bag.count(t) + 20 * (50 + 50 * len(bag) * n_docs // total)))
            if s > 0:
                scores.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def texts(seed=0, n=90):
    rng = random.Random(seed)
    pool = [f"{c}{i}" for c in ("Ab", "é", "x") for i in range(25)]
    rows = []
    for i in range(n):
        words = [pool[min(int(rng.expovariate(0.15)), 74)] for _ in range(rng.randrange(0, 60))]
        rows.append((i * 7 % 97, "".join(w + rng.choice((" ", "-", "_", "\n")) for w in words)))
    return rows + [(200, rows[3][1]), (201, rows[3][1].upper())]


def test_search_against_a_loop(spark, monkeypatch):
    docs, queries = texts(), texts(1, 12)
    for short, step, shard in ((16, 1024, 1 << 24), (3, 4, 600), (1000, 1, 50)):
        monkeypatch.setattr(search, "SHORT", short)
        monkeypatch.setattr(search, "STEP", step)
        monkeypatch.setattr(search, "SHARD_BYTES", shard)
        got = search.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), 7)
        assert sorted(map(tuple, got.collect())) == ranked(docs, queries, 7)


def test_evaluation_skips_and_stays_exact():
    """Random lists with ties, in one pass and in many small steps, against sums."""
    rng = np.random.default_rng(3)
    for trial in range(40):
        size, k = int(rng.integers(1, 3000)), int(rng.integers(1, 40))
        lists, total = [], np.zeros(size, np.int64)
        for _ in range(int(rng.integers(1, 12))):
            doc = np.flatnonzero(rng.random(size) < rng.choice([0.002, 0.03, 0.3, 0.9]))
            if len(doc):
                score = rng.integers(1, 6, len(doc)) * int(rng.choice([1, 10, 100]))
                lists.append((doc, score))
                total[doc] += score
        best = search.Best(k)
        if lists:
            search.evaluate(lists, np.arange(size) * 3, best)
        want = sorted((-int(s), 3 * i) for i, s in enumerate(total) if s > 0)[:k]
        assert list(zip((-best.score).tolist(), best.doc.tolist())) == want


def test_search_blocks_of_queries(spark, monkeypatch):
    docs, queries = texts(2, 40), texts(3, 15)
    monkeypatch.setattr(search, "QUERIES", 4)
    got = search.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), 5)
    assert sorted(map(tuple, got.collect())) == ranked(docs, queries, 5)


@pytest.mark.parametrize("limit", [1 << 22, 3])
def test_only_lists_of_query_terms_are_written(spark, monkeypatch, limit):
    """With few query terms the index has no other; with too many of them it has all, and the answers are the same."""
    docs, queries = texts(4, 60), [(1, "Ab3 Ab7 nowhere"), (2, "é1, AB3"), (2, "ab1")]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    written = []
    whole = search.build_index
    monkeypatch.setattr(search, "TERM_BYTES", limit)
    monkeypatch.setattr(search, "build_index", lambda *a: written.append(whole(*a)) or written[-1])
    got = search.rank(*tables, 7).collect()
    assert sorted(map(tuple, got)) == ranked(docs, queries, 7)
    terms = {r.term for r in written[0].where("term is not null").collect()}
    every = {t for _, text in docs for t in TERM.findall(text.translate(A_Z))}
    assert terms == (every & {"ab3", "ab7", "é1", "ab1"} if limit > 3 else every) and len(terms) > 2
    lengths = [n for r in written[0].where("term is null").collect() for n in r.n]
    assert sum(lengths) == sum(len(TERM.findall(t)) for _, t in docs)
    assert sorted(map(tuple, search.search(whole(tables[0]), tables[1], 7).collect())) == ranked(docs, queries, 7)


def test_postings_of_wanted_terms():
    found = search.postings(pa.array(["", " b A-a", "c", "é_É é\0b "], pa.large_string())[1:], pa.array(["b", "zz", "a", "é"], pa.large_string()))
    assert [x.to_pylist() if isinstance(x, pa.Array) else x.tolist() for x in found] == [["b", "a", "é"], [[0, 2], [0], [2]], [[1, 1], [2], [2]], [3, 1, 4]]


@pytest.mark.parametrize("share", [0.01, 0.1, 0.6])
def test_postings_by_place(share):
    """A list of many documents is kept by place; steps and look-ups give the same scores either way."""
    rng = np.random.default_rng(6)
    doc = np.flatnonzero(rng.random(2500) < share)
    x = search.Postings(doc, rng.integers(1, 9, len(doc)), 2500)
    want = np.zeros(2500, np.int64)
    want[x.doc] = x.score
    assert (x.every is not None) == (share == 0.6) and x.short == (share == 0.01) and x.bound == want.max()
    for step, begin in enumerate(range(0, 2500, search.STEP)):
        sums, few, at = np.zeros(min(search.STEP, 2500 - begin), np.int64), np.zeros(search.STEP, np.int64), np.array([0, 3, 400, 451])
        x.add(sums, step)
        x.look_up(few, step, at)
        assert sums.tolist() == want[begin : begin + search.STEP].tolist() and few[at].tolist() == sums[at].tolist()


def test_search_messy(spark, make, messy):
    from conftest import SAME, messy_rows

    items = [(1, SAME), (1, "ÉTÉ ok"), (2, None), (3, ""), (None, SAME), (4, "nowhere"), (5, "w3x3 12345")]
    queries = spark.createDataFrame([(*i, "extra", "extra") for i in items], "item_id long, text string, doc_id string, block string")
    got = sorted(map(tuple, search.rank(messy, queries).collect()))
    assert got == ranked([r[:2] for r in messy_rows()], items, 50)
    assert search.rank(make([]), queries).count() == 0 == search.rank(messy, queries.limit(0)).count()


# ------------------------------------------------------------------ product codes


def product_codes(rows, parts, entries, rounds):
    kept = sorted(((i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in kept if len(v) == len(kept[0][1])]
    cut = lambda v, p: v[p * len(v) // parts : (p + 1) * len(v) // parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda p, v: min((far(cut(v, p), e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        of = [[near(p, v)[1] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), e in zip(kept, of[p]) if e == j]
                if mine:
                    books[p][j] = [math.floor(sum(c) / len(mine)) for c in zip(*mine)]
    coded = [(i, "".join(f"{near(p, v)[1]:02x}" for p in range(parts)), sum(near(p, v)[0] for p in range(parts)), label) for i, v, label in kept]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, label, c, e, sum(x[2] for x in coded if x[3] == label), digest) for i, c, e, label in coded]


VECTORS = "vec_id long, embedding array<float>, label int, part string, n string"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "extra", "extra") for r in rows], VECTORS)


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("width,parts,entries,rounds", [(8, 4, 5, 3), (32, 16, 64, 2), (7, 3, 4, 2), (4, 4, 300, 1), (8, 2, 3, 0)])
def test_codes_against_a_loop(spark, width, parts, entries, rounds):
    rng = random.Random(width)
    rows = [(i * 11 % 401, [float(np.float32(rng.choice([rng.gauss(0, 1), rng.gauss(3, 0.2), 0.5]))) for _ in range(width)], rng.choice([0, 1, None])) for i in range(200)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(50)]  # one very common vector
    got = codes.compress(table_of(spark, rows), parts=parts, entries=entries, rounds=rounds)
    want = product_codes(rows, parts, entries, rounds)
    if entries > 256:
        want = [(i, la, c, e, s, h) for i, la, c, e, s, h in want]
        assert [(r.vec_id, r.error) for r in sorted(got.collect())] == [(r[0], r[3]) for r in sorted(want, key=lambda r: r[0])]
    else:
        assert order(got.collect()) == order(want)


def test_codes_messy(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, -2.0], 0), (2, None, 0), (3, [nan, 1.0], 0), (4, [1.0, -inf], 0), (5, [1.0, None], 0), (6, [], 0), (7, [1.0, 2.0, 3.0], 0),
            (1, [1.0, -2.0], 0), (8, [0.001, -0.001], None), (None, [4.0, 4.0], None), (9, [1e30, -1e30], 3)]
    got = codes.compress(table_of(spark, rows), parts=2, entries=2).collect()
    assert sorted((r.vec_id or -1) for r in got) == [-1, 1, 1, 8, 9]
    assert len({r.codebooks_sha256 for r in got}) == 1 and {r.label_error for r in got if r.label == 3} == {r.error for r in got if r.label == 3}
    assert codes.compress(table_of(spark, [])).count() == 0
    rows = [r for r in rows if r[0] != 9]
    assert order(codes.compress(table_of(spark, rows), parts=2, entries=2).collect()) == order(product_codes(rows, 2, 2, 2))


def test_only_movers_change_their_owner():
    books = [np.array([[0], [10]])]
    first = next(codes._deal(books, 4)(iter([pa.RecordBatch.from_arrays([pa.array([[0.0], [3 / 256], [9 / 256], [9 / 256]])], ["vector"])])))
    assert first.column("n").to_pylist() == [1, 1, 2] and first.column("entry").to_pylist() == [0, 0, 1]
    judged = next(codes._assign([np.array([[9], [2]])], 4)(iter([first])))
    assert judged.column("entry").to_pylist() == [1, 1, 0] and judged.column("moved").to_pylist() == [True, True, True]
    judged = next(codes._assign([np.array([[1], [9]])], 4)(iter([first])))
    assert judged.column("moved").to_pylist() == [False, False, False] and judged.column("salt") == first.column("salt")


# ------------------------------------------------------------------ SimHash


def fingerprint(text):
    words = WORD.findall((text or "").translate(A_Z))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(rows):
    """Smallest doc_id reachable, by all pairs; rows of one doc_id are one document."""
    prints = [(d, fingerprint(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in prints}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 3:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted([(d, x, find(d)) for d, x in prints] + [(None, fingerprint(t), None) for d, t in rows if d is None], key=repr)


def shown(df):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in df.collect()), key=repr)


def test_fingerprints_against_the_engine(spark):
    """The engine's own hash of every shingle has the same seed."""
    rows = [(i, t) for i, (_, t) in enumerate(texts(5, 30))]
    hashes = spark.createDataFrame([(s,) for _, t in rows for s in {" ".join(WORD.findall(t.translate(A_Z))[i : i + 3]) for i in range(60)}], "s string").select("s", F.xxhash64("s").alias("h")).collect()
    assert all(xxhash.xxh64_intdigest(r.s.encode(), 42) == r.h % 2**64 for r in hashes)
    got = simhash.fingerprints(pa.array([t for _, t in rows], pa.large_string()))
    assert got.tolist() == [fingerprint(t) for _, t in rows]


def test_fingerprints_in_pieces(monkeypatch):
    long = [" ".join(f"w{i * i % 71}" for i in range(4000)), "", "one two", "one two three four"]
    whole = simhash.fingerprints(pa.array(long, pa.large_string())).tolist()
    monkeypatch.setattr(simhash, "_PIECE", 100)
    assert simhash.fingerprints(pa.array(long, pa.large_string())).tolist() == whole == [fingerprint(t) for t in long]


@pytest.mark.parametrize("bounds", [{}, {"split": 4, "cell": 3}, {"split": 1, "cell": 2, "levels": 2}, {"levels": 1, "cell": 16}])
def test_links_of_crowded_blocks(spark, bounds):
    """Families of fingerprints a few bits apart, far more than a block holds at once."""
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for s in seeds for _ in range(60)}
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    links = simhash.close_links(spark.createDataFrame(rows, "node long, fp long"), **bounds).collect()
    of = {i: x % 2**64 for i, x in rows}
    assert all((of[r.a] ^ of[r.b]).bit_count() <= 3 for r in links)

    def classes(pairs):
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return [find(i) for i in range(len(rows))]

    assert classes(links) == classes([(a, b) for a in of for b in range(a) if (of[a] ^ of[b]).bit_count() <= 3])


def test_every_close_pair_shares_a_mask():
    tables = simhash.block_masks(3, 3)
    rng = random.Random(2)
    for _ in range(200):
        x = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4)))
        masks = [0]
        for table in tables:
            masks = [m for parent in masks for m in table[parent] if not m & x]
        assert masks


def test_forest_is_small():
    fp = np.array([0, 1, 2, 3, 255 << 40, 255 << 40 | 1], np.uint64)
    assert len(simhash._forest(fp, np.zeros(6, np.int32), False, 3)) == 4
    crossing = simhash._forest(fp, np.array([0, 1, 0, 1, 0, 0]), True, 3)
    assert len(crossing) == 3 and all((a in (1, 3)) != (b in (1, 3)) for a, b in crossing)


def test_simhash_messy(spark, make, messy):
    from conftest import messy_rows

    assert shown(simhash.near_duplicates(messy)) == linked([r[:2] for r in messy_rows()])
    assert simhash.near_duplicates(make([])).count() == 0
    rows = texts(6, 40) + [(300, texts(6, 40)[1][1]), (300, texts(6, 40)[2][1]), (300, None)]
    assert shown(simhash.near_duplicates(make(rows))) == linked(rows)
    assert T.LongType() == simhash.near_duplicates(messy).schema["component_id"].dataType
