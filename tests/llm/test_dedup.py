"""Near-duplicate, substring and line deduplication against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from opsinlake.llm import lines, minhash, substrings
from opsinlake.llm import words as W
from opsinlake.llm.graph import components

WORD = re.compile(r"[^ \t-\r]+")


def corpus(seed=1, n=60):
    """Texts with exact copies, near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 5)))
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        body = [word() for _ in range(rng.randrange(0, 120))]
        if rows and i % 3 == 0:
            body = WORD.findall(rng.choice(rows)[1])
            for _ in range(rng.randrange(0, 4)):
                if body:
                    body[rng.randrange(len(body))] = word()
        if i % 4 == 0:
            a = rng.randrange(30)
            body[len(body) // 2 : len(body) // 2] = passage[a : a + rng.randrange(5, 40)]
        rows.append((i * 7 % 61, "".join(w + rng.choice((" ", " ", " ", "\n", "  ", "\t")) for w in body)))
    return rows


def test_words_match_a_regex():
    texts = ["", "a  b\tc", None, "é x\x1cy\x85 z", "\n\n", "end", " lead"]
    w = W.split_words(W.utf8(pa.array(texts, pa.string())))
    data = w.data.tobytes()
    got = [[data[a:b].decode() for a, b in zip(w.start[f:t], w.end[f:t])] for f, t in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    assert len(set(W.word_hashes(w).tolist())) == len({x for g in got for x in g})


def test_hash_does_not_depend_on_place(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(5000))
    whole = W.word_hashes(W.split_words(pa.array([text], pa.large_string())))
    monkeypatch.setattr(W, "_PIECE", 1000)
    assert (W.word_hashes(W.split_words(pa.array([text], pa.large_string()))) == whole).all()
    assert len(set(whole.tolist())) == 50


def test_blocks_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 10, None, "y" * 50, "", "z", "q" * 9])], ["i", "text"])
    parts = list(W.blocks(batch, limit=12))
    assert [r for p in parts for r in p.column("i").to_pylist()] == list(range(6)) and len(parts) > 2


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 1000).astype(np.uint64)
    row = np.repeat([0, 1], 900)
    value = np.concatenate([pool[:900], pool[100:]])
    s = minhash.signatures(row, value, np.ones(1800), 2, 1600)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.04
    one = minhash.signatures(np.zeros(1, np.int64), pool[:1], np.ones(1), 1, 160)
    assert (one == pool[0]).all()  # a single shingle fills every register


def jac(a, b, k=5, weigh=None):
    """Probability Jaccard by its definition; of the sets if every shingle weighs 1."""
    x, y = (Counter(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) for w in (WORD.findall(a), WORD.findall(b)))
    weigh = weigh or (lambda n: 1.0)
    x, y = ({s: weigh(n) for s, n in c.items()} for c in (x, y))
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x | y) for i in x if i in y)


def alike(a, b):
    return max(jac(a, b), jac(a, b, weigh=lambda n: 1 + math.log2(n)))


def test_near_duplicates_against_all_pairs(spark, make):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make(rows)).collect()}
    parent = {d: d for d, _ in rows}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, (a, ta) in enumerate(rows):
        for b, tb in rows[:i]:
            if WORD.search(ta) and WORD.search(tb) and (ta == tb or alike(ta, tb) >= 0.8):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert got == {d: find(d) for d, _ in rows}


def test_second_round_links_what_the_hub_misses(spark):
    """A chain whose ends are not similar: a - b - c in one bucket, hub a."""
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join(base[s:] + [f"x{i}" for i in range(s)]) for s in (0, 12, 24, 36, 48)]
    rows = [(i, t) for i, t in enumerate(chain)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert jac(chain[0], chain[4]) < 0.8 <= min(jac(a, b) for a, b in zip(chain, chain[1:]))
    assert {r.class_id for r in got} == {0}


def pair_classes(spark, a, b):
    got = minhash.near_duplicates(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string")).collect()
    return {r.class_id for r in got}


@pytest.mark.parametrize("shared,passage,times", [(300, 40, 60), (100, 20, 30), (300, 20, 200)])
def test_a_passage_repeated_in_one_copy_loses_no_link(spark, shared, passage, times):
    """Alike as sets of shingles, apart in the weighted view."""
    body = [f"w{i}" for i in range(shared + 4)]
    a, b = " ".join(body), " ".join(body + [f"p{i}" for i in range(passage)] * times)
    assert jac(a, b) >= 0.8 > jac(a, b, weigh=lambda n: 1 + math.log2(n))
    assert pair_classes(spark, a, b) == {0}


def test_weights_link_what_sets_do_not(spark):
    """What both texts repeat weighs more than what each says once; without the repeats they are apart."""
    passage = [f"p{i}" for i in range(40)] * 60
    a, b = (" ".join(passage + [f"{c}{i}" for i in range(12)]) for c in "xy")
    assert jac(a, b) < 0.8 <= jac(a, b, weigh=lambda n: 1 + math.log2(n))
    assert pair_classes(spark, a, b) == {0}
    a, b = (" ".join(passage[:40] + [f"{c}{i}" for i in range(12)]) for c in "xy")
    assert alike(a, b) < 0.8 and pair_classes(spark, a, b) == {0, 1}


def test_similarity_against_the_definition():
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))
    a, b = [text() for _ in range(80)], [text() for _ in range(80)]
    got = minhash.similarity(pa.array(a, pa.large_string()), pa.array(b, pa.large_string()), 3)
    want = [max(jac(x, y, 3), jac(x, y, 3, lambda n: 1 + math.log2(n))) if x and y else 0 for x, y in zip(a, b)]
    assert np.allclose(got, want)


def test_every_text_of_a_doc_id_is_compared(spark):
    """doc 1 has two texts, each with a near copy elsewhere."""
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    rows = [(1, a), (1, b), (3, a + " more"), (4, b + " more"), (5, b + " other end of it " + " ".join(f"z{i}" for i in range(90)))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (1, 1), (3, 1), (4, 1), (5, 5)]


def test_recall_on_documents(spark):
    """All pairs of the tables' documents whose hash falls into a sample."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("pmod(xxhash64(source, lang), 3) = 0")
    texts = [(r.doc_id, set(zip(*(w[i:] for i in range(5))))) for r in docs.collect() if len(w := WORD.findall(r.text or "")) >= 5]
    of = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    pairs = [(a, b) for i, (a, x) in enumerate(texts) for b, y in texts[:i] if len(x & y) >= 0.8 * len(x | y)]
    assert len(pairs) > 8 and all(of[a] == of[b] for a, b in pairs)


def test_near_duplicates_messy(messy):
    got = sorted(map(tuple, minhash.near_duplicates(messy).collect()), key=repr)
    assert len(got) == 14
    by = {}
    for d, c, _ in got:
        by.setdefault(d, set()).add(c)
    assert by[1] == by[2] == {1} and by[3] == {3} and by[4] == {4} and by[5] == {5} and by[6] == by[7] == {6} and by[None] == {None, 1}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(10, 40)]
    star = [(100, i) for i in range(101, 130)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 130)}}


def remove_windows(rows, k):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - k + 1):
            first[tuple(w[i : i + k])] = min(d, first.get(tuple(w[i : i + k]), d))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("k,m,buckets", [(13, 3, None), (4, 2, 3), (5, 5, 7)])
def test_substrings_against_brute_force(spark, make, k, m, buckets):
    rows = corpus(seed=k)
    got = sorted(map(tuple, substrings.dedup_substrings(make(rows), k, m, buckets).collect()))
    assert got == remove_windows(rows, k)


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "grams", lambda h, k: np.zeros(len(h) - k + 1, np.uint64))
    text = b"a b c d e a b c d x "
    docs, starts, counts = np.array([1, 2]), np.array([0, 0], np.int32), np.array([2, 2], np.int32)
    doc, _, word = substrings.count_windows(docs, docs, starts, counts, text, 4)
    assert (doc.tolist(), word.tolist()) == ([2], [0])


def test_substrings_messy(messy):
    got = substrings.dedup_substrings(messy).collect()
    assert len(got) == 14
    n = {(r.doc_id, r.n_words): r.n_removed for r in got}
    assert n[(2, 23)] == 23 and n[(1, 23)] == 0 and n[(7, 60_001)] == 60_000 and n[(None, 23)] == 0 and n[(8, 24)] == 23 and n[(8, 2)] == 0 and n[(3, 0)] == 0


def delete_runs(rows, least):
    """Reference: mark every run of lines with enough words that occurred before, longest first."""
    split = {d: [x for x in (t or "").split("\n") if WORD.search(x)] for d, t in rows}
    seen, gone = set(), {d: set() for d, _ in rows}
    for d, _ in sorted(rows):
        own = split[d]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                run = tuple(own[i:j])
                if sum(len(WORD.findall(x)) for x in run) >= least:
                    if run in seen:
                        gone[d] |= set(range(i, j))
                    seen.add(run)
    return sorted((d, len(split[d]), len(gone[d]), "\n".join(x for i, x in enumerate(split[d]) if i not in gone[d]) if gone[d] else t) for d, t in rows)


def line_corpus():
    rng = random.Random(4)
    pool = [" ".join(rng.choice("ab cd e".split()) for _ in range(rng.randrange(1, 6))) for _ in range(9)]
    return [(d, "\n".join(rng.choice(pool + ["", " "]) for _ in range(rng.randrange(0, 12)))) for d in range(25)]


@pytest.mark.parametrize("least", [1, 4, 8, 13])
def test_lines_against_brute_force(make, least):
    rows = line_corpus()
    assert sorted(map(tuple, lines.dedup_lines(make(rows), least).collect())) == delete_runs(rows, least)


def test_lines_messy(messy):
    got = lines.dedup_lines(messy).collect()
    assert len(got) == 14
    by = {(r.doc_id, r.n_lines, r.n_removed) for r in got}
    assert {(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 0), (5, 0, 0), (None, 1, 0), (6, 1, 0), (7, 1, 0), (9, 2, 0)} <= by
    kept = lines.edited(messy)
    assert kept.columns == messy.columns and kept.count() == 12


def test_empty_tables(make):
    none = make([])
    assert minhash.near_duplicates(none).count() == 0
    assert substrings.dedup_substrings(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
