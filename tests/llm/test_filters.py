"""Quality rules, decontamination, mixing, preference formatting and the pipeline."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from opsinlake.llm import decontaminate, lines, minhash, mixing, preferences, rules
from opsinlake.llm.queries import REGISTRY

WORD = re.compile(r"[^ \t-\r]+")
SF = "/root/testdata/sf0.001"


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toPandas() if hasattr(frame, "toPandas") else frame)
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


# ------------------------------------------------------------------ quality rules


def base(text):
    w = WORD.findall(text or "")
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    again = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(again)


def test_statistics_against_regexes(spark, messy):
    got = rules.judge(messy, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    want = collections.Counter((r.doc_id, *base(r.text)) for r in messy.collect())
    assert collections.Counter(tuple(r[c] for c in ("doc_id", *rules.COUNTS[:5])) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_random_texts(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(("a", "b ", "é", "|", " ", "\n", "a b c ", "#", "\x85", "\t")) for _ in range(rng.randrange(60)))) for i in range(200)]
    got = {r.doc_id: tuple(r[c] for c in rules.COUNTS[:5]) for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_rules_find_two_planted_conjunctions():
    rng = np.random.default_rng(1)
    x = {"a": rng.integers(0, 100, 3000), "b": rng.integers(0, 100, 3000), "c": rng.integers(0, 100, 3000)}
    bad = ((x["a"] >= 80) & (x["b"] <= 30)) | (x["c"] >= 95)
    found = rules.learn(x, bad)
    hit = np.zeros(3000, bool)
    for rule in found:
        hit |= rules._holds(x, rule)
    assert (hit == bad).mean() > 0.98 and all(len(r) <= 4 for r in found)
    assert rules.learn(x, np.zeros(3000, bool)) == [] and rules.learn({k: v[:0] for k, v in x.items()}, np.zeros(0, bool)) == []


def test_verdict_is_an_ordered_list(spark):
    rule = [(rules.Condition("a", ">=", 5), rules.Condition("b", "<=", 2)), (rules.Condition("a", "<=", 0),)]
    got = spark.createDataFrame([(5, 2), (5, 3), (0, 9), (4, 0)], "a int, b int").select(rules.verdict(rule).alias("kept")).collect()
    assert [r.kept for r in got] == [False, True, False, True]


def test_rules_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = rules.fit(docs.where("doc_id % 2 = 0"), labels)
    got = rules.statistics(docs.where("doc_id % 2 = 1")).withColumn("kept", ~rules.F.col("base_failed") & rules.verdict(learned)).select("row.doc_id", "base_failed", "kept")
    rows = got.join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.98


def test_a_repeated_doc_id_is_one_training_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rules, "learn", lambda x, bad: seen.append((x, bad.tolist())) or [])
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60 + i))
    rows = [(1, text(i % 40)) for i in range(300)] + [(1, "short"), (2, text(1)), (3, text(2)), (4, "short")]
    rules.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int"))
    (x, bad), = seen
    assert bad == [True, False, True] and {len(v) for v in x.values()} == {3}


# ------------------------------------------------------------------ decontamination


def test_masks_survive_any_two_changes():
    w, s = decontaminate.WINDOW, decontaminate.SUBSTITUTIONS
    for changed in itertools.combinations(range(w), s):
        assert any(all(p + i not in changed for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(w - len(m) + 1))


def test_changed_passages_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, [word() for _ in range(20)]) for i in range(12)]
    rows = []
    for i, t in items:
        part = list(t[3:16])
        changes = i % 4
        for j in rng.sample(range(13), changes):
            part[j] = "zz"
        rows.append((i, changes, [word() for _ in range(i)] + part + [word() for _ in range(5)]))
    docs = spark.createDataFrame([(i, " ".join(w).title() + ".") for i, _, w in rows], "doc_id long, text string")
    got = {r.doc_id: (r.leaked, r["items"]) for r in decontaminate.flag_leaks(docs, spark.createDataFrame([(i, "; ".join(t)) for i, t in items], "item_id long, text string")).collect()}
    assert got == {i: (c <= 2, str(i) if c <= 2 else "") for i, c, _ in rows}


def test_decontamination_messy(spark, messy):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "Seven wizards brew a green potion, under the old STONE bridge at dawn"), (None, "x"), (4, "too short"), (3, None)], "item_id long, text string")
    got = decontaminate.flag_leaks(messy, bench).collect()
    assert len(got) == 14
    assert {(r.doc_id, r.leaked) for r in got} == {(1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, False), (8, False), (8, True), (9, False), (10, False), (None, False)}
    assert decontaminate.flag_leaks(messy, bench.limit(0)).where("leaked").count() == 0
    assert decontaminate.flag_leaks(messy.limit(0), bench).count() == 0


def test_seeds_join_without_broadcast(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.flag_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "sized", lambda df, rows=0: decontaminate.cut(df))
    assert sorted(map(tuple, decontaminate.flag_leaks(docs, bench).collect())) == want


# ------------------------------------------------------------------ mixing


def test_counts_follow_the_distribution(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 10 = 0, 'a', if(id % 3 = 0, NULL, 'b')) AS source")
    rate = {r.source: r.rate for r in mixing.rates(docs, {"a": 3.0}).collect()}
    assert rate["a"] == pytest.approx(20_000 * 0.6 / 2000)
    got = mixing.replicate(docs, {"a": 3.0}).groupBy("source").count().collect()
    for r in got:
        assert r["count"] == pytest.approx({"a": 12_000, None: 4_000, "b": 4_000}[r.source], rel=0.06)
    drawn = mixing.replicate(docs, {"a": 3.0}).where("source = 'a'").groupBy("doc_id").count().groupBy("count").count().collect()
    for k, n in ((r[0], r[1]) for r in drawn):
        p = np.exp(-6) * 6.0**k / np.prod(np.arange(1, k + 1, dtype=float))
        assert abs(n - 2000 * p) < 5 * np.sqrt(2000 * p) + 3


def test_large_rates_are_split(spark):
    docs = spark.createDataFrame([(i, "big" if i else "rare") for i in range(3000)], "doc_id long, source string")
    n = mixing.replicate(docs, {"rare": 1.0, "big": 1.0}).where("source = 'rare'").count()
    assert abs(n - 1500) < 6 * np.sqrt(1500)


def test_mixing_messy(messy):
    out = mixing.replicate(messy)
    assert set(messy.columns) <= set(out.columns) and out.columns[-2:] == ["mix_copy", "mix_key"]
    rows = out.collect()
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.replicate(messy.repartition(5)).collect()), key=repr)
    assert mixing.replicate(messy.limit(0)).count() == 0
    assert {r.source for r in mixing.replicate(messy, {"src0": 0.0}).collect()} <= {None, "src1", "src2"}


# ------------------------------------------------------------------ preference formatting

TURN = "array<struct<turn:bigint,role:string,text:string>>"


def show(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t in turns)


def test_pairs_against_a_loop(spark):
    rng = random.Random(5)
    pairs = []
    for i in range(40):
        a = [(j, rng.choice(("user", "assistant")), rng.choice(("é", "", "two\nlines", "hi"))) for j in range(rng.randrange(6))]
        b = a[: rng.randrange(len(a) + 1)] + [(9, "assistant", rng.choice(("é", "no"))) for _ in range(rng.randrange(3))]
        pairs.append((i, a, b))
    got = preferences.format_pairs(spark.createDataFrame(pairs, f"i long, chosen_turns {TURN}, rejected_turns {TURN}")).collect()
    for (_, a, b), r in zip(pairs, sorted(got)):
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x[1:] != y[1:]), min(len(a), len(b)))
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        for side, ranges, turns in ((r.chosen, r.chosen_mask, a[n:]), (r.rejected, r.rejected_mask, b[n:])):
            cut = [side[int(x) : int(y)] for x, y in (p.split(":") for p in ranges.split(",") if p)]
            assert cut == [f"{t}<|im_end|>\n" for _, role, t in turns if role == "assistant"]


def test_preferences_messy(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, "assistant", None), (3, None, "assistant", ""),
            (4, 0, "user", "alone"), (None, 0, "user", "x"), (6, 0, "assistant", "no partner"), (0, 2, "user", "after")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.chosen_id: r for r in preferences.format_pairs(preferences.swapped_replies(turns)).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert (got[0].prompt, got[0].chosen, got[0].rejected) == (show([(0, "user", "q")]), show([(1, "assistant", "a")]), show([(1, "assistant", "b")]))
    assert got[0].chosen_mask == "22:34" and got[1].prompt == show([(0, "", "")])
    assert (got[2].n_common, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", "")
    assert preferences.swapped_replies(turns.limit(0)).count() == 0
    empty = spark.createDataFrame([(None, [])], f"chosen_turns {TURN}, rejected_turns {TURN}")
    assert preferences.format_pairs(empty).first().prompt == ""


def test_diverging_pairs_by_a_loop(spark):
    """Partners of unlike lengths, a missing partner, equal conversations and one of three thousand turns."""
    rng = random.Random(3)
    talks = {c: [(rng.choice(["user", "assistant", "system"]), rng.choice("abc") * rng.randrange(3)) for _ in range(rng.randrange(1, 9))] for c in range(30)}
    talks[9], talks[30], talks[41] = talks[8], [("assistant", f"t{i}") for i in range(3000)], [("user", "alone")]
    turns = spark.createDataFrame([(c, i, r, x) for c, talk in talks.items() for i, (r, x) in enumerate(talk)], "conv_id long, turn long, role string, text string")
    got = {r.chosen_id: r for r in preferences.format_pairs(preferences.diverging(turns)).collect()}
    assert set(got) == set(talks)
    shown = lambda side: show([(0, *x) for x in side])
    parted = set()
    for c, chosen in talks.items():
        k = int(hashlib.md5(f"{c}:turn".encode()).hexdigest()[:7], 16) % len(chosen)
        rejected = chosen[:k] + talks.get(c ^ 1, [])[k:]
        n = next((i for i, (x, y) in enumerate(zip(chosen, rejected)) if x != y), min(len(chosen), len(rejected)))
        r = got[c]
        assert (r.rejected_id, r.n_common) == (c ^ 1 if c ^ 1 in talks else None, n)
        assert r.prompt == shown(chosen[:n]) and r.chosen == shown(chosen[n:]) and r.rejected == shown(rejected[n:])
        for text, mask, side in ((r.chosen, r.chosen_mask, chosen[n:]), (r.rejected, r.rejected_mask, rejected[n:])):
            spans = [tuple(map(int, m.split(":"))) for m in mask.split(",") if m]
            assert [text[a:b] for a, b in spans] == [x + "<|im_end|>\n" for role, x in side if role == "assistant"]
        parted.add((n, len(chosen) - n))
    assert len(parted) > 8 and got[8].chosen == "" == got[9].rejected


# ------------------------------------------------------------------ queries and pipeline


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_query_against_sql(spark, name):
    from check import _canon, connect

    run, sql = REGISTRY[name]
    got, want = run(spark, SF).toPandas(), connect(SF).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and _canon(got) == _canon(want) and len(got)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from opsinlake.llm.scratch import cut

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF))
        kept[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept["quality rules"]
    judged = rules.judge(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(judged.where("kept"))
    before, after = kept["line dedup"]
    want = {r.doc_id: r.text for r in lines.dedup_lines(before).collect() if r.n_removed == 0 or r.text}
    assert {r.doc_id: r.text for r in after.collect()} == want and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["near dedup"]
    assert ids(after) == sorted({r.class_id for r in minhash.near_duplicates(before).collect()})
    before, after = kept["benchmark decontamination"]
    assert ids(after) == ids(decontaminate.flag_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not leaked"))
    assert set(ids(kept["mixing"][1])) <= set(ids(after))


def test_pipeline_stages_messy(spark, messy, tmp_path):
    import corpus_pipeline as cp

    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for docs in (messy, messy.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf)
            assert set(docs.columns) <= set(out.columns) and out.count() <= (docs.count() if name != "mixing" else 60)
