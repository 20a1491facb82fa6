"""Operators for training data: brute force, exact round trips, edge cases, SQL on the smallest tables."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from netloom.llm import bpe, packing, pairs, setjoin, severity, tokens, topn

TOKENIZER = tokens.VOCABULARY


# --- set similarity
def sets(seed, n=160):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        base = [f"g{int(rnd.paretovariate(0.6)) % 60}" for _ in range(rnd.randint(0, 14))]
        if k % 3 == 0 and out:
            base = list(out[rnd.randrange(len(out))] or [])
            for _ in range(rnd.randint(0, 2)):
                base = base[1:] if rnd.random() < 0.5 else [*base, f"g{rnd.randint(0, 60)}"]
        out.append([x.upper() if rnd.random() < 0.3 else f" {x}" if rnd.random() < 0.2 else x for x in base] if rnd.random() > 0.03 else None)
    return out


SET = "module_id long, module_genes array<string>, n_genes int"


@pytest.mark.parametrize("seed,split,lengths", [(1, 64, 4), (2, 2, 4), (3, 1, 2), (4, 1, 1)])
def test_set_join_against_brute_force(spark, seed, split, lengths, monkeypatch):
    """Whatever is split, extended or joined in blocks (of 3 holders here), the pairs are those of brute force."""
    monkeypatch.setattr(setjoin, "BLOCK", 3)
    monkeypatch.setattr(setjoin.candidates, "__defaults__", (setjoin.THRESHOLD, split, lengths))
    s = sets(seed)
    rows = [(i, x, 0) for i, x in enumerate(s, 1000)]
    ref = [(i, x, 0) for i, x in enumerate(sets(seed + 50, 20), 1)] + [(50, s[3], 0), (51, s[3], 0), (52, [None, "", " "], 0)]
    got = {(r.module_id_1, r.module_id_2): (r.overlap, r.jaccard) for r in setjoin.similar_records(spark.createDataFrame(rows, SET), spark.createDataFrame(ref, SET)).collect()}
    clean = {i: {g.strip(" \t").lower() for g in x or [] if g and g.strip(" \t")} for i, x, _ in rows + ref}
    want = {}
    for a, b in combinations(sorted(i for i, x in clean.items() if len(x) >= 3), 2):
        o, u = len(clean[a] & clean[b]), len(clean[a] | clean[b])
        if 5 * o >= 3 * u and not (a < 1000 and b < 1000):
            want[a, b] = (o, round(o / u, 6))
    assert got == want and want
    pairs, member = setjoin.class_pairs(spark.createDataFrame(rows, SET), spark.createDataFrame(ref, SET))
    of = {}
    for r in member.collect():
        of.setdefault(r.class_id, []).append(r.id)
    every = {(min(x, y), max(x, y)): (r.overlap, r.jaccard) for r in pairs.collect() for x in of[r.a] for y in of[r.b] if x != y and not (x < 1000 and y < 1000)}
    assert every == want


def test_equal_sets_in_blocks(spark, monkeypatch):
    """A third of all records is one set: every pair of its members comes out once."""
    monkeypatch.setattr(setjoin, "BLOCK", 7)
    rows = [(k, ["a", "b", "c"] if k % 3 else [f"x{k}", f"y{k}", "z"], 0) for k in range(90)]
    got = [(r.module_id_1, r.module_id_2) for r in setjoin.similar_records(spark.createDataFrame(rows, SET), spark.createDataFrame([], SET)).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2


def test_set_join_empty(spark):
    e = spark.createDataFrame([], SET)
    assert setjoin.similar_records(e, e).count() == 0


# --- top n
HUB = "row_id long, species string, module int, gene string, degree double, betweenness double, global_degree double, mean_edge_weight double, updated_at timestamp, rank int"


@pytest.mark.parametrize("least", [500, 3])
def test_top_n_against_brute_force(spark, least, monkeypatch):
    import datetime
    import math

    monkeypatch.setattr(topn, "MIN_ROWS", least)
    rnd = random.Random(least)
    num = lambda: rnd.choice([None, float("nan"), 0.0, 1.0, 1.0, 2.0, rnd.random()])
    rows = []
    for k in range(1500):
        m = rnd.choice([1, 1, 1, 2, 3, None, rnd.randint(4, 60)])
        rows.append((k, rnd.choice(["s", "t", None]), m, rnd.choice([None, " ", f"g{rnd.randint(1, 300)}", f" g{rnd.randint(1, 300)}\t"]), num(), num(), num(), num(), datetime.datetime(2024, 1, rnd.randint(1, 28)), 7))
    got = {(r.species, r.module, r.gene): r["rank"] for r in topn.leading_hubs(spark.createDataFrame(rows, HUB)).where("is_hub").collect()}
    last = {}
    for r in rows:
        g = (r[3] or "").strip(" \t")
        if r[2] is not None and g:
            key = (r[1], r[2], g)
            if key not in last or (r[8], r[0]) > (last[key][8], last[key][0]):
                last[key] = r
    groups = {}
    for (s, m, g), r in last.items():
        v = [-math.inf if x is None or x != x else x for x in (r[4], r[6], r[5], r[7])]
        groups.setdefault((s, m), []).append(([-x for x in v], g))
    want = {(s, m, g): k for (s, m), x in groups.items() if len(x) >= 3 for k, (v, g) in enumerate(sorted(x)[:5], 1) if v[0] != math.inf}
    assert got == want


@pytest.mark.parametrize("held", [1, 100_000])
def test_local_bounds_are_valid(spark, held):
    """Counts are whole and a bound is never better than the n-th row, in a null group and in many batches too."""
    rnd = random.Random(held)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), rnd.random(), f"g{k}") for k in range(3000)] + [("c", 1, 0.5, f"t{k}") for k in range(3)]
    df = spark.createDataFrame(rows, "s string, m int, v double, gene string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got = topn.local_bounds(df, ["s", "m"], ["v", "gene"], 5, held).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for s, m, v, g in rows:
        groups.setdefault((s, m), []).append((v, g))
    for key, x in groups.items():
        mine = [r for r in got if (r.s, r.m) == key]
        bounds = [tuple(r.bound) for r in mine if r.bound is not None]
        assert sum(r.c for r in mine) == len(x)
        assert all(b >= sorted(x)[4] for b in bounds) if len(x) >= 5 else not bounds
        assert held == 1 or len(x) < 20 or min(bounds) <= sorted(x)[14]


def test_top_n_empty(spark):
    assert topn.leading_hubs(spark.createDataFrame([], HUB)).count() == 0


# --- co-occurrence
MOD = "scan_id long, run_no int, module int, gene string, n int"


@pytest.mark.parametrize("block,lane,hot", [(512, 50_000, 20_000), (4, 40, 20)])
def test_cooccurrence_against_brute_force(spark, block, lane, hot, monkeypatch):
    monkeypatch.setattr(pairs, "HOT_ROWS", hot)
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "LANE_ITEMS", lane)
    rnd = random.Random(block)
    rows = []
    for s in (1, 2):
        for run in range(40):
            for m in range(6):
                core = [f"g{m}{k}" for k in range(4)] if rnd.random() < 0.8 else []
                for g in [*core, *(f"x{rnd.randint(0, 30)}" for _ in range(rnd.randint(0, 5))), None, " "]:
                    rows += [(s, run, m if rnd.random() > 0.02 else None, f" {g}" if g and rnd.random() < 0.2 else g, 1)] * rnd.choice([1, 1, 2])
    got = {(r.scan_id, r.gene_1, r.gene_2): (r.n_both, r.n_1, r.n_2, r.n_records) for r in pairs.cooccurrence(spark.createDataFrame(rows, MOD), "scan_id", ["run_no", "module"], "gene").collect()}
    rec = {}
    for s, run, m, g, _ in rows:
        if m is not None and g and g.strip(" \t"):
            rec.setdefault((s, run, m), set()).add(g.strip(" \t"))
    n, a, c = Counter(), Counter(), Counter()
    for (s, *_), gs in rec.items():
        n[s] += 1
        a.update((s, g) for g in gs)
        c.update((s, *p) for p in combinations(sorted(gs), 2))
    want = {k: (v, a[k[0], k[1]], a[k[0], k[2]], n[k[0]]) for k, v in c.items() if v >= 5 and v * n[k[0]] >= 5 * a[k[0], k[1]] * a[k[0], k[2]]}
    assert got == want and want


def test_cooccurrence_empty(spark):
    assert pairs.cooccurrence(spark.createDataFrame([], MOD), "scan_id", ["run_no", "module"], "gene").count() == 0


# --- encoding
def texts():
    rnd = random.Random(4)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "日本", "🌱", "=", "---", "0", "17", "'s", "<|endoftext|>", "​", "Ünï", "\t", "aa", "xyz"]
    return ["", " ", "x" * 30_000, "ab" * 9_000, *("".join(rnd.choices(parts, k=rnd.randint(1, 60))) for _ in range(800))]


def test_encoding_is_exact():
    tokenizers = pytest.importorskip("tokenizers")
    e = bpe.Encoder(TOKENIZER)
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    for x in texts():
        ids = e.encode(x)
        assert ids == t.encode(x, add_special_tokens=False).ids
        assert e.decode(ids).decode() == x
    assert e.encode(None) == e.encode("") == []


def test_encoding_of_a_table(spark):
    df = spark.createDataFrame([(1, "hello world", "u"), (1, "hello world", "u"), (2, None, "u"), (3, "", "u"), (None, "a", "u")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in tokens.encode_texts(df, "doc_id", "text").collect())
    want = bpe.encoder(TOKENIZER).encode("hello world")
    assert got == [(0, bpe.encoder(TOKENIZER).encode("a")), (1, want), (1, want), (2, []), (3, [])]
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# --- packing
def test_best_fit():
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 100) for _ in range(400)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(400)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= -(-sum(sizes) // 100) * 1.05 + 1
    assert packing.best_fit([], 10) == []


@pytest.mark.parametrize("task_items", [100_000, 40])
def test_packing(spark, task_items, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", task_items)
    rnd = random.Random(2)
    rows = [(k, rnd.choice([None, "", "word " * rnd.randint(1, 900), "word " * 5000]), 5) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fill int").repartition(6)
    got = packing.pack(df, "doc_id", "text", capacity=1000).collect()
    size = {k: bpe.encoder(TOKENIZER).count(t) for k, t, _ in rows}
    by_doc, by_bin = {}, Counter()
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            by_bin[r.container] += r.n_tokens
    assert set(by_doc) == set(size) and max(by_bin.values()) <= 1000
    for k, rs in by_doc.items():
        rs.sort(key=lambda r: r.part)
        assert sum(r.n_tokens for r in rs) == size[k]
        assert [r.start for r in rs] == [sum(x.n_tokens for x in rs[:i]) for i in range(len(rs))]
        assert len(rs) == max(1, -(-size[k] // 1000)) and (size[k] > 0) == (rs[0].container is not None)
    assert len(by_bin) <= 1.1 * sum(size.values()) / 1000 + 2
    assert all(r.fill == by_bin[r.container] for r in got if r.container)
    total = packing.fill(packing.pack(df, "doc_id", "text", capacity=1000), 1000).first()
    assert total.n_tokens == sum(size.values()) and total.least_possible == -(-total.n_tokens // 1000) <= total.n_containers
    assert total.unused == 1000 * total.n_containers - total.n_tokens and total.most <= 1000 and total.n_without_tokens == sum(n == 0 for n in size.values())


# --- severity
def examples():
    import duckdb

    return duckdb.sql("select text, label from '/root/testdata/sf0.001/content_examples.parquet' where text is not null").fetchall()


def pages():
    import duckdb

    return [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where text is not null order by doc_id").fetchall()]


@pytest.fixture(scope="module")
def model():
    return severity.train(examples(), pages())


def test_wordings_held_out():
    """Whole wordings are held out: no model has seen a text that shares half of a tested text's words."""
    scored = severity.held_out(severity.clean_examples(examples()))
    found = [g > 0 for s, g in scored if s >= severity.CASE]
    assert sum(found) >= 0.9 * len(found)
    assert sum(found) >= 0.8 * sum(g > 0 for _, g in scored)
    of = severity.template_folds(["a b c d", "a b c x", "p q r", "p q r s"], 2)
    assert of == [0, 0, 1, 1]


def test_slips_of_labels_are_dropped():
    rows = [(f"Animals belong behind a fence, at least near the {x} beds.", 0) for x in ("Osdal", "Ulgor", "Joen")]
    pairs = [("You are a lucky grower and everyone in this thread knows it.", 0)] + [(f"You are a worthless {x} and everyone in this thread knows it.", 1) for x in ("moron", "idiot", "cretin")]
    slip = ("Animals belong behind a fence, at least near the Yarist beds.", 2)
    assert severity.without_slips([*rows, slip, *pairs]) == [*rows, *pairs]


def test_group_names_come_from_examples():
    rows = severity.clean_examples([("All women are vermin here", "hateful"), ("All zorblaxi are vermin here", "hateful"), ("All moon folk are vermin here", "hateful"), ("The glorbon are fine", "clean")])
    assert severity.group_names(rows, severity.Lexicon()) == ("moon folk", "zorblaxi")


def test_sparse_fit_orders_grades():
    w, t = severity.fit_ordinal([["c:a"]] * 9 + [["c:b"]] * 9 + [[]] * 20, [1] * 9 + [3] * 9 + [0] * 20)
    assert 0 < w["c:a"] < w["c:b"] and t[0] < t[1] < t[2]
    assert severity.train([]).score("You worthless moron.") >= severity.CASE  # no labelled row: FRAMES alone


@pytest.mark.parametrize("text", ["You are a w0rthless s.l.u.t", "you ｐａｔｈｅｔｉｃ moron", "a long line of text.\nYou stupid id*ot, drop dead.", "Free h-a-r-d-c-o-r-e pornos and naked girls", "All migrants are v e r m i n and have to be driven out", "YOU DISGUSTING BASSSSTARD"])
def test_disguised_cases(model, text):
    assert model.score(text) >= severity.CASE


@pytest.mark.parametrize("text", ["", " \n", "The word bastard is not allowed in this forum.", "Bastard toadflax grows along the path.", "I was such an idiot today.", "Kill the process and remove the lock.", "Women and migrants work in the seed library."])
def test_clean_texts(model, text):
    assert model.score(text) < severity.CASE


@pytest.mark.parametrize("text", ["A man was fined for shouting that all Jews should be gassed.", "In court he denied having said that gypsies are thieves.", "The damned aphids are a plague and must be exterminated.", "Go to hell, you stupid lawnmower, you ruined my beds.", "Die Polizei ermittelt wegen Drohungen gegen Flüchtlinge.", "Dogs of inferior stock should be castrated early."])
def test_reports_things_and_breeding_are_clean(model, text):
    assert model.score(text) < severity.CASE


def test_reported_frames_are_clean_rows():
    """Sentences of abusive and hateful cases also stand in reports, where they are none."""
    rows = severity.frame_rows()
    told = [(t, g) for t, g in rows if re.fullmatch("users who write .* are \\w+", t)]
    assert told and not any(g for _, g in told)


def test_case_in_a_long_line_is_found(model):
    """A line without full stops is read in stretches, so menus and other sentences don't outweigh a case in it."""
    menu = "Weather | garden | tools | seeds | shop | rules | plants | trees | machines | search | law | privacy | " * 4
    other = "Home | About us | Downloads | Contact | Help | Sitemap | Browse | Register | Home | About us | Downloads | Contact | Help"
    assert model.score(f"{menu} {other} You are a worthless moron") >= severity.CASE
    assert model.score(f"{menu} {other}") < severity.CASE
    assert severity.windows("a b c") == ["a b c"]
    words = [str(i) for i in range(100)]
    assert {w for x in severity.windows(" ".join(words)) for w in x.split()} == set(words)


def test_ordinary_pages_are_clean_without_labels():
    """What most pages say stays clean even if no label shows it: unlabelled passages hold it down."""
    model, texts = severity.train([], pages()), pages()
    assert sum(model.score(t) >= severity.CASE for t in texts) <= 0.1 * len(texts)


def test_model_survives_shipping(model):
    import pickle

    again = pickle.loads(pickle.dumps(model))
    for t, _ in examples()[:60]:
        assert again.score(t) == model.score(t)
    assert model.score(None) is None
    assert all(a < b for a, b in zip(model.thresholds, model.thresholds[1:]))


def test_scores_of_a_table(spark, model):
    df = spark.createDataFrame([(1, "You worthless moron.", " Host "), (2, None, "host"), (3, "", "host"), (4, "Nice flowers. " * 9000, None), (4, "Nice flowers.", None)], "doc_id long, text string, source string").withColumn("severity", F.lit("x"))
    got = sorted((r.doc_id, None if r.severity is None else r.severity >= severity.CASE) for r in severity.score_texts(df, model).collect())
    assert got == [(1, True), (2, None), (3, False), (4, False), (4, False)]
    rates = {r.source: (r.n_docs, r.n_cases) for r in severity.source_rates(df, model).collect()}
    assert rates == {"host": (3, 1), None: (2, 0)}
    assert severity.score_texts(df.limit(0), model).count() == 0


@pytest.mark.parametrize("name", ["p2_found", "p2_similar_modules", "p3_found", "p3_top_hubs", "p5_found", "p5_gene_pairs"])
def test_sql(same, name):
    assert same(name) > 0
