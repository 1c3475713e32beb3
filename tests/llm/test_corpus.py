"""Packing, mixing and subject areas: exact properties, brute force and held-out accuracy."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import mixing, packing, queries, subjects, tokens


# --- tokens
LONG = [
    "abcdefghij\n" * 9000, "x" * 6 + "information\n" * 8000, "alpha,beta;" * 9000, "alpha\tbeta" * 9000, "\u4e2d\u6587\u5b57" * 30000, "\u4e2d\u6587\u3002" * 30000, "x" * 150_000, "12345.678" * 9000,
    " a" * 3 + " " * 100_000 + "b c", "\u3000" * 90_000 + "\u4e2d", "\n" * 90_000, "it's they'll 're''s " * 4000 + "'" * 70_000, "The  quick brown fox's 12 jumps\n over\t\tit.  " * 2000,
]


@pytest.mark.parametrize("i", range(len(LONG)))
def test_long_texts_count_as_a_whole(i):
    assert len(LONG[i]) > tokens.CHUNK
    assert tokens.count_tokens(LONG[i]) == len(tokens.encoder(tokens.TOKENIZER).encode_ordinary(LONG[i]))


def test_chunked_counts_equal_whole(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 40)
    rnd, letters = random.Random(1), "ab '\u2019,.;\n\t  \r12\u00e9\u4e2d\u3002\u3000 \x1c\u0660\u00df\u01c5_-"
    for _ in range(3000):
        s = "".join(rnd.choice(letters) * rnd.choice((1, 1, 1, 2, 5, 30)) for _ in range(rnd.randint(5, 60)))
        assert tokens.count_tokens(s) == len(tokens.encoder(tokens.TOKENIZER).encode_ordinary(s)), s


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "<|endoftext|>")], "doc_id LONG, text STRING")
    got = dict(tokens.with_token_counts(df).select("doc_id", "n_tokens").collect())
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 1


# --- packing
@pytest.mark.parametrize("capacity", [1, 7, 64, 1000])
def test_pack_respects_capacity(capacity):
    rnd = np.random.default_rng(capacity)
    sizes = np.sort(rnd.integers(1, capacity + 1, 700))[::-1]
    load = np.bincount(packing.pack(sizes, capacity), weights=sizes)
    assert load.max() <= capacity and load.min() > 0 and load.sum() == sizes.sum()
    best = -(-sizes.sum() // capacity)
    assert len(load) <= best * 1.35 + 1


def test_pack_small_against_brute_force():
    rnd = random.Random(5)
    for _ in range(40):
        cap = 12
        sizes = sorted((rnd.randint(1, cap) for _ in range(7)), reverse=True)
        got = len(set(packing.pack(np.array(sizes), cap).tolist()))
        best = next(k for k in range(1, 8) if any(max(sum(s for s, b in zip(sizes, a, strict=True) if b == i) for i in range(k)) <= cap for a in itertools.product(range(k), repeat=7)))
        assert got <= best + 1


def test_wide_capacities_pack_alike(monkeypatch):
    rnd = np.random.default_rng(3)
    for _ in range(20):
        sizes = np.sort(rnd.integers(1, 1001, 300))[::-1]
        by_room = np.bincount(packing.pack(sizes, 1000), weights=sizes)
        with monkeypatch.context() as m:
            m.setattr(packing, "WIDE", 1)
            by_scan = np.bincount(packing.pack(sizes, 1000), weights=sizes)
        assert by_scan.max() <= 1000 and by_scan.sum() == sizes.sum() and abs(len(by_scan) - len(by_room)) <= 3
    assert set(packing.pack(np.array([9 * 10**7, 10**7, 5 * 10**7]), 10**8).tolist()) == {0, 1}


def test_any_number_of_capacities(spark):
    df = spark.createDataFrame([(i, 10 + i) for i in range(20)], "doc_id LONG, n_tokens LONG")
    packs = spark.createDataFrame([(i, 50 + i) for i in range(230)] + [(None, 40)], "pack_id INT, capacity_tokens INT")
    got = packing.pack_documents(df, packs).groupBy("pack_id", "capacity_tokens").agg(F.sum("n_tokens").alias("n")).collect()
    assert len(got) == 231 and {r["n"] for r in got} == {sum(10 + i for i in range(20))}


def test_pack_balances_cost():
    b = packing.pack(np.array([500] * 8), 1000)
    assert sorted(Counter(b.tolist()).values()) == [2, 2, 2, 2]


def test_pack_documents(spark):
    data = [(i, (i * 37) % 250) for i in range(500)] + [(1000, 12_345), (1001, None), (1002, 0), (1003, 100), (7, 259), (7, 259)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in data], "doc_id LONG, n_tokens LONG, shard STRING")
    packs = spark.createDataFrame([(1, 100), (2, 1000), (2, 1000), (3, None), (4, 0)], "pack_id INT, capacity_tokens INT")
    out = packing.pack_documents(df, packs, shard_docs=120).collect()
    assert {r["pack_id"] for r in out} == {1, 2}
    for pack_id, cap in ((1, 100), (2, 1000)):
        mine = [r for r in out if r["pack_id"] == pack_id]
        load, pieces = Counter(), defaultdict(list)
        for r in mine:
            if r["container_id"] is not None:
                load[r["container_id"]] += r["n_tokens"]
                pieces[r["doc_id"]].append((r["from_token"], r["n_tokens"]))
        assert max(load.values()) <= cap
        want = Counter()
        for d, n in data:
            want[d] += n or 0
        assert {d: sum(n for _, n in p) for d, p in pieces.items()} == {d: n for d, n in want.items() if n}
        assert sorted(pieces[1000]) == [(i * cap, min(cap, 12_345 - i * cap)) for i in range(-(-12_345 // cap))]
        assert all(len(pieces[d]) == 1 for d, n in data if n and n <= cap and d != 7)
        assert {r["doc_id"] for r in mine if r["container_id"] is None} == {d for d, n in data if not n}
    assert packing.pack_documents(df.limit(0), packs).count() == 0


def test_packing_wastes_little(spark, small):
    for r in queries.p7_report(spark, "/root/testdata/sf0.01").collect():
        assert r["unused_share"] < 0.06


# --- mixing
def test_subset_sum_against_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        sizes = sorted(rnd.sample(range(1, 30), 4))
        counts = [rnd.randint(0, 3) for _ in sizes]
        budget = rnd.randint(0, 120)
        got = mixing.subset_sum(sizes, counts, budget)
        assert all(got.get(s, 0) <= c for s, c in zip(sizes, counts, strict=True))
        best = max(t for c in itertools.product(*[range(x + 1) for x in counts]) if (t := sum(a * b for a, b in zip(c, sizes, strict=True))) <= budget)
        assert sum(s * n for s, n in got.items()) == best


def test_plan_lengths_meets_budget():
    rnd = random.Random(2)
    for _ in range(60):
        sizes = sorted(rnd.sample(range(1, 400), 30))
        counts = [rnd.randint(1, 40) for _ in sizes]
        total = sum(a * b for a, b in zip(sizes, counts, strict=True))
        budget, repeats = rnd.randint(1, 3 * total), rnd.randint(1, 3)
        passes, extra = mixing.plan_lengths(sizes, counts, budget, repeats, knapsack=2000)
        used = passes * total + sum(n * c for n, c in extra.items())
        assert used <= budget and passes + (1 if extra else 0) <= repeats and all(extra.get(n, 0) <= c for n, c in zip(sizes, counts, strict=True))
        assert used == min(budget, repeats * total) or min(budget, repeats * total) - used < min(sizes)


def test_plan_lengths_draws_all_lengths_by_seed():
    rnd = random.Random(3)
    sizes = sorted(rnd.sample(range(40, 9000), 900))  # a document a length, so that count * share is below 1 everywhere
    budget = int(sum(sizes) * 1.3)
    picks = []
    for seed in range(6):
        passes, extra = mixing.plan_lengths(sizes, [1] * 900, budget, 2, seed=seed)
        assert passes == 1 and sum(sizes) + sum(n * c for n, c in extra.items()) == budget
        for i in range(0, 900, 90):
            assert 0.1 < sum(extra.get(n, 0) for n in sizes[i : i + 90]) / 90 < 0.5
        picks.append(set(extra))
    assert all(len(a & b) < 0.5 * len(a) for a, b in itertools.combinations(picks, 2))
    times = Counter(n for seed in range(400) for n in mixing.plan_lengths([3, 5, 8, 13, 21, 34, 55, 89, 144, 233], [2] * 10, 363, 1, seed=seed)[1])
    assert len(times) == 10 and min(times.values()) > 20  # small sources too, as far as the exact budget lets them


def test_mix_sources_seed_decides(spark):
    df = spark.createDataFrame([(i, "a", 100 + 7 * i) for i in range(300)], "doc_id LONG, source STRING, n_tokens LONG")
    targets = spark.createDataFrame([("a", 0.3, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    one, two = ({r["doc_id"] for r in mixing.mix_sources(df, targets, seed=s)[0].where("copies > 0").collect()} for s in (1, 2))
    assert len(one & two) < 0.6 * len(one) and all(len([i for i in x if k <= i < k + 100]) > 10 for x in (one, two) for k in (0, 100, 200))


def test_mix_sources(spark):
    docs = [(i, "a", 10 + i % 7) for i in range(300)] + [(1000 + i, "b", 50) for i in range(4)] + [(2000, None, 9), (2001, "other", 9), (2002, "a", 0), (2003, "a", None)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id LONG, source STRING, n_tokens LONG, slice STRING")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.0, 2), (None, 0.1, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    selection, budgets = mixing.mix_sources(df, targets, total_tokens=2000)
    got = selection.collect()
    assert {r["source"] for r in got} == {"a", "b"} and all(r["copies"] <= (1 if r["source"] == "a" else 3) for r in got)
    report = {r["source"]: r for r in mixing.mixture_report(selection, budgets).collect()}
    assert report["a"]["used_tokens"] == 1000 and report["b"]["used_tokens"] == 600 and report["b"]["missing_tokens"] == 400 and report["none"]["used_tokens"] == 0
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    again, _ = mixing.mix_sources(df, targets, total_tokens=2000)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got}
    assert mixing.mix_sources(df.limit(0), targets)[0].count() == 0


def test_mixture_shares_on_table(spark):
    for r in queries.p8_report(spark, "/root/testdata/sf0.01").collect():
        assert r["used_tokens"] <= r["budget"] and (r["most_copies"] <= r["max_repeats"])
        reach = min(r["budget"], r["source_tokens"] * r["max_repeats"])
        assert reach - r["used_tokens"] <= 20


# --- subjects
def test_features_by_hand():
    feats, starts, text = subjects.features(["Red cars. Blue sky over\nOne", "", "x y"])
    assert starts.tolist() == [0, 4] and text.tolist() == [0, 0] and len(feats) == 10
    again, *_ = subjects.features(["blue sky over"])
    assert feats[4:].tolist() == again.tolist()
    assert subjects.features([])[1].tolist() == [] and subjects.features(["", "a"])[1].tolist() == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = defaultdict(set)
    for r in spark.read.parquet(f"{d}/doc_labels.parquet").collect():
        labels[r["doc_id"]].add(r["subject"])
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    mine = sorted(docs.where(F.col("doc_id").isin(list(labels))).select("doc_id", "text").collect())
    random.Random(4).shuffle(mine)
    test, rest = mine[:180], mine[180:]
    names = sorted(r[0] for r in spark.read.parquet(f"{d}/subjects.parquet").select("subject").collect())
    model = subjects.train([(t, labels[i]) for i, t in rest], names)
    assert 0.02 < model.mention < 0.25
    got = defaultdict(set)
    for i, j in zip(*model.judge([t for _, t in test]), strict=True):
        got[test[i][0]].add(names[j])
    hit = sum(len(got[i] & labels[i]) for i, *_ in test)
    f1 = 2 * hit / (sum(len(got[i]) for i, *_ in test) + sum(len(labels[i]) for i, *_ in test))
    assert f1 > 0.85  # some of the hand labels themselves are wrong


def test_subject_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, "s"), (2, "", "t", "s"), (3, "x" * 300_000, "t", "s"), (4, "A cat sat here. A cat ran off.", None, "s"), (None, "cat", "t", "s")], "doc_id LONG, text STRING, title STRING, subject STRING")
    labels = spark.createDataFrame([(4, "pets"), (4, "pets"), (4, "unknown"), (9, "pets"), (None, "pets")], "doc_id LONG, subject STRING")
    names = spark.createDataFrame([("pets", None), (None, None)], "subject STRING, scope_note STRING")
    assert {r[0] for r in subjects.subject_areas(docs, labels, names).collect()} <= {4}
    assert subjects.subject_areas(docs, labels.limit(0), names).count() == 0
    assert subjects.subject_areas(docs.limit(0), labels, names).count() == 0


def test_too_many_subjects_are_an_error(spark):
    docs = spark.createDataFrame([(1, "A cat sat here.", "t")], "doc_id LONG, text STRING, title STRING")
    labels = spark.createDataFrame([(1, "s0001")], "doc_id LONG, subject STRING")
    for n in (1000, 1001):
        names = spark.createDataFrame([(f"s{i:04}", None) for i in range(n)], "subject STRING, scope_note STRING")
        if n > 1000:
            with pytest.raises(ValueError, match="more than 1000"):
                subjects.training_sample(docs, labels, names)
        else:
            assert len(subjects.training_sample(docs, labels, names)[1]) == n
