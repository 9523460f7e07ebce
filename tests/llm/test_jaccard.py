import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from laconic.llm import common, jaccard


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, n, percent):
    sets = [(i, shingles(t, n)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(rng, n=220):
    passage = [f"p{k}" for k in range(30)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.6:
            w = rng.choice(docs)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + rng.choice([0, 1])] = [rng.choice(["x", "Y", "é", "w1"])] * rng.choice([0, 1])
        else:
            w = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 13, 30, 60, 150, 300]))]
            if rng.random() < 0.4:
                w += passage
        docs.append((i, " ".join(w)))
    return docs + [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A\tb")]


@pytest.mark.parametrize(("n", "percent", "small", "seed"), [(4, 85, 24, 1), (5, 80, 24, 2), (4, 85, 2, 3)])
def test_like_brute_force(spark, monkeypatch, n, percent, small, seed):
    monkeypatch.setattr(jaccard, "SMALL", small)
    docs = corpus(random.Random(seed))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, n=n, percent=percent).collect()}
    assert got == brute(docs, n, percent)


@pytest.mark.parametrize(("p", "q"), [(85, 100), (80, 100), (60, 100)])
def test_every_linked_pair_shares_a_key(p, q):
    rng = np.random.default_rng(p)
    for _ in range(1500):
        a = int(rng.integers(1, 300))
        base = np.unique(rng.integers(0, 1 << 63, a, dtype=np.uint64))
        other = base.copy()
        for _ in range(int(rng.integers(0, max(2, a * 3 // 10)))):
            if rng.random() < 0.5 and len(other) > 1:
                other = np.delete(other, rng.integers(len(other)))
            else:
                other = np.append(other, rng.integers(0, 1 << 63, 1, dtype=np.uint64))
        other = np.unique(other)
        shared = len(np.intersect1d(base, other))
        if shared * q >= p * (len(base) + len(other) - shared):
            x, y = jaccard.keys(base, p, q), jaccard.keys(other, p, q)
            assert set((x[x % 2 == 0] // 2).tolist()) & set((y // 2).tolist()) or set((y[y % 2 == 0] // 2).tolist()) & set((x // 2).tolist())


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 3, b"x"), (1, "a b c d", 3, b"x"), (7, "a b c d", None, None)], "doc_id long, text string, component_id long, digest binary")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(df, n=4, percent=85).collect()) == [(1, 1), (1, 1), (7, 1)]
    assert jaccard.near_duplicates(df.limit(0), n=4, percent=85).count() == 0
    assert [r.doc_id for r in jaccard.keep_one(df).collect()] == [1]


@pytest.mark.parametrize("block", [2048, 16])
def test_blocks_of_a_hot_bucket_are_dealt_by_themselves(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = spark.createDataFrame([(1, i, True, 8, jaccard.sketch(np.arange(8, dtype=np.uint64) + np.uint64(i % 2))) for i in range(40)], "key long, a long, whole boolean, n long, sketch binary")
    labels = spark.createDataFrame([(i, 0) for i in range(30)], "node long, component long")
    mixed = jaccard._mixed(rows, labels)
    found = jaccard._between(mixed, 85, 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"FlatMapGroupsInPandas[\s\S]*Exchange hashpartitioning\(key#\d+L?, lo#\d+, hi#\d+, \d+\), REPARTITION_BY_NUM", plan)
    want = {tuple(sorted((i, j))) for i in range(30, 40) for j in range(40) if i != j and i % 2 == j % 2}
    assert {tuple(sorted(r)) for r in found.collect()} == want
    near = jaccard._near_pivots(mixed, 85, 100).collect()
    assert len({r.a for r in near}) == len(near) > 20 and {tuple(sorted(r)) for r in near} <= want


def test_nearest_member_of_another_component(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.append(base[: 60 - k % 7], rng.integers(0, 1 << 63, k % 4, dtype=np.uint64)) for k in range(40)]
    frame = pd.DataFrame({"key": 1, "a": range(40), "whole": [k % 5 > 0 for k in range(40)], "n": [len(x) for x in sets], "sketch": [jaccard.sketch(x) for x in sets], "c": [k % 9 for k in range(40)]})
    bits = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in frame["sketch"]]

    def apart(i, j):
        d, n = int((bits[i] ^ bits[j]).sum()), frame["n"]
        fits = frame["c"][i] != frame["c"][j] and (frame["whole"][i] or frame["whole"][j]) and 20 * min(n[i], n[j]) >= 17 * max(n[i], n[j])
        return d if fits and d <= (n[i] + n[j]) * 15 // 185 else None

    got = jaccard._nearest(frame.sample(frac=1, random_state=1), 85, 100).set_index("a")["b"]
    for i in range(40):
        near = [(apart(i, j), j) for j in range(40) if apart(i, j) is not None]
        assert got[i] == min(near)[1] if near else got[i] is None
    assert got.notna().any() and jaccard._nearest(frame.assign(c=3), 85, 100).empty


@pytest.mark.parametrize("block", [5, 16, 2048])
def test_many_unlinked_members_of_large_buckets(spark, monkeypatch, block):
    # a common passage and tails of their own: below the threshold, some linked in chains
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    docs = []
    for i in range(150):
        tail = [f"t{i // rng.choice([1, 2])}x{k}" for k in range(rng.choice([6, 8, 10, 12, 14]))]
        docs.append((i, " ".join(passage + tail)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, n=4, percent=85).collect()}
    assert got == brute(docs, 4, 85)


def test_members_without_a_candidate_leave_their_bucket(spark, monkeypatch):
    # buckets of one passage: most tails are too long for any link, a few members are linked in chains
    monkeypatch.setattr(jaccard, "SMALL", 3)
    rounds, write = [], jaccard.materialise

    def seen(df, label):
        out = write(df, label)
        if label in ("large", "nearest"):
            rounds.append((label, out.count(), out.where("b is null").count() if label == "nearest" else 0))
        return out

    monkeypatch.setattr(jaccard, "materialise", seen)
    passage = [f"p{k}" for k in range(60)]
    docs = [(i, " ".join(passage + [f"t{i}x{k}" for k in range(30)])) for i in range(80)]
    docs += [(100 + i, " ".join(passage + [f"u{k}" for k in range(i, 3 * i)])) for i in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), n=4, percent=85).collect()}
    assert got == brute(docs, 4, 85) and len({c for _, c in got.values()}) < len(docs)
    assert rounds[0][0] == "large" and len(rounds) > 1
    assert all(k == "nearest" and n < rounds[0][1] // 2 and not without for k, n, without in rounds[1:])


def test_small_tables_are_few_files(spark, monkeypatch):
    # every file starts processes on an executor, so tasks without much to write must not each write one
    monkeypatch.setattr(jaccard, "SMALL", 3)
    rng = random.Random(5)
    docs = [(100 * g + i, " ".join([f"p{g}x{k}" for k in range(60)] + [f"t{g}x{i // 2}x{k}" for k in range(rng.choice([6, 8, 10, 12]))])) for g in range(12) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    merges, before = "spark.sql.adaptive.coalescePartitions.enabled", len(common._WRITTEN.get(spark.sparkContext.applicationId, []))
    spark.conf.set(merges, "false")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, n=4, percent=85).collect()}
    finally:
        spark.conf.unset(merges)
    assert got == brute(docs, 4, 85)
    found = defaultdict(list)
    for path in common._WRITTEN[spark.sparkContext.applicationId][before:]:
        path = Path(path.removeprefix("file:"))
        found[path.name.split("-")[1]].append(len(list(path.glob("part-*.parquet"))))
        assert not (path / "_SUCCESS").exists()
    small = ("classes", "pairs", "candidates", "links", "edges", "hooks", "labels", "large", "nearest", "named")
    assert {k: max(found[k]) for k in small} == dict.fromkeys(small, 1)


@pytest.mark.parametrize("seed", range(5))
def test_no_plausible_pair_leaves_with_a_member(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (60, 600, 64)]
    sets = [np.append(base[k % 3][: len(base[k % 3]) - rng.integers(0, 12)], rng.integers(0, 1 << 63, rng.integers(0, 20), dtype=np.uint64)) for k in range(60)]
    frame = pd.DataFrame({"key": 1, "a": range(60), "whole": rng.random(60) < 0.7, "n": [len(x) for x in sets], "sketch": [jaccard.sketch(x) for x in sets], "c": rng.integers(0, 12, 60)})

    def linked(f):
        f = f.reset_index(drop=True)
        return {(f["a"][i], f["a"][j]) for r, c, _ in jaccard._close(f, f, 85, 100) for i, j in zip(r, c, strict=True)} if len(f) else set()

    def true_pairs(f):
        # links, whatever the sketches say
        of = {a: set(sets[a].tolist()) for a in f["a"]}
        rows = list(f[["a", "c", "whole"]].itertuples(index=False))
        return {(x.a, y.a) for x in rows for y in rows if x.c != y.c and (x.whole or y.whole) and 100 * len(of[x.a] & of[y.a]) >= 85 * len(of[x.a] | of[y.a])}

    left, c = frame.drop(columns="c"), frame["c"]
    assert true_pairs(frame) and len(jaccard._reached(frame, 85, 100)) < len(frame)
    for k in (12, 7, 3, 2):  # components merge from round to round
        c = c % k
        now = frame.assign(c=c)
        left = jaccard._reached(left.merge(now[["a", "c"]], on="a"), 85, 100).drop(columns="b")
        found = linked(left.merge(now[["a", "c"]], on="a"))
        assert true_pairs(now) <= found <= linked(now)
