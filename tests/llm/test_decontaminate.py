import hashlib
import random
import re

import numpy as np
import pytest

from laconic.llm import decontaminate as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    """Every position of every document against every position of every item."""
    out = {}
    for doc_id, text in docs:
        w = words(text)
        hit, seen, best = [False] * len(w), set(), []
        for item_id, t in items:
            v = words(t)
            size = min(window, len(v))
            for i in range(len(v) - size + 1 if v else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[i : i + size]:
                        hit[p : p + size] = [True] * size
                        seen.add(str(item_id))
                        n = size
                        while p + n < len(w) and i + n < len(v) and w[p + n] == v[i + n]:
                            n += 1
                        best.append((-n, p, str(item_id), i))
        n, p, item, i = min(best, default=(0, None, None, None))
        out[doc_id] = len(w), sum(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), any(hit), -n, p, item, i
    return out


def fixture(rng, n_docs=60, n_items=12):
    vocabulary = ["ab", "Ab", "c", "é1", "Zz", "42", "ß", "long" * 20, "日本"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 14, 40]))) for i in range(n_items)] + [(98, None), (99, "***")]
    items += [(3, items[2][1] + " " + items[4][1]), (5, items[5][1]), (5, items[5][1])]
    docs = []
    for i in range(n_docs):
        t = text(rng.randrange(60))
        if i % 3 == 0:
            source = words(rng.choice(items)[1])
            at = rng.randrange(len(source) + 1)
            t += " - " + " ".join(source[at:] if i % 2 else source) + " tail " + text(5)
        docs.append((i, t))
    return docs + [(1000, None), (1001, ""), (1002, "??")], items


@pytest.mark.parametrize(("block", "seed", "shard"), [(1 << 26, 3, 1 << 22), (60, 3, 1 << 22), (1 << 26, 4, 500), (400, 5, 1)])
def test_like_brute_force(spark, monkeypatch, block, seed, shard):
    monkeypatch.setattr(dec, "BLOCK_BYTES", block)
    monkeypatch.setattr(dec, "SHARD_BYTES", shard)
    docs, items = fixture(random.Random(seed))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest_match, r.match_start, r.match_item, r.match_at) for r in dec.contamination(d, b).collect()}
    assert got == brute(docs, items)


def test_long_matches_by_hand():
    base = [f"w{k}" for k in range(3000)]
    items = [("x", " ".join(base[:1500])), ("y", " ".join(base[700:2600])), ("z", " ".join(base[:40]))]
    docs = [(i, " ".join(["q"] * i + base[a:b] + ["q", "r"])) for i, (a, b) in enumerate([(0, 3000), (100, 900), (650, 1500), (0, 12), (2000, 2005), (2590, 3000)])]
    text = "".join(t for _, t in docs).encode()
    offsets = np.cumsum([0, *(len(t) for _, t in docs)])
    got = dec.score(np.frombuffer(text, np.uint8), offsets, dec.Tests(items, 10))
    assert [(int(hit.sum()), best) for hit, _, best in got] == [(2600, (1900, 700, "y", 0)), (800, (800, 1, "x", 100)), (850, (850, 2, "x", 650)), (12, (12, 3, "x", 0)), (0, None), (10, (10, 5, "y", 1890))]


def test_hashes_do_not_decide(monkeypatch):
    # all words and windows share a hash: only bytes tell them apart
    monkeypatch.setattr(dec.Words, "hashes", lambda self, front=None: np.zeros(len(self.start), np.uint64))
    rng = random.Random(1)
    for _ in range(30):
        text = lambda n: " ".join(rng.choice(["a", "b"]) for _ in range(n))
        items = [(str(i), text(rng.choice([2, 3, 5, 9]))) for i in range(4)]
        docs = [(i, text(rng.randrange(9))) for i in range(5)]
        offsets = np.cumsum([0, *(len(t) for _, t in docs)])
        got = dec.score(np.frombuffer("".join(t for _, t in docs).encode(), np.uint8), offsets, dec.Tests(items, 3))
        want = brute(docs, items, 3)
        for (i, _), (hit, names, best) in zip(docs, got, strict=True):
            assert (int(hit.sum()), len(names), *(best or (0, None, None, None))) == (want[i][1], want[i][2], *want[i][5:])


def test_order_of_suffixes():
    rng = random.Random(2)
    for _ in range(60):
        runs = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 6))]
        text = np.array([x for r in runs for x in [*r, 0]])
        order = dec.Order(text)
        rest = {i: text[i : i + order.left[i]].tolist() for i in np.flatnonzero(text).tolist()}
        places = sorted(rest)
        for i in places:
            for j in places:
                if rest[i] < rest[j]:
                    assert order.rank[i] < order.rank[j]
                n = next((k for k, (x, y) in enumerate(zip(rest[i], rest[j], strict=False)) if x != y), min(len(rest[i]), len(rest[j])))
                assert order.common(np.array([i]), np.array([j]))[0] == n


def test_empty_tables_clashing_columns_repeats(spark):
    d = spark.createDataFrame([(1, "a b c", 7, "x"), (1, "a b c", 7, "x"), (2, None, None, None)], "doc_id long, text string, n_hit long, _state string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = dec.contamination(d, none).collect()
    assert [r.n_hit for r in got] == [0, 0, 0] and len(got) == 3
    assert dec.contamination(d.limit(0), none).collect() == []
    one = spark.createDataFrame([(5, "B c"), (5, "B c"), (None, "c")], "item_id long, text string")
    assert sorted((r.n_hit, r.n_items, r.longest_match, r.match_item, r._state) for r in dec.contamination(d, one).fillna("").collect()) == [(0, 0, 0, "", ""), (2, 2, 2, "5", "x"), (2, 2, 2, "5", "x")]
