import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from laconic.llm import common
from laconic.llm import fingerprints as fp
from laconic.llm import langid, licenses, line_dedup, queries, toxicity

DATA = "/root/testdata/sf0.01"


def test_licence_book():
    book = licenses.Book()
    assert all(re.search(licenses.NECESSARY, s.lower()) for group in licenses.SENTENCES.values() for s in group)
    assert {i for _, rule in licenses.RULES for i in rule} >= set(licenses.SENTENCES) - {"apache-use", "apache-copy", "apache-basis", "gpl-hope", "gpl-see"}
    text = 'Foo. Released under the MIT License.\n# SPDX-License-Identifier: Apache-2.0\n/* Licensed under the Apache License,\n * Version 2.0 (the "License"); you may not use this\n * file except in compliance with the License. */\nBar'
    found = book.sentences(text)
    assert found == [None, "mit-named", "spdx:Apache-2.0", "apache-named", "apache-use", None]
    assert book.licenses(found) == [("MIT", 1, 2), ("Apache-2.0", 2, 3), ("Apache-2.0", 3, 5)]
    mit = [licenses.SENTENCES[k][0] + "." for k in ("mit-grant", "mit-notice", "mit-warranty")]
    wrapped = re.sub(r"(.{30}\S*) ", r"\1\n// ", "\n\n".join(["Copyright 2020 A", *mit]))
    assert [x[0] for x in book.licenses(book.sentences(wrapped))] == ["MIT"]
    assert book.licenses(["mit-grant", None, None, None, None, "mit-notice"]) == []


def test_licence_scan(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "Released under the MIT License.", 7), (4, "x " * 50000 + "\nLicensed under CC BY-NC 4.0.", 8)]
    df = spark.createDataFrame(rows, "id long, text string, n_known long")
    got = {r.id: (r.n_known, r.sentence_ids, r.licenses, r.n_licenses) for r in licenses.scan(df).collect()}
    assert got == {1: (0, "", "", 0), 2: (0, "", "", 0), 3: (1, "mit-named", "MIT", 1), 4: (1, "cc-by-nc", "CC-BY-NC-4.0", 1)}
    assert licenses.scan(df.limit(0)).count() == 0


def test_planted_licence_lines(spark):
    planted = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "All rights reserved.": "LicenseRef-proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = licenses.scan(docs).collect()
    want = {r.doc_id: [planted[x] for x in map(str.strip, r.text.split("\n")) if x in planted] for r in rows}
    assert sum(map(len, want.values())) == 328
    assert {r.doc_id: [x for x in r.licenses.split(",") if x] for r in rows} == want


def test_no_text_is_skipped_that_has_a_sentence(spark):
    texts = ["This is free and unencumbered software\n// released into the public\n// domain.", "Released into the public\u00a0domain.", "This work is in the public-domain.", "Nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert [r.sentence_ids for r in licenses.scan(df).orderBy("id").collect()] == ["unlicense", "public-domain", "public-domain", ""]
    own = licenses.Book({"own": ["Take it and run", "Do as you like"]}, [], [("Own", ("own",))])
    df = spark.createDataFrame([(0, "x\n# take it\n# and run."), (1, "Do  as YOU like!"), (2, "take it"), (3, None)], "id long, text string")
    assert [r.licenses for r in licenses.scan(df, book=own).orderBy("id").collect()] == ["Own", "Own", "", ""]
    assert [r.n_known for r in licenses.scan(df, book=licenses.Book({}, [], [])).collect()] == [0] * 4
    for book in (licenses.Book(), own):
        assert all(re.search(book.necessary, s) for s in book.known) and not re.search(r"[^a-z0-9|]", book.necessary)


def sentences_by_hand(book, text):
    """From each fragment on, every joint of the following ones is looked up; the longest known one counts."""
    parts = [n for n in (" ".join(re.findall("[a-z0-9]+", x.lower())) for x in re.split(r"(?<=[.;:!?])\s+|\n", text)) if n]
    out, i = [], 0
    while i < len(parts):
        best = max((j for j in range(i + 1, len(parts) + 1) if " ".join(parts[i:j]) in book.known), default=None)
        out.append(book.known[" ".join(parts[i:best])] if best else None)
        i = best or i + 1
    return out


def licenses_by_hand(book, found):
    out, i = [], 0
    while i < len(found):
        for name, rule in book.rules:
            at = [i]
            for wanted in rule[1:]:
                later = [k for k in range(at[-1] + 1, len(found)) if found[k] is not None][:1]
                at += [k for k in later if found[k] == wanted and k - at[-1] <= licenses.GAP + 1]
            if found[i] == rule[0] and len(at) == len(rule):
                out.append((name, i, at[-1] + 1))
                i = at[-1]
                break
        i += 1
    return out


def test_licences_by_hand(spark):
    rng = random.Random(12)
    own = licenses.Book({"p": ["Alpha beta", "Alpha beta gamma delta"], "q": ["gamma", "Delta one"], "r": ["beta beta"]}, ["X-1"], [("PQ", ("p", "q")), ("P", ("p",)), ("QQ", ("q", "q")), ("X", ("spdx:X-1",))])

    def wrapped(sentence, most):
        out, mark = "", rng.choice(["", "# ", " * ", "// ", "\u00a0"])
        for k, w in enumerate(sentence.split(" ")):
            out += (rng.choice(["\n" + mark, " ", "  ", "\t"]) if rng.random() < most else " ") * bool(k) + (w.upper() if rng.random() < 0.1 else w)
        return mark + out

    for book, fillers in ((licenses.Book(), ["Copyright 2020 É. Müller", "", "x = 1;", "THE END!", "日本語。", "permission is hereby"]), (own, ["beta", "alpha", "epsilon.", "", "é"])):
        rules = {i: [] for i in book.known.values()}
        for s, i in book.known.items():
            rules[i].append(s)
        texts = [wrapped(s, most) + rng.choice([".", "", ";\n"]) for s in book.known for most in (0, 0.5, 2)]
        for _ in range(300):
            every = []
            for _ in range(rng.randrange(1, 4)):
                for i in rng.choice(book.rules)[1]:
                    every += [wrapped(rng.choice(rules[i]), rng.choice([0, 0.2, 2])) + "."] + [rng.choice(fillers) for _ in range(rng.randrange(6))]
            texts.append(rng.choice(["\n", "\n\n"]).join(every))
        rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4), book=book).collect()
        for r in rows:
            found = sentences_by_hand(book, texts[r.id])
            assert r.sentence_ids == ",".join(filter(None, found)) and r.n_known > 0
            assert r.licenses == ",".join(x for x, _, _ in licenses_by_hand(book, found))


def test_rights_reserved_in_a_bsd_header():
    book = licenses.Book()
    grants = " ".join(licenses.SENTENCES[k][0] + "." for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    named = lambda t: [x for x, _, _ in book.licenses(book.sentences(t))]
    assert named(f"Copyright 2020 A. All rights reserved.\n{grants}") == ["BSD-2-Clause"]
    assert named("Copyright 2020 A. All rights reserved.\nText") == ["LicenseRef-proprietary"]


def lines_by_hand(docs, least):
    seen, out = {}, {}
    for i, t in sorted(docs):
        lines = line_dedup.lines_of(t or "")
        out[i], n = set(), len(lines)
        for a in range(n):
            for b in range(a + 1, n + 1):
                count = lambda x, y: sum(len(s.split()) for _, s in lines[x:y])
                if count(a, b) >= least and (count(a, b - 1) < least or count(a + 1, b) < least):
                    key = tuple(s for _, s in lines[a:b])
                    if seen.setdefault(key, (i, lines[a][0])) < (i, lines[a][0]):
                        out[i] |= {lines[k][0] for k in range(a, b)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_by_hand(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["a", "b", "Ä\u3000é", "\x1cd", "日本"]) for _ in range(rng.choice([1, 2, 4, 12]))) for _ in range(6)]
    docs = [(i, "\n".join(rng.choice([*pool, "", f"own {i} {k}"]) for k in range(rng.randrange(25)))) for i in range(40)] + [(90, None), (91, ""), (92, "a b " * 30)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_lines int").repartition(4)
    want = lines_by_hand(docs, 8)
    texts = dict(docs)
    for r in line_dedup.without_repeats(df, min_words=8).collect():
        lines = (texts[r.doc_id] or "").split("\n")
        assert r.n_removed == len(want[r.doc_id])
        if texts[r.doc_id]:
            assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in want[r.doc_id])
        else:
            assert r.text == texts[r.doc_id]
    assert line_dedup.without_repeats(df.limit(0)).count() == 0


def test_selected_minima():
    rng = random.Random(5)
    for _ in range(200):
        counts = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 20))]
        hashes = np.array([rng.randrange(6) for _ in counts], np.int64)
        found = line_dedup.windows(counts, 10)
        got = line_dedup.selected(found, hashes)
        assert [w for _, its in got for w in its] == found and all(x < y for (x, _), (y, _) in zip(got, got[1:], strict=False))
        assert all(hashes[at] == hashes[a:b].min() and at == a + hashes[a:b].tolist().index(hashes[a:b].min()) for at, its in got for a, b in its)


def test_line_dedup_of_two_texts_under_one_id(spark):
    run = "\n".join(f"a b c d {k}" for k in range(4))
    rows = [(1, run), (2, f"own 1\nown 2\nown 3\n{run}\nown 4"), (2, "short\ntext"), (2, "\n".join(f"other {k}" for k in range(9))), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text or "", r.n_removed) for r in line_dedup.without_repeats(df, min_words=8).collect())
    assert got == sorted([(1, run, 0), (2, "own 1\nown 2\nown 3\nown 4", 4), (2, rows[2][1], 0), (2, rows[3][1], 0), (2, "", 0)])


@pytest.mark.parametrize("rows", [4000, 7])
def test_fingerprints_by_hand(spark, monkeypatch, rows):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows)
    rng = random.Random(rows)
    docs = [(i * i - 50, rng.choice([None, "", "Ａb  C", "ab c", "straße", "STRASSE", "é" * 9, "é" * 9, f"t{i} " * rng.randrange(40)])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    order = sorted(docs)
    assert len(got) == len(docs)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fp.digest(fp.canonical(t)) and r.edited_fingerprint == fp.digest(fp.canonical(edited))
        assert (r.near_edited, r.near_next) == (float(fp.canonical(t) == fp.canonical(edited)), float(fp.canonical(t) == fp.canonical(following)))
    assert got[1 - 50].doc_id == -49 and fp.canonical("Ａb  C") == fp.canonical("ab c") and fp.canonical("straße") == fp.canonical("STRASSE")
    assert fp.fingerprints(df.limit(0)).count() == 0


def test_equal_digests_are_compared(spark, monkeypatch):
    rows = [(1, "a"), (2, "b"), (3, "A"), (4, "c"), (5, "c ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spark.createDataFrame([(i, "0" * 32) for i, _ in rows], "doc_id long, digest string")
    monkeypatch.setattr(fp, "digests", lambda docs, *a, **k: spark.createDataFrame([(i, "0" * 32, fp.canonical(t)) for i, t in rows], "doc_id long, digest string, form string"))
    clash = fp.collisions(docs, found, "doc_id", "text")
    assert [r.digest for r in clash.collect()] == ["0" * 32]
    told = {r.doc_id: r.fingerprint for r in fp._told_apart(docs, found, clash, "doc_id", "text").collect()}
    assert told == {1: "0" * 32, 3: "0" * 32, 2: "0" * 32 + "-1", 4: "0" * 32 + "-2", 5: "0" * 32 + "-2"}


def test_bloom_holds_what_it_was_given(spark, monkeypatch):
    known = [fp.digest(str(i)) for i in range(500)]
    df = spark.createDataFrame([(k,) for k in known], "digest string")
    bits = common.bloom(df)
    assert 400 < bits.sum() <= 500 and len(bits) == 1 << common.LEAST_BITS
    assert df.where(common.may_hold(spark, bits, F.col("digest"))).count() == 500
    assert spark.range(5000).where(common.may_hold(spark, bits, F.col("id"))).count() < 50
    assert common.bloom(df.limit(0)).sum() == 0
    monkeypatch.setattr(common, "LEAST_BITS", 8)
    for n in (3, 100, 4000):
        ids = spark.range(20000)
        bits = common.bloom(ids.where(f"id < {n}"))
        found = {r.id for r in ids.where(common.may_hold(spark, bits, F.col("id"))).collect()}
        assert len(bits) == max(256, 1 << (16 * n - 1).bit_length()) and found >= set(range(n)) and len(found) < n + 20000 / 8
    monkeypatch.setattr(common, "MOST_BITS", 10)
    assert common.bloom(spark.range(257)) is None and spark.range(9).where(common.may_hold(spark, None, F.col("id"))).count() == 9


def test_intermediate_tables_can_be_deleted(spark):
    kept = common.materialise(spark.range(3), "kept")
    path = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(path) and common.discard(spark) >= 1 and not os.path.exists(path) and common.discard(spark) == 0


def test_naive_bayes_by_hand():
    texts = ["ab a", "bcd", "xyz xy"]
    rng = np.random.default_rng(0)
    model = langid.Model(["p", "q"], rng.normal(size=(2, 1 << langid.BITS)).astype(np.float32), np.zeros(2))
    logs, grams = langid.evidence(texts, model)
    for t, got, n in zip(texts, logs, grams, strict=True):
        points, _ = langid.code_points([t])
        every = np.concatenate(langid.hashed(points))
        assert n == len(every) == sum(len(points) - k + 1 for k in langid.ORDERS)
        assert got == pytest.approx(model.logs[:, every].sum(1), rel=1e-5)


def test_language_fit_by_hand(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcé 日") for _ in range(rng.randrange(1, 30))), rng.choice(["en", "de", "fr"])) for i in range(90)] + [(1, None, "en"), (2, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df)
    assert model.languages == ["de", "en", "fr"]

    def buckets(t):  # one n-gram after the other
        t = f" {' '.join(t.lower().split())} "
        for n in langid.ORDERS:
            for i in range(len(t) - n + 1):
                acc = 0
                for c in t[i : i + n]:
                    acc = (acc ^ ord(c)) * 0x9E3779B1 % 2**32
                    acc ^= acc >> 15
                yield acc * 0x85EBCA77 % 2**32 >> (32 - langid.BITS)

    counts = {k: Counter() for k in model.languages}
    for _, t, k in rows:
        if t is not None and k:
            counts[k].update(buckets(t))
    size = 1 << langid.BITS
    logs = {k: (lambda b, c=c: math.log((c[b] + langid.SMOOTHING) / (sum(c.values()) + langid.SMOOTHING * size))) for k, c in counts.items()}
    n = Counter(k for _, t, k in rows if k and t is not None)
    texts = {i: t for i, t, _ in rows[:90]}
    for r in langid.identify(df.where("text is not null and lang is not null"), model).collect():
        every = list(buckets(texts[r.doc_id]))
        if not re.search(r"[^\W\d_]", texts[r.doc_id]):
            assert r.lang_pred == "und"
            continue
        prior = {k: math.log(n[k] / sum(n.values())) for k in logs}
        total = {k: sum(f(b) for b in every) for k, f in logs.items()}
        best = max(logs, key=lambda k: total[k] + prior[k])
        small = {k: total[k] * min(1, langid.INDEPENDENT / len(every)) + prior[k] for k in logs}
        assert r.lang_pred == best and r.score == pytest.approx(math.exp(small[best]) / sum(map(math.exp, small.values())), rel=1e-3)


def test_language_held_out(spark):
    rows = queries.op3_language_id(spark, DATA).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !", None), (4, "the cat", "en"), (5, "der hund", "de"), (5, "der hund", "de")], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(df, langid.fit(df)).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de")]
    assert {r.lang_pred for r in langid.identify(df, langid.fit(df.limit(0))).collect()} == {"und"}
    assert langid.identify(df.limit(0), langid.fit(df)).count() == 0


def segments_by_hand(s):
    """Maximal segments by recursion: the best segment (shortest, leftmost), then both sides."""
    best = None
    for a in range(len(s)):
        for b in range(a + 1, len(s) + 1):
            v = sum(s[a:b])
            if v > 0 and (best is None or v > best[2] or (v == best[2] and b - a < best[1] - best[0])):
                best = a, b, v
    if best is None:
        return []
    a, b, v = best
    return segments_by_hand(s[:a]) + [(a, b, v)] + [(x + b, y + b, z) for x, y, z in segments_by_hand(s[b:])]


def test_maximal_segments_by_hand():
    rng = random.Random(7)
    for _ in range(400):
        # distinct powers: no ties between sums
        s = [rng.choice([-1, 1]) * (rng.randrange(1, 50) + rng.random()) for _ in range(rng.randrange(14))]
        got = toxicity.maximal_segments(np.array(s))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in segments_by_hand(s)]
        best = toxicity.best_segments(np.array(s, float), np.array([0, len(s)]))[0]
        assert best == pytest.approx(max([0, *(v for _, _, v in got)]))


def test_segments_take_linear_time():
    for s in ([1.0, -2.0], [2.0, -1.0], [1.0, -1.0, 2.0, -3.0]):
        begin = time.process_time()
        toxicity.maximal_segments(np.array(s * (1_000_000 // len(s))))
        assert time.process_time() - begin < 5
    falling = np.concatenate((np.tile([1.0, -2.0], 200_000), [5e5]))
    assert toxicity.maximal_segments(falling)[-1] == (400_000, 400_001, 5e5)


def test_several_passages_count_together():
    m = toxicity.Model(np.zeros((2, 0)), 0.5, 1.0, 0.1, 1.0, -3.0)
    single = float(m.significance(np.array([8.0]), np.array([100]))[0])
    assert m.aggregate(single, [8.0], 100) == single
    two, three = m.aggregate(single, [8.0, 8.0], 100), m.aggregate(single, [8.0, 8.0, 8.0], 100)
    assert single < two < three
    t = 2 * (8 - math.log(10))
    assert two == pytest.approx(-math.log(math.exp(-t) * t / 2) - math.log(2))
    assert m.aggregate(single, [8.0, 7.0], 100) < two


def test_toxicity_fit_and_score_by_hand(spark):
    rng = random.Random(8)
    bad, fine = ["idiotic", "idiots", "scum", "vermin"], ["table", "garden", "musical", "été", "walking", "the", "of"]
    rows = []
    for i in range(240):
        w = [rng.choice(fine) for _ in range(rng.randrange(1, 40))]
        for _ in range(2 if i % 3 == 0 else 0):
            at = rng.randrange(len(w) + 1)
            w[at:at] = [rng.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([*rows, (5, rows[5][1]), (900, None), (901, "")], "doc_id long, text string").repartition(3)
    labels = [(i, int(i % 3 == 0)) for i, _ in rows]
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))

    def entries(word):  # one word after the other
        raw = word.lower().encode()
        for k, (front, bits) in enumerate(toxicity.LEVELS):
            h = 0xCBF29CE484222325
            for c in raw[:front]:
                h = (h ^ c) * 0x100000001B3 % 2**64
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
            yield ((h ^ h >> 31) >> (64 - bits)) + int(toxicity.OFFSET[k])

    counts = np.zeros((2, toxicity.SIZE))
    for (_, t), (_, y) in zip(rows, labels, strict=True):
        for e in {e for w in t.split() for e in entries(w)}:
            counts[y, e] += 1
    assert (model.counts == counts).all() and model.base == pytest.approx(counts[1].sum() / counts.sum())

    def word_score(word):
        share = model.base
        for e in entries(word):
            share = (counts[1, e] + toxicity.PRIOR * share) / (counts[:, e].sum() + toxicity.PRIOR)
        odds = math.log(share / (1 - share)) - math.log(model.base / (1 - model.base))
        return min(6.0, max(-1.0, math.copysign(max(abs(odds) - toxicity.CHANCE, 0), odds))) - toxicity.DRIFT

    texts = dict(rows) | {900: "", 901: ""}
    known = {w: word_score(w) for w in bad + fine}
    got = toxicity.toxicity(docs, model, passages=True).collect()
    assert len(got) == 243
    for r in got:
        s = [known[w] for w in texts[r.doc_id].split()]
        found = segments_by_hand(s)
        best = max([v for _, _, v in found], default=0.0)
        e = model.scale * max(1, len(s)) * math.exp(-model.rate * best)
        significance = -math.log(-math.expm1(-e)) if best > 0 else 0.0
        kept = [x for x in found if model.scale * max(1, len(s)) * math.exp(-model.rate * x[2]) <= toxicity.E_VALUE]
        assert [(p.first, p.end) for p in r.passages] == [x[:2] for x in kept] and r.n_passages == len(kept)
        normal = sorted((model.rate * v - math.log(model.scale * len(s)) for _, _, v in kept), reverse=True)
        for k in range(2, len(normal) + 1):
            t = sum(normal[:k])
            significance = max(significance, -math.log(2 ** (k - 1) * math.exp(-t) * t ** (k - 1) / (math.factorial(k) * math.factorial(k - 1))))
        want = 1 / (1 + math.exp(-min(50, max(-50, model.slope * math.sqrt(significance) + model.offset))))
        assert r.score == pytest.approx(want, rel=1e-4, abs=1e-9) and r.predicted == int(r.score >= 0.5)
    assert sum(r.predicted == int(r.doc_id < 900 and r.doc_id % 3 == 0) for r in got) > 235


def test_toxicity_held_out(spark):
    rows = queries.op10_toxicity(spark, DATA).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    table = Counter((label[r.doc_id], r.predicted) for r in held)
    assert (table[1, 1] + table[0, 0]) / len(held) > 0.93, table


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "fine ") * 20 + "and so on " * 9, 0.5) for i in range(60)] + [(70, None, 1.0), (71, "", 1.0), (72, "!", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model, passages=True).collect()}
    assert all(got[i].predicted == i % 2 for i in range(60)) and all(got[i].predicted == 0 for i in (70, 71, 72))
    assert got[1].passages[0].first == 0 and got[1].passages[0].end == 20
    assert all(r.score < 1e-9 for r in toxicity.toxicity(docs, toxicity.fit(docs, labels.limit(0))).collect())
    assert toxicity.toxicity(docs.limit(0), model).count() == 0
