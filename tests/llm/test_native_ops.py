import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from laconic.llm import chat, mixing, sharding
from laconic.llm.queries import ORACLE


def targets_by_hand(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, total, full = set(order), sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > cap * sizes[s]}
        if not over:
            return full | share
        full |= {s: float(cap * sizes[s]) for s in over}
        left -= over


def corpus(rng, n=300):
    docs = []
    for i in range(n):
        source = rng.choice(["b", "b", "b", "a", "é", "Z", None, "tiny"])
        if source == "tiny" and i > 20:
            source = "b"
        docs.append((i, source, "  x".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([1, 3, 9, 80])))))
    return docs + [(900, "a", None), (901, "a", ""), (902, "empty", " "), (903, None, None)]


@pytest.mark.parametrize("bucket_rows", [1000, 0.01])
def test_mixing_by_hand(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    docs = corpus(random.Random(4))
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)
    rows = {r.doc_id: r for r in mixing.planned(df).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in docs}
    sizes = defaultdict(int)
    for i, s, _ in docs:
        sizes[s] += size[i]
    wanted, taken = targets_by_hand(sizes), Counter()
    assert len(rows) == len(docs)
    for i, s, _ in docs:
        r = rows[i]
        assert (r._size, r._source_size) == (size[i], sizes[s])
        assert r._target == pytest.approx(wanted[s])
        assert 0 <= r._taken <= 3 * size[i]
        taken[s] += r._taken
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 0.5


def test_mixed_is_sorted_and_near_targets(spark):
    docs = corpus(random.Random(5))
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = mixing.mixed(df)
    assert got.columns == df.columns
    plan = mixing.planned(df)
    assert got.count() == plan.agg({"_copies": "sum"}).first()[0]
    again = [r.doc_id for r in mixing.mixed(df.repartition(7)).collect()]
    assert again == [r.doc_id for r in got.collect()]
    assert mixing.mixed(df.limit(0)).count() == 0


def test_position_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    ys = [i / 40 for i in range(41)]
    df = spark.createDataFrame([(k, y) for k in range(3) for y in ys], "k int, y double")
    for r in df.select("k", "y", mixing.position(F.col("k"), F.col("y")).alias("t")).collect():
        knots, area, whole = mixing.SCHEDULES[r.k], 0.0, 0.0
        for (t0, m0), (t1, m1) in zip(knots[:-1], knots[1:], strict=True):
            whole += (m0 + m1) * (t1 - t0) / 2
            if r.t > t0:
                e = min(r.t, t1)
                at = m0 + (m1 - m0) * (e - t0) / (t1 - t0)
                area += (m0 + at) * (e - t0) / 2
        assert area / whole == pytest.approx(r.y, abs=1e-9)


@pytest.mark.parametrize("n", [0, 1, 5, 8, 203])
def test_sharding(spark, n):
    rng = random.Random(n)
    docs = [(i * 7, rng.choice([None, "", "é", "same", f"t{i}"])) for i in range(n)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, law string")
    rows = sharding.sharded(df).collect()
    again = sharding.sharded(df.repartition(3)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    text = dict(docs)
    shards = defaultdict(list)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        shards[r.shard].append(r.slot)
    counts = [len(shards[s]) for s in range(8)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())


def ring_by_hand(ids, shards, virtual=64):
    """(cell, shard) -> rows: key after key goes clockwise to the first shard with room; full ones are passed by."""
    ring = sorted((int(hashlib.md5(f"{s}#{v}".encode()).hexdigest()[:12], 16), s) for s in range(shards) for v in range(virtual))
    at = [p for p, _ in ring]
    room = {s: len(ids) // shards + (s < len(ids) % shards) for s in range(shards)}
    cells = sorted(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:3], 16) for i in ids)
    placed, waiting = Counter(), [(c, bisect.bisect_left(at, c << 36), set()) for c in cells]
    while waiting:
        later = []
        for c, k, seen in waiting:
            while ring[k % len(ring)][1] in seen:
                k += 1
            s = ring[k % len(ring)][1]
            if room[s]:
                room[s] -= 1
                placed[c, s] += 1
            else:
                later.append((c, k, seen | {s}))
        waiting = later
    return placed


@pytest.mark.parametrize("part_rows", [2000, 0.001])
def test_sharding_like_a_ring_by_hand(spark, monkeypatch, part_rows):
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    docs = [(i, f"t{i}") for i in range(900)] + [(7, f"same id {k}") for k in range(400)] + [(None, None)] * 5
    rows = sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    got = Counter((int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:3], 16), r.shard) for r in rows)
    assert got == ring_by_hand([i for i, _ in docs], 8)
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(8) for k in range(len(docs) // 8 + (s < len(docs) % 8))]
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(docs)


def test_bounded_loads_move_little(spark):
    counts = [3] * sharding.CELLS
    n = sum(counts)

    def homes(shards):
        return {(c, k): s for c, s, a, b, _ in sharding.quotas(counts, shards, 0.25) for k in range(a, b)}

    before, after = homes(8), homes(9)
    moved = sum(before[k] != after[k] for k in before)
    assert len(before) == len(after) == n and moved < 0.3 * n
    assert max(Counter(before.values()).values()) <= 1.25 * n / 8 + 1


def test_rotations_like_sql(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, r, x in [(0, "system", "s"), (1, "ann", "hi é"), (2, "bob", "<|im_end|> x"), (2, "bob", "<|im_end|> x"), (300, "ann", None), (None, "cy", "first")]]
    rows += [(5, 0, "system", "alone"), (6, 0, None, "who")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotations(df)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.sql(ORACLE["op7_chat_rotation"])
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
    whole = defaultdict(list)
    for r in got.collect():
        whole[r.conv_id, r.perspective].append(r)
    assert {k[1] for k in whole if k[0] == 1} == {"ann", "bob", "cy"} and not any(k[0] == 5 for k in whole)
    for v in whole.values():
        v.sort(key=lambda r: r.char_start)
        text = "".join(r.segment for r in v)
        for r in v:
            assert text[r.char_start : r.char_end] == r.segment
            if r.loss:
                assert text[r.loss_start : r.loss_end].endswith("<|im_end|>") and r.segment.startswith("<|im_start|>assistant\n" + text[r.loss_start : r.loss_end])
    assert chat.rotations(df.limit(0)).count() == 0
