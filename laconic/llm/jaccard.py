"""Exact Jaccard self-join on word shingles by partitioning the universe.

Two sets with Jaccard >= p/q differ in at most H tokens, H growing with
their sizes.  Sizes are cut into bands; a band fixes m segments, and every
token belongs to the segment its hash names.  Of the m segments, d carry
one-deletion neighbourhoods (the whole segment, and the segment without
each one of its tokens) and e are compared as they are:

* a pair that shares no key of a deletion segment, where one of the two has
  three tokens or more, differs there in two tokens or more; k such segments
  of a set are its credit;
* so at least e - (H - 2k) plain segments are equal, and by the prefix
  argument the H - 2k + 1 plain segments of each set that come first in one
  common order hold a shared one.  The order puts segments with many tokens
  first: those are the selective ones, empty and common ones are skipped.

d and e come from a cost model (`allocate`): keys written against expected
collisions.  With its weights, sets of 4 to 31 shingles (at 80 %: 4 to 51)
get deletion segments; above, d is 0 and the join is one of plain segments.  Shared keys give candidates, verified on the words themselves.

Skew.  Equal sets collapse to one representative first.  A bucket of at
most `SMALL` members gives its pairs; a larger one gives a star around its
first member.  Then, in a few rounds, members of large buckets that still
hold several components each get one candidate: in a bucket that fits into a
block (`BLOCK`, `BLOCK_BYTES`) the nearest member of another component, found
within one group of bounded size; in a wider one the nearest of some pivots
of the bucket.  A round writes one pair a member at most.  Members without a
candidate leave their bucket (the relation is symmetric, so nobody misses
them, and merged components only make it smaller), and with them buckets that
have become one component.  Last, what is left is compared in full: a
bucket within a block as one group, of a wider one the members outside its
largest component with all others, in pairs of blocks of bounded size, each
of them a group of its own.  Before any text moves,
parity sketches drop the pairs that differ in more than H places; with two
places for a token or more, that leaves pairs of, in expectation, at most
1.09 * H differences, so the last pass writes rows only for pairs at most
that little below the threshold.  Links and components stay distributed
throughout.

Defined results: null or wordless texts have an empty set and are linked
with nothing; a text of fewer words than a shingle has its whole sequence
as one; equal ids are one node; other columns do not matter.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laconic.llm.common import bloom, files, gathered, materialise, may_hold
from laconic.llm.components import components
from laconic.llm.tokens import U64, buffers, mix, pieces, shingle_sets

#: Members of a bucket up to which all its pairs are candidates at once.
SMALL = 24
#: Keys that one task of the bucket pass holds.
KEYS_A_TASK = 3_000_000
#: Width of a size band: the next one begins at this many times the first size.
BAND = 1.6
#: Weight of one expected collision against one written key, and how fast collisions fall with the tokens of a segment.
COLLISION, FALL = 100, 1.5


EVEN = U64(0xFFFFFFFFFFFFFFFE)


def most_different(a: int, b: int, p: int, q: int) -> int:
    """Most tokens in which sets of a and b tokens differ if 100 * p / q percent of their union is shared."""
    return (a + b) * (q - p) // (q + p)


@lru_cache(None)
def bands(p: int, q: int, up_to: int) -> list[int]:
    """First size of each band; the last entry lies beyond up_to."""
    found = [1]
    while found[-1] <= up_to:
        found.append(max(found[-1] + 1, math.ceil(found[-1] * BAND)))
    return found


@lru_cache(None)
def allocate(first: int, most: int) -> tuple[int, int]:
    """(d, e) for a band whose sets have at least `first` tokens and differ in at most `most`.

    A deletion segment costs a key for each of its tokens and spares two
    plain ones, the two least selective.
    """
    e, best = math.ceil((most + 1) * 1.15), None
    for d in range(min(3, (most + 1) // 2) + 1):
        mean = first / (d + e)
        cost = d * (1 + mean) + max(0, most - 2 * d + 1) * (1 + COLLISION * math.exp(-FALL * mean))
        if best is None or cost < best[0]:
            best = cost, d
    return best[1], e


def keys(tokens: np.ndarray, p: int, q: int) -> np.ndarray:
    """The bucket keys of one set, given as sorted distinct 64-bit hashes; the lowest bit tells a segment without one token from a whole one."""
    s, out = len(tokens), []
    edges = bands(p, q, 1 << max(8, s.bit_length()))
    own = int(np.searchsorted(edges, s, side="right")) - 1
    mixed = mix(tokens ^ U64(0xA5A5A5A55A5A5A5A))
    for band in (own, own - 1):
        if band < 0:
            continue
        first, last = edges[band], edges[band + 1] - 1
        if band != own and s * p > last * q:
            continue  # no set of the lower band is large enough
        d, e = allocate(first, most_different(last, last * q // p, p, q))
        here = most_different(s, s * q // p if band == own else s, p, q)
        m = d + e
        segment = (mixed % U64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        members, counts = mixed[order], np.bincount(segment, minlength=m)
        total = np.concatenate((np.zeros(1, U64), np.cumsum(members, dtype=U64)))
        ends = np.cumsum(counts)
        sums = total[ends] - total[ends - counts]
        base = mix(np.arange(m, dtype=U64) + U64((band + 1) << 40))
        # a segment of one or two tokens, or none, is too common as a key: it gives no credit
        credit = int((counts[:d] > 2).sum())
        if here - 2 * credit + 1 > 0:
            rank = np.lexsort((np.arange(e), -counts[d:]))[: here - 2 * credit + 1] + d
            out.append(mix(mix(base[rank] + sums[rank]) + counts[rank].astype(U64)) & EVEN)
        if d:
            i = np.flatnonzero(counts[:d] > 1)
            out.append(mix(mix(base[i] + sums[i]) + counts[i].astype(U64)) & EVEN)
            i = segment[order]
            inside = (i < d) & (counts[i] > 2)
            i = i[inside]
            out.append(mix(mix(base[i] + sums[i] - members[inside]) + (counts[i] - 1).astype(U64)) | U64(1))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U64)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in a power of two of places, two for each token or more.

    Two sets differ in at least as many tokens as their sketches differ in
    bits; the halves of a sketch, one upon the other, are the next smaller one.
    """
    places = max(1024, 1 << (2 * len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((mix(tokens + U64(77)) & U64(places - 1)).astype(np.int64), minlength=places) & 1).tobytes()


def _width(n: np.ndarray) -> np.ndarray:
    """Bytes of the sketches of sets of n tokens."""
    return np.maximum(128, 2 ** np.ceil(np.log2(2 * n)).astype(np.int64) // 8)


def set_digests(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch): digest and sketch are null for an empty set; equal sets share the 16 bytes of the digest."""

    def run(batches):
        for batch in batches:
            sets = [u for _, _, d, o in pieces(*buffers(batch.column(1))) for u in shingle_sets(d, o, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(u) for u in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None for u in sets], pa.binary()), pa.array([sketch(u) if len(u) else None for u in sets], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sketch"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, sketch binary")


def _packed(docs: DataFrame, text: str, n: int, p: int, q: int, parts: int) -> DataFrame:
    """(part, blob): keys dealt by value, for each run of documents and part one blob of sets (digest, size, number of keys) and their keys."""

    def run(batches):
        seen: set[bytes] = set()  # equal sets within a task write their keys once
        for batch in batches:
            for _, _, d, o in pieces(*buffers(batch.column(0))):
                heads, found = [], []
                for u in shingle_sets(d, o, n):
                    if len(u):
                        digest = xxhash.xxh3_128_digest(u.tobytes())
                        if digest not in seen:
                            seen.add(digest)
                            k = keys(u, p, q)
                            if len(k):
                                heads.append((digest, len(u)))
                                found.append(k)
                if not found:
                    continue
                of = np.repeat(np.arange(len(found)), [len(k) for k in found])
                every = np.concatenate(found)
                part = ((every >> U64(1)) % U64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                of, every, part = of[order], every[order], part[order]
                cuts = np.flatnonzero(np.diff(part)) + 1
                numbers, blobs = [], []
                for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                    which, counts = np.unique(of[a:b], return_counts=True)
                    head = np.zeros(len(which), HEAD)
                    head["digest"] = np.frombuffer(b"".join(heads[w][0] for w in which), np.uint8).reshape(-1, 16)
                    head["size"], head["keys"] = [heads[w][1] for w in which], counts
                    numbers.append(int(part[a]))
                    blobs.append(len(which).to_bytes(8, "little") + head.tobytes() + every[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return docs.select(text).mapInArrow(run, "part long, blob binary")


HEAD = np.dtype([("digest", np.uint8, 16), ("size", np.uint32), ("keys", np.uint32)])
NAME = np.dtype([("hi", np.uint64), ("lo", np.uint64)])
CANDIDATE = "key long, a binary, b binary, whole boolean, fits boolean"


def _buckets(frame: pd.DataFrame, p: int, q: int, small: int, block: int) -> pd.DataFrame:
    """Candidates of one part: pairs (key null) and the members of large buckets (b null), which may fit into a block."""
    heads, found = [], []
    for blob in frame["blob"]:
        n = int.from_bytes(blob[:8], "little")
        heads.append(np.frombuffer(blob, HEAD, n, 8))
        found.append(np.frombuffer(blob, U64, -1, 8 + n * HEAD.itemsize))
    head, every = np.concatenate(heads), np.concatenate(found)
    # the same set may come from several tasks
    names, ids = np.unique(np.ascontiguousarray(head["digest"]).view(NAME).ravel(), return_inverse=True)
    size = np.zeros(len(names), np.int64)
    size[ids] = head["size"]
    of = np.repeat(ids, head["keys"])
    part_of, every = (every & U64(1)).astype(np.int8), every & EVEN
    order = np.lexsort((of, part_of, every))
    of, every, part_of = of[order], every[order], part_of[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (every[1:] != every[:-1])
    of, every, part_of = of[fresh], every[fresh], part_of[fresh]
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(every)])))
    wholes = np.add.reduceat(1 - part_of, starts)  # they come first in their bucket; without any, it has no candidate
    left, right, big, fit = [], [], [], []
    for length in np.unique(lengths[(lengths > 1) & (wholes > 0)]).tolist():
        at = starts[(lengths == length) & (wholes > 0)]
        places = at[:, None] + np.arange(length)
        rows = of[places]
        if length <= small:
            i, j = np.triu_indices(length, 1)
            useful = part_of[places][:, i] == 0
            left.append(rows[:, i][useful])
            right.append(rows[:, j][useful])
        else:
            left.append(np.repeat(rows[:, 0], length - 1))
            right.append(rows[:, 1:].ravel())
            big.append(places.ravel())
            fit.append(np.repeat((length <= block) & (length * _width(size[rows].max(1)) <= BLOCK_BYTES), length))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    near = np.minimum(size[a], size[b]) * q >= np.maximum(size[a], size[b]) * p
    a, b = np.minimum(a, b)[near], np.maximum(a, b)[near]
    pair = np.unique(a * len(names) + b)
    a, b = pair // max(1, len(names)), pair % max(1, len(names))
    places = np.concatenate(big) if big else np.zeros(0, np.int64)
    flat = names.tobytes()
    raw = [flat[i : i + 16] for i in range(0, len(flat), 16)]
    return pd.DataFrame({
        "key": pd.array([None] * len(a) + every[places].view(np.int64).tolist(), "Int64"),
        "a": [raw[i] for i in a] + [raw[i] for i in of[places]],
        "b": [raw[i] for i in b] + [None] * len(places),
        "whole": [True] * len(a) + (part_of[places] == 0).tolist(),
        "fits": [True] * len(a) + (np.concatenate(fit).tolist() if fit else []),
    })


def _words(sketches, size: int) -> np.ndarray:
    """Sketches, folded to `size` bytes, as rows of 64-bit words."""
    out = []
    for x in sketches:
        v = np.frombuffer(x, U64)
        while len(v) * 8 > size:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out.append(v)
    return np.stack(out) if out else np.zeros((0, size // 8), U64)


def plausible(pairs: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b) of the pairs (a, b, na, nb, sa, sb) whose sketches allow the similarity; no linked pair is lost."""

    def run(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = batch.columns
            most = (na.to_numpy() + nb.to_numpy()) * (q - p) // (q + p)
            x, y = sa.to_pylist(), sb.to_pylist()
            size = np.array([min(len(u), len(v)) for u, v in zip(x, y, strict=True)], np.int64)
            apart = np.zeros(len(x), np.int64)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                apart[at] = np.bitwise_count(_words([x[i] for i in at], n) ^ _words([y[i] for i in at], n)).sum(1, dtype=np.int64)
            keep = pa.array(apart <= most)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


#: Rounds in which members of a large bucket only meet its pivots, and pivots of each side, before all that is left is compared.
ROUNDS, PIVOTS = 3, 2
#: Rows of a block at most, and bytes of its sketches.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
#: Bytes of sketches compared at once.
COMPARED = 16 << 20
#: Tasks of the last pass for each shuffle partition: its groups differ in size.
TASKS = 2
#: Texts of a file of candidates, on average.
TEXTS_A_FILE = 1_000


def _close(x: pd.DataFrame, y: pd.DataFrame, p: int, q: int):
    """(rows of x, rows of y, bits apart) of the plausible pairs of different components, some rows of x at a time."""
    size = min(x["sketch"].map(len).min(), y["sketch"].map(len).min())
    sx, sy = _words(x["sketch"], size), _words(y["sketch"], size)
    nx, ny, cx, cy, wx, wy = (f[c].to_numpy() for c in ("n", "c", "whole") for f in (x, y))
    step = max(1, min(32, COMPARED // (len(y) * int(size))))
    for at in range(0, len(x), step):
        s = slice(at, at + step)
        ok = (cx[s, None] != cy) & (wx[s, None] | wy) & (np.minimum(nx[s, None], ny) * q >= np.maximum(nx[s, None], ny) * p)
        r, c = np.nonzero(ok)
        apart = np.bitwise_count(sx[s][r] ^ sy[c]).sum(1, dtype=np.int64)
        good = apart <= (nx[s][r] + ny[c]) * (q - p) // (q + p)
        yield r[good] + at, c[good], apart[good]


def _across(frame: pd.DataFrame, p: int, q: int) -> pd.DataFrame:
    """Plausible pairs between two blocks of a large bucket whose members are in different components."""
    x, y = (frame[frame["block"] == frame[side].iloc[0]] for side in ("lo", "hi"))
    if x.empty or y.empty:
        return pd.DataFrame({"a": [], "b": []})
    r, c = (np.concatenate(z) for z in list(zip(*_close(x, y, p, q), strict=True))[:2])
    return pd.DataFrame({"a": x["a"].to_numpy()[r], "b": y["a"].to_numpy()[c]})


def _nearest(frame: pd.DataFrame, p: int, q: int) -> pd.DataFrame:
    """The members of a bucket with several components, each with the nearest plausible member of another one as b, or null."""
    if frame["c"].nunique() < 2:
        return frame[:0].drop(columns="c").assign(b=None)
    frame = frame.sort_values("a", ignore_index=True)
    ids, b = frame["a"].to_numpy(), np.full(len(frame), None, object)
    for r, c, apart in _close(frame, frame, p, q):
        order = np.lexsort((c, apart, r))
        r, c = r[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else []
        b[r[first]] = ids[c[first]]
    return frame.drop(columns="c").assign(b=b)


def _reached(frame: pd.DataFrame, p: int, q: int) -> pd.DataFrame:
    """Of `_nearest` the members with a partner.

    They hold all plausible pairs of different components that the bucket has
    now or later: both sides of such a pair have a partner, merged components
    only take pairs away, and so do the wider sketches of the members left.
    """
    met = _nearest(frame, p, q)
    return met[met["b"].notna()]


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@lru_cache(32)
def _exact_set(text: str, n: int) -> frozenset:
    w = _WORDS.findall(text.translate(_LOWER))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False))


def verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, n: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) of document ids whose shingle sets, as words, have Jaccard >= p / q."""
    many = pairs.count()
    wanted = pairs.select("a").union(pairs.select("b")).distinct()
    near = docs.where(may_hold(docs.sparkSession, bloom(wanted), F.col(doc_id))).select(F.col(doc_id).alias("a"), F.col(text).alias("_a"))
    texts = materialise(near.join(wanted, "a", "left_semi").dropDuplicates(["a"]).coalesce(files(2 * many, TEXTS_A_FILE)), "candidates")

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                s, t = _exact_set(x or "", n), _exact_set(y or "", n)
                shared = len(s & t)
                if shared * q >= p * (len(s) + len(t) - shared) and shared:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    both = pairs.join(texts, "a").join(texts.select(F.col("a").alias("b"), F.col("_a").alias("_b")), "b").select("a", "b", "_a", "_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return gathered(both.mapInArrow(run, f"a {kind}, b {kind}"), many)


def _grouped(rows: DataFrame, labels: DataFrame):
    """The rows (key, a, whole, n, sketch) of buckets that fit into a block, with their component c, grouped by bucket."""
    tasks = TASKS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _labelled(rows, labels).repartition(tasks, "key").groupBy("key")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("c", F.coalesce("component", "a")).drop("component")


def _mixed(rows: DataFrame, labels: DataFrame, number: int = 0) -> DataFrame:
    """Members (key, a, whole, n, sketch) of the buckets with several components.

    c: a member's component; inner: whether it is the bucket's largest; m,
    inside, wide: the bucket's members, those inside, its widest sketch;
    pivots: the members that a hash of this round picks, `PIVOTS` inside the
    largest component and as many outside.
    """
    known = _labelled(rows, labels)
    member = lambda k: F.struct(F.xxhash64("a", F.lit(number * PIVOTS + k)).alias("h"), "a", "n", "c", "whole", "sketch")
    parts = known.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"), F.max(F.octet_length("sketch")).alias("wide"), *[F.min(member(k)).alias(f"p{k}") for k in range(PIVOTS)])
    main = parts.groupBy("key").agg(F.max(F.struct("k", "c")).alias("main"), F.sum("k").alias("m"), F.max("wide").alias("wide")).where("m > main.k")
    outside = lambda k: F.min(F.when(F.col("c") != F.col("main.c"), F.col(f"p{k}")))
    inside = lambda k: F.min(F.when(F.col("c") == F.col("main.c"), F.col(f"p{k}")))
    both = parts.drop("wide").join(main, "key").groupBy("key", "main", "m", "wide").agg(F.array(*[side(k) for k in range(PIVOTS) for side in (inside, outside)]).alias("pivots"))
    cuts = both.select("key", F.col("main.c").alias("main"), F.col("main.k").alias("inside"), "m", "wide", "pivots")
    # as a table of its own: Spark knows its size, and may split a hot key of the other side
    return materialise(known.join(materialise(cuts, "cuts"), "key").withColumn("inner", F.col("c") == F.col("main")).drop("main"), "mixed")


def _near_pivots(mixed: DataFrame, p: int, q: int) -> DataFrame:
    """Plausible pairs (a, b): each member with the nearest pivot of another component in any of its buckets.

    Every row only meets its bucket's pivots, so the work grows with the
    rows, and no bucket has to be in one place.
    """
    far = lambda s: (s["c"] != F.col("c")) & (s["whole"] | F.col("whole")) & (F.least(s["n"], F.col("n")) * q >= F.greatest(s["n"], F.col("n")) * p)
    met = mixed.select("a", "n", "sketch", F.filter("pivots", far).alias("pivots")).where(F.size("pivots") > 0)
    met = met.withColumn("most", F.transform("pivots", lambda s: F.expr("n") + s["n"])).select("a", "sketch", "most", F.transform("pivots", lambda s: s["a"]).alias("b"), F.transform("pivots", lambda s: s["sketch"]).alias("there"))

    def run(batches):
        for batch in batches:
            a, b, apart = [], [], []
            for x, s, sums, others, there in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best = None
                for n, y, t in zip(sums, others, there, strict=True):
                    u, v = _words([s, t], min(len(s), len(t)))
                    d = int(np.bitwise_count(u ^ v).sum())
                    if d <= n * (q - p) // (q + p) and (best is None or (d, y) < best):
                        best = d, y
                if best:
                    a.append(x)
                    b.append(best[1])
                    apart.append(best[0])
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(apart, pa.int64())], names=["a", "b", "apart"])

    kind = mixed.schema["a"].dataType.simpleString()
    return met.mapInArrow(run, f"a {kind}, b {kind}, apart long").groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))


def _between(mixed: DataFrame, p: int, q: int) -> DataFrame:
    """All plausible pairs (a, b) of different components within the buckets.

    Only members outside a bucket's largest component are compared: with that
    component and with each other.  Both sides are cut into blocks, and each
    pair of blocks is a group of its own, dealt by all three of (key, lo, hi):
    one hot bucket is spread over as many tasks as it has pairs of blocks.
    """
    size = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(BLOCK_BYTES / F.col("wide"))))
    blocks = lambda n: F.ceil(n / size).cast("int")
    dealt = mixed.withColumns({"outside": blocks(F.col("m") - F.col("inside")), "blocks": blocks(F.col("inside"))})
    place = F.xxhash64("a")
    dealt = dealt.withColumn("block", F.when(F.col("inner"), F.col("outside") + F.pmod(place, "blocks")).otherwise(F.pmod(place, "outside")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("outside") - 1 + F.when(F.col("inner"), 0).otherwise(F.col("blocks")))))
    dealt = dealt.select("key", "a", "whole", "n", "sketch", "c", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    tasks = TASKS * int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = mixed.schema["a"].dataType.simpleString()
    return dealt.repartition(tasks, "key", "lo", "hi").groupBy("key", "lo", "hi").applyInPandas(lambda f: _across(f, p, q), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs: texts link when 100 * intersection >= percent * union of their n-word shingles."""
    p, q = percent, 100
    base = materialise(set_digests(docs, doc_id, text, n), "sets")
    total, rows = base.agg(F.sum("n_shingles"), F.count(F.lit(1))).first()
    total = total or 0
    first = F.min(F.struct("doc_id", "n_shingles", "sketch"))
    classes = materialise(base.where("digest is not null and doc_id is not null").groupBy("digest").agg(first.alias("f")).select("digest", F.col("f.doc_id").alias("rep"), F.col("f.n_shingles").alias("n"), F.col("f.sketch").alias("sketch")).coalesce(files(rows)), "classes")
    parts = 12 + total // 3 // KEYS_A_TASK
    small, block = SMALL, BLOCK
    found = materialise(_packed(docs, text, n, p, q, parts).repartition(parts, "part").groupBy("part").applyInPandas(lambda f: _buckets(f, p, q, small, block), CANDIDATE), "buckets")

    def known(column: str) -> DataFrame:
        return classes.select(F.col("digest").alias(column), F.col("rep").alias("r" + column), F.col("n").alias("n" + column), F.col("sketch").alias("s" + column))

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()

    found_pairs, members = found.agg(F.count(F.when(F.col("key").isNull(), 1)), F.count("key")).first()
    pairs = found.where("key is null").select("a", "b").distinct().join(known("a"), "a").join(known("b"), "b")
    pairs = materialise(ordered(plausible(pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "na", "nb", "sa", "sb"), p, q)).coalesce(files(found_pairs)), "pairs")
    links = materialise(verified(pairs, docs, doc_id, text, n, p, q), "links")
    labels = components(links)
    large = found.where("key is not null")
    if members:
        large = large.select("key", "a", "whole", "fits").join(known("a"), "a").select("key", F.col("ra").alias("a"), "whole", F.col("na").alias("n"), F.col("sa").alias("sketch"), "fits")
        large = materialise(large.coalesce(files(members)), "large")
        narrow, wide = (large.where(F.col("fits") == fits).drop("fits") for fits in (True, False))
        wide = None if wide.isEmpty() else _mixed(wide, labels)
        kind = large.schema["a"].dataType.simpleString()
        member = f"key long, a {kind}, whole boolean, n long, sketch binary, b {kind}"
        tried, number = pairs, 0
        while True:
            if number < ROUNDS:
                met = materialise(gathered(_grouped(narrow, labels).applyInPandas(lambda f: _reached(f, p, q), member), members), "nearest")
                near, narrow = met.select("a", "b"), met.drop("b")
                near = near if wide is None else near.union(_near_pivots(wide, p, q))
            else:
                near = _grouped(narrow.withColumns({"block": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)}), labels).applyInPandas(lambda f: _across(f, p, q), f"a {kind}, b {kind}")
                near = near if wide is None else near.union(_between(wide, p, q))
            rest = ordered(near).join(tried, ["a", "b"], "left_anti")
            rest = materialise(rest.coalesce(files(2 * members)) if number < ROUNDS else rest, "rest")
            fresh = None if rest.isEmpty() else materialise(verified(rest, docs, doc_id, text, n, p, q), "links")
            linked = fresh is not None and not fresh.isEmpty()
            if linked:
                links = links.union(fresh)
                labels = components(links)
            if number >= ROUNDS:
                break
            if linked and wide is not None:
                wide = _mixed(wide.select("key", "a", "whole", "n", "sketch"), labels, number + 1)
            # a round that links nothing: the members left are apart, or few
            tried, number = tried.union(rest), number + 1 if linked else ROUNDS
    # as a table of its own, so that Spark can split a digest that very many rows share
    named = materialise(classes.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id")).coalesce(files(rows)), "named")
    return base.drop("sketch").join(named, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the row with the component's id stays, one if it is repeated; rows without an id or words all stay."""
    found = near_duplicates(docs, doc_id, text, n, percent).where("n_shingles > 0 and doc_id is not null")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, F.col(doc_id) == F.col("_gone"), "left_anti")
    twice = materialise(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice")), "twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, F.col(doc_id) == F.col("_twice"), "left_semi").dropDuplicates([doc_id])
    return kept.join(twice, F.col(doc_id) == F.col("_twice"), "left_anti").unionByName(once)
