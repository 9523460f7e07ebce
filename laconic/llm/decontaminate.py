"""Benchmark decontamination with suffix arrays over the training text.

Letters are windows: two positions have the same letter if the same words
follow them, compared word by word on their bytes.  A match of w + k words
is a match of k + 1 letters, so suffixes over these letters say all about
matches of a window or more.

* Each task cuts its documents into shards of a few MB.  A shard's suffix
  array is sparse: it keeps the training suffixes whose first window passes
  a filter of the benchmark's windows.  No match is lost, as every suffix of
  a match that is a window long or longer passes.  The suffixes are sorted
  by prefix doubling, over all their letters, in numpy.
* Every test suffix that can occur (the shard's letters are looked up among
  the test suffixes, the smaller side in the larger) is binary-searched in
  the shard's array: the range that shares its first letter are the
  occurrences of its window, all of whose words are hit.
* Training suffixes find their places among the test suffixes in the same
  order; the neighbours there have the longest common prefixes, which are
  each document's longest verbatim matches, with their places.

The pass is narrow: documents are neither shuffled nor collected.  The
benchmark travels as blocks of `BLOCK_BYTES` of text at most (a longer item
is a block by itself), which take about 16 bytes for each byte of text
while they are made and 7 in a worker; after each `CHAINED` blocks the
documents are written with their hits so far, so no more workers than that
stand in a row.

Defined results: a null or wordless text has no words and no hit; a null or
wordless item never occurs; a row that is repeated in the benchmark is one
item; rows with equal ids are scored on their own; of equally long matches
the first one in the document counts, and of its items the first by code
point; all columns of the input stay untouched, but for those with the
names of the added ones, which are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laconic.llm.common import materialise
from laconic.llm.tokens import ALNUM, Words, buffers, grams, pieces

#: Most bytes of benchmark text that one block carries, and blocks between two written tables.
BLOCK_BYTES = 16 << 20
CHAINED = 3
SHARD_BYTES = 4 << 20
TABLE_BITS = 20

MATCH = {"longest_match": "long", "match_start": "long", "match_item": "string", "match_at": "long"}
FIELDS = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", **MATCH, "contaminated": "boolean"}


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers start, start + 1, ... of each range."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Letters:
    """The windows of one size in a block of items, sorted by letter."""

    def __init__(self, size: int, h: np.ndarray, ids: np.ndarray, at: np.ndarray):
        g = grams(h, size)[at]
        order = np.lexsort((*(ids[at + j] for j in reversed(range(size))), g))
        self.size, self.at, g = size, at[order], g[order]
        other = np.ones(len(at), bool)
        other[1:] = g[1:] != g[:-1]
        for j in range(size):
            other[1:] |= ids[self.at[1:] + j] != ids[self.at[:-1] + j]
        self.starts = np.append(np.flatnonzero(other), len(at))  # of each letter in `at`
        first = g[self.starts[:-1]]
        self.hashes, self.first = np.unique(first, return_index=True)  # letters of one hash follow each other
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def suffixes(self, g: np.ndarray) -> np.ndarray:
        """Positions whose window may be one of these."""
        return np.flatnonzero(self.table[(g >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])

    def of(self, g: np.ndarray, ids: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The letter at each position `at` (ids: word ids there; own: those of the items), or -1."""
        slot = np.minimum(np.searchsorted(self.hashes, g[at]), len(self.hashes) - 1)
        out = np.full(len(at), -1, np.int64)
        last = np.append(self.first[1:], len(self.starts) - 1)
        letter, left = self.first[slot], np.flatnonzero(self.hashes[slot] == g[at])
        while len(left):
            there = self.at[self.starts[letter[left]]]
            same = np.ones(len(left), bool)
            for j in range(self.size):
                same &= ids[at[left] + j] == own[there + j]
            out[left[same]] = letter[left[same]]
            left = left[~same]
            letter[left] += 1
            left = left[letter[left] < last[slot[left]]]
        return out


class Tests:
    """The test side: all suffixes of a block of items that begin with a whole window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw = [t.encode("utf-8", "surrogatepass") for _, t in items]
        w = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), ALNUM)
        counts, h, text = np.diff(w.doc_start), w.hashes(), w.low.tobytes()
        self.start = w.doc_start
        self.item = np.repeat(np.arange(len(items)), counts)
        self.names = sorted({i for i, _ in items})
        place = {n: k for k, n in enumerate(self.names)}
        self.name = np.array([place[i] for i, _ in items], np.int64)
        self.words: dict[int, dict[bytes, int]] = {}  # hash -> word -> id
        ids, n = [], 0
        for x, a, b in zip(h.tolist(), w.start.tolist(), w.end.tolist(), strict=True):
            same = self.words.setdefault(x, {})
            k = same.get(text[a:b])
            if k is None:
                same[text[a:b]] = k = n
                n += 1
            ids.append(k)
        self.ids = np.array(ids, np.int32)
        sizes, within = np.minimum(counts, window)[self.item], np.arange(len(h)) - w.doc_start[self.item]
        begins = within + sizes <= counts[self.item]
        self.letters = [Letters(int(s), h, self.ids, np.flatnonzero(begins & (sizes == s))) for s in np.unique(sizes)]

    def numbers(self, w: Words, h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The ids of the wanted words of a shard, compared on their bytes; -1 for unknown words and those not asked for."""
        out, text = np.full(len(h), -1, np.int32), w.low
        for k in np.flatnonzero(wanted).tolist():
            same = self.words.get(int(h[k]))
            if same:
                out[k] = same.get(text[w.start[k] : w.end[k]].tobytes(), -1)
        return out


def _strings(at: np.ndarray, owner: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters with a 0 after each run, place of each position there): a run is a stretch of neighbouring positions of one owner."""
    last = np.ones(len(at), bool)
    last[:-1] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(last)[:-1]))
    out = np.zeros(len(at) + int(last.sum()), np.int64)
    out[place] = letter + 1
    return out, place


class Order:
    """Suffixes of a text of runs, ranked by prefix doubling; a run's end (0) comes before every letter."""

    def __init__(self, text: np.ndarray):
        ends = np.flatnonzero(text == 0)
        self.left = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))  # letters up to the end of the run
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.levels, step, most = [rank], 1, int(self.left.max(initial=0))
        while step < most:
            after = np.zeros_like(rank)
            after[:-step] = rank[step:]
            rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
            rank[ends] = 0
            self.levels.append(rank)
            step *= 2

    @property
    def rank(self) -> np.ndarray:
        return self.levels[-1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that the suffixes i and j have in common."""
        n = np.zeros(len(i), np.int64)
        for k, rank in reversed(list(enumerate(self.levels))):
            last = len(rank) - 1
            n += (rank[np.minimum(i + n, last)] == rank[np.minimum(j + n, last)]).astype(np.int64) << k
        return np.minimum(n, np.minimum(self.left[i], self.left[j]))


class Found:
    """What a shard's documents share with a block."""

    def __init__(self, words: int):
        self.edge = np.zeros(words + 1, np.int64)
        self.items: list[np.ndarray] = [np.zeros((0, 2), np.int64)]  # (document, name)
        self.best: dict[int, tuple[int, int, str, int]] = {}  # document -> (words, start, item, place in the item)


def _match(letters: Letters, tests: Tests, at: np.ndarray, letter: np.ndarray, doc: np.ndarray, first: np.ndarray, out: Found) -> None:
    """at: training positions that begin a window, ascending; doc: their documents; first: the first word of each document."""
    size = letters.size
    present = np.unique(letter)
    counts = letters.starts[present + 1] - letters.starts[present]
    there = letters.at[_ranges(letters.starts[present], counts)]
    test_letter = np.repeat(present, counts)
    order = np.argsort(there)
    there, test_letter = there[order], test_letter[order]
    x, train = _strings(at, doc, letter)
    y, test = _strings(there, tests.item[there], test_letter)
    both, test = Order(np.concatenate((x, y))), test + len(x)
    # the suffix array of the shard, and the place of every test suffix in it
    array = train[np.argsort(both.rank[train], kind="stable")]
    heads = both.levels[0]
    lo, hi = (np.searchsorted(heads[array], np.unique(heads[test]), side=s) for s in ("left", "right"))
    occurs = np.sort(np.searchsorted(train, array[_ranges(lo, hi - lo)]))
    np.add.at(out.edge, at[occurs], 1)
    np.add.at(out.edge, at[occurs] + size, -1)
    pair = np.unique(doc * (int(present.max()) + 1) + letter)
    d, c = pair // (int(present.max()) + 1), pair % (int(present.max()) + 1)
    n = letters.starts[c + 1] - letters.starts[c]
    named = tests.name[tests.item[letters.at[_ranges(letters.starts[c], n)]]]
    out.items.append(np.unique(np.column_stack((np.repeat(d, n), named)), axis=0))
    # longest common prefixes: with the neighbours among the sorted test suffixes
    array = test[np.argsort(both.rank[test], kind="stable")]
    place = np.searchsorted(both.rank[array], both.rank[train])
    long = np.maximum(both.common(train, array[np.maximum(place - 1, 0)]), both.common(train, array[np.minimum(place, len(array) - 1)]))
    order = np.lexsort((at, -long, doc))
    for k in order[np.concatenate(([True], np.diff(doc[order]) != 0))].tolist():
        j = np.flatnonzero(test_letter == letter[k])
        j = j[both.common(np.full(len(j), train[k]), test[j]) == long[k]]
        item = tests.item[there[j]]
        name, inside = min(zip(tests.name[item].tolist(), (there[j] - tests.start[item]).tolist(), strict=True))
        found = (int(long[k]) + size - 1, int(at[k] - first[doc[k]]), tests.names[name], inside)
        out.best[int(doc[k])] = better(out.best.get(int(doc[k])), found)


def better(x: tuple | None, y: tuple | None) -> tuple | None:
    """The longer of two matches (words, start, item, place in the item); then the first by the rest."""
    if x is None or y is None:
        return x or y
    return min(x, y, key=lambda m: (-m[0], *m[1:]))


def score(data: np.ndarray, offsets: np.ndarray, tests: Tests) -> list[tuple[np.ndarray, list[str], tuple | None]]:
    """For each document of a shard: which words are hit, which items occur (sorted), its longest match."""
    w = Words(data, offsets, ALNUM)
    h, n_docs = w.hashes(), len(offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(w.doc_start))
    last = w.doc_start[1:][doc] if len(h) else doc
    out, kept, wanted = Found(len(h)), [], np.zeros(len(h) + 1, np.int64)
    for letters in tests.letters:
        g = grams(h, letters.size)
        at = letters.suffixes(g)
        at = at[at + letters.size <= last[at]]
        slot = np.minimum(np.searchsorted(letters.hashes, g[at]), len(letters.hashes) - 1)
        at = at[letters.hashes[slot] == g[at]]
        np.add.at(wanted, at, 1)
        np.add.at(wanted, at + letters.size, -1)
        kept.append((letters, g, at))
    ids = tests.numbers(w, h, np.cumsum(wanted[:-1]) > 0)
    for letters, g, at in kept:
        letter = letters.of(g, ids, at, tests.ids)
        at, letter = at[letter >= 0], letter[letter >= 0]
        if len(at):
            _match(letters, tests, at, letter, doc[at], w.doc_start, out)
    hit = np.cumsum(out.edge[:-1]) > 0
    pairs = np.unique(np.concatenate(out.items), axis=0)
    edges = np.searchsorted(pairs[:, 0], np.arange(n_docs + 1))
    return [(hit[a:b], [tests.names[k] for k in pairs[edges[d] : edges[d + 1], 1]], out.best.get(d)) for d, (a, b) in enumerate(zip(w.doc_start[:-1], w.doc_start[1:], strict=True))]


def _column(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, the longest match and contaminated.

    A window is `window` consecutive item words; an item of fewer words is
    one window.  A document word inside any occurrence of a window is hit.
    longest_match: words of the longest verbatim match of a window or more
    (0: none), match_start: its first word in the document, match_item and
    match_at: its item and first word there (from 0).
    """
    keep = [c for c in docs.columns if c not in FIELDS]
    docs = docs.select(*keep)
    source = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    size = source.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    spark, state = docs.sparkSession, _column("_state", keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    carried = f"{schema}, `{state}` struct<mask:binary, items:array<string>, {', '.join(f'{k}:{v}' for k, v in MATCH.items())}>"
    for b in range(blocks):
        rows = source.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect() if size else []
        held = spark.sparkContext.broadcast(Tests([(r.i, r.t) for r in rows], window))
        final = b == blocks - 1
        docs = docs.mapInArrow(_pass(held, keep, text, state, b == 0, final), ", ".join([schema, *(f"`{k}` {v}" for k, v in FIELDS.items())]) if final else carried)
        if not final and b % CHAINED == CHAINED - 1:
            docs = materialise(docs, "hits")
    return docs


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _pass(held, keep: list[str], text: str, state: str, first: bool, final: bool):
    """One block of the benchmark against all documents; what earlier blocks found rides along."""

    def joined(found: tuple, before: dict) -> tuple:
        hit, names, best = found
        hit = hit | np.unpackbits(np.frombuffer(before["mask"], np.uint8), count=len(hit)).astype(bool)
        earlier = tuple(before[k] for k in MATCH) if before["longest_match"] else None
        return hit, sorted({*names, *before["items"]}), better(earlier, best)

    def run(batches):
        tests = held.value
        for batch in batches:
            base = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
            found = [x for _, _, d, o in pieces(data, offsets, SHARD_BYTES) for x in score(d, o, tests)]
            if not first:
                found = [joined(x, s) for x, s in zip(found, batch.column(len(keep)).to_pylist(), strict=True)]
            matches = {k: [(best or (0, None, None, None))[j] for _, _, best in found] for j, k in enumerate(MATCH)}
            if not final:
                rows = [{"mask": np.packbits(hit).tobytes(), "items": names, **{k: v[i] for k, v in matches.items()}} for i, (hit, names, _) in enumerate(found)]
                kind = pa.struct([("mask", pa.binary()), ("items", pa.list_(pa.string())), *((k, _ARROW[v]) for k, v in MATCH.items())])
                extra = {state: pa.array(rows, kind)}
            else:
                n_hit = [int(hit.sum()) for hit, _, _ in found]
                values = {"n_words": [len(hit) for hit, _, _ in found], "n_hit": n_hit, "n_items": [len(s) for _, s, _ in found], "items_sha256": [hashlib.sha256(",".join(s).encode()).hexdigest() for _, s, _ in found], **matches, "contaminated": [x > 0 for x in n_hit]}
                extra = {k: pa.array(values[k], _ARROW[v]) for k, v in FIELDS.items()}
            yield pa.RecordBatch.from_arrays([*base, *extra.values()], names=[*keep, *extra])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with all their own columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    return contamination(rows, benchmark, text="_text", **options).where(~F.col("contaminated")).select("_row.*")
