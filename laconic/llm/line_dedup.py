"""Repeated runs of lines across documents, found by winnowing.

Lines are stripped and hashed; blank lines do not count.  A window is the
shortest stretch of consecutive lines, from a line on or up to a line, that
has at least `min_words` words.  Every window selects its smallest line
hash: windows with equal lines select the same one, so a repeated run of
that many words is certain to share a fingerprint.

1. Each text gives its selected positions, one row for each change of the
   minimum, with the lines around it that its windows reach.
2. Positions whose fingerprint occurs only once are done with; the others
   are joined by fingerprint, and their windows, each known by a hash of all
   its lines, meet their first occurrence (smallest id, then line).
3. Matches are extended both ways, line by line: the next line belongs to a
   run if the shortest window that ends (or begins) with it occurred before,
   too.  What such runs cover is deleted from all but the place where it came
   first.

Nothing pairs the members of a group: each occurrence meets the first one
only, so a passage that a third of all documents share costs as many rows
as it has occurrences, spread by Spark's skew join.

Defined results: null and empty texts have no lines and come back as they
are, and so do rows without an id, which take no part; two rows with one id
are the same place, so neither is later than the other at the same line, but
runs are deleted from the text in which they were found; other columns are kept, and the added ones replace their namesakes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laconic.llm.common import materialise

MIN_WORDS = 50


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, stripped line) of the lines that are not blank."""
    return [(i, s) for i, x in enumerate(text.split("\n")) if (s := x.strip())]


def windows(counts: list[int], least: int) -> list[tuple[int, int]]:
    """(first, end) of the shortest windows of at least `least` words: forward from each line, and back from each line."""
    total = np.concatenate(([0], np.cumsum(counts)))
    n = len(counts)
    if total[-1] < least:
        return []
    end = np.searchsorted(total, total[:-1] + least, side="left")
    first = np.searchsorted(total, total[1:] - least, side="right") - 1
    found = {(i, int(e)) for i, e in enumerate(end) if e <= n}
    return sorted(found | {(int(f), j + 1) for j, f in enumerate(first) if f >= 0 and total[j + 1] >= least})


def selected(found: list[tuple[int, int]], hashes: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(position, its windows): each window selects its smallest line hash, the first one if it is repeated; windows ascend, so a position's are neighbours."""
    out: list[tuple[int, list[tuple[int, int]]]] = []
    for a, b in found:
        at = a + int(hashes[a:b].argmin())
        if not out or out[-1][0] != at:
            out.append((at, []))
        out[-1][1].append((a, b))
    return out


def _positions(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(print, doc_id, digest, lines, numbers, spans): fingerprint, the text's digest; hashes and numbers of the lines from the first to the last that its windows reach, and the windows as pairs of places in them."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, t, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = lines_of(t or "")
                found = windows([len(s.split()) for _, s in lines], least)
                if not found:
                    continue
                hashes = np.array([xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) for _, s in lines], np.uint64).view(np.int64)
                numbers = np.array([k for k, _ in lines], np.int32)
                for at, its in selected(found, hashes):
                    a, b = its[0][0], its[-1][1]
                    rows.append((int(hashes[at]), i, digest, hashes[a:b].tobytes(), numbers[a:b].tobytes(), (np.array(its, np.int32) - a).tobytes()))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), batch.column(0).type, pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["print", "doc_id", "digest", "lines", "numbers", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.where(F.col(doc_id).isNotNull()).select(doc_id, text, F.xxhash64(text)).mapInArrow(run, f"print long, doc_id {kind}, digest long, lines binary, numbers binary, spans binary")


def _windows(positions: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, digest, first, last): the windows of positions, each with a 128-bit hash of its lines and its lines' numbers."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, digest, lines, numbers, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(numbers, np.int32)
                for a, b in np.frombuffer(spans, np.int32).reshape(-1, 2).tolist():
                    key = xxhash.xxh3_128_digest(lines[8 * a : 8 * b])
                    rows.append((int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), i, digest, int(n[a]), int(n[b - 1])))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), batch.column(0).type, pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["k1", "k2", "doc_id", "digest", "first", "last"])

    kind = positions.schema["doc_id"].dataType.simpleString()
    return positions.select("doc_id", "digest", "lines", "numbers", "spans").mapInArrow(run, f"k1 long, k2 long, doc_id {kind}, digest long, first long, last long")


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, digest, first, last): text (its xxhash64) and line numbers of the windows that occurred before, in an earlier place."""
    positions = materialise(_positions(docs, doc_id, text, min_words), "positions")
    shared = materialise(positions.groupBy("print").count().where("count > 1").select("print"), "shared")
    left = materialise(_windows(positions.join(shared, "print", "left_semi")), "windows")
    origin = left.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "first")).alias("origin"), F.max(F.struct("doc_id", "first")).alias("final")).where("origin < final").drop("final")
    # as a table of its own, so that Spark can split the other side of a hot passage
    later = left.join(materialise(origin, "origins"), ["k1", "k2"]).where(F.struct("doc_id", "first") > F.col("origin"))
    return later.select("doc_id", "digest", "first", "last")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later repeated runs deleted from the text, and n_lines, n_removed (lines).

    Lines that stay keep their bytes.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")])
    names = docs.columns
    spans = repeated_runs(docs, doc_id, text, min_words).groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.collect_list(F.struct("first", "last")).alias("_spans"))
    joined = docs.join(spans, (docs[doc_id] == spans["_id"]) & (F.xxhash64(docs[text]) == spans["_digest"]), "left").select(*[docs[c] for c in names], "_spans")
    at = names.index(text)

    def run(batches):
        for batch in batches:
            texts, counts, removed = [], [], []
            for t, found in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines = (t or "").split("\n") if t else []
                gone = {k for s in found or () for k in range(s["first"], s["last"] + 1) if lines[k].strip()} if lines else set()
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t)
                counts.append(len(lines))
                removed.append(len(gone))
            columns = [*batch.columns[:-1]]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "n_lines long, n_removed long"])
    return joined.mapInArrow(run, schema)
