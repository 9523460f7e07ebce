"""Canonical exact digests of documents.

The canonical form is NFKC, case-folded, NFKC again, with runs of white
space as one blank and none at the ends.  Its digest is 128 bits of xxh3,
as 32 hex digits.  Inside buckets of equal digests the canonical bytes are
compared: should two differ, the later ones (in byte order) get a suffix
`-1`, `-2`, ..., so equal fingerprints mean equal canonical texts.  A Bloom
filter of fixed size, made from the digests that occur twice, picks the
texts that need comparing; it can only let too many through.

`with_successor` pairs each document with the next one by ascending id:
documents are dealt by ranges of the id, the first of each range goes to
the range before it as well, and every task walks its sorted ranges once.
Texts are shuffled once and never gathered.

Defined results: a null text is the empty text, and all empty texts share a
fingerprint; rows with a null id come first; rows of equal ids follow each
other in order of their texts; a single row is its own successor.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from laconic.llm.common import bloom, materialise, may_hold

#: Rows of a range of ids, and most ranges.
RANGE_ROWS = 4_000
MOST_RANGES = 20_000


def canonical(text: str | None) -> str:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.casefold().split())


def digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def _ranges(docs: DataFrame, doc_id: str) -> tuple[np.ndarray, int]:
    """Upper ids of the ranges and their number; bounded by MOST_RANGES."""
    rows = docs.count()
    n = min(MOST_RANGES, rows // RANGE_ROWS + 1)
    if n == 1:
        return np.zeros(0, np.int64), 1
    cuts = docs.agg(F.percentile_approx(doc_id, [i / n for i in range(1, n)], 10 * n).alias("c")).first().c
    edges = np.unique(np.array(cuts or [], np.int64))  # no cuts: all ids are null
    return edges, len(edges) + 1


def with_successor(docs: DataFrame, doc_id: str, text: str, work, schema: str) -> DataFrame:
    """work(id, text, next text) -> a tuple of schema for each row of docs; ids are whole numbers."""
    docs = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    edges, n = _ranges(docs, "_id")

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int64)
        out[known] = np.searchsorted(edges, ids[known].astype(np.int64), side="left")
        return pd.Series(out)

    dealt = docs.withColumn("_range", range_of("_id"))
    firsts = sorted((r[0], r[1]) for r in dealt.select("_range", "_id").groupBy("_range").agg(F.min(F.struct(F.col("_id").isNotNull().alias("k"), F.col("_id").alias("i"))).alias("m")).select("_range", "m.i").collect())
    before = {(None if i is None else int(i)): int(firsts[k - 1][0]) for k, (_, i) in enumerate(firsts)}
    starts = np.array(sorted(i for i in before if i is not None), np.int64)
    targets = np.array([before[int(i)] for i in starts], np.int64)
    null_target = before.get(None)

    @F.pandas_udf("long")
    def sent_before(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), -1 if null_target is None else null_target, np.int64)
        if known.any():
            v = ids[known].astype(np.int64).to_numpy()
            at = np.minimum(np.searchsorted(starts, v), max(0, len(starts) - 1))
            out[known] = np.where(starts[at] == v, targets[at], -1) if len(starts) else -1
        return pd.Series(out)

    # own rows sort before the row of the next range
    places = F.when(F.col("_before") >= 0, F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest"))))
    dealt = dealt.withColumn("_before", sent_before("_id")).select("_id", "_text", F.explode(places).alias("_p")).select("_p.r", "_p.guest", "_id", "_text")
    dealt = dealt.repartition(max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "r").sortWithinPartitions("r", "guest", "_id", "_text")
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    types = pa.schema([(name, arrow[kind]) for name, kind in (x.split() for x in schema.split(","))])

    def run(batches):
        held = None  # an own row that waits for its successor
        out = []
        for batch in batches:
            for r, guest, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == r:
                    out.append(work(held[1], held[2], t or ""))
                    held = None
                if not guest:
                    held = r, i, t or ""
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for f, x in zip(types, zip(*out, strict=True), strict=True)], schema=types)
                out = []

    return dealt.mapInArrow(run, schema)


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the front of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(doc_id, text: str, following: str) -> tuple:
    edited = edit(text, following)
    own, changed, other = canonical(text), canonical(edited), canonical(following)
    fingerprint, edited_fingerprint = digest(own), digest(changed)
    if changed != own and edited_fingerprint == fingerprint:
        edited_fingerprint += "-1"
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint, edited_fingerprint, float(own == changed), float(own == other)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, form) of each row."""

    def run(batches):
        for batch in batches:
            forms = [canonical(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(f) for f in forms], pa.string()), pa.array(forms, pa.string())], names=["doc_id", "digest", "form"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, digest string, form string")


def collisions(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(digest) of the buckets that hold more than one canonical text, byte by byte; found: a column digest of all rows.

    Copies within a task are one row before the shuffle.
    """
    repeated = found.groupBy("digest").count().where("count > 1")
    held = may_hold(docs.sparkSession, bloom(repeated.select("digest")), F.col("digest"))
    forms = digests(docs, doc_id, text).where(held).select("digest", "form").distinct()
    return forms.groupBy("digest").count().where("count > 1").select("digest")


def _told_apart(docs: DataFrame, rows: DataFrame, clash: DataFrame, doc_id: str, text: str) -> DataFrame:
    forms = materialise(digests(docs, doc_id, text).join(clash, "digest", "left_semi"), "forms")
    rank = forms.select("digest", "form").distinct().withColumn("rank", F.row_number().over(W.partitionBy("digest").orderBy("form")) - 1)
    named = forms.join(rank, ["digest", "form"]).groupBy("doc_id", "digest").agg(F.min("rank").alias("rank"))
    joined = rows.join(named, rows["doc_id"].eqNullSafe(named["doc_id"]) & (rows["digest"] == named["digest"]), "left").select(*[rows[c] for c in rows.columns], "rank")
    told = F.when(F.col("rank") > 0, F.concat("digest", F.lit("-"), F.col("rank").cast("string"))).otherwise(F.col("digest"))
    return joined.withColumn("digest", told).drop("rank").withColumnRenamed("digest", "fingerprint")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = "doc_id long, n_chars long, edited_sha256 string, digest string, edited_fingerprint string, near_edited double, near_next double"
    rows = materialise(with_successor(docs, doc_id, text, _compared, schema), "digests")
    clash = materialise(collisions(docs, rows.select("digest"), doc_id, text), "collisions")
    if clash.isEmpty():
        return rows.withColumnRenamed("digest", "fingerprint")
    return _told_apart(docs, rows, clash, doc_id, text)
