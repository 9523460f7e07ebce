"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule: a piecewise-linear density over
training time 0..1 that says when its share is wanted.  Its target (words)
follows from the weights by water-filling: no source is repeated more than
`cap` times, the excess goes to the others by weight.  A source's documents
form one stream in the order of a hash of id and text, repeated as often as
the target asks; the offset of an occurrence in that stream, divided by the
target, is inverted through the integral of the schedule and gives its
training position.  Documents are then range-sorted by position.

All of it is DataFrame operations.  The offset is a prefix sum in two
levels: within (source, bucket of the hash), and over the buckets' totals,
so a source that holds a third of all rows is spread over all its buckets,
whose number follows from the number of rows, and so is an id with very many
texts; only one row for each source and bucket meets in one place.

Defined results: a null source is a source, the last one; null or wordless
texts have size 0 and take nothing; rows that repeat each other in id and
text share a bucket and follow one another; an empty table gives an empty result; input
columns are kept, the added ones start with an underscore.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laconic.llm.common import WORD, materialise

#: Rows of a bucket, if its source holds all; hex digits of the hash that name buckets, least and most.
BUCKET_ROWS, LEAST_HEX, MOST_HEX = 1_000, 3, 5
CYCLE = (1, 2, 3)
CAP = 3
#: Knots (time, density) of each schedule; source number i takes schedule i modulo their number.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle=CYCLE, cap: int = CAP) -> DataFrame:
    """(source, number, source_size, weight, target) from (source, source_size): one row for each source.

    Sources by code point, null last, take the weights of `cycle` in turn.
    With sources ordered by cap / weight, the level is the largest of
    (total - caps before) / weights from here on.
    """
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("number") % len(cycle) + 1).cast("int"))
    limit = F.col("source_size").cast("double") * cap
    s = sizes.withColumn("number", number).withColumn("weight", weight).withColumn("limit", limit)
    order = W.orderBy(F.col("limit") / F.col("weight"), "number")
    before = F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1))
    onward = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    s = s.withColumn("level", (total - F.coalesce(before, F.lit(0.0))) / onward)
    s = s.withColumn("level", F.max("level").over(W.partitionBy()))
    return s.select("source", "number", "source_size", "weight", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def position(schedule: Column, done: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a source of that schedule has used up the share `done` of its target."""
    out = F.lit(None).cast("double")
    for number, knots in enumerate(schedules):
        areas = [(m0 + m1) * (t1 - t0) / 2 for (t0, m0), (t1, m1) in zip(knots[:-1], knots[1:], strict=True)]
        whole, at, here = sum(areas), 0.0, F.lit(1.0)
        pieces = []
        for area, (t0, m0), (t1, m1) in zip(areas, knots[:-1], knots[1:], strict=True):
            slope, rest = (m1 - m0) / (t1 - t0), (done - F.lit(at)) * whole
            t = F.lit(t0) + (rest / m0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(m0 * m0) + rest * (2 * slope))) - m0) / slope)
            at += area / whole
            pieces.append((at, F.least(t, F.lit(t1))))
        for end, t in reversed(pieces):
            here = F.when(done < end, t).otherwise(here)
        out = F.when(schedule == number, here).otherwise(out)
    return out


def planned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cycle=CYCLE, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """docs with _size, _source_size, _target, _taken (words), _copies (whole occurrences), _offset, _number."""
    hashed = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(F.col(text)), F.lit(""))))
    digits = min(MOST_HEX, max(LEAST_HEX, math.ceil(math.log(docs.count() / BUCKET_ROWS + 1, 16))))
    # a null source is told from any text by the flag
    sized = docs.withColumns({"_size": words(text), "_hash": hashed, "_bucket": F.substring(hashed, 1, digits), "_source": F.coalesce(F.col(source).cast("string"), F.lit("")), "_unknown": F.col(source).isNull()})
    key = ["_unknown", "_source"]
    buckets = materialise(sized.groupBy(*key, "_bucket").agg(F.sum("_size").alias("words")), "mix")
    sizes = buckets.groupBy(*key).agg(F.sum("words").alias("source_size")).select(F.when(~F.col("_unknown"), F.col("_source")).alias("source"), "source_size")
    plan = targets(sizes, cycle, cap).select(F.col("source").isNull().alias("_unknown"), F.coalesce("source", F.lit("")).alias("_source"), F.col("number").alias("_number"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    before = F.sum("words").over(W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = buckets.withColumn("_start", F.coalesce(before, F.lit(0))).drop("words").join(plan, key)
    inside = F.sum("_size").over(W.partitionBy(*key, "_bucket").orderBy("_hash", "_size").rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")
    rows = sized.withColumn("_inside", inside).join(starts, [*key, "_bucket"]).withColumn("_offset", F.col("_start") + F.col("_inside"))
    quota = F.floor(F.col("_target") + 0.5)
    full = F.when(F.col("_source_size") > 0, F.expr("floor(_target + 0.5) div _source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("_full", full).withColumn("_rest", quota - F.col("_full") * F.col("_source_size") - F.col("_offset"))
    part = F.greatest(F.lit(0), F.least("_size", "_rest"))
    last = ((F.col("_rest") > 0) & (2 * F.col("_rest") >= F.col("_size"))).cast("long")
    rows = rows.withColumn("_taken", F.col("_full") * F.col("_size") + part).withColumn("_copies", F.col("_full") + last)
    return rows.drop("_hash", "_bucket", "_source", "_unknown", "_start", "_inside", "_full", "_rest")


def share_done(copy: Column) -> Column:
    """Share of its source's target that comes before occurrence number `copy` (from 0) of a row of planned()."""
    return F.when(F.col("_target") > 0, (copy * F.col("_source_size") + F.col("_offset")) / F.col("_target")).otherwise(F.lit(0.0))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs as training takes them: each as often as the mix does, whole, range-sorted by training position.

    The document at which a source's target ends is taken whole if at least
    half of it is wanted.  Columns are those of docs.
    """
    schedules = options.get("schedules", SCHEDULES)
    rows = planned(docs, doc_id, text, source, **options).where("_copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    rows = rows.withColumn("_position", position(F.col("_number") % len(schedules), share_done(F.col("_copy")), schedules))
    return rows.orderBy("_position", doc_id, "_copy").select(*docs.columns)
