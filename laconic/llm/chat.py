"""Chat formatting by perspective rotation.

For every participant of a dialogue, the dialogue is rendered once with
that speaker as the assistant and all others as named users; only the
assistant's words carry loss.  `system` messages keep their role and are
nobody's perspective.

A rendering is a row for each message, with its place in the whole: char
offsets of the segment and of the part that carries loss.  So a dialogue of
any length is never gathered into one row or task: offsets are prefix sums
in two levels, within `BUCKET` turns and over the buckets' totals.

Defined results: a null role is the speaker `unknown`, a null text is
empty, a null turn comes first, a null conv_id is a conversation of its
own; repeated rows are repeated messages (ties in order of speaker and
text); a conversation with system messages only has no rendering; `<|` in
a text is broken up, so no text can fake a marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turns whose offsets one task adds up.
BUCKET = 128
#: Fixed markers of the rendering.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _tag(speaker: Column, perspective: Column) -> Column:
    return F.when(speaker == "system", F.lit("system")).when(speaker == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))


def rotations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, turn, speaker, segment, loss, char_start, char_end, loss_start, loss_end): char offsets within the perspective's rendering; loss offsets are null where nothing carries loss."""
    body = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |"))
    m = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"), body.alias("text"))
    m = m.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit(-(1 << 60))))
    stats = m.groupBy("conv_id", "bucket", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    people = stats.where("speaker <> 'system'").select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    frame = len(OPEN) + len(CLOSE) + 2
    each = F.col("n") * (frame + F.length(_tag(F.col("speaker"), F.col("perspective")))) + F.col("chars")
    per = stats.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).groupBy("conv_id", "bucket", "perspective").agg(F.sum(each).alias("chars"))
    before = F.sum("chars").over(W.partitionBy("conv_id", "perspective").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    per = per.select(F.col("conv_id").alias("c"), F.col("bucket").alias("b"), "perspective", F.coalesce(before, F.lit(0)).alias("start"))
    rows = m.join(per, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("bucket") == F.col("b")))
    tag = _tag(F.col("speaker"), F.col("perspective"))
    rows = rows.withColumn("segment", F.concat(F.lit(OPEN), tag, F.lit("\n"), F.col("text"), F.lit(CLOSE + "\n"))).withColumn("_head", F.length(tag) + len(OPEN) + 1)
    order = W.partitionBy("conv_id", "bucket", "perspective").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    rows = rows.withColumn("char_end", (F.col("start") + F.sum(F.length("segment")).over(order.rowsBetween(W.unboundedPreceding, 0))).cast("long"))
    rows = rows.withColumn("char_start", F.col("char_end") - F.length("segment")).withColumn("loss", (F.col("speaker") == F.col("perspective")).cast("int"))
    carries = lambda c: F.when(F.col("loss") == 1, c.cast("long"))
    return rows.select("conv_id", "perspective", "turn", "speaker", "segment", "loss", "char_start", "char_end", carries(F.col("char_start") + F.col("_head")).alias("loss_start"), carries(F.col("char_end") - 1).alias("loss_end"))
