"""Savings over time on a stream of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laconic.operators.stats import saved

GRAINS = {"hour": "1 hour", "day": "1 day"}


def _sums():
    return [F.count(F.lit(1)).alias("messages"), F.sum("original").alias("original"), F.sum("compressed").alias("compressed")]


def series(facts: DataFrame, grain: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """bucket, messages, original, compressed, saved; facts later than `late` are left out of hours and days.

    Months have no window of fixed length: they are grouped by their first
    instant and kept for good, as are running totals.
    """
    if grain == "month":
        g = facts.groupBy(F.date_trunc("month", ts).alias("bucket")).agg(*_sums())
    else:
        g = facts.withWatermark(ts, late).groupBy(F.window(ts, GRAINS[grain]).alias("w")).agg(*_sums()).withColumn("bucket", F.col("w.start")).drop("w")
    return g.withColumn("saved", saved()).select("bucket", "messages", "original", "compressed", "saved")


def totals(facts: DataFrame) -> DataFrame:
    """Running totals: use it with the output mode `complete`."""
    return facts.groupBy().agg(*_sums(), F.sum(saved()).alias("saved"))
