"""What a service would show, as DataFrames: statistics, series, the dashboard's slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laconic.operators import stats

LAST = {"hour": 48, "day": 30}


def stats_page(facts: DataFrame, k: int = 20) -> DataFrame:
    """(section, name, hits, saved, note): totals, then the top filters and commands; note: the saving in percent, as text with one decimal."""
    t = stats.summary(facts)
    totals = t.select(F.lit("totals").alias("section"), F.lit("messages").alias("name"), F.col("messages").alias("hits"), F.col("saved"), F.format_string("%.1f", "avg_savings_pct").alias("note"))
    none = lambda kind: F.lit(None).cast(kind)
    filters = stats.top_filters(facts, k).select(F.lit("filters"), "filter_id", "hits", none("long"), none("string"))
    commands = stats.top_commands(facts, k).select(F.lit("commands"), "command_type", "hits", "saved", none("string"))
    return totals.union(filters).union(commands)


def recent(facts: DataFrame, grain: str, ts: str = "ts") -> DataFrame:
    """The last buckets of a series, oldest first: 48 hours or 30 days."""
    return stats.series(facts, grain, ts).orderBy(F.desc("bucket")).limit(LAST[grain]).orderBy("bucket")


def write_tsv(df: DataFrame, path: str) -> None:
    """A report as tab-separated text with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
