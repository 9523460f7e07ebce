"""Token savings: totals, rankings and series over a table of facts.

A fact is one compressed message: filter_id, command_type, original,
compressed (tokens), and ts where series are wanted.  All of these are
pre-aggregated groupings; rankings end in a top-k, not in a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the series' buckets.
GRAINS = {"month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH"}


def saved() -> Column:
    return F.greatest(F.col("original") - F.col("compressed"), F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def summary(facts: DataFrame) -> DataFrame:
    """One row: messages, original, compressed, saved (each message's saving is at least 0), avg_savings_pct."""
    t = facts.agg(F.count(F.lit(1)).alias("messages"), *[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("original", F.col("original")), ("compressed", F.col("compressed")), ("saved", saved()))])
    return t.withColumn("avg_savings_pct", percent(F.col("saved"), F.col("original")))


def top_filters(facts: DataFrame, k: int = 20) -> DataFrame:
    return facts.groupBy(F.coalesce("filter_id", F.lit("none")).alias("filter_id")).agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "filter_id").limit(k)


def top_commands(facts: DataFrame, k: int = 20) -> DataFrame:
    return facts.groupBy("command_type").agg(F.count(F.lit(1)).alias("hits"), F.sum(saved()).alias("saved")).orderBy(F.desc("hits"), "command_type").limit(k)


def series(facts: DataFrame, grain: str, ts: str = "ts") -> DataFrame:
    """bucket, messages, original, compressed, saved: here the bucket's saving as a whole is at least 0."""
    g = facts.groupBy(F.date_format(ts, GRAINS[grain]).alias("bucket")).agg(F.count(F.lit(1)).alias("messages"), F.sum("original").alias("original"), F.sum("compressed").alias("compressed"))
    return g.withColumn("saved", saved())


def all_series(facts: DataFrame, ts: str = "ts") -> DataFrame:
    """The three series in one pass: hours are summed up to days and months, so the facts are shuffled once."""
    hours = series(facts, "hour", ts)
    out = hours.select(F.lit("hour").alias("grain"), "*")
    for grain, size in (("day", 10), ("month", 7)):
        g = hours.groupBy(F.substring("bucket", 1, size).alias("bucket")).agg(*[F.sum(c).alias(c) for c in ("messages", "original", "compressed")])
        out = out.unionByName(g.withColumn("saved", saved()).select(F.lit(grain).alias("grain"), "*"))
    return out


def by_request(facts: DataFrame, key: str = "request_id", pos: str = "pos") -> DataFrame:
    """For each request its totals, its filters in order of first use, and what each command saved."""
    each = F.sort_array(F.collect_list(F.struct(pos, "filter_id", "command_type", "original", "compressed")))
    g = facts.groupBy(key).agg(F.sum("original").alias("original"), F.sum("compressed").alias("compressed"), F.bool_or("modified").alias("modified"), each.alias("_each"))
    tools = F.filter("_each", lambda s: s["command_type"].isNotNull())
    return g.withColumns({"filters": F.array_distinct(F.filter(F.transform(tools, lambda s: s["filter_id"]), lambda x: x.isNotNull())), "per_command": tools, "saves": F.col("modified") & (F.col("compressed") < F.col("original"))}).drop("_each")


def headers(requests: DataFrame, most_bytes: int = 8192) -> DataFrame:
    """Response header values of requests that became smaller; null for the others."""
    smaller = F.col("compressed") < F.col("original")
    listed = F.array_join(F.transform("per_command", lambda s: F.concat(s["command_type"], F.lit(":"), s["original"].cast("string"), F.lit("->"), s["compressed"].cast("string"), F.lit(","))), "")
    return requests.withColumns({"h_original": F.when(smaller, F.col("original").cast("string")), "h_compressed": F.when(smaller, F.col("compressed").cast("string")), "h_filters": F.when(smaller, F.array_join("filters", ",")), "h_commands": F.when(smaller, F.substring(listed, 1, most_bytes))})


def cache_hits(events: DataFrame, keys: list[str], ts: str, ttl_s: int) -> DataFrame:
    """events with is_hit: the key was used at most ttl_s before (each use renews it). ts: seconds since the epoch."""
    from pyspark.sql import Window as W

    gap = F.col(ts) - F.lag(ts).over(W.partitionBy(*keys).orderBy(ts))
    return events.withColumn("is_hit", F.coalesce(gap <= ttl_s, F.lit(False)))


def hit_rate(hits: DataFrame) -> DataFrame:
    """hits, misses, hit_rate_pct (one decimal; 0.0 without any use)."""
    n = F.sum(F.col("is_hit").cast("long"))
    t = hits.agg(F.coalesce(n, F.lit(0)).alias("hits"), (F.count(F.lit(1)) - F.coalesce(n, F.lit(0))).alias("misses"))
    return t.withColumn("hit_rate_pct", F.round(percent(F.col("hits"), F.col("hits") + F.col("misses")), 1))
