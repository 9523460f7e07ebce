"""The session-to-command map between requests, as a table.

A snapshot holds one row for each session, with the time of its last
writing; entries older than the time to live are left out when it is read.
Each write is a new snapshot in a folder of its own, so a reader never sees
half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "session_id long, command string, updated_at long"


def latest(updates: DataFrame) -> DataFrame:
    """One row for each session: its last command."""
    return updates.groupBy("session_id").agg(F.max_by("command", F.struct("updated_at", "command")).alias("command"), F.max("updated_at").alias("updated_at"))


def write(state: DataFrame, path: str, now: int) -> None:
    """A snapshot; it counts from now, for all sessions."""
    latest(state).withColumn("updated_at", F.lit(now).cast("long")).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, now: int, ttl_s: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("updated_at") >= now - ttl_s)


def merge(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Sessions of both; where both know one, the fresh entry wins."""
    return latest(fresh).unionByName(stored.join(fresh.select("session_id").distinct(), "session_id", "left_anti").select("session_id", "command", "updated_at"))


def from_json(spark: SparkSession, path: str, now: int, ttl_s: int) -> DataFrame:
    """The same from a JSON array file."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).where(F.col("updated_at") >= now - ttl_s)
