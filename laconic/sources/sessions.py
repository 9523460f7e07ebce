"""Session logs and command lists: JSON lines, read in parallel, bad lines left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laconic.functions.text import trim


def session_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all *.jsonl files below root, with file and place: the block's start and a number that ascends within it, so the order is the file's however files are split."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"), "value")


def items(lines: DataFrame) -> DataFrame:
    """The response items of a session log: type, name, call_id, arguments, output (JSON text or plain), in the log's order."""
    v = F.try_parse_json("value")
    row = lines.withColumn("_v", v).where(F.try_variant_get("_v", "$.type", "string") == "response_item")
    row = row.withColumn("_i", F.coalesce(F.try_variant_get("_v", "$.payload.item", "variant"), F.try_variant_get("_v", "$.payload", "variant")))
    get = lambda k, t="string": F.try_variant_get("_i", f"$.{k}", t)
    return row.select("file", "place", get("type").alias("type"), F.coalesce(get("name"), F.lit("")).alias("name"), get("call_id").alias("call_id"), get("arguments", "variant").alias("arguments"), get("output", "variant").alias("output"))


def as_text(v: Column) -> Column:
    """A string as it is, anything else as JSON."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def command_of(arguments: str) -> Column:
    """The command in a call's arguments: cmd or command, text or a list of lines; null if blank."""
    a = F.col(arguments)
    args = F.when(F.schema_of_variant(a) == "STRING", F.try_parse_json(F.try_variant_get(a, "$", "string"))).otherwise(a)
    c = F.coalesce(F.try_variant_get(args, "$.cmd", "variant"), F.try_variant_get(args, "$.command", "variant"))
    listed = F.array_join(F.transform(F.try_variant_get(c, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.lit(""))), "\n", "")
    text = F.when(F.schema_of_variant(c).startswith("ARRAY"), listed).otherwise(as_text(c))
    return F.when(trim(text) != "", text)


def commands(spark: SparkSession, path: str) -> DataFrame:
    """(command): one to a line, as JSON strings or raw; blank ones left out."""
    raw = spark.read.text(path).where(trim("value") != "")
    v = F.try_parse_json("value")
    c = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.col("value"))
    return raw.select(c.alias("command")).where(trim("command") != "")
