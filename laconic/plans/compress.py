"""The output pipeline: detect, pass short ones, filter, group, fold, cut.

Most of its steps are sequential, so a text goes through all of them in one
Arrow pass; only the command and the text travel.  No step shuffles.  With
`distinct=True` equal (command, text) pairs are compressed once and joined
back, which pays where outputs repeat a lot.
"""

from __future__ import annotations

from dataclasses import astuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laconic.config import EngineConfig
from laconic.functions import text as tx
from laconic.operators import outputs, plain
from laconic.operators.condense import condensed
from laconic.rules.filters import Filter, combined
from laconic.sources import requests

RESULT = "text string, command_type string, category string, confidence double, filter_id string, grouped boolean"


def compressed(df: DataFrame, text: str = "text", command: str | None = None, config: EngineConfig | None = None, custom: list[Filter] | None = None, distinct: bool = False) -> DataFrame:
    """df with compressed, filter_id, command_type, category, confidence, grouped, original_tokens, compressed_tokens.

    command: a column with the command that made the text, where known.  A
    null text stays null; filter_id is null for short outputs of unknown
    commands, which only lose their escape codes.
    """
    config = config or EngineConfig()
    if not config.compress:
        n = tx.tokens(text)
        return df.withColumns({"compressed": F.col(text), "filter_id": F.lit(None).cast("string"), "command_type": F.lit(None).cast("string"), "category": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "grouped": F.lit(False), "original_tokens": n, "compressed_tokens": n})
    if distinct:
        keys = [text, *([command] if command else [])]
        once = compressed(df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct(), "_k0", "_k1" if command else None, config, custom)
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return df.join(once, same[0] & same[1] if command else same[0], "left").drop("_k0", "_k1")
    filters = combined(custom or ())

    @F.pandas_udf(RESULT)
    def run(s: pd.DataFrame) -> pd.DataFrame:
        empty = (None,) * 6
        rows = [empty if t is None else astuple(plain.compress_output(t, c, config, filters)) for t, c in zip(s["t"], s["c"], strict=True)]
        return pd.DataFrame(rows, columns=["text", "command_type", "category", "confidence", "filter_id", "grouped"])

    known = F.col(command) if command else F.lit(None).cast("string")
    d = df.withColumn("_out", run(F.struct(F.col(text).alias("t"), known.alias("c"))))
    d = d.withColumns({"compressed": F.col("_out.text"), **{c: F.col(f"_out.{c}") for c in ("filter_id", "command_type", "category", "confidence")}, "grouped": F.coalesce(F.col("_out.grouped"), F.lit(False))})
    return d.withColumns({"original_tokens": tx.tokens(text), "compressed_tokens": tx.tokens("compressed")}).drop("_out")


def fact(df: DataFrame) -> DataFrame:
    """The columns that `operators.stats` reads."""
    return df.withColumns({"original": F.col("original_tokens"), "compressed": F.col("compressed_tokens")})


def user_text(text, config: EngineConfig) -> Column:
    return condensed(text, "user", config.condense_level) if config.condense else tx.col(text)


@F.udtf(returnType="dialect string, pos int, path string, role string, kind string, text string, hint string")
class ExplodeMessages:
    """SQL: SELECT ... FROM requests, LATERAL explode_messages(body)."""

    def eval(self, body: str):
        dialect, rows, _ = requests.read(body)
        for r in rows:
            yield dialect, r["pos"], r["path"], r["role"], r["kind"], r["text"], r["hint"]


def register(spark: SparkSession) -> None:
    """SQL functions estimate_tokens, fold_lines, compress_output(text, command), and the table function explode_messages(body)."""
    spark.udf.register("estimate_tokens", F.pandas_udf(lambda s: s.map(lambda t: None if t is None else (len(t) + 3) // 4), "long"))
    spark.udf.register("fold_lines", F.pandas_udf(lambda s: s.map(lambda t: None if t is None else outputs.fold(t)), "string"))
    spark.udf.register("compress_output", F.pandas_udf(lambda t, c: pd.Series([None if x is None else plain.compress_output(x, y).text for x, y in zip(t, c, strict=True)], dtype=object), "string"))
    spark.udtf.register("explode_messages", ExplodeMessages)
