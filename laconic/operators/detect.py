"""Which command made an output, and which filter suits it, as columns.

All of it is `operators.plain`, the form the output pipeline runs, in one
narrow Arrow pass: hundreds of patterns are too many for generated code, and
the JVM's regular expressions with classes of Unicode were some eighty times
slower on the same texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laconic.functions.text import col
from laconic.operators import plain
from laconic.rules import detectors
from laconic.rules.filters import Filter

FOUND = "command_type string, category string, confidence double, norm_command string"
SIGNALS = "array<struct<command_type: string, signals: int>>"


def detected(df: DataFrame, text: str = "text", command: str | None = None) -> DataFrame:
    """df with norm_command, command_type, category, confidence.

    command: a column with the command line (null or blank: it is looked for
    on the first lines of the text).  Ties go to the earlier detector; a null
    text is one without signals.
    """

    @F.pandas_udf(FOUND)
    def run(s: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([plain.detect(t or "", c) for t, c in zip(s["t"], s["c"], strict=True)], columns=["command_type", "category", "confidence", "norm_command"])

    known = F.col(command) if command else F.lit(None).cast("string")
    df = df.withColumn("_found", run(F.struct(F.col(text).alias("t"), known.alias("c"))))
    return df.withColumns({c: F.col(f"_found.{c}") for c in ("norm_command", "command_type", "category", "confidence")}).drop("_found")


def content_scores(text) -> Column:
    """Array of (type, signals) for the detectors whose content patterns match; null for a null text."""
    names = [d[0] for d in detectors.DETECTORS]

    @F.pandas_udf(SIGNALS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [{"command_type": x, "signals": n} for x, n in zip(names, plain.signals(t), strict=True) if n])

    return run(col(text))


def filter_id(filters: list[Filter], text="text", command_type="command_type", command="norm_command") -> Column:
    """The best filter: by type, else by command, else by content (known types only), else the generic one."""

    @F.pandas_udf("string")
    def run(t: pd.Series, kind: pd.Series, c: pd.Series) -> pd.Series:
        found = [plain.choose(filters, *x) for x in zip(t, kind, c, strict=True)]
        return pd.Series([f and f.id for f in found], dtype=object)

    return run(F.coalesce(col(text), F.lit("")), col(command_type), col(command))
