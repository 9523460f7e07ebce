"""Custom filter packs: every *.json of a folder, read on the driver (packs are small and must be checked before a plan is made)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from laconic.rules.filters import CUSTOM, Filter, parse


def custom(folder: str) -> list[Filter]:
    """Filters of a local folder; a missing folder or a bad file gives none."""
    return [f for p in sorted(Path(folder).glob("*.json")) for f in parse(p.read_text(errors="replace"), CUSTOM)] if Path(folder).is_dir() else []


def custom_from(spark: SparkSession, folder: str, most_bytes: int = 16 << 20) -> list[Filter]:
    """The same from any store that Spark reads, up to a checked size."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    sizes = files.selectExpr("sum(octet_length(value)) n").first().n or 0
    if sizes > most_bytes:
        raise ValueError(f"filter packs of {sizes} bytes; at most {most_bytes} are read")
    return [f for r in files.selectExpr("_metadata.file_path p", "value").orderBy("p").collect() for f in parse(r.value, CUSTOM)]
