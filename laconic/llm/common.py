"""Helpers that several operators share: reading tables, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is these six code points, everywhere in this subpackage where a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has written, by session.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local session without either gets one of its own (tests); on a
    cluster a machine's folder would lose what other machines write, so
    there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="laconic-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Rows of a file, on average, in tables whose rows are bounded beforehand.
ROWS_A_FILE = 10_000


def files(rows: int, each: int = ROWS_A_FILE) -> int:
    """Files for a table of that many rows at most.

    Every file is several requests to a store; in a local folder each one has
    the executor start three processes that set permissions.  So small tables
    get few, also where Spark doesn't coalesce partitions: by coalesce() after
    a cheap last stage, by `gathered` after a costly one.
    """
    return 1 + rows // each


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, of that many rows at most, dealt once more into partitions as its files are to be; the stage before keeps its tasks."""
    return df.repartition(min(files(rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back.

    Later readers neither recompute it nor depend on the executor that made
    it.  Columns and types are those of df.  `discard` deletes what has been
    written, once its results have been read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/laconic-{label}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete the intermediate tables of this session; DataFrames made from them can't be read any more. Returns their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def remainder(doc_id: str, n: int):
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


#: Bits of a filter for each value, and the sizes of filters (powers of two): beyond the largest there is none.
BITS_A_VALUE, LEAST_BITS, MOST_BITS = 16, 20, 27


def bloom(values: DataFrame) -> np.ndarray | None:
    """A filter of bits that holds the rows' single column, or None for more than 2**MOST_BITS / 4 values.

    It spares a shuffle rows without a partner, and grows with the number of
    values (up to 16 MB), so about one other in 16 passes, and at most one in
    five.  It is gathered as columns of 64-bit words.
    """
    column = values.columns[0]
    n = values.count()
    if n * 4 > 1 << MOST_BITS:
        return None
    size = min(MOST_BITS, max(LEAST_BITS, (n * BITS_A_VALUE - 1).bit_length()))
    place = F.shiftrightunsigned(F.xxhash64(column), 64 - size)
    words = values.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def may_hold(spark: SparkSession, bits: np.ndarray | None, column):
    """Condition: the column's value may be in the filter (without one: any value may). Only its hash goes to Python."""
    if bits is None:
        return F.lit(True)
    held, shift = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little")), np.uint64(65 - len(bits).bit_length())

    @F.pandas_udf("boolean")
    def look(h: pd.Series) -> pd.Series:
        at = (h.to_numpy().view(np.uint64) >> shift).astype(np.int64)
        return pd.Series(held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0)

    return look(F.xxhash64(column))
