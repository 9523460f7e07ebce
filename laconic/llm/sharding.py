"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has `CELLS` cells; a key's cell is the front of its md5.  Every
shard stands on the ring at `VIRTUAL` points, and a cell prefers the shards
in the order in which they come clockwise.  A shard takes keys up to its
capacity; those that find it full go on clockwise.  With `slack` 0 the
capacities add up to the number of rows and differ by one at most, so the
counts do, too; a larger slack moves fewer rows when a shard joins.

Only one count for each cell is gathered (CELLS rows, whatever the input).
The quotas of cells in shards follow from them, and a row finds its shard
and slot from its rank within its cell.  Ranks are prefix sums in two levels:
over the parts of a cell, whose number follows from the number of rows, and
within a part.  A part is named by a hash of id and text, so a window holds
about `PART_ROWS` rows even where one id has very many texts; only rows
that repeat each other in both stay together.  One shuffle, all in DataFrame
operations.

With law `rows` (slack 0) a shard that joins takes its quota from all others,
and about a third of the rows that move go between old shards; a slack of
0.25 moves only rows to the new one, with counts up to a quarter apart (law
`bounded`).

Defined results: rows with equal ids share a cell; a null id hashes as the
empty text; a null text has no bytes;
an empty table gives an empty result.  Columns of docs with the names of
the added ones are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laconic.llm.common import materialise

#: Cells of the ring: 16 ** HEX.
HEX = 3
CELLS = 16**HEX
VIRTUAL = 64
#: Rows of a part of a cell, and most parts.
PART_ROWS, MOST_PARTS = 2_000, 4_096


def preferences(shards: int, virtual: int = VIRTUAL) -> list[list[int]]:
    """For each cell the shards in the order in which they come clockwise from it."""
    points = sorted((int(hashlib.md5(f"{s}#{v}".encode()).hexdigest()[:12], 16), s) for s in range(shards) for v in range(virtual))
    step, out = 16 ** (12 - HEX), []
    for cell in range(CELLS):
        first = next((i for i, (at, _) in enumerate(points) if at >= cell * step), 0)
        out.append(list(dict.fromkeys(s for _, s in points[first:] + points[:first])))
    return out


def quotas(counts: list[int], shards: int, slack: float = 0.0, virtual: int = VIRTUAL) -> list[tuple[int, int, int, int, int]]:
    """(cell, shard, first rank, last rank + 1, first slot): how each cell's rows are dealt."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) if slack == 0 else -int(-total * (1 + slack) // shards) for s in range(shards)]
    taken, done, used = [], [0] * CELLS, [0] * shards
    wanted = preferences(shards, virtual)
    for turn in range(shards):
        for cell in range(CELLS):
            s = wanted[cell][turn]
            n = min(counts[cell] - done[cell], room[s] - used[s])
            if n > 0:
                taken.append((cell, s, done[cell], done[cell] + n, used[s]))
                done[cell] += n
                used[s] += n
    return taken


def sharded(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", slack: float = 0.0, virtual: int = VIRTUAL) -> DataFrame:
    """docs with size (bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard."""
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = docs.select(*[c for c in docs.columns if c not in added])
    hashed = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({"_hash": hashed, "_cell": F.conv(F.substring(hashed, 1, HEX), 16, 10).cast("int"), "size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body)})
    parts = min(MOST_PARTS, docs.count() // (CELLS * PART_ROWS) + 1)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_hash", "size", "text_crc32"), F.lit(parts)).cast("int"))
    cells = materialise(rows.groupBy("_cell", "_part").agg(F.count(F.lit(1)).alias("n")), "cells")
    counts = [0] * CELLS
    for r in cells.groupBy("_cell").agg(F.sum("n").alias("n")).collect():  # CELLS rows at most
        counts[r["_cell"]] = r["n"]
    plan = docs.sparkSession.createDataFrame(quotas(counts, shards, slack, virtual), "_c int, shard int, _first long, _end long, _base long")
    before = F.sum("n").over(W.partitionBy("_cell").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = cells.select("_cell", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_cell", "_part").orderBy("_hash", F.col(doc_id), "size", "text_crc32")) - 1
    rows = rows.withColumn("_inside", inside).join(starts, ["_cell", "_part"]).withColumn("_rank", F.col("_start") + F.col("_inside"))
    # the plan has CELLS * shards rows at most
    rows = rows.join(F.broadcast(plan), (F.col("_cell") == F.col("_c")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    law = F.lit("rows" if slack == 0 else "bounded")
    return rows.select(*docs.columns, "size", "text_crc32", law.alias("law"), "shard", (F.col("_base") + F.col("_rank") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
