"""Balanced contiguous shards from global byte-size prefix sums.

Law ``bytes``: rows are put into one global order, every row gets the number
of bytes before it, and the order is cut at equal byte targets.

1. Rows are range-partitioned and sorted by (text hash, id), so equal texts
   are neighbours and a hot group is still split over partitions (the id is
   part of the range key).  Each task writes its rows with their running
   bytes and row number; the rows are written once, so the totals below are
   those of the very partitions that the offsets are applied to.
2. Per-partition totals (one row per task) give the bytes and rows before
   each partition; the sums make every position global.
3. The ``n_shards - 1`` cuts are at equal targets.  A cut that falls inside
   a group of equal texts moves to the nearer end of the group when the
   group holds at most ``snap`` of a target, so small groups stay whole and
   shards stay within that share of each other; larger groups are cut.

A null text has no bytes.  Empty tables give no rows; repeated rows are rows
of their own (ties end in input order).  Input columns other than the id and
the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, materialize, partition_starts

OVERHEAD = 16
SNAP = 0.02

_PLACED = ("id long, size long, crc long, group long, pid int, bytes_in long, row_in long")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running bytes and row number of the sorted rows of one partition."""
    pid = TaskContext.get().partitionId()
    seen_bytes = seen_rows = 0
    for b in batches:
        size = b.column("size").to_numpy(zero_copy_only=False)
        ends = seen_bytes + np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("size"), b.column("crc"), b.column("group"),
             pa.array(np.full(len(size), pid, np.int32)), pa.array((ends - size).astype(np.int64)),
             pa.array(np.arange(seen_rows, seen_rows + len(size), dtype=np.int64))],
            names=["id", "size", "crc", "group", "pid", "bytes_in", "row_in"])
        seen_rows += len(size)
        seen_bytes = int(ends[-1]) if len(size) else seen_bytes


def byte_prefix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, group, at_byte, at_row): global positions in (group, id) order."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("group"))
    order = ["group", "id", F.monotonically_increasing_id()]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions("group", "id")
    placed = materialize(arrow_map(ranged, _place, _PLACED), "shard-rows")
    totals = placed.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = partition_starts(totals, "pid", "bytes", "rows")
    return placed.join(F.broadcast(starts), "pid").select(  # one row per task: bounded by the partition count
        "id", "size", "crc", "group", (F.col("bytes_before") + F.col("bytes_in")).alias("at_byte"),
        (F.col("rows_before") + F.col("row_in")).alias("at_row"))


def _cuts(placed: DataFrame, n_shards: int, snap: float) -> list[int]:
    """Byte positions at which shards 1 .. n-1 begin (``n_shards`` numbers, not data rows)."""
    total = placed.agg(F.sum("size").alias("t")).first()["t"] or 0
    target = total / n_shards
    cuts = [round(k * target) for k in range(1, n_shards)]
    if not total:
        return cuts
    # the groups that a cut falls into: at most n_shards - 1 of them
    inside = F.lit(False)
    for c in cuts:
        inside = inside | ((F.col("at_byte") < c) & (F.col("at_byte") + F.col("size") > c))
    on_cut = placed.where(inside).select("group").distinct()
    ends = (placed.join(F.broadcast(on_cut), "group").groupBy("group")
            .agg(F.min("at_byte").alias("a"), F.max(F.col("at_byte") + F.col("size")).alias("b")).collect())
    out = []
    for c in cuts:
        for r in ends:
            if r["a"] < c < r["b"] and r["b"] - r["a"] <= snap * target:
                c = r["a"] if c - r["a"] <= r["b"] - c else r["b"]
        out.append(c)
    return out


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                   snap: float = SNAP) -> DataFrame:
    """(id, size, crc, shard, slot): ``slot`` counts the rows of a shard from 0.

    A row belongs to the shard in which its middle byte lies.
    """
    placed = materialize(byte_prefix(docs, id_col, text_col), "shard-prefix")
    cuts = _cuts(placed, n_shards, snap)
    middle = F.col("at_byte") + F.col("size") / 2
    shard = sum((F.when(middle >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    rows = placed.withColumn("shard", shard)
    firsts = rows.groupBy("shard").agg(F.min("at_row").alias("first"))  # n_shards rows
    return rows.join(F.broadcast(firsts), "shard").select(
        "id", "size", "crc", "shard", (F.col("at_row") - F.col("first")).alias("slot"))
