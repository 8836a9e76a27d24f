"""Global order without a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
``global_rank`` range-partitions instead, numbers rows inside each partition,
and adds the row counts of the earlier partitions (a table with one row per
partition, so its broadcast is bounded by the partition count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


def global_rank(df: DataFrame, order: list[str], n_parts: int | None = None,
                name: str = "rank") -> DataFrame:
    """Adds ``name`` = 1-based position in the total order of ``order``
    (which must be unique).

    The range-partitioned rows are written once with their partition number
    and position.  The counts are taken from that table: a second range
    exchange would sample its own bounds, and its counts would not fit."""
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order) \
        .withColumn("_mid", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("_pid", F.shiftright("_mid", 33))
                         .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid"), "ranked")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per range partition
    out = ranged.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
    return out.withColumn(name, F.col("_off") + F.col("_pos") + 1).drop("_pid", "_pos", "_off")


def with_previous(df: DataFrame, order: list[str], cols: list[str], prefix: str = "prev_") -> DataFrame:
    """``lag(col) OVER (ORDER BY order)`` for each col, via rank + equi-join
    (both sides read the table that ``global_rank`` wrote)."""
    ranked = global_rank(df, order)
    prev = ranked.select((F.col("rank") + 1).alias("rank"), *[F.col(c).alias(prefix + c) for c in cols])
    return ranked.join(prev, "rank", "left")


def chunked_running(df: DataFrame, part: list[str], order: list[str], chunk: str,
                    aggs: dict[str, str], exclusive: bool = False) -> DataFrame:
    """Running ``sum``/``max``/``min`` of columns per ``part`` in ``order`` as a
    segmented prefix scan: windows per ``part + [chunk]`` (``chunk`` must be
    non-decreasing in ``order``), chunk totals, and chunk offsets from a window
    over the (few) chunks of each ``part``.  A partition key holding a large
    share of the rows is thereby spread over many tasks.  Adds ``run_<col>``
    (inclusive of the row, or only earlier rows with ``exclusive``); a
    max/min over no rows is null, a sum over no rows is 0."""
    fn = {"sum": F.sum, "max": F.max, "min": F.min}
    hi = -1 if exclusive else 0
    w = Window.partitionBy(*part, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
    local = df.select("*", *[fn[a](c).over(w).alias(f"_l_{c}") for c, a in aggs.items()])
    tot = df.groupBy(*part, chunk).agg(*[fn[a](c).alias(f"_t_{c}") for c, a in aggs.items()])
    wc = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*part, chunk, *[fn[a](f"_t_{c}").over(wc).alias(f"_o_{c}") for c, a in aggs.items()])
    j = local.join(offs, [*part, chunk])

    def combine(c, a):
        o, loc = F.col(f"_o_{c}"), F.col(f"_l_{c}")
        if a == "sum":
            return F.coalesce(o, F.lit(0)) + F.coalesce(loc, F.lit(0))
        return F.greatest(o, loc) if a == "max" else F.least(o, loc)  # both skip nulls
    return j.select(*df.columns, *[combine(c, a).alias(f"run_{c}") for c, a in aggs.items()])


def chunked_running_sums(df: DataFrame, part: list[str], order: list[str], chunk: str,
                         sums: list[str]) -> DataFrame:
    """Inclusive running sums (see ``chunked_running``)."""
    return chunked_running(df, part, order, chunk, {c: "sum" for c in sums})
