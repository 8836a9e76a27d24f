"""FIFO queue reconstruction from an enqueue / pop event log.

Events: ``(queue_id, seq, op, ...)`` with ``op`` in {enqueue, pop}.  A pop
takes the oldest pending story; a pop on an empty queue returns nothing and
has no effect.

With ``d = +1`` for enqueue and ``-1`` for pop and ``S`` the running sum of
``d`` per queue, the queue size after an event is ``S - min(0, running min S)``.
A pop is effective unless it drives ``S`` to a new strict minimum below zero.
The k-th enqueue is popped by the k-th effective pop, so pairing is an
equi-join on ``(queue_id, k)``.

Scale: the running sums are a *segmented prefix scan*.  Events are cut into
chunks of ``chunk`` sequence numbers per queue; each chunk is scanned with a
window of at most ``chunk`` rows, chunk totals are combined over the (few)
chunks of a queue, and the offsets are joined back.  A queue holding a third
of all events is therefore spread over many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import chunked_running

ENQUEUE, POP = "enqueue", "pop"


def _scan(events: DataFrame, chunk: int, super_chunk: int = 4096) -> DataFrame:
    """Adds S (running sum of d), E (running enqueues), m_prev (min(0, min S
    before this event)) per queue, via per-chunk windows + chunk offsets.

    The chunk offsets are themselves running sums/minima over the chunk
    summaries of a queue; they come from the same chunked scan one level up
    (``super_chunk`` chunks per group), so no step runs a window over all the
    chunks of a hot queue."""
    e = events.withColumn("d", F.when(F.col("op") == ENQUEUE, 1).otherwise(-1)) \
        .withColumn("is_enq", (F.col("op") == ENQUEUE).cast("long")) \
        .withColumn("chunk", F.floor(F.col("seq") / F.lit(chunk)))
    w = Window.partitionBy("queue_id", "chunk").orderBy("seq")
    w_run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_excl = w.rowsBetween(Window.unboundedPreceding, -1)
    loc = e.withColumn("ls", F.sum("d").over(w_run)) \
        .withColumn("le", F.sum("is_enq").over(w_run))
    loc = loc.withColumn("lmin_excl", F.min("ls").over(w_excl))
    summ = loc.groupBy("queue_id", "chunk").agg(
        F.sum("d").alias("tot_d"), F.sum("is_enq").alias("tot_e"), F.min("ls").alias("min_ls"))
    summ = summ.withColumn("_sc", F.floor(F.col("chunk") / F.lit(super_chunk)))
    summ = chunked_running(summ, ["queue_id"], ["chunk"], "_sc", {"tot_d": "sum", "tot_e": "sum"},
                           exclusive=True)
    summ = summ.withColumnRenamed("run_tot_d", "off_d").withColumnRenamed("run_tot_e", "off_e")
    # min S over all earlier chunks = min over them of (their offset + their local min)
    summ = chunked_running(summ.withColumn("_lo", F.col("off_d") + F.col("min_ls")), ["queue_id"], ["chunk"],
                           "_sc", {"_lo": "min"}, exclusive=True).withColumnRenamed("run__lo", "prev_min")
    j = loc.join(summ.select("queue_id", "chunk", "off_d", "off_e", "prev_min"), ["queue_id", "chunk"])
    s = F.col("off_d") + F.col("ls")
    m_prev = F.least(F.lit(0), F.coalesce(F.col("prev_min"), F.lit(0)),
                     F.coalesce(F.col("off_d") + F.col("lmin_excl"), F.lit(0)))
    return j.select(*events.columns, s.alias("S"), (F.col("off_e") + F.col("le")).alias("E"),
                    m_prev.alias("m_prev"))


def fifo_pairs(events: DataFrame, chunk: int = 1 << 16, materialize_scan: bool = True,
               super_chunk: int = 4096) -> DataFrame:
    """One row per enqueue: ``queue_id, enq_seq, deq_seq`` (null = still pending)
    plus the enqueue's other columns and ``deq_ts`` when ``ts`` exists.

    The scanned log feeds both the enqueue and the pop side of the pairing
    join; it is written once to the shared checkpoint folder
    (``materialize_scan``) instead of being recomputed per side."""
    scanned = _scan(events, chunk, super_chunk)
    if materialize_scan:
        from tessera.session import materialize
        scanned = materialize(scanned, "fifo-scan")
    m_now = F.least(F.col("m_prev"), F.col("S"))
    enq = scanned.filter(F.col("op") == ENQUEUE).withColumn("k", F.col("E"))
    # effective pop: S did not fall to a new strict minimum below zero
    eff = scanned.filter((F.col("op") == POP) & (F.col("S") >= F.col("m_prev"))) \
        .withColumn("k", F.col("E") - (F.col("S") - m_now))
    deq_cols = [F.col("seq").alias("deq_seq")]
    if "ts" in events.columns:
        deq_cols.append(F.col("ts").alias("deq_ts"))
    pops = eff.select("queue_id", "k", *deq_cols)
    keep = [c for c in events.columns if c not in ("queue_id", "seq", "op")]
    return enq.select("queue_id", F.col("seq").alias("enq_seq"), "k", *keep) \
        .join(pops, ["queue_id", "k"], "left").drop("k")


def queue_depth(events: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """A11 + O4: pending count, popped count and oldest pending per queue.

    No pairing: what is pending at the end is ``S - min(0, min S)``, the rest
    of the enqueues were popped, and the oldest pending story is the enqueue
    that follows them.  Only the key columns of the log are scanned."""
    from tessera.session import materialize

    scanned = materialize(_scan(events.select("queue_id", "seq", "op"), chunk), "queue-scan")
    ends = scanned.groupBy("queue_id").agg(
        F.max("E").alias("enqueued"), F.least(F.lit(0), F.min("S")).alias("low"),
        F.max_by("S", "seq").alias("last")).where("enqueued > 0").select(
        "queue_id", (F.col("last") - F.col("low")).cast("bigint").alias("pending"),
        (F.col("enqueued") - (F.col("last") - F.col("low"))).cast("bigint").alias("popped"))
    oldest = scanned.filter(F.col("op") == ENQUEUE).select("queue_id", (F.col("E") - 1).cast("bigint").alias("popped"),
                                                           F.col("seq").alias("oldest_pending_seq"))
    return ends.join(oldest, ["queue_id", "popped"], "left").select("queue_id", "pending", "popped", "oldest_pending_seq")


def queued_lookup(stories: DataFrame, probes: DataFrame, probe_col: str = "probe") -> DataFrame:
    """J6 + U2: is a URL already queued (pending or sent) under ``link`` or ``url``?

    The OR-condition is rewritten as an equi-join: explode both keys of every
    story, de-duplicate, and left-join the probes on the single key (no nested
    loop join).
    """
    keys = stories.select(F.explode(F.array(F.col("link"), F.col("url"))).alias("k")) \
        .filter(F.col("k").isNotNull()).distinct().withColumn("_hit", F.lit(True))
    return probes.join(keys, probes[probe_col] == keys["k"], "left") \
        .select(*probes.columns, F.coalesce(F.col("_hit"), F.lit(False)).alias("queued"))


def validate_events(raw: DataFrame) -> dict[str, DataFrame]:
    """S8 + V2: split a queue log into typed events and a quarantine.

    A row is valid when it has a queue id, a sequence number and a known op;
    invalid rows go to ``quarantine`` with a reason instead of turning the
    whole queue into "empty" (the source's behaviour for a corrupt file)."""
    reason = (F.when(F.col("queue_id").isNull(), F.lit("missing queue_id"))
              .when(F.col("seq").isNull(), F.lit("missing seq"))
              .when(~F.col("op").isin(ENQUEUE, POP) | F.col("op").isNull(), F.lit("unknown op")))
    tagged = raw.withColumn("_reason", reason)
    return {"events": tagged.filter(F.col("_reason").isNull()).drop("_reason"),
            "quarantine": tagged.filter(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")}
