"""Structured Streaming jobs (T-1 .. T-5).

* ``stream_unsent``: feed ingestion with an age cut-off (T-1, T-4) and
  never-send-twice (T-2) as ``foreachBatch``: per micro-batch the first event
  of each new link is appended to the sent table.  The write is idempotent
  (T-5): a micro-batch owns the partition ``batch_id=<id>`` and rewrites it on
  retry, and the anti-join ignores the batch's own earlier attempt.
* ``stream_fifo``: the shared queue (T-3) as ``foreachBatch`` over the batch
  operator's chunked scan, with the pending stories carried from micro-batch
  to micro-batch in a table.
* ``stream_feeds``: whole feed files (T-1) into fresh, late and rejected items, broken files aside;
  the source moves read files to an archive (``feed_documents``).
* ``stream_stories``: open stories with event-time timers, expiry and a side output of late events (T-4).
* ``stream_retry``: deliveries tried again with an attempt ledger until each is settled (T-5).
* ``stream_deliver``: deliveries, and re-queueing of those that fail (T-5).
* ``dedup_within_watermark``: the bounded variant of never-send-twice: keeps
  the first event per link while the watermark (= maximum age) holds it (T-4).

Sources are append-only file folders read with ``trigger(availableNow=True)``;
checkpoints and sinks live under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir, small_files


def file_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream the parquet files ``name`` in ``folder`` (schema from the files)."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}").schema
    r = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", name)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def _run(writer, ckpt: str) -> None:
    q = writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


# ---------------------------------------------------------------------------
# T-1 / T-2 / T-4 / T-5
# ---------------------------------------------------------------------------
SENT_BUCKETS = 64  # folders of the sent table, by link hash


def _bucket(link: str = "link"):
    return F.pmod(F.xxhash64(link), F.lit(SENT_BUCKETS)).cast("int")


def _sent_links(spark: SparkSession, out_dir: str, batch_id: int, buckets: list[int]):
    """Links sent by earlier micro-batches in the given buckets (this batch's
    own earlier attempt excluded, so a retried batch rewrites the same rows);
    None before the first write."""
    try:
        sent = spark.read.parquet(out_dir)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return sent.filter((F.col("batch_id") != batch_id) & F.col("bucket").isin(buckets)).select("link")


def stream_unsent(stories: DataFrame, out_dir: str, ckpt: str, now: str | None = None,
                  max_age_hours: float = 24) -> None:
    """Append the first event of every link not sent before to ``out_dir``.

    ``stories`` is a streaming frame with ``link, event_id, ts``.  The sent
    table is partitioned by batch and link bucket, and a micro-batch reads
    only the buckets its links fall into.
    """
    spark = stories.sparkSession
    if now is not None:
        from tessera.operators.feeds import recent
        stories = recent(stories, now, max_age_hours)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy("link").agg(F.min("event_id").alias("first_event")) \
            .withColumn("bucket", _bucket()).persist()
        try:
            touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # at most SENT_BUCKETS
            sent = _sent_links(spark, out_dir, batch_id, touched)
            new = first if sent is None else first.join(sent, "link", "left_anti")
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out_dir}/batch_id={batch_id}")
        finally:
            first.unpersist()

    _run(stories.writeStream.foreachBatch(per_batch), ckpt)


def dedup_within_watermark(stories: DataFrame, max_age: str = "24 hours") -> DataFrame:
    """Bounded never-send-twice: first event per link within the watermark."""
    return stories.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", max_age) \
        .dropDuplicatesWithinWatermark(["link"])


def arrivals(df: DataFrame, folder: str, order: str, name: str = "*.parquet", parts: int = 3) -> Iterator[DataFrame]:
    """A stream over ``folder`` for each of ``parts`` ranges of ``order``, when
    the range has been written there, a file by each task.  A job run on each in turn with one checkpoint gets a range as
    one micro-batch, in order, and every scan and write is spread over tasks."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    for i in range(parts if lo is not None else 0):
        a, b = lo + (hi + 1 - lo) * i // parts, lo + (hi + 1 - lo) * (i + 1) // parts
        df.where((F.col(order) >= a) & (F.col(order) < b)).write.mode("append").parquet(folder)
        yield file_stream(df.sparkSession, folder, name)


# ---------------------------------------------------------------------------
# T-3: stateful FIFO queue
# ---------------------------------------------------------------------------
def stream_fifo(events: DataFrame, out_dir: str, ckpt: str) -> None:
    """Run the FIFO over a stream of ``queue_id, seq, op`` (a queue's ``seq``
    grows from batch to batch) into ``out_dir``: ``queue_id, enq_seq, deq_seq``
    per effective pop.

    The state is a table of pending stories per micro-batch.  Each micro-batch
    puts what was pending in front of its own events and runs the batch
    operator's chunked scan over both, so a hot queue is spread over many
    tasks and no task or state value holds a whole queue.  Output and state
    folders belong to the micro-batch, so a retry rewrites the same rows.
    """
    from tessera.operators import fifo

    spark = events.sparkSession
    state = f"{ckpt}-pending"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        log = batch.select("queue_id", "seq", "op")
        if batch_id:
            log = spark.read.parquet(f"{state}/batch_id={batch_id - 1}").unionByName(log)
        pairs = fifo.fifo_pairs(log).persist()
        try:
            pairs.where("deq_seq IS NOT NULL").write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
            pairs.where("deq_seq IS NULL").select("queue_id", F.col("enq_seq").alias("seq"), F.lit(fifo.ENQUEUE).alias("op")) \
                .write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        finally:
            pairs.unpersist()

    _run(events.writeStream.foreachBatch(per_batch), ckpt)


def stream_deliver(popped: DataFrame, send, out_dir: str, ckpt: str, key: str = "enq_seq") -> None:
    """T-5: deliver every popped story of a stream with ``send(text)``; a story
    whose delivery fails is put back: it appears in ``out_dir/requeued`` as a
    new enqueue event, the others in ``out_dir/delivered``.  ``popped`` has
    ``queue_id, enq_seq, deq_seq, payload``; one failure stops nothing, and a
    retried micro-batch rewrites its own folders."""
    from tessera.operators import fifo
    from tessera.operators.complete import batch_complete
    from tessera.session import materialize

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        sent = materialize(batch_complete(batch, key, "payload", send), "deliveries")  # each story is sent once
        both = batch.join(sent, key)
        both.where("error IS NULL").select("queue_id", "enq_seq", "deq_seq").write.mode("overwrite") \
            .parquet(f"{out_dir}/delivered/batch_id={batch_id}")
        both.where("error IS NOT NULL").select("queue_id", F.col("enq_seq").alias("story"), F.lit(fifo.ENQUEUE).alias("op")) \
            .write.mode("overwrite").parquet(f"{out_dir}/requeued/batch_id={batch_id}")

    _run(popped.writeStream.foreachBatch(per_batch), ckpt)


def _written(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """What a micro-batch wrote to its folder; None before the first one."""
    return spark.read.parquet(f"{folder}/batch_id={batch_id}") if batch_id >= 0 else None


# ---------------------------------------------------------------------------
# T-4: event time, late rows and expiry
# ---------------------------------------------------------------------------
def stream_stories(events: DataFrame, out_dir: str, ckpt: str, max_age_hours: float) -> None:
    """Follow every link of a stream of ``link, event_id, ts`` from its first event until
    it has been silent for ``max_age_hours`` of event time.

    The watermark of a micro-batch is the latest event time of the earlier
    ones less the age.  Events before it are late: they go to ``out_dir/late``
    and change nothing else.  The others update the open stories (link, first
    event, last event time, number of events); when a micro-batch has moved
    the watermark past a story's last event, the story's timer fires: it
    leaves the state for ``out_dir/closed``.  A link that comes back later is a
    new story.  ``out_dir/open`` holds the state after each micro-batch and
    ``out_dir/clock`` its event time.  State, outputs and clock belong to the
    micro-batch, so a retry rewrites the same rows; the state holds one row a
    link, and only links younger than the age.
    """
    from tessera.session import materialize

    spark = events.sparkSession
    age = F.expr(f"make_dt_interval(0, 0, 0, {max_age_hours * 3600})")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        clock, held = (_written(spark, f"{out_dir}/{name}", batch_id - 1) for name in ("clock", "open"))
        before = clock.first()["seen"] if clock is not None else None  # one value a micro-batch
        rows = batch.select("link", "event_id", "ts")
        late = F.lit(False) if before is None else F.coalesce(F.col("ts") < F.lit(before) - age, F.lit(False))
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch_id={batch_id}")
        put(rows.where(late), "late")
        new = rows.where(~late & F.col("ts").isNotNull()).select(
            "link", F.struct("ts", "event_id").alias("first"), F.col("ts").alias("last_ts"), F.lit(1).cast("long").alias("n"))
        both = new if held is None else held.unionByName(new)
        state = materialize(both.groupBy("link").agg(F.min("first").alias("first"), F.max("last_ts").alias("last_ts"),
                                                     F.sum("n").alias("n")), "open-stories")
        put(state.agg(F.greatest(F.max("last_ts"), F.lit(before).cast(state.schema["last_ts"].dataType)).alias("seen")), "clock")
        seen = _written(spark, f"{out_dir}/clock", batch_id).first()["seen"]
        silent = F.lit(False) if seen is None else F.col("last_ts") < F.lit(seen) - age
        put(state.where(silent).select("link", F.col("first.event_id").alias("first_event"), "last_ts", "n"), "closed")
        put(state.where(~silent), "open")

    _run(events.writeStream.foreachBatch(per_batch), ckpt)


# ---------------------------------------------------------------------------
# T-5: deliveries that are tried again
# ---------------------------------------------------------------------------
def deliver_due(new: DataFrame | None, spark: SparkSession, send, out_dir: str, round_id: int, max_attempts: int) -> None:
    """One round of deliveries with an attempt ledger.

    The ledger after a round (``out_dir/ledger``) holds each story (a unique id)
    that is not settled: ``queue_id, story, payload, attempts, next_round``.  A round adds
    ``new`` stories, tries those that are due with ``send(payload, attempt)``,
    and settles what was delivered or has been tried ``max_attempts`` times
    (``out_dir/settled``: ``queue_id, story, attempts, delivered``).  What failed is due
    again after 1, 2, 4, ... rounds.  A round reads the ledger before it and
    writes folders of its own, so a round that is run again gives the same rows.
    """
    from tessera.operators.complete import batch_complete
    from tessera.session import materialize

    spark.range(1).write.mode("overwrite").parquet(f"{out_dir}/rounds/batch_id={round_id}")
    ledger = _written(spark, f"{out_dir}/ledger", round_id - 1)
    if new is not None:
        new = new.select("queue_id", "story", "payload", F.lit(0).alias("attempts"), F.lit(round_id).alias("next_round"))
        ledger = new if ledger is None else ledger.unionByName(new)
    due = ledger.where(F.col("next_round") <= round_id)
    call = due.select("story", F.concat_ws("\n", F.col("attempts") + 1, "payload").alias("call"))
    sent = materialize(batch_complete(call, "story", "call", lambda c: send(c.partition("\n")[2], int(c.partition("\n")[0]))), "attempts")
    tried = due.join(sent.select("story", F.col("error").isNull().alias("delivered")), "story").withColumn("attempts", F.col("attempts") + 1)
    done = F.col("delivered") | (F.col("attempts") >= max_attempts)
    tried.where(done).select("queue_id", "story", "attempts", "delivered").write.mode("overwrite") \
        .parquet(f"{out_dir}/settled/batch_id={round_id}")
    again = tried.where(~done).withColumn("next_round", (F.lit(round_id) + F.pow(F.lit(2), F.col("attempts") - 1)).cast("int"))
    ledger.where(F.col("next_round") > round_id).unionByName(again.drop("delivered")).write.mode("overwrite") \
        .parquet(f"{out_dir}/ledger/batch_id={round_id}")


def stream_retry(popped: DataFrame, send, out_dir: str, ckpt: str, max_attempts: int = 4) -> None:
    """Deliver the stories of a stream of ``queue_id, story, payload``; see ``deliver_due``: a micro-batch is a round."""
    spark = popped.sparkSession
    _run(popped.writeStream.foreachBatch(lambda batch, i: deliver_due(batch, spark, send, out_dir, i, max_attempts)), ckpt)


def settle(spark: SparkSession, send, out_dir: str, max_attempts: int = 4) -> None:
    """For a stream that has ended: rounds without new stories until the ledger is empty."""
    last = spark.read.parquet(f"{out_dir}/rounds").agg(F.max("batch_id")).first()[0]
    while not _written(spark, f"{out_dir}/ledger", last).isEmpty():
        last += 1
        deliver_due(None, spark, send, out_dir, last, max_attempts)


def run_dirs(spark: SparkSession, purpose: str) -> tuple[str, str]:
    """Fresh sink and checkpoint folders under the shared checkpoint folder."""
    base = shared_dir(spark, purpose)
    return f"{base}/out", f"{base}/checkpoint"


def feed_stream(spark: SparkSession, folder: str, glob: str = "*.xml",
                max_files: int | None = None) -> DataFrame:
    """T-1: RSS documents arriving in ``folder`` as a stream of items
    (``feed``, ``source``, ``item_pos``, ``title``, ``link``, ``description``,
    ``pub_date_raw``, ``pub_ts``).  Items without title/link or with an
    unparsable date are dropped (F1, F2)."""
    from tessera.functions.dates import parse_rfc822
    from tessera.operators.feeds import valid_items
    from tessera.sources.files import CHANNEL, feed_items

    r = (spark.readStream.format("xml").option("rowTag", "channel").schema(CHANNEL)
         .option("pathGlobFilter", glob))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    with small_files(spark):
        items = valid_items(feed_items(r.load(folder))).withColumn("pub_ts", parse_rfc822(F.col("pub_date_raw")))
    return items.filter(F.col("pub_ts").isNotNull())


def feed_documents(spark: SparkSession, folder: str, glob: str = "*", archive: str | None = None,
                   max_files: int | None = None) -> DataFrame:
    """T-1: feed files arriving anywhere below ``folder``, whole: ``feed`` (path), ``text``.

    With ``archive`` a file is moved there once the micro-batch that read it
    has been committed, so the folder to be listed stays short.  An empty file
    gives no row.
    """
    from tessera.sources.files import _decoded

    r = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True) \
        .option("pathGlobFilter", glob)
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    with small_files(spark):
        return r.load(folder).select(_decoded(F.col("_metadata.file_path")).alias("feed"), F.col("value").alias("text"))


def stream_feeds(docs: DataFrame, out_dir: str, ckpt: str, max_age_hours: float) -> None:
    """T-1: items of a stream of feed files, every file and item accounted for.

    ``out_dir`` gets per micro-batch: ``corrupt`` (feed, text) for files that do not parse
    as a whole, ``items`` (F1, F2 and age passed), ``late`` and ``rejected``
    with the ``reason`` of an item without title or link, or of a bad date.
    An item is late when its date is more than ``max_age_hours`` before the
    latest valid date of the earlier micro-batches (``clock``); late items
    move the clock no further.  All folders belong to the micro-batch, so a
    retry rewrites the same rows.
    """
    from tessera.functions.dates import parse_rfc822
    from tessera.functions.text import ustrip
    from tessera.session import materialize
    from tessera.sources.files import channel_items, parse_feeds

    spark = docs.sparkSession
    empty = lambda name: F.coalesce(ustrip(F.col(name)), F.lit("")) == ""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch_id={batch_id}")
        clock = _written(spark, f"{out_dir}/clock", batch_id - 1)
        before = clock.first()["seen"] if clock is not None else None  # one value a micro-batch
        parsed = materialize(parse_feeds(batch).withColumn("text", F.when(F.col("broken"), F.col("text"))), "feed-files")
        put(parsed.where("broken").select("feed", "text"), "corrupt")
        items = channel_items(parsed.where("NOT broken")).withColumn("pub_ts", parse_rfc822(F.col("pub_date_raw")))
        oldest = F.lit(None).cast("timestamp") if before is None else F.lit(before) - F.expr(f"make_dt_interval(0, 0, 0, {max_age_hours * 3600})")
        items = materialize(items.withColumn("reason", F.when(empty("title") | empty("link"), "no title or link")
                                             .when(F.col("pub_ts").isNull(), "bad date").when(F.col("pub_ts") < oldest, "late")), "feed-items")
        fresh = items.where("reason IS NULL")
        put(fresh.drop("reason"), "items")
        put(items.where("reason = 'late'").drop("reason"), "late")
        put(items.where("reason <> 'late'"), "rejected")
        put(fresh.agg(F.greatest(F.max("pub_ts"), F.lit(before).cast("timestamp")).alias("seen")), "clock")

    with small_files(spark):
        _run(docs.writeStream.foreachBatch(per_batch), ckpt)
