"""Registered streaming queries (T-1 .. T-5), each checked against batch SQL.

The ``events`` table arrives in several ranges, each as many files; after each
the stream runs on with ``availableNow`` from its checkpoint, and the query
returns the sink table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import fifo
from tessera.plans import sqltext as S
from tessera.plans.registry import query
from tessera.plans.source_plans import _xml
from tessera.session import shared_dir
from tessera.sources.tables import Tables
from tessera.streaming import jobs

STREAM_NOW = "2024-01-31 00:00:00"
STREAM_MAX_AGE_HOURS = 24 * 7


def _event_streams(spark, sf_dir):
    return jobs.arrivals(Tables(spark, sf_dir).events, shared_dir(spark, "event-files"), "event_id")


@query("stream_unsent", oracle=f"""
SELECT 'https://news.example/s/' || json_extract_string(props, '$.k') AS link, min(event_id) AS first_event
FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '{STREAM_NOW}' - INTERVAL {STREAM_MAX_AGE_HOURS} HOUR
GROUP BY 1""")
def stream_unsent(spark, sf_dir):
    """T-1 T-2 T-4 T-5: streamed feed items, first event of every new link."""
    out, ckpt = jobs.run_dirs(spark, "stream-unsent")
    for ev in _event_streams(spark, sf_dir):
        stories = ev.filter(F.col("event_type") == "view").select(
            F.concat(F.lit("https://news.example/s/"), F.get_json_object("props", "$.k")).alias("link"),
            "event_id", "ts")
        jobs.stream_unsent(stories, out, ckpt, STREAM_NOW, STREAM_MAX_AGE_HOURS)
    return spark.read.parquet(out).select("link", "first_event")


_PAIRS = """
e AS (SELECT user_id AS queue_id, event_id AS seq, CASE WHEN event_type = 'view' THEN 1 ELSE -1 END AS d
      FROM events WHERE event_type IN ('view', 'click')),
s AS (SELECT *, sum(d) OVER (PARTITION BY queue_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM e),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY queue_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS m FROM s),
z AS (SELECT *, coalesce(lag(s - m) OVER (PARTITION BY queue_id ORDER BY seq), 0) AS size_before FROM m),
enq AS (SELECT queue_id, seq, row_number() OVER (PARTITION BY queue_id ORDER BY seq) AS k FROM z WHERE d = 1),
deq AS (SELECT queue_id, seq, row_number() OVER (PARTITION BY queue_id ORDER BY seq) AS k
        FROM z WHERE d = -1 AND size_before > 0),
pairs AS (SELECT enq.queue_id, enq.seq AS enq_seq, deq.seq AS deq_seq
          FROM enq JOIN deq ON enq.queue_id = deq.queue_id AND enq.k = deq.k)"""


def _run_fifo(spark, sf_dir):
    out, ckpt = jobs.run_dirs(spark, "stream-fifo")
    for ev in _event_streams(spark, sf_dir):
        q = ev.filter(F.col("event_type").isin("view", "click")).select(
            F.col("user_id").alias("queue_id"), F.col("event_id").alias("seq"),
            F.when(F.col("event_type") == "view", F.lit(fifo.ENQUEUE)).otherwise(F.lit(fifo.POP)).alias("op"))
        jobs.stream_fifo(q, out, ckpt)
    return out


@query("stream_fifo", oracle=f"WITH {_PAIRS} SELECT queue_id, enq_seq, deq_seq FROM pairs")
def stream_fifo(spark, sf_dir):
    """T-3: FIFO per queue in Structured Streaming (pairs of popped stories)."""
    return spark.read.parquet(_run_fifo(spark, sf_dir)).select("queue_id", "enq_seq", "deq_seq")


def flaky_send(payload: str) -> str:
    """Stand-in for a message service: refuses every seventh story."""
    if int(payload) % 7 == 0:
        raise ConnectionError("refused")
    return "sent"


@query("stream_requeue", oracle=f"""WITH {_PAIRS}
SELECT queue_id, enq_seq AS story, deq_seq, enq_seq % 7 <> 0 AS delivered FROM
(SELECT queue_id, enq_seq, CASE WHEN enq_seq % 7 <> 0 THEN deq_seq END AS deq_seq FROM pairs)""")
def stream_requeue(spark, sf_dir):
    """T-5: popped stories are delivered; those that fail are enqueued again."""
    out = _run_fifo(spark, sf_dir)
    schema = spark.read.parquet(out).select("queue_id", "enq_seq", "deq_seq").schema
    popped = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(out) \
        .withColumn("payload", F.col("enq_seq").cast("string"))
    done, ckpt = jobs.run_dirs(spark, "stream-deliver")
    jobs.stream_deliver(popped, flaky_send, done, ckpt)
    sent = spark.read.parquet(f"{done}/delivered").select("queue_id", F.col("enq_seq").alias("story"), "deq_seq",
                                                          F.lit(True).alias("delivered"))
    back = spark.read.parquet(f"{done}/requeued").where(F.col("op") == fifo.ENQUEUE).select(
        "queue_id", "story", F.lit(None).cast("long").alias("deq_seq"), F.lit(False).alias("delivered"))
    return sent.unionByName(back)


@query("stream_watermark", oracle="""
SELECT DISTINCT 'https://news.example/s/' || json_extract_string(props, '$.k') AS link FROM events WHERE event_type = 'view'""")
def stream_watermark(spark, sf_dir):
    """T-4 T-2: never-send-twice bounded by an event-time watermark (as long as the table's time span)."""
    out, ckpt = jobs.run_dirs(spark, "stream-watermark")
    for ev in _event_streams(spark, sf_dir):
        stories = ev.filter(F.col("event_type") == "view").select(
            F.concat(F.lit("https://news.example/s/"), F.get_json_object("props", "$.k")).alias("link"), "event_id", "ts")
        d = jobs.dedup_within_watermark(stories, "3650 days").select("link")
        jobs._run(d.writeStream.format("parquet").option("path", out), ckpt)
    return spark.read.parquet(out)


LATE_PARTS, LATE_HOURS = 4, 36
_ARRIVES = "epoch_us(ts) + CASE WHEN event_id % 10 = 0 THEN 6 * 86400000000 ELSE 0 END"


def _stories_sql() -> str:
    """Micro-batch after micro-batch: watermark, late rows, state, closed stories."""
    age = f"INTERVAL {LATE_HOURS} HOUR"
    steps = [f"""WITH e AS (SELECT 'https://news.example/s/' || json_extract_string(props, '$.k') AS link, event_id, ts,
  {_ARRIVES} AS arrives FROM events WHERE event_type = 'view'),
r AS (SELECT min(arrives) AS lo, max(arrives) + 1 - min(arrives) AS span FROM e),
b AS (SELECT e.*, CASE {' '.join(f'WHEN arrives < lo + span * {i + 1} // {LATE_PARTS} THEN {i}' for i in range(LATE_PARTS))} END AS batch FROM e, r),
c0 AS (SELECT NULL::TIMESTAMP AS seen), o0 AS (SELECT link, ts AS first_ts, event_id AS first_event, ts AS last_ts, 1 AS n FROM b WHERE false)"""]
    for i in range(LATE_PARTS):
        steps.append(f"""
l{i} AS (SELECT link, event_id, ts FROM b, c{i} WHERE batch = {i} AND ts < seen - {age}),
s{i} AS (SELECT link, min(first_ts) AS first_ts, arg_min(first_event, (first_ts, first_event)) AS first_event, max(last_ts) AS last_ts, sum(n) AS n
  FROM (SELECT * FROM o{i} UNION ALL SELECT link, ts, event_id, ts, 1 FROM b, c{i} WHERE batch = {i} AND (seen IS NULL OR ts >= seen - {age}))
  GROUP BY link),
c{i + 1} AS (SELECT greatest(max(last_ts), (SELECT seen FROM c{i})) AS seen FROM s{i}),
d{i} AS (SELECT s{i}.* FROM s{i}, c{i + 1} WHERE last_ts < seen - {age}),
o{i + 1} AS (SELECT s{i}.* FROM s{i}, c{i + 1} WHERE last_ts >= seen - {age})""")
    parts = [f"SELECT 'late' AS kind, link, event_id AS first_event, ts AS last_ts, 1 AS n FROM l{i}" for i in range(LATE_PARTS)]
    parts += [f"SELECT 'closed', link, first_event, last_ts, n FROM d{i}" for i in range(LATE_PARTS)]
    parts += [f"SELECT 'open', link, first_event, last_ts, n FROM o{LATE_PARTS}"]
    return ",".join(steps) + "\nSELECT kind, link, first_event, last_ts, n::BIGINT AS n FROM (" + " UNION ALL ".join(parts) + ")"


@query("stream_late", oracle=_stories_sql())
def stream_late(spark, sf_dir):
    """T-4: stories by event time; every tenth event arrives six days late, the watermark is 36 hours."""
    views = Tables(spark, sf_dir).events.where("event_type = 'view'").select(
        F.concat(F.lit("https://news.example/s/"), F.get_json_object("props", "$.k")).alias("link"), "event_id", "ts",
        (F.unix_micros(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 10 == 0, 6 * 86_400_000_000).otherwise(0)).alias("arrives"))
    out, ckpt = jobs.run_dirs(spark, "stream-late")
    for stream in jobs.arrivals(views, shared_dir(spark, "late-files"), "arrives", parts=LATE_PARTS):
        jobs.stream_stories(stream, out, ckpt, LATE_HOURS)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    last = read("open").agg(F.max("batch_id")).first()[0]
    late = read("late").select(F.lit("late").alias("kind"), "link", F.col("event_id").alias("first_event"), F.col("ts").alias("last_ts"),
                               F.lit(1).cast("long").alias("n"))
    closed = read("closed").select(F.lit("closed").alias("kind"), "link", "first_event", "last_ts", "n")
    left = read("open").where(F.col("batch_id") == last).select(
        F.lit("open").alias("kind"), "link", F.col("first.event_id").alias("first_event"), "last_ts", "n")
    return late.unionByName(closed).unionByName(left)


MAX_ATTEMPTS = 4


def busy_send(payload: str, attempt: int) -> str:
    """Stand-in for a message service: every seventh story is refused up to five times."""
    story = int(payload)
    if story % 7 == 0 and attempt <= story // 7 % 6:
        raise ConnectionError("busy")
    return "sent"


@query("stream_retries", oracle=f"""WITH {_PAIRS},
t AS (SELECT queue_id, enq_seq AS story, CASE WHEN enq_seq % 7 = 0 THEN enq_seq // 7 % 6 ELSE 0 END AS refused FROM pairs)
SELECT queue_id, story, least(refused + 1, {MAX_ATTEMPTS})::INTEGER AS attempts, refused < {MAX_ATTEMPTS} AS delivered FROM t""")
def stream_retries(spark, sf_dir):
    """T-5: popped stories are delivered; refused ones are tried again, later each time, and given up after four attempts."""
    popped = _run_fifo(spark, sf_dir)
    schema = spark.read.parquet(popped).select("queue_id", "enq_seq").schema
    stories = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(popped).select(
        "queue_id", F.col("enq_seq").alias("story"), F.col("enq_seq").cast("string").alias("payload"))
    out, ckpt = jobs.run_dirs(spark, "stream-retries")
    jobs.stream_retry(stories, busy_send, out, ckpt, MAX_ATTEMPTS)
    jobs.settle(spark, busy_send, out, MAX_ATTEMPTS)
    return spark.read.parquet(f"{out}/settled").select("queue_id", "story", "attempts", "delivered")


# Hadoop's local folders get a checksum file beside every file, which doubles the time to
# write many small ones; other stores are not touched by this.
NO_CHECKSUM_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
FEED_SIZE, FEED_ROUNDS, FEED_HOURS = 20, 3, 60
_FEED = f"(doc_id // {FEED_SIZE})"


@query("stream_feeds", oracle=f"""
WITH d AS (SELECT {_FEED} AS feed, CASE WHEN {_FEED} % 4 = 3 THEN 2 ELSE {_FEED} % 3 END AS round,
  'https://news.example/doc/' || cast(doc_id AS varchar) AS link, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'Story ' || cast(doc_id AS varchar) END AS title,
  {S.ustrip("regexp_replace(coalesce(text, ''), '[[:cntrl:]]+', ' ', 'g')")} AS description,
  CASE WHEN doc_id % 11 <> 4 THEN TIMESTAMP '2026-05-01 06:30:00' + INTERVAL (CASE WHEN {_FEED} % 4 = 3 THEN 0 WHEN doc_id % 13 = 5 THEN 2
    ELSE 9 + 2 * ({_FEED} % 3) + doc_id % 3 END) DAY END AS pub_ts FROM documents),
i AS (SELECT *, CASE WHEN title = '' THEN 'no title or link' WHEN pub_ts IS NULL THEN 'bad date' END AS bad FROM d WHERE feed % 5 <> 2),
c AS (SELECT r, (SELECT max(pub_ts) FROM i WHERE bad IS NULL AND round < r) - INTERVAL {FEED_HOURS} HOUR AS oldest FROM range({FEED_ROUNDS}) t(r))
SELECT CASE WHEN bad IS NOT NULL THEN 'rejected' WHEN pub_ts < oldest THEN 'late' ELSE 'item' END AS kind, feed, link, title, description, pub_ts, bad AS reason
FROM i JOIN c ON round = r
UNION ALL SELECT DISTINCT 'corrupt', feed, NULL, NULL, NULL, NULL::TIMESTAMP, NULL FROM d WHERE feed % 5 = 2""")
def stream_feeds(spark, sf_dir):
    """T-1: XML files come in three rounds and are archived when read; broken files, late and bad items go aside."""
    n = F.col("doc_id")
    feed = F.floor(n / FEED_SIZE)
    day = F.when(feed % 4 == 3, 1).when(n % 13 == 5, 3).otherwise(10 + 2 * (feed % 3) + n % 3)
    date = F.when(n % 11 == 4, "soon").otherwise(F.concat(F.lpad(day.cast("string"), 2, "0"), F.lit(" May 2026 06:30:00 GMT")))
    item = F.concat(F.lit("<item><title>"), F.when(n % 9 == 0, " ").otherwise(F.concat(F.lit("Story "), n.cast("string"))),
                    F.lit("</title><link>https://news.example/doc/"), n.cast("string"), F.lit("</link><description>"),
                    _xml(F.regexp_replace(F.coalesce("text", F.lit("")), r"\p{Cntrl}+", " ")), F.lit("</description><pubDate>"), date,
                    F.lit("</pubDate></item>"))
    end = F.when(F.col("feed") % 5 == 2, "").otherwise("</channel></rss>")
    docs = Tables(spark, sf_dir).documents.groupBy(feed.alias("feed")).agg(F.array_join(F.collect_list(item), "").alias("items")) \
        .select("feed", F.concat(F.lit("<rss><channel><title>Feed</title>"), "items", end).alias("value"),
                F.when(F.col("feed") % 4 == 3, 2).otherwise(F.col("feed") % 3).alias("round"))
    folder, archive = shared_dir(spark, "feeds-in"), shared_dir(spark, "feeds-read")
    out, ckpt = jobs.run_dirs(spark, "stream-feeds")
    for i in range(FEED_ROUNDS):
        docs.where(F.col("round") == i).drop("round").repartition("feed").write.options(**NO_CHECKSUM_FILES).partitionBy("feed").text(f"{folder}/round-{i}")
        jobs.stream_feeds(jobs.feed_documents(spark, folder, "*.txt", archive), out, ckpt, FEED_HOURS)
    found = None
    for kind, name in (("item", "items"), ("late", "late"), ("rejected", "rejected"), ("corrupt", "corrupt")):
        rows = spark.read.parquet(f"{out}/{name}")
        rows = rows.select(F.lit(kind).alias("kind"), F.regexp_extract("feed", r"feed=(\d+)", 1).cast("long").alias("feed"),
                           *[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in ("link", "title", "description")],
                           (F.col("pub_ts") if kind != "corrupt" else F.lit(None).cast("timestamp")).cast("timestamp_ntz").alias("pub_ts"),
                           (F.col("reason") if kind == "rejected" else F.lit(None).cast("string")).alias("reason"))
        found = rows if found is None else found.unionByName(rows)
    return found
