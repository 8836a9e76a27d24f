"""Registered queries for the shared queue.

Binding on ``events``: a ``view`` enqueues a story, a ``click`` pops one, the
queue is the user (``queue_id = user_id``) and ``seq = event_id``.  The story's
link comes from ``props.k``, its url from the event id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import fifo
from tessera.plans.registry import query
from tessera.sources.tables import Tables

CHUNK = 1 << 16  # sequence numbers per scan chunk


def queue_events(spark, sf_dir):
    ev = Tables(spark, sf_dir).events.filter(F.col("event_type").isin("view", "click"))
    k = F.get_json_object("props", "$.k")
    return ev.select(
        F.col("user_id").alias("queue_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", F.lit(fifo.ENQUEUE)).otherwise(F.lit(fifo.POP)).alias("op"),
        "ts", F.concat(F.lit("story "), k).alias("title"),
        F.concat(F.lit("https://news.example/s/"), k).alias("link"),
        F.concat(F.lit("https://news.example/e/"), F.col("event_id").cast("string")).alias("url"))


_QE = """
e AS (SELECT user_id AS queue_id, event_id AS seq, ts,
        CASE WHEN event_type = 'view' THEN 1 ELSE -1 END AS d,
        'story ' || json_extract_string(props, '$.k') AS title,
        'https://news.example/s/' || json_extract_string(props, '$.k') AS link,
        'https://news.example/e/' || cast(event_id AS varchar) AS url
      FROM events WHERE event_type IN ('view', 'click')),
s AS (SELECT *, sum(d) OVER (PARTITION BY queue_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM e),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY queue_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS m FROM s),
z AS (SELECT *, s - m AS size_after,
        coalesce(lag(s - m) OVER (PARTITION BY queue_id ORDER BY seq), 0) AS size_before FROM m),
enq AS (SELECT queue_id, seq, ts, title, link, url,
          row_number() OVER (PARTITION BY queue_id ORDER BY seq) AS k FROM z WHERE d = 1),
deq AS (SELECT queue_id, seq, ts, row_number() OVER (PARTITION BY queue_id ORDER BY seq) AS k
        FROM z WHERE d = -1 AND size_before > 0),
pairs AS (SELECT enq.queue_id, enq.seq AS enq_seq, enq.ts, enq.title, enq.link, enq.url,
            deq.seq AS deq_seq, deq.ts AS deq_ts
          FROM enq LEFT JOIN deq ON enq.queue_id = deq.queue_id AND enq.k = deq.k)"""


@query("fifo_queue", oracle=f"WITH {_QE} SELECT * FROM pairs")
def fifo_queue(spark, sf_dir):
    """Each enqueued story with the pop that took it (null = pending)."""
    return fifo.fifo_pairs(queue_events(spark, sf_dir), CHUNK)


@query("queue_depth", oracle=f"""WITH {_QE}
SELECT queue_id, count(*) FILTER (WHERE deq_seq IS NULL) AS pending,
  count(*) FILTER (WHERE deq_seq IS NOT NULL) AS popped,
  min(enq_seq) FILTER (WHERE deq_seq IS NULL) AS oldest_pending_seq
FROM pairs GROUP BY queue_id""")
def queue_depth(spark, sf_dir):
    """Pending count and oldest pending story per queue."""
    return fifo.queue_depth(queue_events(spark, sf_dir), CHUNK)


@query("queued_lookup", oracle="""
WITH st AS (SELECT 'https://news.example/s/' || json_extract_string(props, '$.k') AS link,
              'https://news.example/e/' || cast(event_id AS varchar) AS url
            FROM events WHERE event_type = 'view'),
p AS (SELECT event_id, CASE WHEN event_id % 2 = 0
        THEN 'https://news.example/s/' || json_extract_string(props, '$.k')
        ELSE 'https://news.example/e/' || cast(event_id - 1 AS varchar) END AS probe
      FROM events WHERE event_type = 'purchase')
SELECT event_id, probe,
  EXISTS (SELECT 1 FROM st WHERE st.link = p.probe OR st.url = p.probe) AS queued
FROM p""")
def queued_lookup(spark, sf_dir):
    """Is the probe URL in pending or sent (link or url match)?"""
    qe = queue_events(spark, sf_dir)
    stories = qe.filter(F.col("op") == fifo.ENQUEUE)  # pending + sent = every enqueued story
    ev = Tables(spark, sf_dir).events.filter(F.col("event_type") == "purchase")
    k = F.get_json_object("props", "$.k")
    probes = ev.select("event_id", F.when(F.col("event_id") % 2 == 0,
                                          F.concat(F.lit("https://news.example/s/"), k))
                       .otherwise(F.concat(F.lit("https://news.example/e/"),
                                           (F.col("event_id") - 1).cast("string"))).alias("probe"))
    return fifo.queued_lookup(stories, probes)
