"""Late events, expiry and retries: plain versions, and micro-batches that are killed between write and commit."""

import datetime as dt
import os
from collections import Counter

from pyspark.sql import functions as F

from tessera.streaming import jobs

DAY = dt.datetime(2024, 1, 1)


def _run_parts(spark, folder, schema, parts, job):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        job(spark.readStream.schema(schema).parquet(folder))


def _uncommit(ckpt):
    """As if the run had been killed after its last micro-batch's writes, before its commit."""
    last = max(int(n) for n in os.listdir(f"{ckpt}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{ckpt}/commits/{name}"):
            os.remove(f"{ckpt}/commits/{name}")


def test_stories_close_by_event_time_and_late_events_go_aside(spark, tmp_path):
    at = lambda h: None if h is None else DAY + dt.timedelta(hours=h)
    parts = [[("a", 1, 0), ("b", 2, 5), ("a", 3, 9), ("n", 4, None)],
             [("a", 5, 30), ("b", 6, 1)],  # seen 9 -> nothing late yet; the clock moves to 30 and closes b
             [("b", 7, 4), ("b", 8, 25), ("c", 9, 20), ("c", 10, 19)],  # before 20: late
             [("d", 11, 60)]]
    out, ckpt = f"{tmp_path}/out", f"{tmp_path}/ckpt"
    schema = "link string, event_id long, ts timestamp_ntz"
    job = lambda s: jobs.stream_stories(s, out, ckpt, 10)
    _run_parts(spark, f"{tmp_path}/in", schema, [[(k, i, at(h)) for k, i, h in p] for p in parts], job)

    def state():
        late = sorted(r["event_id"] for r in spark.read.parquet(f"{out}/late").collect())
        closed = sorted((r["link"], r["first_event"], r["n"], r["batch_id"]) for r in spark.read.parquet(f"{out}/closed").collect())
        held = sorted((r["link"], r["n"]) for r in spark.read.parquet(f"{out}/open").where("batch_id = 3").collect())
        return late, closed, held

    want = ([7, 10], [("a", 1, 3, 3), ("b", 6, 2, 1), ("b", 8, 1, 3), ("c", 9, 1, 3)], [("d", 1)])
    assert state() == want
    _uncommit(ckpt)
    job(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    assert state() == want


def test_every_story_is_settled_once_and_a_killed_round_changes_nothing(spark, tmp_path):
    stories = [(k % 3, k, f"p{k}\nx") for k in range(40)]
    refused = lambda k: k % 6

    def send(payload, attempt):
        assert payload.endswith("\nx")
        if attempt <= int(payload[1:-2]) % 6:
            raise ConnectionError("busy")
        return "sent"

    out, ckpt = f"{tmp_path}/out", f"{tmp_path}/ckpt"
    schema = "queue_id long, story long, payload string"
    job = lambda s: jobs.stream_retry(s, send, out, ckpt, 4)
    _run_parts(spark, f"{tmp_path}/in", schema, [stories[:15], stories[15:16], stories[16:]], job)
    rows = lambda: Counter(map(tuple, spark.read.parquet(f"{out}/settled").collect()))
    before = rows()
    _uncommit(ckpt)
    job(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    assert rows() == before
    first = {r[1]: r[4] for r in before if r[0] is not None and r[2] == 1}
    assert set(first.values()) == {0, 2} and all(r[4] > first.get(r[1], -1) for r in before if r[2] > 1)
    jobs.settle(spark, send, out, 4)
    got = Counter((r["queue_id"], r["story"], r["attempts"], r["delivered"]) for r in spark.read.parquet(f"{out}/settled").collect())
    assert got == Counter((q, k, min(refused(k) + 1, 4), refused(k) < 4) for q, k, _ in stories)
    assert spark.read.parquet(f"{out}/ledger").where(F.col("batch_id") == 0).count() > 0


def _feed(title, *items, end="</channel></rss>"):
    return f"<rss><channel><title>{title}</title>" + "".join(
        f"<item><title>{t}</title><link>{u}</link><pubDate>{d}</pubDate></item>" for t, u, d in items) + end


def _feed_rounds(folder, run):
    day = "{:02d} May 2026 08:00:00 GMT".format
    rounds = [{"a": _feed("A", ("one", "u1", day(10)), (" ", "u2", day(10)), ("three", "u3", "soon"))},
              {"b": _feed("B", ("cut", "u4", day(20)), end=""), "c": "no xml", "d": "<html><body/></html>", "e": "", "f": _feed("F")},
              {"sub/g": _feed("G", ("five", "u5", day(14)), ("&lt;six&gt;", "u6", day(9)), ("seven", "u7", day(8)))}]
    for files in rounds:
        for name, text in files.items():
            path = os.path.join(folder, f"{name}.xml")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write(text)
        run()


def _feed_state(spark, out):
    read = lambda name, *cols: sorted(map(tuple, spark.read.parquet(f"{out}/{name}").select(*cols).collect()))
    return (read("items", "source", "title", "link"), read("late", "link"), read("rejected", "link", "reason"),
            sorted((os.path.basename(f), len(t)) for f, t in read("corrupt", "feed", "text")))


_FEED_WANT = ([("A", "one", "u1"), ("G", "<six>", "u6"), ("G", "five", "u5")], [("u7",)],
              [("u2", "no title or link"), ("u3", "bad date")],
              [("b.xml", len(_feed("B", ("cut", "u4", "20 May 2026 08:00:00 GMT"), end=""))), ("c.xml", 6), ("d.xml", 20)])


def test_feed_files_are_accounted_for_and_a_killed_round_changes_nothing(spark, tmp_path):
    folder, out, ckpt = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ckpt"
    run = lambda: jobs.stream_feeds(jobs.feed_documents(spark, folder, "*.xml"), out, ckpt, 36)
    _feed_rounds(folder, run)
    assert _feed_state(spark, out) == _FEED_WANT
    _uncommit(ckpt)
    run()
    assert _feed_state(spark, out) == _FEED_WANT


def test_read_feed_files_go_to_the_archive(spark, tmp_path):
    folder, archive, out, ckpt = (f"{tmp_path}/{n}" for n in ("in", "read", "out", "ckpt"))
    left = lambda top: {n for _, _, names in os.walk(top) for n in names if n.endswith(".xml")}
    _feed_rounds(folder, lambda: jobs.stream_feeds(jobs.feed_documents(spark, folder, "*.xml", archive), out, ckpt, 36))
    assert _feed_state(spark, out) == _FEED_WANT
    assert "a.xml" in left(archive) and "a.xml" not in left(folder)
    assert left(folder) | left(archive) == {f"{n}.xml" for n in "abcdefg"}


def test_listing_takes_few_tasks_however_many_feed_folders_there_are(spark, tmp_path):
    folder, archive, out, ckpt = (f"{tmp_path}/{n}" for n in ("in", "read", "out", "ckpt"))
    day = "10 May 2026 08:00:00 GMT"
    for k in range(100):
        os.makedirs(f"{folder}/feed={k}")
        with open(f"{folder}/feed={k}/part.xml", "w") as f:
            f.write(_feed("A", (f"story {k}", f"u{k}", day), end="" if k % 10 == 0 else "</channel></rss>"))
    sc, names = spark.sparkContext, ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes",
                                     "spark.sql.streaming.fileSource.cleaner.numThreads")
    before = [spark.conf.get(n, None) for n in names]
    sc.setJobGroup("feed-listing", "")
    try:
        docs = jobs.feed_documents(spark, folder, "*.xml", archive)
        track = sc.statusTracker()
        tasks = [track.getStageInfo(s).numTasks for j in track.getJobIdsForGroup("feed-listing") for s in track.getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < max(tasks) <= 4 * sc.defaultParallelism < 100
    jobs.stream_feeds(docs, out, ckpt, 36)
    assert [spark.conf.get(n, None) for n in names] == before
    items, _, rejected, corrupt = _feed_state(spark, out)
    assert (len(items), rejected, len(corrupt)) == (90, [], 10) and all(n > 0 for _, n in corrupt)
