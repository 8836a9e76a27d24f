"""FIFO queue (FIXTURES 1.4), sent log and candidates (1.1, 1.3)."""

from pyspark.sql import functions as F

from tessera.operators import feeds, fifo
from tessera.operators.ordering import global_rank, with_previous

EV = "queue_id long, seq long, op string, ts timestamp"


def pairs(spark, rows, chunk, super_chunk=4096):
    df = spark.createDataFrame([(q, s, o, None) for q, s, o in rows], EV)
    return sorted((r.enq_seq, r.deq_seq) for r in fifo.fifo_pairs(df, chunk, super_chunk=super_chunk).collect())


def brute(rows):
    out, pend = {}, {}
    for q, s, o in sorted(rows, key=lambda r: r[1]):
        if o == "enqueue":
            pend.setdefault(q, []).append(s)
            out[s] = None
        elif pend.get(q):
            out[pend[q].pop(0)] = s
    return sorted(out.items())


def test_enqueue_pop_and_empty_pop(spark):
    rows = [(1, 1, "pop"), (1, 2, "enqueue"), (1, 3, "pop"), (1, 4, "pop"), (1, 5, "enqueue"),
            (1, 6, "enqueue"), (1, 7, "pop")]
    assert pairs(spark, rows, 1 << 16) == [(2, 3), (5, 7), (6, None)]


def test_chunked_scan_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(rnd.randrange(3), s, rnd.choice(["enqueue", "pop", "pop"])) for s in range(400)]
    want = brute(rows)
    for chunk, sup in ((3, 2), (3, 4096), (17, 3), (1000, 4096)):
        assert pairs(spark, rows, chunk, sup) == want


def test_depth_and_lookup(spark):
    df = spark.createDataFrame([(1, 1, "enqueue", None), (1, 2, "enqueue", None), (1, 3, "pop", None),
                                (2, 4, "pop", None)], EV)
    d = {r.queue_id: (r.pending, r.popped, r.oldest_pending_seq)
         for r in fifo.queue_depth(df).collect()}
    assert d == {1: (1, 1, 2)}
    stories = spark.createDataFrame([("l1", "u1"), ("l2", None)], "link string, url string")
    probes = spark.createDataFrame([("u1",), ("l2",), ("zz",)], "probe string")
    got = {r.probe: r.queued for r in fifo.queued_lookup(stories, probes).collect()}
    assert got == {"u1": True, "l2": True, "zz": False}


def test_unsent_keeps_order_values_and_duplicates(spark):
    items = spark.createDataFrame([(1, " a "), (2, "b"), (3, "b"), (4, "c")], "pos long, link string")
    sent = spark.createDataFrame([("a",), ("  ",), ("c\n",)], "url string")
    got = [(r.pos, r.link) for r in feeds.unsent(items, sent).orderBy("pos").collect()]
    assert got == [(2, "b"), (3, "b")]
    flags = {r.pos: r.is_sent for r in feeds.sent_flag(items, sent).collect()}
    assert flags == {1: True, 2: False, 3: False, 4: True}


def test_limit_before_filter_and_age(spark):
    import datetime as dt
    items = spark.createDataFrame(
        [(0, i, "t", f"l{i}", dt.datetime(2026, 5, 8, 12) - dt.timedelta(hours=h)) for i, h in enumerate([1, 30, 12])],
        "feed_pos int, item_pos int, title string, link string, ts timestamp")
    fresh = feeds.recent(items, "2026-05-08 12:00:00", 24)
    assert sorted(r.item_pos for r in fresh.collect()) == [0, 2]
    first = feeds.first_n(fresh, 1)
    sent = spark.createDataFrame([("l0",)], "url string")
    assert feeds.unsent(first, sent).count() == 0   # fewer than n remain


def test_global_rank_and_previous(spark):
    df = spark.range(0, 500).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    got = [r.rank for r in global_rank(df, ["name"], 7).orderBy("name").collect()]
    assert got == list(range(1, 501))
    prev = {r.name: r.prev_name for r in with_previous(df.withColumn("v", F.col("name")), ["name"], ["name"]).collect()}
    names = sorted(prev)
    assert prev[names[0]] is None and all(prev[names[i]] == names[i - 1] for i in range(1, 500))


def test_global_rank_of_many_wide_rows(spark):
    """More rows than the range sample, with a payload that is written out."""
    from tessera.session import shared_dir
    n = 1_000_000
    df = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("name"), F.col("id"),
                               F.repeat(F.col("id").cast("string"), 5).alias("payload"))
    path = shared_dir(spark, "rank-test")
    global_rank(df, ["name"], 16).write.parquet(path)
    out = spark.read.parquet(path)
    assert out.select("rank").distinct().count() == n and out.agg(F.min("rank"), F.max("rank")).first() == (1, n)
    by_name = out.select("rank", "name").sort("rank").select("name").collect()
    assert all(a.name < b.name for a, b in zip(by_name, by_name[1:]))


def test_queue_depth_without_pairs(spark):
    import random
    rnd = random.Random(4)
    rows = [(q, q * 1000 + i, rnd.choice(["enqueue", "pop"])) for q in range(9) for i in range(60)] + [(77, 1, "pop")]
    pairs = fifo.fifo_pairs(spark.createDataFrame(rows, "queue_id long, seq long, op string"), 16).collect()
    want = {}
    for r in pairs:
        p, d, o = want.get(r.queue_id, (0, 0, None))
        pending = r.deq_seq is None
        want[r.queue_id] = (p + pending, d + (not pending), min(x for x in (o, r.enq_seq) if x is not None) if pending else o)
    got = {r.queue_id: (r.pending, r.popped, r.oldest_pending_seq) for r in fifo.queue_depth(
        spark.createDataFrame(rows, "queue_id long, seq long, op string"), 16).collect()}
    assert got == want


def test_validate_events_quarantine(spark):
    raw = spark.createDataFrame([(1, 1, "enqueue", None), (1, None, "pop", None), (2, 3, "peek", None)], EV)
    out = fifo.validate_events(raw)
    assert out["events"].count() == 1
    assert sorted(r.reason for r in out["quarantine"].collect()) == ["missing seq", "unknown op"]


def test_stream_fifo_across_micro_batches(spark):
    """Three files = three micro-batches; state carries pending stories over."""
    import os
    import tempfile
    from tessera.streaming import jobs
    rows = [(1, 1, "enqueue"), (1, 2, "enqueue"), (2, 3, "pop"),      # file 0
            (1, 4, "pop"), (1, 5, "enqueue"), (2, 6, "enqueue"),      # file 1
            (1, 7, "pop"), (1, 8, "pop"), (1, 9, "pop"), (2, 10, "pop")]  # file 2
    import pyarrow as pa
    import pyarrow.parquet as pq
    src = tempfile.mkdtemp(prefix="qlog-")
    for i, part in enumerate([rows[:3], rows[3:6], rows[6:]]):
        q, sq, op = zip(*part)
        pq.write_table(pa.table({"queue_id": pa.array(q, pa.int64()), "seq": pa.array(sq, pa.int64()),
                                 "op": pa.array(op, pa.string())}), os.path.join(src, f"q{i}.parquet"))
    stream = jobs.file_stream(spark, src, "q*.parquet", max_files=1)
    out, ckpt = jobs.run_dirs(spark, "test-fifo")
    jobs.stream_fifo(stream, out, ckpt)
    got = sorted((r.queue_id, r.enq_seq, r.deq_seq) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1, 4), (1, 2, 7), (1, 5, 8), (2, 6, 10)]


def test_drop_materialized(spark):
    import os
    from tessera.session import _WRITTEN, drop_materialized, materialize
    df = materialize(spark.range(10), "test-drop")
    path = _WRITTEN[-1]
    assert df.count() == 10 and os.path.isdir(path.replace("file:", ""))
    assert drop_materialized(spark) >= 1
    assert not os.path.exists(path.replace("file:", ""))


def test_arrivals_are_written_by_many_tasks_and_read_in_order(spark, tmp_path):
    from tessera.streaming import jobs

    df = spark.range(0, 900, 1, 6).withColumnRenamed("id", "event_id")
    seen = []
    note = lambda b, k: seen.append((k, b.agg({"event_id": "min"}).first()[0], b.count()))
    for s in jobs.arrivals(df, str(tmp_path / "in"), "event_id"):
        jobs._run(s.writeStream.foreachBatch(note), str(tmp_path / "checkpoint"))
    assert seen == [(0, 0, 300), (1, 300, 300), (2, 600, 300)]
    assert len(list((tmp_path / "in").glob("*.parquet"))) >= 6  # two tasks or more wrote each range
