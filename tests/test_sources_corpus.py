"""File sources (S1 S2 S3 S5 S7), corpus operators and the completion UDF."""

import os
import tempfile


from tessera.operators import complete, corpus
from tessera.sources import files

RSS = """<?xml version="1.0"?><rss><channel><title>{src}</title>
<item><title> {t1} </title><link>http://x/{t1}</link><pubDate>Fri, 08 May 2026 12:00:00 GMT</pubDate></item>
<item><title>{t2}</title><link></link><pubDate>x</pubDate></item>
</channel></rss>"""


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)
    return os.path.join(folder, name)


def test_read_feeds_union_no_dedup(spark):
    d = tempfile.mkdtemp(prefix="feeds-")
    paths = [_write(d, f"f{i}.xml", RSS.format(src=f"S{i}", t1="same", t2="B")) for i in range(4)]
    paths.append(_write(d, "bad.xml", "this is not xml"))
    items = files.read_feeds(spark, paths)
    rows = items.orderBy("feed_pos", "item_pos").collect()
    assert [(r.feed_pos, r.title, r.source) for r in rows if r.link] == [(i, "same", f"S{i}") for i in range(4)]
    assert len(rows) == 8  # blank links are filtered later (F1), not here


def test_json_arrays_and_totals(spark):
    d = tempfile.mkdtemp(prefix="cards-")
    _write(d, "a.json", '[{"direction": "spanish_to_target", "cue_spanish": "hola"}, {"direction": "x"}]')
    _write(d, "b.json", '{"not": "an array"}')
    _write(d, "c.json", "{broken")
    _write(d, "d.txt", "[]")
    schema = "direction string, cue_spanish string"
    from pyspark.sql.types import _parse_datatype_string
    out = files.read_json_arrays(spark, d, _parse_datatype_string(schema))
    rows = sorted((r.file, r.idx, r.direction) for r in out["rows"].collect())
    assert rows == [("a.json", 0, "spanish_to_target"), ("a.json", 1, "x")]
    t = files.file_totals(out["files"]).first()
    assert (t.total_files, t.total_cards) == (2, 2)


def test_texts_sent_log_word_list(spark):
    d = tempfile.mkdtemp(prefix="texts-")
    _write(d, "track01.txt", "uno\ndos")
    _write(d, "track2.txt", "tres")
    names = sorted(r.name for r in files.read_texts(spark, d).collect())
    assert names == ["track01.txt", "track2.txt"]
    log = _write(d, "sent.log", " http://a \n\nhttp://b\nhttp://a\n")
    assert sorted(r.url for r in files.read_sent_log(spark, log).collect()) == ["http://a", "http://b"]
    assert files.read_sent_log(spark, os.path.join(d, "missing.log")).count() == 0
    wl = _write(d, "words.txt", "hablar - to speak\nCasa (house - noun)\nsolo")
    got = [(r.term, r.gloss) for r in files.read_word_list(spark, wl).collect()]
    assert got == [("hablar", "to speak"), ("Casa", "house - noun"), ("solo", None)]


def _list(spark, words):
    return spark.createDataFrame([(w,) for w in words], "term string")


def test_hard_words_any_list_size_and_phrase_length(spark):
    docs = spark.createDataFrame([(1, "Además, la fuente dijo: los aliados, los aliados y además."),
                                  (2, "Nada aquí. Medida busca protegerla."), (3, None), (4, "a a a a b a a")],
                                 "doc_id long, text string")
    want = {(1, "además"): 2, (1, "fuente"): 1, (1, "los aliados"): 2, (2, "medida busca protegerla"): 1}
    got = lambda words: {(r.doc_id, r.term): r.n for r in corpus.hard_words(docs, _list(spark, words)).collect()}
    assert got(corpus.hard_word_list()) == want
    assert got([*corpus.hard_word_list(), *(f"none{i}" for i in range(6000))]) == want  # same answer for a long list
    assert got(["los  aliados", "LOS, aliados"]) == {(1, "los aliados"): 2}
    assert got(["a a", "a a a a b a a", "a"]) == {(4, "a a"): 4, (4, "a a a a b a a"): 1, (4, "a"): 6}
    assert got([]) == {} and got(["", " "]) == {}
    nested = {(r.doc_id, r.term): r.n for r in corpus.hard_words(
        docs, _list(spark, ["los", "los aliados", "aliados", "y además"])).collect()}
    assert nested == {(1, "los"): 2, (1, "los aliados"): 2, (1, "aliados"): 2, (1, "y además"): 1}


def test_glosses_follow_the_terms(spark):
    docs = spark.createDataFrame([(1, "Los Aliados, y la FUENTE: fuentes.", 7), (2, "nada", 8), (3, None, 9)],
                                 "doc_id long, text string, x int")
    words = spark.createDataFrame([("los aliados", "the allies"), ("aliados", "allies"), ("fuente", "source - note"),
                                   ("la", None), ("nada", " ")], "term string, gloss string")
    got = {r.doc_id: r.text for r in corpus.gloss(docs, words).collect()}
    assert got == {1: "Los Aliados ||(the allies)||, y la FUENTE ||(source - note)||: fuentes.", 2: "nada", 3: None}


def test_compact_batches_takes_every_sheet(spark):
    sheets = spark.createDataFrame([(f"s{i:03d}", f"t{i}") for i in range(195)], "name string, text string").repartition(3)
    out = corpus.compact_batches(sheets).orderBy("batch").collect()
    assert [r.n_sheets for r in out] == [10] * 19 + [5] and [r.batch for r in out] == list(range(1, 21))
    assert out[0].text.startswith("<s000>\nt0\n</>\n\n<s001>") and out[0].text.endswith(corpus.COMPACT_INSTRUCTION)


def test_sections_in_one_row(spark):
    docs = spark.createDataFrame([(1, "a\nb\n# T\nc\n## U \n# V"), (2, "# only"), (3, "plain"), (4, None), (5, "")],
                                 "doc_id long, text string")
    got = sorted(tuple(r) for r in corpus.sections(docs).collect())
    assert got == [(1, -1, 0, "", 2), (1, 2, 1, "T", 2), (1, 4, 2, "U ", 1), (1, 5, 1, "V", 1), (2, 0, 1, "only", 1),
                   (3, -1, 0, "", 1), (5, -1, 0, "", 1)]


def test_batch_complete_errors_do_not_stop(spark):
    df = spark.createDataFrame([(i, "p" * i) for i in range(6)], "k long, prompt string")

    def fn(p):
        if len(p) == 3:
            raise ValueError("boom")
        return '{"n": %d}' % len(p) if len(p) % 2 == 0 else "```json\n[{\"n\": 1}]"

    res = complete.batch_complete(df, "k", "prompt", fn, max_in_flight=3)
    r = {x.k: (x.raw, x.error) for x in res.collect()}
    assert r[3][0] is None and "boom" in r[3][1] and r[4] == ('{"n": 4}', None)
    parts = complete.split_results(res, "k")
    assert parts["ok"].count() == 5 and parts["quarantine"].count() == 1
    done = spark.createDataFrame([(0,), (1,)], "k long")
    assert complete.resume(df, done, "k").count() == 4


def test_collection_tables_and_sinks(spark):
    import json
    from tessera.operators import notes as N
    col = spark.createDataFrame([(json.dumps({"1": {"id": 1, "name": "Default"}, "77": {"id": 77, "name": "ES"}}),
                                  json.dumps({"5": {"id": 5, "name": "Basic", "flds": [{"name": "Front"}, {"name": "Back"}],
                                                    "tmpls": []}}))], "decks string, models string")
    t = N.collection_tables(col)
    assert sorted((r.deck_id, r.deck_name) for r in t["decks"].collect()) == [(1, "Default"), (77, "ES")]
    assert [(r.mid, r.field_names) for r in t["models"].collect()] == [(5, ["Front", "Back"])]
    d = tempfile.mkdtemp(prefix="sinks-")
    cards = spark.createDataFrame([("k1", "A1"), ("k2", None)], "key string, level string")
    files.write_by_level(cards, d + "/by_level")
    assert {x for x in os.listdir(d + "/by_level") if x.startswith("level=")} == {"level=A1", "level=Uncategorized"}
    files.write_json_by_bucket(cards, d + "/json", "key", 4)
    assert spark.read.json(d + "/json").count() == 2
    files.append_sent(spark.createDataFrame([(" http://a ",)], "url string"), d + "/sent")
    files.append_sent(spark.createDataFrame([("http://a",)], "url string"), d + "/sent")
    assert [r.url for r in files.read_sent_log(spark, d + "/sent").collect()] == ["http://a"]


def test_render_blocks_keep_order(spark):
    from tessera.operators import speech
    segs = spark.createDataFrame([(1, i, i * 1.0, i + 0.5, "SPEAKER_00" if i % 2 else None, f" t{i} ")
                                  for i in range(25)], "track long, seg_no long, start double, end double, "
                                 "speaker string, text string")
    r = speech.render_transcripts(segs, block=4).first()
    want = "".join(f"[{float(i)}s - {i + 0.5}s] {'SPEAKER_00' if i % 2 else 'UNKNOWN'}: t{i}\n" for i in range(25))
    assert r.text == want and r.n_segments == 25


def test_dedup_within_watermark_and_unsent_stream(spark):
    """T-2 bounded variant and T-1/T-2/T-5 foreachBatch job on a two-file stream."""
    import datetime as dt
    import pyarrow as pa
    import pyarrow.parquet as pq
    from tessera.streaming import jobs
    src = tempfile.mkdtemp(prefix="feed-")
    t0 = dt.datetime(2026, 5, 8, 12)
    batches = [[("a", 1, t0), ("b", 2, t0), ("a", 3, t0)], [("a", 4, t0), ("c", 5, t0), ("old", 6, t0 - dt.timedelta(days=3))]]
    for i, b in enumerate(batches):
        link, eid, ts = zip(*b)
        pq.write_table(pa.table({"link": pa.array(link), "event_id": pa.array(eid, pa.int64()),
                                 "ts": pa.array(ts, pa.timestamp("us"))}), os.path.join(src, f"s{i}.parquet"))
    stream = jobs.file_stream(spark, src, "s*.parquet", max_files=1)
    out, ckpt = jobs.run_dirs(spark, "test-unsent")
    jobs.stream_unsent(stream, out, ckpt, now="2026-05-08 12:00:00", max_age_hours=24)
    got = sorted((r.link, r.first_event, r.batch_id) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, 0), ("b", 2, 0), ("c", 5, 1)]
    # bounded variant: one row per link while the watermark holds it
    d = jobs.dedup_within_watermark(jobs.file_stream(spark, src, "s*.parquet"))
    out2, ckpt2 = jobs.run_dirs(spark, "test-dedup")
    jobs._run(d.writeStream.format("parquet").option("path", out2), ckpt2)
    assert sorted(r.link for r in spark.read.parquet(out2).collect()) == ["a", "b", "c", "old"]


def test_transcript_sink_writes_both(spark):
    from tessera.operators import speech
    d = tempfile.mkdtemp(prefix="tr-")
    segs = spark.createDataFrame([(1, 0, 0.0, 1.25, None, "hola")],
                                 "track long, seg_no long, start double, end double, speaker string, text string")
    files.write_transcripts(segs, speech.render_transcripts(segs), d)
    assert spark.read.parquet(d + "/text").first().text == "[0.0s - 1.25s] UNKNOWN: hola\n"
    assert spark.read.parquet(d + "/segments").count() == 1


def test_feed_flow_end_to_end(spark):
    """Four XML feeds -> candidates, with reject counting."""
    from pyspark.sql import Observation
    from tessera.operators import feeds
    d = tempfile.mkdtemp(prefix="flow-")
    item = "<item><title>{t}</title><link>http://x/{t}</link><pubDate>{d}</pubDate></item>"
    docs = []
    for f in range(4):
        items = "".join(item.format(t=f"f{f}i{i}", d=("Fri, 08 May 2026 1%d:00:00 GMT" % i) if i != 2 else "bad date")
                        for i in range(4))
        docs.append(_write(d, f"feed{f}.xml", f"<rss><channel><title>S{f}</title>{items}</channel></rss>"))
    obs = Observation("feed")
    sent = spark.createDataFrame([("http://x/f0i1",)], "url string")
    got = feeds.feed_candidates(files.read_feeds(spark, docs), sent, "2026-05-08 13:30:00", 24, 5, obs)
    rows = [r.title for r in got.orderBy("feed_pos", "item_pos").collect()]
    assert rows == ["f0i0", "f0i3", "f1i0", "f1i1"]   # limit 5 first, then f0i1 removed
    assert obs.get == {"bad_dates": 4, "items": 16}


def test_xml_feed_stream_never_sends_twice(spark):
    """T-1 + T-2: XML feed files arrive one per micro-batch; a link already
    sent in an earlier batch is not sent again; old items never enter."""
    from pyspark.sql import functions as F
    from tessera.streaming import jobs
    d = tempfile.mkdtemp(prefix="xmlstream-")
    item = "<item><title>{t}</title><link>http://x/{l}</link><pubDate>{p}</pubDate></item>"
    recent_d, old_d = "Fri, 08 May 2026 11:00:00 GMT", "Mon, 04 May 2026 11:00:00 GMT"
    _write(d, "a.xml", "<rss><channel><title>A</title>" + item.format(t="t1", l="1", p=recent_d)
           + item.format(t="t2", l="2", p=recent_d) + "</channel></rss>")
    _write(d, "b.xml", "<rss><channel><title>B</title>" + item.format(t="t1 again", l="1", p=recent_d)
           + item.format(t="t3", l="3", p=recent_d) + item.format(t="old", l="4", p=old_d) + "</channel></rss>")
    s = jobs.feed_stream(spark, d, max_files=1).withColumn(
        "event_id", F.xxhash64("feed", "item_pos")).withColumnRenamed("pub_ts", "ts")
    out, ckpt = jobs.run_dirs(spark, "test-xml")
    jobs.stream_unsent(s.select("link", "event_id", "ts"), out, ckpt, now="2026-05-08 12:00:00",
                       max_age_hours=24)
    assert sorted(r.link for r in spark.read.parquet(out).collect()) == ["http://x/1", "http://x/2", "http://x/3"]


def test_speaker_assignment_matches_brute_force(spark):
    import random
    from tessera.operators import speech
    rnd = random.Random(3)
    segs, turns = [], []
    for tr in range(3):
        for i in range(40):
            s = rnd.randrange(0, 5000)
            segs.append((tr, tr * 1000 + i, s, s + rnd.randrange(0, 300)))
        for i in range(25):
            s = rnd.randrange(0, 5000)
            turns.append((tr, rnd.choice(["A", "B", "C"]), s, s + rnd.randrange(1, 900)))

    def brute():
        out = {}
        for tr, sid, s, e in segs:
            ov = {}
            for tr2, spk, s2, e2 in turns:
                if tr2 == tr and min(e, e2) - max(s, s2) > 0:
                    ov[spk] = ov.get(spk, 0) + min(e, e2) - max(s, s2)
            best = min(ov.items(), key=lambda kv: (-kv[1], kv[0])) if ov else ("UNKNOWN", 0)
            out[sid] = best
        return out

    sdf = spark.createDataFrame(segs, "track long, seg_id long, start_us long, end_us long")
    tdf = spark.createDataFrame(turns, "track long, speaker string, start_us long, end_us long")
    want = brute()
    for fn in (lambda: speech.assign_speakers(sdf, tdf, chunk_rows=16), lambda: speech.assign_speakers(sdf, tdf),
               lambda: speech.assign_speakers_binned(sdf, tdf, bin_us=250)):
        got = {r.seg_id: (r.speaker, r.overlap_us) for r in fn().collect()}
        assert got == want


def test_snapshot_fields_dict_semantics(spark):
    """Repeated names keep the first position and the last value; zip truncates."""
    from pyspark.sql import functions as F
    from tessera.operators import notes as N
    df = spark.createDataFrame([(["a", "b", "a", "c"], "1\x1f2\x1f3")], "field_names array<string>, flds string")
    z = N.zip_fields(df)
    r = z.select(F.to_json(N.snapshot_fields(F.col("_names"), F.col("_values"), F.col("_rnames"))).alias("j"),
                 N.note_text(F.col("_names"), F.col("_values")).alias("t")).first()
    names, vals = ["a", "b", "a", "c"], ["1", "2", "3"]
    assert r.j == '{"a":"3","b":"2"}' == __import__("json").dumps(dict(zip(names, vals)), separators=(",", ":"))
    assert r.t == "a: 1\nb: 2\na: 3"


def test_speakers_of_a_long_dense_track(spark):
    """100,000 turns of one speaker with epoch microseconds: nothing overflows."""
    import bisect
    from pyspark.sql import functions as F
    from tessera.operators import speech
    base, n = 1_780_000_000_000_000, 100_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("track"), F.lit("A").alias("speaker"),
                                  (F.lit(base) + F.col("id") * 1_000_000).alias("start_us"),
                                  (F.lit(base) + F.col("id") * 1_000_000 + 400_000 + F.col("id") % 7).alias("end_us"))
    segs = [(1, k, base + k * 37_000_123, base + k * 37_000_123 + 5_500_000 * (1 + k % 50)) for k in range(2500)]
    segs += [(1, 9000, base - 10**12, base + 10**13), (1, 9001, 0, 5), (1, 9002, base, base), (2, 9003, base, base + 10)]
    got = {r.seg_id: (r.speaker, r.overlap_us) for r in speech.assign_speakers(
        spark.createDataFrame(segs, "track long, seg_id long, start_us long, end_us long"), turns).collect()}
    s = [base + i * 1_000_000 for i in range(n)]
    e = [x + 400_000 + i % 7 for i, x in enumerate(s)]
    total = [0]
    for a, b in zip(s, e):
        total.append(total[-1] + b - a)
    for track, k, lo, hi in segs:
        i, j = bisect.bisect_right(e, lo), bisect.bisect_left(s, hi)
        want = 0
        if track == 1 and i < j and lo < hi:
            want = total[j] - total[i] - max(0, lo - s[i]) - max(0, e[j - 1] - hi)
        assert got[k] == (("A", want) if want else ("UNKNOWN", 0)), k


def test_speakers_of_long_and_nested_intervals(spark):
    """Intervals over many chunks, ties, several intervals of one seg_id: as by brute force."""
    import random
    from tessera.operators import speech
    rnd = random.Random(8)
    segs, turns = [], []
    for tr in range(2):
        for i in range(60):
            s = rnd.randrange(0, 4000)
            turns.append((tr, rnd.choice("ABCDEF"), s, s + rnd.choice([5, 40, 300, 2500])))
        for i in range(50):
            s = rnd.randrange(0, 3000)
            segs.append((tr, 100 * tr + i, s, s + rnd.choice([3, 100, 900, 3000])))
        segs += [(tr, 100 * tr + 80, 10 + i, 6000 - i) for i in range(3)]  # nested
        segs += [(tr, 100 * tr + 81, 100, 1500), (tr, 100 * tr + 81, 2000, 3900), (tr, 100 * tr + 81, 2000, 3900)]
        turns += [(tr, "Y", 0, 5000), (tr, "X", 0, 5000), (tr, "X", 1, 2)]
    want = {}
    for tr, sid, s, e in segs:
        ov = want.setdefault(sid, {})
        for tr2, spk, s2, e2 in turns:
            if tr2 == tr and min(e, e2) > max(s, s2):
                ov[spk] = ov.get(spk, 0) + min(e, e2) - max(s, s2)
    want = {k: min(ov.items(), key=lambda kv: (-kv[1], kv[0])) if ov else ("UNKNOWN", 0) for k, ov in want.items()}
    sdf = spark.createDataFrame(segs, "track long, seg_id long, start_us long, end_us long")
    tdf = spark.createDataFrame(turns, "track long, speaker string, start_us long, end_us long")
    for rows in (4, 9):
        got = {r.seg_id: (r.speaker, r.overlap_us) for r in speech.assign_speakers(sdf, tdf, chunk_rows=rows).collect()}
        assert got == want


def test_nested_segments_cost_linear_rows(spark):
    """100,000 segments, each around the next, over 2,000 turns: a segment has two pieces, not one for each chunk."""
    from pyspark.sql import functions as F
    from tessera import session
    from tessera.operators import speech
    n = 100_000
    segs = spark.range(n).select(F.lit(1).cast("long").alias("track"), F.col("id").alias("seg_id"),
                                 F.col("id").alias("start_us"), (2 * n + 2000 * 50 - F.col("id")).alias("end_us"))
    turns = spark.range(2000).select(F.lit(1).cast("long").alias("track"), F.when(F.col("id") % 5 < 3, "B").otherwise("A").alias("speaker"),
                                     (n + F.col("id") * 50).alias("start_us"), (n + F.col("id") * 50 + 40).alias("end_us"))
    written = []
    session.ON_MATERIALIZE.append(written.append)
    try:
        got = speech.assign_speakers(segs, turns, chunk_rows=1024)
        sizes = [df.count() for df in written]
    finally:
        session.ON_MATERIALIZE.remove(written.append)
    assert got.select("speaker", "overlap_us").distinct().collect() == [("B", 1200 * 40)]
    assert max(sizes) <= 2 * (n + 2000)


def test_feed_order_on_encoded_paths(spark):
    d = tempfile.mkdtemp(prefix="feeds with spaces + 100%25 é-")
    paths = [_write(d, f"f {i}.xml", RSS.format(src=f"S{i}", t1=f"A{i}", t2="B")) for i in range(3)]
    rows = files.read_feeds(spark, paths[::-1]).where("link <> ''").collect()
    assert sorted((r.feed_pos, r.title) for r in rows) == [(0, "A2"), (1, "A1"), (2, "A0")]


def test_listed_feeds_follow_the_table(spark):
    """A file or a folder may be listed; what is not listed is left out."""
    d = tempfile.mkdtemp(prefix="feeds listed-")
    paths = [_write(d, f"f{i}.xml", RSS.format(src=f"S{i}", t1=f"A{i}", t2="B")) for i in range(3)]
    os.makedirs(os.path.join(d, "sub"))
    _write(os.path.join(d, "sub"), "g.xml", RSS.format(src="G", t1="AG", t2="B"))
    table = spark.createDataFrame([(7, "file://" + paths[2]), (3, os.path.join(d, "sub")), (1, d + "/gone.xml")],
                                  "feed_pos long, path string")
    rows = files.read_listed_feeds(spark, d, table).where("link <> ''").collect()
    assert sorted((r.feed_pos, r.title) for r in rows) == [(3, "AG"), (7, "A2")]
    assert files.read_listed_feeds(spark, d, table.limit(0)).count() == 0


def test_session_keeps_submitted_values_and_wants_a_shared_folder(spark, monkeypatch):
    from tessera import session
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("X", (), {"master": "yarn", "getCheckpointDir": staticmethod(lambda: None)})
    import pytest
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere, "x")
    monkeypatch.setenv("PYSPARK_SUBMIT_ARGS", "--master spark://h:7077 pyspark-shell")
    assert session._submitted()
