"""The token automaton: parts, a million terms, overlaps, repeated keys and clashing columns."""

import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import corpus, terms


def _plain(docs, listed):
    out = Counter()
    for key, text in docs:
        w = (text or "").split()
        for t in set(listed):
            ts = t.split()
            n = sum(w[i:i + len(ts)] == ts for i in range(len(w) - len(ts) + 1))
            if n:
                out[key, t, n] += 1
    return out


def test_counts_equal_plain_search_whatever_the_parts(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choices(["a", "b", "é", "漢字", "d1", "x"], k=n))
    docs = [(k % 25, prose(rng.randint(0, 60))) for k in range(40)] + [(99, None), (None, "a b")]  # keys repeat
    listed = [prose(rng.randint(1, 6)) for _ in range(80)]
    frame = spark.createDataFrame(docs, "term long, text string").repartition(3)  # a column named like the result's
    frame = frame.withColumnRenamed("term", "n")
    want = _plain(docs, listed)
    words = spark.createDataFrame([(t,) for t in listed], "term string")
    for part_bytes in (1 << 20, 400):
        out = terms.count_terms(frame.withColumnRenamed("n", "id"), "id", F.col("text"), words, part_bytes)
        assert Counter(map(tuple, out.collect())) == want


def test_a_million_terms_in_one_pass(spark):
    words = spark.range(1_000_000).select(F.concat(F.lit("w"), F.col("id"), F.lit(" v"), F.col("id") % 1000).alias("term"))
    docs = spark.createDataFrame([(1, "x w7 v7 W7, v7 w8 v9 w999999 V999"), (2, "v7 w7"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, corpus.hard_words(docs, words).collect())) == [(1, "w7 v7", 2), (1, "w999999 v999", 1)]


def test_glosses_of_several_parts_are_chosen_together(spark):
    docs = spark.createDataFrame([(1, "Uno dos, tres cuatro! cinco", "f", 5), (1, "dos tres", "g", 6), (2, None, "h", 7), (3, "", "i", 8)],
                                 "own long, text string, found string, rest int")
    words = spark.createDataFrame([("uno dos", "1-2"), ("dos tres cuatro", "2-4"), ("tres", "3"), ("Tres, Cuatro", "3-4"), ("cinco", "5b"),
                                   ("cinco", "5a"), ("dos", "2")], "term string, gloss string")
    for part_bytes in (1 << 20, 30):
        terms.PART_BYTES, old = part_bytes, terms.PART_BYTES
        terms.annotate.__defaults__, before = (part_bytes,), terms.annotate.__defaults__
        try:
            got = corpus.gloss(docs, words)
            rows = sorted(map(tuple, got.collect()), key=lambda r: r[3])
        finally:
            terms.PART_BYTES, terms.annotate.__defaults__ = old, before
        assert got.columns == docs.columns
        assert rows == [(1, "Uno dos ||(1-2)||, tres cuatro ||(3-4)||! cinco ||(5a)||", "f", 5), (1, "dos ||(2)|| tres ||(3)||", "g", 6),
                        (2, None, "h", 7), (3, "", "i", 8)]
    assert corpus.gloss(docs, words.limit(0)).collect() == docs.collect()


def _tasks_of(monkeypatch, frame, call):
    """The functions that ``call`` gives to Spark's tasks."""
    run, old = [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema, *a, **k: run.append(f) or old(self, f, schema, *a, **k))
    call()
    return run


def test_memory_of_a_task_does_not_grow_with_the_rows_of_a_batch(spark, monkeypatch):
    prose = "uno_dos, x İx ΑΣ'Β. " * 200
    docs = spark.createDataFrame([(1, prose)], "id long, text string")
    words = spark.createDataFrame([("uno", "1"), ("ας", "s"), ("i̇x", "i")], "term string, gloss string")
    gloss = _tasks_of(monkeypatch, docs, lambda: corpus.gloss(docs, words))[-1]
    count = _tasks_of(monkeypatch, docs, lambda: corpus.hard_words(docs, words.select("term"), "id"))[-1]

    def peak(run, columns, rows):
        text = "uno dos x " * 400 if columns[1] == "_tokens" else prose
        batch = pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array([text] * (rows - 1) + [None])], names=columns)
        tracemalloc.start()
        try:
            out = sum(b.num_rows for b in run(iter([batch])))
            return out, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    for run, columns in ((gloss, ["c0", "c1"]), (count, ["id", "_tokens"])):
        peak(run, columns, 10)  # the automaton is built
        (few, low), (many, high) = peak(run, columns, 600), peak(run, columns, 2000)
        assert many > 3 * few > 0 and high < 1.5 * low


def test_glosses_stand_where_the_tokens_end(spark):
    docs = spark.createDataFrame([(k, text) for k, text in enumerate(["__Uno", "uno dos", "İx ΑΣ'Β_ας", "x", "", None] * 50 + ["uno " * 200_000])],
                                 "id long, text string")
    words = spark.createDataFrame([("uno", "1"), ("ας", "s"), ("İX", "i")], "term string, gloss string")
    got = [r["text"] for r in corpus.gloss(docs, words).orderBy("id").collect()]
    want = ["__Uno ||(1)||", "uno ||(1)|| dos", "İx ΑΣ ||(s)||'Β_ας ||(s)||", "x", "", None]
    assert [re.sub(r" \|\|\(i\)\|\|", "", t or "") if t else t for t in got[:-1]] == want * 50
    assert got[-1] == "uno ||(1)|| " * 200_000
