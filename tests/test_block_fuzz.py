"""The Spark fold and the window-based SQL formulation agree on
random line sequences (markers, nested and unclosed blocks, noise lines)."""

import random

import duckdb
from pyspark.sql import functions as F

from tessera.functions.html import clean_lines
from tessera.plans import sqltext as S

VOCAB = ["Más leídas", "Final de Más leídas", "El nuevo podcast de BBC Mundo", "Fin de Podcast",
         "Más leídas y Fin de Podcast", "El nuevo podcast de BBC Mundo Final de Más leídas",
         "Pie de foto, x", "Autor, y", "12 mayo 2024", "02:27", "  ", "", "Actualizado hoy",
         "texto uno", "texto dos", "  texto tres  ", "Saltar  al contenido"]


def test_fold_equals_window_formulation(spark):
    rnd = random.Random(11)
    docs = [(i, "\n".join(rnd.choice(VOCAB) for _ in range(rnd.randrange(0, 14)))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select(
        "doc_id", F.nullif(F.array_join(clean_lines(F.col("text")), "\n"), F.lit("")).alias("t")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", docs)
    ctes, final = S.clean_text_ctes("d", "doc_id", "text", "fz")
    want = dict(con.execute(f"WITH {ctes} SELECT doc_id, text FROM {final}").fetchall())
    assert got == want


def test_row_based_skip_equals_fold(spark):
    from tessera.operators.pagetext import skip_blocks
    rnd = random.Random(12)
    docs = [(i, [rnd.choice(VOCAB) for _ in range(rnd.randrange(0, 14))]) for i in range(300)]
    rows = [(i, p, ln) for i, lines in docs for p, ln in enumerate(lines)]
    lines_df = spark.createDataFrame(rows, "doc_id long, pos long, line string")
    kept = skip_blocks(lines_df, "doc_id", "pos", "line", chunk=3).collect()
    got = {}
    for r in sorted(kept, key=lambda r: (r.doc_id, r.pos)):
        got.setdefault(r.doc_id, []).append(r.line)
    texts = spark.createDataFrame([(i, "\n".join(lines)) for i, lines in docs], "doc_id long, text string")
    want = {r.doc_id: r.k for r in texts.select("doc_id", clean_lines(F.col("text")).alias("k")).collect() if r.k}
    assert got == want


def test_long_texts_of_rows_equal_the_fold_whatever_the_chunk(spark):
    """States that run through whole chunks; lines without a key or a text are left out."""
    from tessera.operators.pagetext import skip_blocks
    rnd = random.Random(13)
    docs = [(i, [rnd.choice(VOCAB if rnd.random() < 0.3 else VOCAB[10:14] + VOCAB[15:]) for _ in range(120)]) for i in range(30)]
    rows = [(i, p, ln) for i, lines in docs for p, ln in enumerate(lines)]
    frame = spark.createDataFrame(rows + [(None, 0, "texto uno"), (0, 500, None)], "doc_id long, pos long, line string")
    texts = spark.createDataFrame([(i, "\n".join(lines)) for i, lines in docs], "doc_id long, text string")
    want = {r.doc_id: r.k for r in texts.select("doc_id", clean_lines(F.col("text")).alias("k")).collect() if r.k}
    for chunk in (1, 7, 1000):
        got = {}
        for r in sorted(skip_blocks(frame, "doc_id", "pos", "line", chunk=chunk).collect(), key=lambda r: (r.doc_id, r.pos)):
            got.setdefault(r.doc_id, []).append(r.line)
        assert got == want, chunk
    assert skip_blocks(frame.limit(0), "doc_id", "pos", "line").count() == 0
