"""Registered queries for the corpus jobs.

``documents`` stand in for transcripts (``trackNN.txt``), ``pages`` for
cheatsheets, ``labels`` for outputs already written (toxic = 1 means only an
error file exists, which does not count as done).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import output_key
from tessera.operators import corpus
from tessera.plans import sqltext as S
from tessera.plans.registry import query
from tessera.sources.tables import Tables

RULES = "RULES: list every useful word.\n"   # job parameter: the prompt file's text


def _sheets(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    return p.select(F.concat(F.lit("sheet"), F.col("page_id").cast("string"), F.lit("_cheat.md")).alias("name"),
                    F.col("html").alias("text"))


@query("compact_batches", oracle=f"""
WITH s AS (SELECT 'sheet' || cast(page_id AS varchar) || '_cheat.md' AS name,
             html AS text FROM pages),
n AS (SELECT *, row_number() OVER (ORDER BY name COLLATE "C") AS rn FROM s),
b AS (SELECT *, (rn - 1) // 10 + 1 AS batch FROM n)
SELECT 'compacted_' || cast(batch AS varchar) || '.md' AS out_name, batch,
  string_agg('<' || name || '>' || chr(10) || text || chr(10) || '</>' || chr(10) || chr(10), '' ORDER BY rn)
    || {S.sql_text(corpus.COMPACT_INSTRUCTION)} AS text,
  count(*) AS n_sheets
FROM b GROUP BY batch""")
def compact_batches(spark, sf_dir):
    """Compaction input text of every batch of 10 sheets."""
    return corpus.compact_batches(_sheets(spark, sf_dir))


# fixed values of the oracle, written out on their own
_WORDS = ["suponiendo", "sorprendente", "discretas", "medida busca protegerla", "conquistaron", "relacionados", "fuente",
          "dispositivo", "los aliados", "ofrecer", "conocida", "fronterizo", "apoyo", "aparcamiento", "señalar", "además"]
_TOKS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_INJECTED = ("text || CASE doc_id % 17 " + " ".join(
    f"WHEN {i} THEN ' ' || upper({S.lit(w)}) || '; ' || replace({S.lit(w)}, ' ', ', ')" for i, w in enumerate(_WORDS)) + " ELSE '' END")


def _counts_sql(docs: str, terms: str) -> str:
    """Occurrences by comparing token lists at every position."""
    return f"""
t AS (SELECT doc_id, {_TOKS.format('text')} AS toks FROM {docs}),
w AS (SELECT DISTINCT {_TOKS.format('term')} AS ws FROM {terms}),
l AS (SELECT ws, len(ws) AS n, ws[1] AS first FROM w WHERE len(ws) > 0),
p AS (SELECT doc_id, toks, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM t)
SELECT doc_id, array_to_string(ws, ' ') AS term, count(*) AS n
FROM p JOIN l ON p.tok = l.first AND toks[i:i + n - 1] = ws GROUP BY ALL"""


def _word_docs(spark, sf_dir):
    """The documents, most with a listed word or phrase put at their end, twice."""
    d = Tables(spark, sf_dir).documents
    tail = None
    for i, w in enumerate(corpus.hard_word_list()):
        put = F.lit(f" {w.upper()}; {w.replace(' ', ', ')}")
        tail = F.when(F.col("doc_id") % 17 == i, put) if tail is None else tail.when(F.col("doc_id") % 17 == i, put)
    return d.select("doc_id", F.concat("text", tail.otherwise("")).alias("text"))


def _list_frame(spark):
    return spark.createDataFrame([(w,) for w in corpus.hard_word_list()], "term string")


@query("hard_words", oracle=f"""WITH d AS (SELECT doc_id, {_INJECTED} AS text FROM documents),
f AS (SELECT unnest([{', '.join(S.lit(w) for w in _WORDS)}]) AS term), {_counts_sql('d', 'f')}""")
def hard_words(spark, sf_dir):
    """Occurrences of the hard-word list (single and multi-word) per document."""
    return corpus.hard_words(_word_docs(spark, sf_dir), _list_frame(spark))


_LINES = f"""l AS (SELECT doc_id, generate_subscripts(arr, 1) - 1 AS pos, unnest(arr) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents))"""


@query("line_dedup", oracle=f"""WITH {_LINES},
n AS (SELECT doc_id, pos, lower({S.ustrip('line')}) AS norm FROM l)
SELECT norm, arg_min(doc_id, (doc_id, pos)) AS first_doc, arg_min(pos, (doc_id, pos)) AS first_pos,
  count(*) AS copies
FROM n WHERE norm <> '' GROUP BY norm""")
def line_dedup(spark, sf_dir):
    """First occurrence and copy count of every normalised line."""
    return corpus.line_dedup(Tables(spark, sf_dir).documents)


@query("doc_dedup", oracle="SELECT min(doc_id) AS keep_id, count(*) AS copies FROM documents GROUP BY text")
def doc_dedup(spark, sf_dir):
    """Exact duplicate documents."""
    return corpus.doc_dedup(Tables(spark, sf_dir).documents)


_HEADED = ("array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE (doc_id + i) % 4 WHEN 0 "
           "THEN repeat('#', (1 + i % 3)::INTEGER) || ' ' || l ELSE l END), chr(10))")


@query("sections", oracle=f"""WITH l AS (SELECT doc_id, generate_subscripts(arr, 1) - 1 AS pos, unnest(arr) AS line
  FROM (SELECT doc_id, string_split({_HEADED}, chr(10)) AS arr FROM documents)),
h AS (SELECT *, regexp_matches(line, '^(#+)\\s+(.*)$') AS is_h FROM l),
s AS (SELECT *, coalesce(last_value(CASE WHEN is_h THEN pos END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS sec FROM h)
SELECT doc_id, sec AS start_line,
  coalesce(max(length(regexp_extract(line, '^(#+)\\s+(.*)$', 1))) FILTER (WHERE is_h AND pos = sec), 0)::BIGINT AS level,
  coalesce(max(regexp_extract(line, '^(#+)\\s+(.*)$', 2)) FILTER (WHERE is_h AND pos = sec), '') AS title,
  count(*) AS n_lines
FROM s GROUP BY doc_id, sec""")
def sections(spark, sf_dir):
    """Markdown sections of each document (every fourth line is made a heading)."""
    d = Tables(spark, sf_dir).documents
    headed = F.transform(F.split("text", "\n"), lambda x, i: F.when((F.col("doc_id") + i + 1) % 4 == 0, F.concat(
        F.repeat(F.lit("#"), (F.lit(1) + (i + 1) % 3).cast("int")), F.lit(" "), x)).otherwise(x))
    return corpus.sections(d.select("doc_id", F.array_join(headed, "\n").alias("text")))


def transcript_files(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    name = F.concat(F.lit("track"), F.when(F.col("doc_id") < 10, F.lit("0")).otherwise(F.lit("")),
                    F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", name.alias("name"), "text")


_FILES_SQL = """f AS (SELECT doc_id, 'track' || CASE WHEN doc_id < 10 THEN '0' ELSE '' END
    || cast(doc_id AS varchar) || '.txt' AS name, text FROM documents)"""


@query("prompts", oracle=f"""WITH {_FILES_SQL},
s AS (SELECT *, '# ' || name || chr(10) || text AS sheet FROM f),
p AS (SELECT *, lag(sheet) OVER (ORDER BY name COLLATE "C") AS prev_sheet FROM s)
SELECT name,
  CASE WHEN name <> 'track01.txt' THEN {S.sql_text(corpus.VOCAB_INTRO + '<transcript>' + chr(10))} || text
    || {S.sql_text(chr(10) + '</transcript>' + chr(10) + chr(10) + corpus.VOCAB_AFTER + RULES)} END AS vocab_prompt,
  {S.sql_text(corpus.VOCAB_INTRO + '<transcript>' + chr(10))} || text
    || {S.sql_text(chr(10) + '</transcript>' + chr(10) + chr(10) + corpus.SHEET_PREV + '<cheatsheet>' + chr(10))}
    || coalesce(prev_sheet, {S.lit(corpus.NO_PREVIOUS)})
    || {S.sql_text(chr(10) + '</cheatsheet>' + chr(10) + chr(10) + 'Now, based on the transcript above (from ')}
    || name || {S.sql_text(') and the current cheatsheet content, strictly follow these instructions:'
                           + chr(10) + chr(10) + RULES + corpus.SHEET_OUTRO)} AS sheet_prompt
FROM p""")
def prompts(spark, sf_dir):
    """Vocabulary and chained-cheatsheet prompts per transcript."""
    f = transcript_files(spark, sf_dir)
    f = f.withColumn("sheet", F.concat(F.lit("# "), F.col("name"), F.lit("\n"), F.col("text")))
    return corpus.prompts(f, RULES)


@query("resume_pending", oracle=f"""WITH {_FILES_SQL},
k AS (SELECT doc_id, name, regexp_replace(name, '\\.[^.]*$', '') || '_vocab.json' AS out_key FROM f),
done AS (SELECT 'track' || CASE WHEN doc_id < 10 THEN '0' ELSE '' END || cast(doc_id AS varchar)
           || CASE WHEN toxic = 1 THEN '_vocab_ERROR.txt' ELSE '_vocab.json' END AS out_key FROM labels)
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.out_key = k.out_key)""")
def resume_pending(spark, sf_dir):
    """Inputs whose output does not exist yet (error files do not count)."""
    f = transcript_files(spark, sf_dir).select("doc_id", "name",
                                               output_key(F.col("name"), "_vocab.json").alias("out_key"))
    lab = Tables(spark, sf_dir).labels
    stem = F.concat(F.lit("track"), F.when(F.col("doc_id") < 10, F.lit("0")).otherwise(F.lit("")),
                    F.col("doc_id").cast("string"))
    done = lab.select(F.concat(stem, F.when(F.col("toxic") == 1, F.lit("_vocab_ERROR.txt"))
                               .otherwise(F.lit("_vocab.json"))).alias("out_key"))
    return f.join(done, "out_key", "left_anti").select("doc_id", "name", "out_key")


def benchmark_terms(spark, sf_dir):
    """The whole item texts, and their first one and two tokens, as list terms."""
    b = Tables(spark, sf_dir).benchmark
    t = corpus.tokens(F.col("text"))
    return b.select(F.explode(F.array(F.col("text"), F.element_at(t, 1), F.array_join(F.slice(t, 1, 2), "  "))).alias("term"))


@query("hard_words_table", oracle=f"""
WITH bt AS (SELECT text, {_TOKS.format('text')} AS toks FROM benchmark),
bw AS (SELECT text AS term FROM bt UNION ALL SELECT toks[1] FROM bt UNION ALL SELECT array_to_string(toks[1:2], ' ') FROM bt),
{_counts_sql('documents', 'bw')}""")
def hard_words_table(spark, sf_dir):
    """J11 with a table word list (whole texts and first words of ``benchmark``)."""
    return corpus.hard_words(Tables(spark, sf_dir).documents, benchmark_terms(spark, sf_dir))
