"""Registered queries for the news pipeline (P1): pages, feeds, choice, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.dates import parse_rfc822, utc_wall_clock
from tessera.functions.html import clean_lines
from tessera.functions.jsonx import json_kind, object_field, required_int_key_rules, unfence, unfence_array
from tessera.functions.text import first_line, truncate_text, ustrip
from tessera.operators import choose, feeds, messages
from tessera.operators.corpus import HARD_WORDS
from tessera.operators.pagetext import pages_to_text as _pages_to_text
from tessera.plans import sqltext as S
from tessera.plans.registry import query
from tessera.sources.tables import Tables

_pt_ctes, _pt_final = S.pages_text_ctes()


@query("pages_to_text", oracle=f"WITH {_pt_ctes} SELECT page_id, text FROM {_pt_final}")
def pages_to_text(spark, sf_dir):
    """Readable article text for every crawled page."""
    return _pages_to_text(Tables(spark, sf_dir).pages)


# ---------------------------------------------------------------------------
# Feed candidates (orders stand in for feed items, events for the sent log)
# ---------------------------------------------------------------------------


NOW = "2001-08-01 00:00:00"          # job parameter: the run's "now"
MAX_AGE_HOURS = 24 * 60
N_CANDIDATES = 15


def feed_items(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    link = F.concat(F.lit("https://shop.example/c/"), F.col("o_custkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("item_pos"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("feed_pos"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit(" "), link, F.lit(" "))).otherwise(link)
        .alias("link"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("source"))


def sent_log(spark, sf_dir):
    e = Tables(spark, sf_dir).events.filter(F.col("event_type") == "purchase")
    url = F.concat(F.lit("https://shop.example/c/"), F.col("user_id").cast("string"))
    return e.select(F.when(F.col("event_id") % 3 == 0, F.concat(url, F.lit("  "))).otherwise(url).alias("url"))


def _fresh(spark, sf_dir):
    return feeds.recent(feeds.valid_items(feed_items(spark, sf_dir)), NOW, MAX_AGE_HOURS)


_ITEMS_SQL = f"""
items AS (
  SELECT o_orderkey AS item_pos, cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS feed_pos,
    'Order ' || cast(o_orderkey AS varchar) AS title,
    CASE WHEN o_orderkey % 7 = 0 THEN ' https://shop.example/c/' || cast(o_custkey AS varchar) || ' '
         ELSE 'https://shop.example/c/' || cast(o_custkey AS varchar) END AS link,
    o_orderdate AS ts, o_orderpriority AS source
  FROM orders),
fresh AS (SELECT * FROM items
  WHERE coalesce({S.ustrip('title')}, '') <> '' AND coalesce({S.ustrip('link')}, '') <> ''
    AND ts >= TIMESTAMP '{NOW}' - INTERVAL {MAX_AGE_HOURS} HOUR),
sent AS (
  SELECT DISTINCT {S.ustrip("CASE WHEN event_id % 3 = 0 THEN 'https://shop.example/c/' || cast(user_id AS varchar) || '  ' ELSE 'https://shop.example/c/' || cast(user_id AS varchar) END")} AS url
  FROM events WHERE event_type = 'purchase')"""


@query("candidates_limit_then_unsent", oracle=f"""WITH {_ITEMS_SQL},
c AS (SELECT * FROM fresh ORDER BY feed_pos, item_pos LIMIT {N_CANDIDATES})
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM sent WHERE sent.url = {S.ustrip('c.link')})""")
def candidates_limit_then_unsent(spark, sf_dir):
    """First 15 fresh items in feed order, then drop sent ones."""
    cands = feeds.first_n(_fresh(spark, sf_dir), N_CANDIDATES)
    return feeds.unsent(cands, sent_log(spark, sf_dir))


@query("unsent_all", oracle=f"""WITH {_ITEMS_SQL}
SELECT * FROM fresh WHERE NOT EXISTS (SELECT 1 FROM sent WHERE sent.url = {S.ustrip('fresh.link')})""")
def unsent_all(spark, sf_dir):
    """Every fresh item not sent yet (no limit)."""
    return feeds.unsent(_fresh(spark, sf_dir), sent_log(spark, sf_dir))


@query("sent_flag", oracle=f"""WITH {_ITEMS_SQL}
SELECT *, EXISTS (SELECT 1 FROM sent WHERE sent.url = {S.ustrip('fresh.link')}) AS is_sent FROM fresh""")
def sent_flag(spark, sf_dir):
    """Every fresh item with its sent flag."""
    return feeds.sent_flag(_fresh(spark, sf_dir), sent_log(spark, sf_dir))


EVENTS_NOW = "2024-01-29 12:00:00"


@query("recent_items", oracle=f"""
SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR""")
def recent_items(spark, sf_dir):
    """age cut-off, inclusive, no upper bound."""
    ev = Tables(spark, sf_dir).events.select("event_id", "ts", "event_type")
    return feeds.recent(ev, EVENTS_NOW, 24)


# RFC 822 strings in six shapes made from the order date.
def _rfc_raw():
    d = F.col("o_orderdate")
    full = F.date_format(d, "EEE, dd MMM yyyy HH:mm:ss")
    noday = F.date_format(d, "dd MMM yyyy HH:mm:ss")
    k = F.col("o_orderkey") % 6
    return (F.when(k == 0, F.concat(full, F.lit(" GMT")))
            .when(k == 1, F.concat(noday, F.lit(" +0200")))
            .when(k == 2, F.concat(F.lit("Mon, "), noday, F.lit(" +0000")))
            .when(k == 3, F.concat(full, F.lit(" EST")))
            .when(k == 4, F.lit("not a valid date"))
            .otherwise(F.concat(F.date_format(d, "dd MMM yyyy HH:mm"), F.lit(" -0330"))))


@query("rfc822_parse", oracle="""
SELECT o_orderkey,
  CASE o_orderkey % 6
    WHEN 0 THEN strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' GMT'
    WHEN 1 THEN strftime(o_orderdate, '%d %b %Y %H:%M:%S') || ' +0200'
    WHEN 2 THEN 'Mon, ' || strftime(o_orderdate, '%d %b %Y %H:%M:%S') || ' +0000'
    WHEN 3 THEN strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' EST'
    WHEN 4 THEN 'not a valid date'
    ELSE strftime(o_orderdate, '%d %b %Y %H:%M') || ' -0330' END AS raw,
  CASE o_orderkey % 6
    WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate - INTERVAL 2 HOUR
    WHEN 2 THEN o_orderdate WHEN 3 THEN o_orderdate + INTERVAL 5 HOUR
    WHEN 4 THEN NULL ELSE o_orderdate + INTERVAL 210 MINUTE END AS pub_ts
FROM orders""")
def rfc822_parse(spark, sf_dir):
    """Feed dates to UTC instants; unparsable -> null."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", _rfc_raw().alias("raw"))
    return o.select("o_orderkey", "raw", utc_wall_clock(parse_rfc822(F.col("raw"))).alias("pub_ts"))


# ---------------------------------------------------------------------------
# Candidate lists, answer matching, messages (documents / part)
# ---------------------------------------------------------------------------
def _doc_items(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select(
        (F.col("doc_id") / 15).cast("bigint").alias("batch"), F.col("doc_id").alias("pos"),
        ustrip(first_line(F.col("text"))).alias("title"),
        F.col("source"),
        F.concat(F.lit("2024-01-"), F.lpad(((F.col("doc_id") % 28) + 1).cast("string"), 2, "0"),
                 F.lit("T08:00:00+00:00")).alias("pub_date"),
        ustrip(F.col("text")).alias("description"))


@query("numbered_list", oracle=f"""
WITH d AS (
  SELECT doc_id // 15 AS batch, doc_id AS pos, {S.ustrip(S.split_lines('text') + '[1]')} AS title, source,
    '2024-01-' || lpad(cast(doc_id % 28 + 1 AS varchar), 2, '0') || 'T08:00:00+00:00' AS pub_date,
    {S.ustrip('text')} AS description FROM documents),
n AS (SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY pos) AS i, * FROM d)
SELECT batch, string_agg('[' || cast(i AS varchar) || '] ' || title || chr(10) || '    Fuente: ' || source
    || ' | Fecha: ' || pub_date || chr(10) || '    ' || left(description, 300), chr(10) || chr(10) ORDER BY i)
    AS story_list, count(*) AS n_items
FROM n GROUP BY batch""")
def numbered_list(spark, sf_dir):
    """Numbered candidate list per batch of 15 documents."""
    return choose.numbered_list(_doc_items(spark, sf_dir))


_ANSWER_SQL = """CASE cast(substr(p_brand, 7) AS INTEGER) % 4 WHEN 0 THEN 'small ring' WHEN 1 THEN 'RING'
       WHEN 2 THEN '  blue gizmo ' ELSE 'zzz' END"""


@query("title_match", oracle=f"""
WITH a AS (SELECT DISTINCT p_brand, {_ANSWER_SQL} AS answer FROM part),
j AS (SELECT p.p_brand, p.p_partkey, p.p_name,
        ({S.ustrip('p.p_name')} = {S.ustrip('a.answer')}
         OR contains(lower({S.ustrip('p.p_name')}), lower({S.ustrip('a.answer')}))) AS hit
      FROM part p JOIN a ON p.p_brand = a.p_brand)
SELECT p_brand AS batch,
  coalesce(min(p_partkey) FILTER (WHERE hit), min(p_partkey)) AS chosen_pos,
  coalesce(arg_min(p_name, p_partkey) FILTER (WHERE hit), arg_min(p_name, p_partkey)) AS chosen_title,
  count(*) FILTER (WHERE hit) > 0 AS matched
FROM j GROUP BY p_brand""")
def title_match(spark, sf_dir):
    """Map the model's answer back to a candidate (first match, else first)."""
    part = Tables(spark, sf_dir).part
    cands = part.select(F.col("p_brand").alias("batch"), F.col("p_partkey").alias("pos"),
                        F.col("p_name").alias("title"))
    answers = part.select(F.col("p_brand").alias("batch")).distinct().withColumn(
        "answer", F.expr(_ANSWER_SQL.replace("p_brand", "batch")))
    return choose.match_title(cands, answers)


def _payloads(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    title = ustrip(first_line(F.col("text")))
    return d.select("doc_id", messages.headline(title).alias("headline"),
                    F.col("text").alias("summary"),
                    F.concat(F.lit("• "), F.col("lang"), F.lit("\n• "), F.col("source")).alias("bullets"),
                    F.concat(F.lit("https://news.example/doc/"), F.col("doc_id").cast("string")).alias("url"),
                    title.alias("topic_title"))


_T = S.ustrip(S.split_lines("text") + "[1]")


@query("message_texts", oracle=f"""
WITH p AS (
  SELECT doc_id, '📰 **' || coalesce({_T}, '') || '**' AS headline, text AS summary,
    '• ' || lang || chr(10) || '• ' || source AS bullets,
    'https://news.example/doc/' || cast(doc_id AS varchar) AS url, {_T} AS topic_title
  FROM documents)
SELECT doc_id,
  '📰 *' || headline || '*' || chr(10) || chr(10) || summary || chr(10) || chr(10) || bullets
    || chr(10) || chr(10) || '🔗 ' || url AS plain_text,
  left('📰 *Nueva historia de BBC Mundo*' || chr(10) || chr(10) || headline || chr(10) || chr(10) || summary
    || chr(10) || chr(10) || bullets || chr(10) || chr(10) || '🔗 ' || url, 2000) AS webhook_text,
  '> ' || summary || chr(10) || chr(10) || bullets || chr(10) || chr(10) || '🔗 [Artículo original](' || url || ')'
    AS thread_body,
  '📰 *' || headline || '*' || chr(10) || chr(10) || 'Haz clic para recibir la historia.' AS teaser,
  left({S.ustrip("replace(replace(topic_title, '**', ''), '*', '')")}, 100) AS thread_name
FROM p""")
def message_texts(spark, sf_dir):
    """Headline, four message templates, 2,000 / 100 char caps."""
    return messages.message_texts(_payloads(spark, sf_dir))


@query("truncate_docs", oracle="""
SELECT doc_id, CASE WHEN length(text) > 20000 THEN left(text, 20000) || chr(10) || '[... texto truncado ...]'
  ELSE text END AS text, length(text) > 20000 AS truncated FROM documents""")
def truncate_docs(spark, sf_dir):
    """Article cap of 20,000 characters before the rewrite prompt."""
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", truncate_text(F.col("text")).alias("text"),
                    (F.length("text") > 20000).alias("truncated"))


# ---------------------------------------------------------------------------
# Model output: fences, strict JSON, quarantine, file stats (events.props)
# ---------------------------------------------------------------------------
def _raw_outputs(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    p, k = F.col("props"), F.col("event_id") % 8
    raw = (F.when(k == 0, p)
           .when(k == 5, F.concat(p, F.lit("\nHope this helps!")))
           .when(k == 6, F.concat(F.lit('{"k": "first", '), F.substring(p, 2, 1000)))
           .when(k == 7, F.concat(p, F.lit(" "), p))
           .when(k == 1, F.concat(F.lit("```json\n["), p, F.lit("]\n```")))
           .when(k == 2, F.concat(F.lit("Sure! "), p))
           .when(k == 3, F.concat(F.lit("```\n"), p, F.lit("\n```")))
           .otherwise(F.concat(F.lit("["), p, F.lit(", "), p, F.lit("]"))))
    return e.select("event_id", raw.alias("raw"))


_RAW_SQL = """raw AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN props
    WHEN 5 THEN props || chr(10) || 'Hope this helps!'
    WHEN 6 THEN '{"k": "first", ' || substr(props, 2)
    WHEN 7 THEN props || ' ' || props
    WHEN 1 THEN '```json' || chr(10) || '[' || props || ']' || chr(10) || '```'
    WHEN 2 THEN 'Sure! ' || props
    WHEN 3 THEN '```' || chr(10) || props || chr(10) || '```'
    ELSE '[' || props || ', ' || props || ']' END AS raw FROM events)"""


def _duck_kind(x):
    return (f"CASE WHEN json_valid({x}) THEN CASE json_type({x}::JSON) WHEN 'ARRAY' THEN 'array' "
            f"WHEN 'OBJECT' THEN 'object' ELSE 'scalar' END END")


_CLEAN_SQL = f"""{_RAW_SQL},
c AS (SELECT event_id, raw,
  CASE WHEN regexp_matches(raw, '(?s)```(?:json)?\\s*(\\[\\s*\\{{.*?\\}}\\s*\\])\\s*```')
       THEN regexp_extract(raw, '(?s)```(?:json)?\\s*(\\[\\s*\\{{.*?\\}}\\s*\\])\\s*```', 1)
       ELSE {S.ustrip('raw')} END AS clean_a,
  {S.ustrip("regexp_replace(raw, '```(?:json)?\\s*', '', 'g')")} AS clean_b FROM raw),
k AS (SELECT *, {_duck_kind('clean_a')} AS kind_a, {_duck_kind('clean_b')} AS kind_b FROM c)"""


def _clean(spark, sf_dir):
    r = _raw_outputs(spark, sf_dir)
    r = r.select("event_id", "raw", unfence_array(F.col("raw")).alias("clean_a"),
                 unfence(F.col("raw")).alias("clean_b"))
    return r.select("*", json_kind(F.col("clean_a")).alias("kind_a"),
                    json_kind(F.col("clean_b")).alias("kind_b"))


@query("json_extract", oracle=f"""WITH {_CLEAN_SQL}
SELECT event_id, clean_b, kind_a, kind_b,
  CASE WHEN kind_b IN ('object', 'array') THEN (SELECT json_extract_string(e.props, '$.k') FROM events e
                                                WHERE e.event_id = k.event_id) END AS k
FROM k""")
def json_extract(spark, sf_dir):
    """Both fence dialects, strict parse, required key ``k`` (of a repeated key the last)."""
    c = _clean(spark, sf_dir)
    first = F.get(F.from_json("clean_b", "array<string>"), 0)
    k = (F.when(F.col("kind_b") == "object", object_field(F.col("clean_b"), "k"))
         .when(F.col("kind_b") == "array", object_field(first, "k")))
    k = F.variant_get(k, "$", "string")
    return c.select("event_id", "clean_b", "kind_a", "kind_b", k.alias("k"))


@query("json_quarantine", oracle=f"""WITH {_CLEAN_SQL}
SELECT event_id, raw, 'invalid json' AS error FROM k WHERE kind_b IS NULL""")
def json_quarantine(spark, sf_dir):
    """K2: rows whose output does not parse, raw text kept (deviation V3)."""
    return _clean(spark, sf_dir).filter(F.col("kind_b").isNull()).select(
        "event_id", "raw", F.lit("invalid json").alias("error"))


@query("json_file_stats", oracle=f"""WITH {_CLEAN_SQL}
SELECT count(*) FILTER (WHERE kind_b IS NOT NULL) AS n_files,
  coalesce(sum(CASE WHEN kind_b = 'array' THEN json_array_length(clean_b) ELSE 0 END), 0)::BIGINT AS n_cards
FROM k""")
def json_file_stats(spark, sf_dir):
    """A5: a valid non-array counts as a file without cards; invalid as neither."""
    c = _clean(spark, sf_dir)
    return c.agg(F.count_if(F.col("kind_b").isNotNull()).cast("bigint").alias("n_files"),
                 F.coalesce(F.sum(F.when(F.col("kind_b") == "array", F.json_array_length("clean_b"))
                                  .otherwise(0)), F.lit(0)).cast("bigint").alias("n_cards"))


# ---------------------------------------------------------------------------
# Block skip and noise lines on documents (W3 E7 F8 E6): marker lines are
# injected at positions derived from (doc_id, line number), then cleaned.
# ---------------------------------------------------------------------------

_MARKERS = [(0, "Más leídas: hoy"), (5, "Final de Más leídas"), (11, "El nuevo podcast de BBC Mundo"),
            (17, "Fin de Podcast"), (21, "12 mayo 2024"), (23, "02:27"), (25, "Pie de foto, algo"),
            (27, "Autor, Nombre")]


def _inject(doc_id, i, line):
    out = None
    for k, m in _MARKERS:
        cond = ((doc_id * 7 + i) % 29) == k
        out = F.when(cond, F.lit(m)) if out is None else out.when(cond, F.lit(m))
    return out.otherwise(line)


_INJECT_SQL = ("array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE (doc_id * 7 + i - 1) % 29 "
               + " ".join(f"WHEN {k} THEN {S.lit(m)}" for k, m in _MARKERS) + " ELSE l END), chr(10))")
_dc_ctes, _dc_final = S.clean_text_ctes("dsrc", "doc_id", "txt", "dc")


@query("doc_clean_lines", oracle=f"""WITH dsrc AS (SELECT doc_id, {_INJECT_SQL} AS txt FROM documents), {_dc_ctes}
SELECT doc_id, text FROM {_dc_final}""")
def doc_clean_lines(spark, sf_dir):
    """Block skip, noise phrases / prefixes, date and duration lines."""
    d = Tables(spark, sf_dir).documents
    injected = F.array_join(F.transform(F.split(F.col("text"), "\n"),
                                        lambda l, i: _inject(F.col("doc_id"), i, l)), "\n")
    # separate projections: the line fold is interpreted and would re-run its input
    staged = d.select("doc_id", injected.alias("_t")).select("doc_id", clean_lines(F.col("_t")).alias("_l"))
    return staged.select("doc_id", F.nullif(F.array_join(F.col("_l"), "\n"), F.lit("")).alias("text"))



REWRITE_TEMPLATE = ("Profile: {profile}\nHard words: {hard_words}\nKeep {{braces}}.\n"
                    "Article:\n{article_text}")          # job parameter: the prompt template
PROFILE = "B1 learner"                                    # job parameter


@query("rewrite_prompts", oracle=f"""
SELECT doc_id, {S.sql_text('Profile: ' + PROFILE + chr(10) + 'Hard words: ' + HARD_WORDS + chr(10)
                           + 'Keep {braces}.' + chr(10) + 'Article:' + chr(10))}
  || CASE WHEN length(text) > 20000 THEN left(text, 20000) || chr(10) || '[... texto truncado ...]' ELSE text END
  AS prompt
FROM documents""")
def rewrite_prompts(spark, sf_dir):
    """Rewrite prompt per article from a user template."""
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", messages.fill_template(
        REWRITE_TEMPLATE, profile=F.lit(PROFILE), hard_words=F.lit(HARD_WORDS),
        article_text=truncate_text(F.col("text"))).alias("prompt"))


def _mutated_outputs(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    p = (F.when(F.col("event_id") % 7 == 0, F.replace(F.col("props"), F.lit('"k"'), F.lit('"key"')))
         .when(F.col("event_id") % 11 == 0, F.regexp_replace("props", r": (\d+)", ': "$1"'))
         .otherwise(F.col("props")))
    k = F.col("event_id") % 5
    raw = (F.when(F.col("event_id") % 13 == 0, F.lit("```json\n[]\n```"))
           .when(k == 0, p)
           .when(k == 1, F.concat(F.lit("```json\n["), p, F.lit("]\n```")))
           .when(k == 2, F.concat(F.lit("Sure! "), p))
           .when(k == 3, F.lit("42"))
           .otherwise(F.concat(F.lit("["), p, F.lit(", "), p, F.lit("]"))))
    return e.select("event_id", raw.alias("raw"))


_INT = "coalesce(json_type({x}, '$.k') IN ('BIGINT', 'UBIGINT'), false)"


@query("json_required_keys", oracle=f"""
WITH m AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN replace(props, '"k"', '"key"')
                                 WHEN event_id % 11 = 0 THEN regexp_replace(props, ': (\\d+)', ': "\\1"')
                                 ELSE props END AS p FROM events),
r AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '```json' || chr(10) || '[]' || chr(10) || '```'
        WHEN event_id % 5 = 0 THEN p
        WHEN event_id % 5 = 1 THEN '```json' || chr(10) || '[' || p || ']' || chr(10) || '```'
        WHEN event_id % 5 = 2 THEN 'Sure! ' || p
        WHEN event_id % 5 = 3 THEN '42'
        ELSE '[' || p || ', ' || p || ']' END AS raw FROM m),
c AS (SELECT event_id, {S.ustrip("regexp_replace(raw, '```(?:json)?\\s*', '', 'g')")} AS t FROM r),
k AS (SELECT event_id, t, CASE WHEN json_valid(t) THEN json_type(t::JSON) END AS ty FROM c)
SELECT event_id, 'invalid_json' AS rule FROM k WHERE ty IS NULL
UNION ALL SELECT event_id, 'not_object_or_array' FROM k WHERE ty NOT IN ('OBJECT', 'ARRAY')
UNION ALL SELECT event_id, 'k_not_integer' FROM k WHERE ty = 'OBJECT' AND NOT {_INT.format(x='t')}
UNION ALL SELECT event_id, 'empty_array' FROM k WHERE ty = 'ARRAY' AND json_array_length(t) = 0
UNION ALL SELECT event_id, 'element_k_not_integer' FROM k
  WHERE ty = 'ARRAY' AND NOT list_bool_and(list_transform(json_extract(t, '$[*]'), lambda e: {_INT.format(x='e')}))""")
def json_required_keys(spark, sf_dir):
    """Q5: required key present and integer, arrays non-empty (violations)."""
    c = _mutated_outputs(spark, sf_dir).select("event_id", unfence(F.col("raw")).alias("t"))
    parsed = c.select("event_id", "t", json_kind(F.col("t")).alias("kind"))
    return parsed.select("event_id", F.explode(required_int_key_rules(F.col("t"), F.col("kind"), "k"))
                         .alias("rule"))
