"""Registered queries for the collection reader.

Binding: ``orders`` are notes (model = customer, fields made from the order),
``lineitem`` rows are cards (deck = ``l_suppkey % 30``; decks 25-29 do not
exist), ``customer`` rows are models (field names by market segment),
``nation`` rows are decks, ``region`` rows are collections whose media map
lists their nations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import urlsafe_b64
from tessera.operators import notes as N
from tessera.plans import sqltext as S
from tessera.plans.registry import query
from tessera.sources.tables import Tables

CARD_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]

_MODEL_FIELDS_SQL = """CASE c_mktsegment
  WHEN 'AUTOMOBILE' THEN {A}'Index', 'Word', 'Meaning', 'Example', 'word_audio'{Z}
  WHEN 'BUILDING' THEN {A}'Word', 'Meaning'{Z}
  WHEN 'FURNITURE' THEN {A}'Front', 'Back', 'sentence_audio', 'Extra', 'Notes', 'More'{Z}
  WHEN 'HOUSEHOLD' THEN {A}'Index', 'Front', 'Back'{Z}
  ELSE {A}'Spanish', 'English', 'German', 'Example', 'Audio'{Z} END"""
_TAGS_SQL = """CASE o_orderkey % 4 WHEN 1 THEN ' ' || o_orderstatus || ' '
  WHEN 2 THEN o_orderpriority || '  x' ELSE '' END"""


def notes_table(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    flds = F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority",
                       F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("id"),
                    F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("guid"),
                    F.col("o_custkey").alias("mid"), flds.alias("flds"), F.expr(_TAGS_SQL).alias("tags"))


def cards_table(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.select(F.col("l_orderkey").alias("nid"), *CARD_ORDER, (F.col("l_suppkey") % 30).alias("did"))


def models_table(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    return c.select(F.col("c_custkey").alias("mid"),
                    F.expr(_MODEL_FIELDS_SQL.replace("{A}", "array(").replace("{Z}", ")")).alias("field_names"))


def decks_table(spark, sf_dir):
    n = Tables(spark, sf_dir).nation
    return n.select(F.col("n_nationkey").cast("bigint").alias("deck_id"), F.col("n_name").alias("deck_name"))


_NOTE_DECK_SQL = """nd AS (
  SELECT o_orderkey AS note_id, 'g' || cast(o_orderkey AS varchar) AS guid,
    arg_min(l_suppkey % 30, (l_linenumber, l_partkey, l_suppkey)) AS did, count(*) AS n_cards
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


@query("notes_join", oracle=f"WITH {_NOTE_DECK_SQL} SELECT * FROM nd")
def notes_join(spark, sf_dir):
    """One row per note with cards; deck of its first card."""
    nd = N.note_deck(notes_table(spark, sf_dir), cards_table(spark, sf_dir), CARD_ORDER)
    return nd.select(F.col("id").alias("note_id"), "guid", "did", "n_cards")


@query("note_text", oracle=f"""
WITH n AS (SELECT o_orderkey AS note_id,
    string_split(cast(o_orderkey AS varchar) || chr(31) || o_orderstatus || chr(31) || o_orderpriority || chr(31)
      || strftime(o_orderdate, '%Y-%m-%d') || chr(31) || cast(o_custkey AS varchar), chr(31)) AS fields,
    {_TAGS_SQL} AS tags, o_custkey AS mid FROM orders),
m AS (SELECT c_custkey AS mid, {_MODEL_FIELDS_SQL.replace('{A}', '[').replace('{Z}', ']')} AS names FROM customer),
j AS (SELECT n.note_id, n.fields, n.tags, m.names, least(len(m.names), len(n.fields)) AS k
      FROM n JOIN m ON n.mid = m.mid)
SELECT note_id,
  array_to_string(list_filter(list_transform(range(1, k + 1),
      lambda i: CASE WHEN names[i] NOT IN ('Index', 'word_audio', 'sentence_audio')
                     THEN names[i] || ': ' || fields[i] END), lambda x: x IS NOT NULL), chr(10)) AS note_text,
  array_to_string(list_filter(string_split(trim(tags), ' '), lambda t: t <> ''), '~') AS tags,
  len(fields)::BIGINT AS n_fields
FROM j""")
def note_text(spark, sf_dir):
    """Note -> prompt text in model field order, tags split."""
    n = N.zip_fields(N.with_model(notes_table(spark, sf_dir), models_table(spark, sf_dir)))
    return n.select(F.col("id").alias("note_id"), N.note_text(F.col("_names"), F.col("_values")).alias("note_text"),
                    F.array_join(N.split_tags(F.col("tags")), "~").alias("tags"),
                    F.size("_vals").cast("bigint").alias("n_fields"))


@query("collection_checks", oracle=f"""WITH {_NOTE_DECK_SQL}
SELECT o_orderkey AS note_id, 'unknown_model' AS rule FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL
SELECT note_id, 'unknown_deck' FROM nd WHERE did NOT IN (SELECT n_nationkey FROM nation)
UNION ALL
SELECT o_orderkey, 'has_tags' FROM orders
WHERE len(list_filter(string_split(trim({_TAGS_SQL}), ' '), lambda t: t <> '')) > 0""")
def collection_checks(spark, sf_dir):
    """Unknown model, unknown deck, notes with tags."""
    nd = N.note_deck(notes_table(spark, sf_dir), cards_table(spark, sf_dir), CARD_ORDER)
    notes = notes_table(spark, sf_dir)
    checks = N.collection_checks(nd, models_table(spark, sf_dir), decks_table(spark, sf_dir))
    # the model and tag rules apply to every note, not only notes with cards
    base = N.collection_checks(notes.withColumn("did", F.lit(0).cast("bigint")),
                               models_table(spark, sf_dir), decks_table(spark, sf_dir))
    return checks.filter(F.col("rule") == "unknown_deck").unionByName(
        base.filter(F.col("rule") != "unknown_deck"))


@query("active_decks", oracle=f"""WITH {_NOTE_DECK_SQL}
SELECT n_nationkey::BIGINT AS deck_id, n_name AS deck_name, count(*) AS n_notes
FROM nd JOIN nation ON nd.did = nation.n_nationkey GROUP BY ALL""")
def active_decks(spark, sf_dir):
    """Decks with at least one note and their note counts."""
    nd = N.note_deck(notes_table(spark, sf_dir), cards_table(spark, sf_dir), CARD_ORDER)
    return N.active_decks(nd, decks_table(spark, sf_dir))


@query("media_manifest", oracle="""
SELECT r.r_name AS collection, cast(n.n_nationkey AS varchar) AS id, lower(n.n_name) || '.mp3' AS original_name
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey % 3 <> 0""")
def media_manifest(spark, sf_dir):
    """Media map entries whose numbered file exists."""
    t = Tables(spark, sf_dir)
    nat = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    # one media map per collection (the source keeps one JSON map per package)
    cols = nat.groupBy(F.col("r_name").alias("collection")).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("n_nationkey").cast("string"), F.concat(F.lower("n_name"), F.lit(".mp3"))))).alias("media"))
    files = nat.filter(F.col("n_nationkey") % 3 != 0).select(
        F.col("r_name").alias("collection"), F.col("n_nationkey").cast("string").alias("id"))
    return N.media_manifest(cols, files)


RULES = "RULES: one card per meaning."   # job parameter: the prompt file's text

_SNAP_BASE = f"""WITH {_NOTE_DECK_SQL},
n AS (SELECT o_orderkey AS note_id, 'g' || cast(o_orderkey AS varchar) AS guid,
    string_split(cast(o_orderkey AS varchar) || chr(31) || o_orderstatus || chr(31) || o_orderpriority || chr(31)
      || strftime(o_orderdate, '%Y-%m-%d') || chr(31) || cast(o_custkey AS varchar), chr(31)) AS fields,
    list_filter(string_split(trim({_TAGS_SQL}), ' '), lambda t: t <> '') AS tags, o_custkey AS mid FROM orders),
m AS (SELECT c_custkey AS mid, {_MODEL_FIELDS_SQL.replace('{A}', '[').replace('{Z}', ']')} AS names FROM customer),
j AS (SELECT n.*, m.names, nd.did, least(len(m.names), len(n.fields)) AS k
      FROM n JOIN m ON n.mid = m.mid JOIN nd ON nd.note_id = n.note_id
      WHERE nd.did IN (SELECT n_nationkey FROM nation)),
s AS (SELECT *, array_to_string(list_filter(list_transform(range(1, k + 1),
      lambda i: CASE WHEN names[i] NOT IN ('Index', 'word_audio', 'sentence_audio')
                     THEN names[i] || ': ' || fields[i] END), lambda x: x IS NOT NULL), chr(10)) AS llm_str FROM j)"""


@query("note_snapshot", oracle=f"""{_SNAP_BASE}
SELECT guid, did AS deck_id, to_json(map(names[1:k], fields[1:k]))::VARCHAR AS fields_json, to_json(tags)::VARCHAR AS tags_json,
  llm_str FROM s""")
def note_snapshot(spark, sf_dir):
    """Snapshot row per exported note (known deck and model)."""
    nd = N.note_deck(notes_table(spark, sf_dir), cards_table(spark, sf_dir), CARD_ORDER)
    nd = nd.join(decks_table(spark, sf_dir).select(F.col("deck_id").alias("did")), "did", "left_semi")
    n = N.zip_fields(N.with_model(nd, models_table(spark, sf_dir)))
    return n.select("guid", F.col("did").alias("deck_id"),
                    F.to_json(N.snapshot_fields(F.col("_names"), F.col("_values"), F.col("_rnames")))
                    .alias("fields_json"),
                    F.to_json(N.split_tags(F.col("tags"))).alias("tags_json"),
                    N.note_text(F.col("_names"), F.col("_values")).alias("llm_str"))


@query("note_prompts", oracle=f"""{_SNAP_BASE}
SELECT guid, replace(replace(to_base64(encode(guid)), '+', '-'), '/', '_') || '.json' AS out_key,
  {S.sql_text(RULES + N.NOTE_PROMPT_MID)} || llm_str || {S.sql_text(N.NOTE_PROMPT_END)} AS prompt FROM s""")
def note_prompts(spark, sf_dir):
    """E12 E17 J7 key: extraction prompt and output file key per exported note."""
    snap = note_snapshot(spark, sf_dir)
    return snap.select("guid", F.concat(urlsafe_b64(F.col("guid")), F.lit(".json")).alias("out_key"),
                       N.note_prompt(RULES, F.col("llm_str")).alias("prompt"))
