"""Registered queries for the card pipeline (P4) and the quality rules.

The driver has no card files, so cards are derived from ``part`` (one card per
part, every part used): file/idx give the merge order, direction cycles over
the four known values plus one unknown, and the text fields come from the
part's name, type, brand and size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cards as C
from tessera.plans import sqltext as S
from tessera.plans.registry import query
from tessera.sources.tables import Tables

# The same derivation in SQL (Spark SQL and DuckDB accept this text; only
# the array constructor differs).
_CARDS_SQL = """
SELECT
  'w' || lpad(cast(p_partkey % 20 AS string), 2, '0') || '.json' AS file,
  p_partkey AS idx,
  CASE p_partkey % 5 WHEN 0 THEN 'spanish_to_target' WHEN 1 THEN 'target_to_spanish'
       WHEN 2 THEN 'spanish_sentence_to_target' WHEN 3 THEN 'target_sentence_to_spanish'
       ELSE 'bogus' END AS direction,
  CASE WHEN p_partkey % 5 NOT IN (1, 3) THEN p_name END AS cue_spanish,
  CASE WHEN p_partkey % 5 IN (1, 3) THEN p_type END AS cue_en,
  CASE WHEN p_partkey % 5 IN (1, 3) THEN p_brand END AS cue_de,
  CASE WHEN p_partkey % 5 NOT IN (1, 3) THEN
    (CASE WHEN p_size % 5 = 0 THEN {A}lower(p_type), p_brand, lower(p_type){Z}
          ELSE {A}lower(p_type), p_brand{Z} END) END AS target_en,
  CASE WHEN p_partkey % 5 NOT IN (1, 3) THEN {A}p_brand{Z} END AS target_de,
  CASE WHEN p_partkey % 5 IN (1, 3) THEN {A}p_name{Z} END AS target_es,
  CASE WHEN p_partkey % 3 = 0 THEN upper(p_type || ' ' || cast(p_size AS string))
       ELSE p_type || ' ' || lower(p_type) || ' ' || cast(p_size % 3 AS string) END AS example_sentence_es,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS notes,
  CASE p_size % 7 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'B1' WHEN 3 THEN 'B2'
       WHEN 4 THEN 'C1' WHEN 5 THEN 'X9' ELSE '' END AS earliest_level,
  CASE (p_size + p_partkey) % 7 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'B1' WHEN 3 THEN 'B2'
       WHEN 4 THEN 'C1' WHEN 5 THEN 'C2' ELSE '' END AS mandatory_level,
  p_name || '/' || cast(p_size % 2 AS string) AS tag
FROM part
"""
CARDS_SPARK_SQL = _CARDS_SQL.replace("{A}", "array(").replace("{Z}", ")")
CARDS_DUCK_SQL = _CARDS_SQL.replace("{A}", "[").replace("{Z}", "]")
KEY_SQL = ("concat_ws('|', coalesce(direction, 'None'), coalesce(cue_spanish, ''), "
           "coalesce(cue_en, ''), coalesce(cue_de, ''))")


def cards_view(spark, sf_dir):
    """The card table derived from ``part`` (all rows)."""
    part = Tables(spark, sf_dir).part
    return part.sparkSession.sql(CARDS_SPARK_SQL.replace("FROM part", "FROM {p}"), p=part)


def _join_arr(c):
    return F.array_join(F.col(c), "~").alias(c)


_MERGE_ORACLE = f"""
WITH cards AS ({CARDS_DUCK_SQL}), k AS (SELECT *, {KEY_SQL} AS key FROM cards)
SELECT key, count(*) AS n_cards,
  arg_min(file, (file, idx)) AS file, arg_min(idx, (file, idx)) AS idx,
  arg_min(direction, (file, idx)) AS direction,
  arg_min(cue_spanish, (file, idx)) AS cue_spanish,
  arg_min(cue_en, (file, idx)) AS cue_en, arg_min(cue_de, (file, idx)) AS cue_de,
  arg_min(tag, (file, idx)) AS tag,
  arg_min(earliest_level, (file, idx)) AS earliest_level,
  arg_min(mandatory_level, (file, idx)) AS mandatory_level,
  array_to_string(list_reduce(list(target_en ORDER BY file, idx) FILTER (WHERE target_en IS NOT NULL),
      lambda acc, y: list_concat(acc, list_filter(y, lambda z: NOT list_contains(acc, z)))), '~') AS target_en,
  array_to_string(list_reduce(list(target_de ORDER BY file, idx) FILTER (WHERE target_de IS NOT NULL),
      lambda acc, y: list_concat(acc, list_filter(y, lambda z: NOT list_contains(acc, z)))), '~') AS target_de,
  array_to_string(list_reduce(list(target_es ORDER BY file, idx) FILTER (WHERE target_es IS NOT NULL),
      lambda acc, y: list_concat(acc, list_filter(y, lambda z: NOT list_contains(acc, z)))), '~') AS target_es,
  list_reduce(list(example_sentence_es ORDER BY file, idx),
      lambda acc, y: CASE WHEN lower(acc) = lower(y) THEN acc ELSE acc || chr(10) || y END) AS example_sentence_es,
  list_reduce(list(notes ORDER BY file, idx),
      lambda acc, y: CASE WHEN lower(acc) = lower(y) THEN acc ELSE acc || chr(10) || y END) AS notes
FROM k GROUP BY key
"""


@query("card_merge", oracle=_MERGE_ORACLE)
def card_merge(spark, sf_dir):
    """Ordered merge of duplicate cards, one row per card key."""
    m = C.merge_cards(cards_view(spark, sf_dir))["merged"]
    return m.select("key", "n_cards", "file", "idx", "direction", "cue_spanish", "cue_en", "cue_de",
                    "tag", "earliest_level", "mandatory_level", _join_arr("target_en"),
                    _join_arr("target_de"), _join_arr("target_es"), "example_sentence_es", "notes")


@query("card_merge_totals", oracle=f"""
WITH cards AS ({CARDS_DUCK_SQL}), k AS (SELECT {KEY_SQL} AS key FROM cards)
SELECT count(DISTINCT key) AS unique_cards, count(*) - count(DISTINCT key) AS duplicates FROM k""")
def card_merge_totals(spark, sf_dir):
    """A2: unique cards and resolved duplicates."""
    return C.merge_totals(cards_view(spark, sf_dir))


@query("card_conflicts", oracle=f"""
WITH cards AS ({CARDS_DUCK_SQL}), k AS (SELECT *, {KEY_SQL} AS key FROM cards),
f AS (SELECT key, arg_min(tag, (file, idx)) AS kept, min((file, idx)) AS o FROM k GROUP BY key)
SELECT f.key, 'tag' AS field, count(*) AS n_conflicts, min(k.file) AS first_file
FROM k JOIN f ON k.key = f.key
WHERE (k.file, k.idx) <> f.o AND lower(k.tag) <> lower(f.kept)
GROUP BY f.key""")
def card_conflicts(spark, sf_dir):
    """A3: conflicting non-sentence fields per key (original value kept)."""
    c = C.card_conflicts(cards_view(spark, sf_dir))
    return c.groupBy("key", "field").agg(F.count(F.lit(1)).alias("n_conflicts"),
                                         F.min("file").alias("first_file"))


_FWD = "direction IN ('spanish_to_target', 'spanish_sentence_to_target')"
_EN, _DE, _ES = S.lit(C.LABEL_EN), S.lit(C.LABEL_DE), S.lit(C.LABEL_ES)
_FACES_ORACLE = f"""
WITH m AS ({_MERGE_ORACLE})
SELECT key, coalesce(mandatory_level, 'Uncategorized') AS level,
  CASE WHEN {_FWD} THEN coalesce(cue_spanish, '')
       ELSE {_EN} || coalesce(cue_en, '') || '<br>' || {_DE} || coalesce(cue_de, '') END AS front_word,
  CASE WHEN {_FWD} THEN '"' || coalesce(example_sentence_es, '') || '"'
       ELSE {_EN} || '""<br>' || {_DE} || '""' END AS front_sentence,
  CASE WHEN {_FWD} THEN {_EN} || coalesce(replace(target_en, '~', ', '), '') || '<br>' || {_DE}
            || coalesce(replace(target_de, '~', ', '), '')
       ELSE {_ES} || coalesce(replace(target_es, '~', ', '), '') END AS back_word,
  CASE WHEN {_FWD} THEN {_EN} || '<br>' || {_DE}
       ELSE {_ES} || coalesce(example_sentence_es, '') END AS back_sentence,
  substr(sha256(key), 1, 16) AS note_guid,
  'Spanish Core 2K::level' || coalesce(mandatory_level, 'Uncategorized') AS deck_name
FROM m
WHERE direction IN ('spanish_to_target', 'spanish_sentence_to_target', 'target_to_spanish',
                    'target_sentence_to_spanish')"""


@query("card_faces", oracle=_FACES_ORACLE)
def card_faces(spark, sf_dir):
    """Rendered faces, stable guid and deck name per merged card."""
    m = C.merge_cards(cards_view(spark, sf_dir))["merged"]
    faces = C.stable_ids(C.card_faces(m), "decks/spanish_core_2k")
    return faces.drop("deck_id")


@query("level_distribution", oracle=f"""
WITH cards AS ({CARDS_DUCK_SQL}),
l AS (SELECT 'earliest' AS kind, earliest_level AS level FROM cards
      UNION ALL SELECT 'mandatory', mandatory_level FROM cards),
c AS (SELECT kind, level, count(*) AS n FROM l WHERE level IS NOT NULL AND level <> '' GROUP BY ALL),
d AS (SELECT kind, level FROM (VALUES ('earliest'), ('mandatory')) k(kind),
      (VALUES ('A1'), ('A2'), ('B1'), ('B2'), ('C1'), ('C2')) v(level))
SELECT d.kind, d.level, coalesce(c.n, 0) AS n, true AS standard FROM d LEFT JOIN c USING (kind, level)
UNION ALL
SELECT kind, level, n, false FROM c WHERE level NOT IN ('A1', 'A2', 'B1', 'B2', 'C1', 'C2')""")
def level_distribution(spark, sf_dir):
    """Cards per earliest / mandatory level with zero-filled domain."""
    return C.level_distribution(cards_view(spark, sf_dir))


_LVL = "list_position(['A1','A2','B1','B2','C1','C2'], {x})"


@query("quality_levels", oracle=f"""
WITH cards AS ({CARDS_DUCK_SQL}), k AS (SELECT *, {KEY_SQL} AS key FROM cards),
r AS (
  SELECT key, file, idx, 'earliest_level_domain' AS rule FROM k
  WHERE coalesce({_LVL.format(x='earliest_level')}, 0) = 0
  UNION ALL SELECT key, file, idx, 'mandatory_level_domain' FROM k
  WHERE coalesce({_LVL.format(x='mandatory_level')}, 0) = 0
  UNION ALL SELECT key, file, idx, 'earliest_after_mandatory' FROM k
  WHERE {_LVL.format(x='earliest_level')} > {_LVL.format(x='mandatory_level')})
SELECT * FROM r""")
def quality_levels(spark, sf_dir):
    """Q1: level domain and earliest <= mandatory."""
    return C.quality_levels(cards_view(spark, sf_dir))


@query("quality_prefix", oracle=f"""
WITH cards AS ({CARDS_DUCK_SQL}), k AS (SELECT *, {KEY_SQL} AS key FROM cards)
SELECT key, file, idx, 'en_verb_to' AS rule FROM k
WHERE direction IN ('spanish_to_target', 'spanish_sentence_to_target')
  AND regexp_matches(cue_spanish, '(ar|er|ir)$')
  AND NOT list_bool_and(list_transform(coalesce(target_en, []), lambda t: starts_with(t, 'to ')))
UNION ALL
SELECT key, file, idx, 'de_noun_article' FROM k
WHERE direction IN ('spanish_to_target', 'spanish_sentence_to_target')
  AND list_bool_or(list_transform(coalesce(target_de, []),
        lambda t: regexp_matches(t, '^\\p{{Lu}}') AND NOT regexp_matches(t, '^(der|die|das) ')))""")
def quality_prefix(spark, sf_dir):
    """Q2: English verb targets start with 'to ', German nouns with an article."""
    return C.quality_prefix(cards_view(spark, sf_dir))


@query("quality_counts", oracle=f"""
WITH cards AS ({CARDS_DUCK_SQL}),
w AS (SELECT CASE WHEN direction IN ('target_to_spanish', 'target_sentence_to_spanish')
                  THEN target_es[1] ELSE cue_spanish END AS word, direction FROM cards),
g AS (SELECT word, count(*) AS n_cards,
        count(*) FILTER (WHERE direction IN ('spanish_to_target', 'spanish_sentence_to_target')) > 0 AS has_forward,
        count(*) FILTER (WHERE direction IN ('target_to_spanish', 'target_sentence_to_spanish')) > 0 AS has_reverse
      FROM w GROUP BY word)
SELECT * FROM g WHERE n_cards < 2 OR n_cards > 8 OR NOT has_forward OR NOT has_reverse""")
def quality_counts(spark, sf_dir):
    """Q3: cards per word between 2 and 8, both directions present."""
    return C.quality_counts(cards_view(spark, sf_dir))


@query("quality_symmetry", oracle=f"""
WITH cards AS ({CARDS_DUCK_SQL}), k AS (SELECT *, {KEY_SQL} AS key FROM cards),
fwd AS (SELECT * FROM k WHERE direction IN ('spanish_to_target', 'spanish_sentence_to_target')),
rev AS (SELECT * FROM k WHERE direction IN ('target_to_spanish', 'target_sentence_to_spanish'))
SELECT key, file, idx, 'reverse_cue_not_in_forward_targets' AS rule FROM rev
WHERE NOT EXISTS (SELECT 1 FROM fwd, unnest(fwd.target_en) u(t) WHERE u.t = rev.cue_en)
UNION ALL
SELECT key, file, idx, 'forward_cue_not_in_reverse_targets' FROM fwd
WHERE NOT EXISTS (SELECT 1 FROM rev, unnest(rev.target_es) u(t) WHERE u.t = fwd.cue_spanish)""")
def quality_symmetry(spark, sf_dir):
    """Q4: every reverse cue is some forward target and vice versa."""
    return C.quality_symmetry(cards_view(spark, sf_dir))

