"""Registered queries for transcripts (J9 E21 A9) and block skip on line rows.

Speaker assignment is bound to ``events``: per user (= track), view / signup /
click events are speech segments of ``value * 600`` s and purchase / error
events are speaker turns of ``value * 3600`` s.  Rendering is bound to
``conversations``: a conversation is a track, a turn a segment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.dates import epoch_micros_ntz
from tessera.functions.html import MOST_READ_CLOSE, MOST_READ_OPEN, PODCAST_CLOSE, PODCAST_OPEN
from tessera.operators import speech
from tessera.operators.pagetext import skip_blocks
from tessera.plans import sqltext as S
from tessera.plans.registry import query
from tessera.sources.tables import Tables


def _us(ts):
    return epoch_micros_ntz(F.col(ts))


def segments_turns(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    start = _us("ts")
    seg = ev.filter(F.col("event_type").isin("view", "signup", "click")).select(
        F.col("user_id").alias("track"), F.col("event_id").alias("seg_id"), start.alias("start_us"),
        (start + F.round(F.col("value") * 600_000_000).cast("bigint")).alias("end_us"))
    turns = ev.filter(F.col("event_type").isin("purchase", "error")).select(
        F.col("user_id").alias("track"),
        F.when(F.col("event_type") == "purchase", "SPEAKER_00").otherwise("SPEAKER_01").alias("speaker"),
        start.alias("start_us"),
        (start + F.round(F.col("value") * 3_600_000_000).cast("bigint")).alias("end_us"))
    return seg, turns


@query("speaker_assign", oracle="""
WITH seg AS (SELECT user_id AS track, event_id AS seg_id, epoch_us(ts) AS s,
               epoch_us(ts) + CAST(round(value * 600000000) AS BIGINT) AS e
             FROM events WHERE event_type IN ('view', 'signup', 'click')),
tu AS (SELECT user_id AS track, CASE WHEN event_type = 'purchase' THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker,
         epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 3600000000) AS BIGINT) AS e
       FROM events WHERE event_type IN ('purchase', 'error')),
ov AS (SELECT seg.track, seg.seg_id, tu.speaker, sum(least(seg.e, tu.e) - greatest(seg.s, tu.s)) AS ov
       FROM seg JOIN tu ON seg.track = tu.track AND tu.s < seg.e AND tu.e > seg.s
       WHERE least(seg.e, tu.e) - greatest(seg.s, tu.s) > 0
       GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY track, seg_id ORDER BY ov DESC, speaker) AS rn FROM ov)
SELECT seg.track, seg.seg_id, coalesce(b.speaker, 'UNKNOWN') AS speaker, coalesce(b.ov, 0)::BIGINT AS overlap_us
FROM seg LEFT JOIN best b ON seg.track = b.track AND seg.seg_id = b.seg_id AND b.rn = 1""")
def speaker_assign(spark, sf_dir):
    """Speaker with the largest total overlap per segment (row-balanced chunks, prefix sums)."""
    seg, turns = segments_turns(spark, sf_dir)
    return speech.assign_speakers(seg, turns)


def conversation_segments(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    start = F.col("turn") * 1.5
    return c.select(
        F.col("conv_id").alias("track"), F.col("turn").alias("seg_no"), start.alias("start"),
        (start + (F.length("text") % 400) / 100.0).alias("end"),
        F.when(F.col("role") == "user", "SPEAKER_00").when(F.col("role") == "assistant", "SPEAKER_01")
        .alias("speaker"), "text")


_RENDER = """
WITH s AS (SELECT conv_id AS track, turn AS seg_no, turn * 1.5 AS st,
             turn * 1.5 + (length(text) % 400) / 100.0 AS en,
             CASE role WHEN 'user' THEN 'SPEAKER_00' WHEN 'assistant' THEN 'SPEAKER_01' END AS speaker, text
           FROM conversations)
SELECT track, string_agg('[' || cast(round(st, 2) AS varchar) || 's - ' || cast(round(en, 2) AS varchar) || 's] '
    || coalesce(speaker, 'UNKNOWN') || ': ' || {strip} || chr(10), '' ORDER BY seg_no) AS text,
  count(*) AS n_segments
FROM s GROUP BY track""".replace("{strip}", S.ustrip("text"))


@query("transcript_render", oracle=_RENDER)
def transcript_render(spark, sf_dir):
    """Readable transcript per track."""
    return speech.render_transcripts(conversation_segments(spark, sf_dir))


# ---------------------------------------------------------------------------
# W3 E7 F8 on line rows: conversation turns are the lines of a conversation;
# marker lines are placed by (conv_id + turn).
# ---------------------------------------------------------------------------

LINES_PER_TURN = 1 << 20  # line positions reserved for a turn
_TURN_MARKERS = [(0, MOST_READ_OPEN), (4, MOST_READ_CLOSE), (7, PODCAST_OPEN), (10, PODCAST_CLOSE), (12, "02:27")]


def turn_lines(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    # every line of every turn; the first line of some turns becomes a marker
    lines = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    k = F.when(F.col("i") == 0, (F.col("conv_id") + F.col("turn")) % 13)
    line = None
    for v, m in _TURN_MARKERS:
        line = F.when(k == v, F.lit(m)) if line is None else line.when(k == v, F.lit(m))
    return lines.select("conv_id", (F.col("turn") * LINES_PER_TURN + F.col("i")).alias("pos"), line.otherwise(F.col("line")).alias("line"))


_MR_OPEN = f"(contains(t, {S.lit(MOST_READ_OPEN)}) AND NOT contains(t, {S.lit(MOST_READ_CLOSE)}))"
_W = "PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_BLOCK_SQL = f"""
WITH x AS (
  SELECT conv_id, turn, generate_subscripts(arr, 1) - 1 AS i, unnest(arr) AS line
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS arr FROM conversations)),
l AS (
  SELECT conv_id, turn * 1048576 + i AS pos, {S.ustrip('CASE WHEN i > 0 THEN line ' + ' '.join(
      f"WHEN (conv_id + turn) % 13 = {v} THEN {S.lit(m)}" for v, m in _TURN_MARKERS) + ' ELSE line END')} AS t
  FROM x),
a AS (SELECT *, {_MR_OPEN} AS mo,
        coalesce(last_value(CASE WHEN {_MR_OPEN} THEN true WHEN contains(t, {S.lit(MOST_READ_CLOSE)}) THEN false END
                 IGNORE NULLS) OVER ({_W}), false) AS mr_before FROM l),
b AS (SELECT *, coalesce(last_value(CASE WHEN contains(t, {S.lit(PODCAST_OPEN)}) THEN true
                 WHEN contains(t, {S.lit(PODCAST_CLOSE)}) THEN false END IGNORE NULLS) OVER ({_W}), false) AS pod_before
      FROM a WHERE NOT (mo OR mr_before))
SELECT conv_id, pos, t AS line FROM b
WHERE NOT (contains(t, {S.lit(PODCAST_OPEN)}) OR pod_before) AND NOT {S.is_noise('t')}"""


@query("block_skip", oracle=_BLOCK_SQL)
def block_skip(spark, sf_dir):
    """Block skip and noise filter over line rows (conversation turns)."""
    return skip_blocks(turn_lines(spark, sf_dir), "conv_id", "pos", "line")
