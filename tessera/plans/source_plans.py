"""Registered round trips through the file sources and sinks.

Each query writes a given table with a sink under the shared folder and
returns what the matching source reads back.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tessera.operators import complete, corpus, feeds, fifo, notes, speech
from tessera.plans import sqltext as S
from tessera.plans.complete_plans import stub_completer
from tessera.plans.registry import query
from tessera.plans.speech_plans import _RENDER, conversation_segments
from tessera.session import shared_dir
from tessera.sources import files
from tessera.sources.tables import Tables


@query("json_array_files", oracle="SELECT p_partkey, p_name, p_retailprice, (p_partkey % 1000)::BIGINT AS idx FROM part")
def json_array_files(spark, sf_dir):
    """Records written as JSON array files and read back with their place."""
    path = shared_dir(spark, "json-arrays")
    files.write_json_arrays(Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_retailprice"), path, "p_partkey")
    schema = _parse_datatype_string("p_partkey bigint, p_name string, p_retailprice double")
    return files.read_json_arrays(spark, path, schema, "*.txt")["rows"].select("p_partkey", "p_name", "p_retailprice", "idx")


@query("json_bucket_files", oracle="SELECT p_partkey, p_name, p_brand FROM part")
def json_bucket_files(spark, sf_dir):
    """K1: JSON records in bucket folders."""
    path = shared_dir(spark, "json-buckets")
    files.write_json_by_bucket(Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_brand"), path, "p_partkey", 8)
    return spark.read.schema("p_partkey bigint, p_name string, p_brand string").json(path).select("p_partkey", "p_name", "p_brand")


@query("level_folders", oracle="""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Uncategorized' ELSE p_brand END AS level FROM part""")
def level_folders(spark, sf_dir):
    """K5: one folder per level, missing levels under Uncategorized."""
    path = shared_dir(spark, "levels")
    part = Tables(spark, sf_dir).part.select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("level"))
    files.write_by_level(part, path)
    return spark.read.parquet(path).select("p_partkey", "level")


@query("queue_log_files", oracle="""
SELECT seq, reason FROM (
  SELECT event_id AS seq, CASE WHEN event_id % 10 = 0 THEN 'missing queue_id'
    WHEN event_type NOT IN ('view', 'click') THEN 'unknown op' END AS reason FROM events)
UNION ALL SELECT NULL, 'missing seq' FROM events WHERE event_id % 25 = 3""")
def queue_log_files(spark, sf_dir):
    """Events appended to the queue log in two writes, read back with the corrupt rows set apart."""
    path = shared_dir(spark, "queue-log")
    ev = Tables(spark, sf_dir).events
    rows = ev.select(F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("queue_id"), F.col("event_id").alias("seq"),
                     F.when(F.col("event_type") == "view", fifo.ENQUEUE).when(F.col("event_type") == "click", fifo.POP)
                     .otherwise("peek").alias("op"))
    files.append_queue_events(rows, path)
    files.append_queue_events(ev.where("event_id % 25 = 3").select(
        F.col("user_id").alias("queue_id"), F.lit(None).cast("long").alias("seq"), F.lit(fifo.POP).alias("op")), path)
    out = fifo.validate_events(spark.read.parquet(path))
    return out["events"].select("seq", F.lit(None).cast("string").alias("reason")).unionByName(
        out["quarantine"].select("seq", "reason"))


@query("sent_log_files", oracle="""
SELECT DISTINCT 'https://shop.example/c/' || cast(user_id AS varchar) AS url FROM events
WHERE event_type IN ('purchase', 'error')""")
def sent_log_files(spark, sf_dir):
    """URLs appended twice, with blanks and repeats, read back as a set."""
    path = shared_dir(spark, "sent-log")
    ev = Tables(spark, sf_dir).events
    url = F.concat(F.lit("  https://shop.example/c/"), F.col("user_id").cast("string"), F.lit(" "))
    files.append_sent(ev.where("event_type = 'purchase'").select(F.when(F.col("event_id") % 4 == 0, " ").otherwise(url).alias("url")), path)
    files.append_sent(ev.where("event_type IN ('purchase', 'error')").select(url.alias("url")), path)
    return files.read_sent_log(spark, path)


@query("text_files", oracle="SELECT 'track' || cast(item_id AS varchar) || '.txt' AS name, text FROM benchmark")
def text_files(spark, sf_dir):
    """S3: a folder of text files, one row per file."""
    path = shared_dir(spark, "texts")
    b = Tables(spark, sf_dir).benchmark.select(
        F.concat(F.lit("track"), F.col("item_id").cast("string")).alias("track"), F.col("text").alias("value"))
    b.repartition("track").write.option("lineSep", "\u0000").partitionBy("track").text(path)
    # the sink names its own files: the track is the folder
    read = files.read_texts(spark, f"{path}/*/")
    return read.select(F.concat(F.regexp_extract("path", r"track=([^/]*)/", 1), F.lit(".txt")).alias("name"),
                       F.regexp_replace("text", "\u0000$", "").alias("text"))


_TOK = "[\\p{L}\\p{N}]+"


@query("word_list_glosses", oracle=f"""
WITH w AS (SELECT item_id, regexp_extract(text, '{_TOK}') AS term FROM benchmark),
g AS (SELECT lower(term) AS term, min(CASE item_id % 3 WHEN 1 THEN 'sense ' || cast(item_id AS varchar)
        WHEN 2 THEN 'sense ' || cast(item_id AS varchar) || ' - note' END) AS gloss FROM w GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(text, '{_TOK}') AS toks, regexp_split_to_array(text, '{_TOK}') AS seps FROM documents),
u AS (SELECT doc_id, generate_subscripts(seps, 1) AS i, unnest(seps) AS sep, unnest(list_resize(toks, len(seps))) AS tok FROM d)
SELECT doc_id, string_agg(sep || coalesce(tok, '') || CASE WHEN gloss IS NULL THEN '' ELSE ' ||(' || gloss || ')||' END, '' ORDER BY i) AS text
FROM u LEFT JOIN g ON lower(u.tok) = g.term GROUP BY doc_id""")
def word_list_glosses(spark, sf_dir):
    """A word list file (``term``, ``term - gloss``, ``Term (gloss - note)``) glossed into the documents."""
    path = shared_dir(spark, "word-list")
    t = Tables(spark, sf_dir)
    w = t.benchmark.select("item_id", F.regexp_extract("text", r"[\p{L}\p{N}]+", 0).alias("term"))
    sense = F.concat(F.lit("sense "), F.col("item_id").cast("string"))
    w.select(F.when(F.col("item_id") % 3 == 0, F.col("term")).when(F.col("item_id") % 3 == 1, F.concat("term", F.lit(" - "), sense))
             .otherwise(F.concat("term", F.lit(" ("), sense, F.lit(" - note)"))).alias("value")).write.text(path)
    return corpus.gloss(t.documents.select("doc_id", "text"), files.read_word_list(spark, path))


@query("collection_files", oracle="""
SELECT n_regionkey::BIGINT AS collection, n_nationkey::BIGINT AS id, n_name AS name, [n_name, 'Back'] AS field_names FROM nation""")
def collection_files(spark, sf_dir):
    """Decks and models from a collection's JSON maps, written as files and read back."""
    path = shared_dir(spark, "collections")
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    deck = F.struct(F.col("n_nationkey").alias("id"), name.alias("name"))
    model = F.struct(F.col("n_nationkey").alias("id"), name.alias("name"),
                     F.array(F.struct(name.alias("name")), F.struct(F.lit("Back").alias("name"))).alias("flds"))
    as_map = lambda v: F.to_json(F.map_from_entries(F.collect_list(F.struct(key, v))))
    Tables(spark, sf_dir).nation.groupBy(F.col("n_regionkey").cast("long").alias("collection")).agg(
        as_map(deck).alias("decks"), as_map(model).alias("models")).write.json(path)
    col = notes.collection_tables(spark.read.schema("collection long, decks string, models string").json(path))
    return col["decks"].join(col["models"], [col["decks"]["deck_id"] == col["models"]["mid"],
                                             col["decks"]["collection"] == col["models"]["collection"],
                                             col["decks"]["deck_name"] == col["models"]["model_name"]]).select(
        col["decks"]["collection"], F.col("deck_id").alias("id"), F.col("deck_name").alias("name"), "field_names")


@query("transcript_files", oracle=_RENDER)
def transcript_files(spark, sf_dir):
    """K6: segments and readable text written together; the text read back."""
    path = shared_dir(spark, "transcripts")
    seg = conversation_segments(spark, sf_dir)
    files.write_transcripts(seg, speech.render_transcripts(seg), path)
    return spark.read.parquet(f"{path}/text")


# ---------------------------------------------------------------------------
# Feeds: every 50 documents are one RSS file, with blank titles and bad dates
# ---------------------------------------------------------------------------
PER_FEED = 50


def _xml(c):
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


@query("feed_files", oracle=f"""
WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id // {PER_FEED} ORDER BY doc_id) - 1 AS item_pos,
  {S.ustrip("CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE ' Story ' || cast(doc_id AS varchar) || ' <&> ' || source END")} AS title,
  {S.ustrip("regexp_replace(text, '[[:cntrl:]]+', ' ', 'g')")} AS description FROM documents)
SELECT (doc_id // {PER_FEED})::INTEGER AS feed_pos, item_pos::INTEGER AS item_pos, 'Feed ' || cast(doc_id // {PER_FEED} AS varchar) AS source,
  title, 'https://news.example/doc/' || cast(doc_id AS varchar) AS link, description,
  TIMESTAMP '2026-05-01 06:30:00' + INTERVAL (doc_id % 28) DAY AS pub_ts
FROM d WHERE title <> '' AND doc_id % 11 <> 4""")
def feed_files(spark, sf_dir):
    """RSS files read in feed and item order; blank titles and bad dates are dropped."""
    path = shared_dir(spark, "feeds with spaces").replace(" ", "+ ")
    d = Tables(spark, sf_dir).documents
    n = F.col("doc_id")
    day = F.lpad((n % 28 + 1).cast("string"), 2, "0")
    date = (F.when(n % 11 == 4, "soon").when(n % 3 == 0, F.concat(F.lit("Friday, "), day, F.lit("-May-26 06:30:00 GMT")))
            .when(n % 3 == 1, F.concat(F.lit("May "), day, F.lit(" 2026 08:30 +0200 (CEST)")))
            .otherwise(F.concat(day, F.lit(" May 2026 01:30:00 EST"))))
    title = F.when(n % 9 == 0, "  ").otherwise(F.concat(F.lit(" Story "), n.cast("string"), F.lit(" <&> "), F.col("source")))
    item = F.concat(F.lit("<item><title>"), _xml(title), F.lit("</title><link>https://news.example/doc/"), n.cast("string"),
                    F.lit("</link><description>"), _xml(F.regexp_replace("text", r"\p{Cntrl}+", " ")),
                    F.lit("</description><pubDate>"), date, F.lit("</pubDate></item>"))
    feed = F.floor(n / PER_FEED)
    one = d.groupBy(feed.alias("feed")).agg(F.array_join(F.array_sort(F.collect_list(F.struct(n, item.alias("x"))))["x"], "").alias("items"))
    one.select("feed", F.concat(F.lit("<rss><channel><title>Feed "), F.col("feed").cast("string"), F.lit("</title>"), "items",
                                F.lit("</channel></rss>")).alias("value")).repartition("feed").write.partitionBy("feed").text(path)
    listed = d.select(feed.alias("feed_pos")).distinct()  # the configured feed list
    items = files.read_listed_feeds(spark, path, listed.select(
        F.concat(F.lit(f"{path}/feed="), F.col("feed_pos").cast("string")).alias("path"), "feed_pos"))
    out = feeds.with_pub_ts(feeds.valid_items(items))
    return out.select("feed_pos", "item_pos", "source", "title", "link", "description",
                      F.col("pub_ts").cast("timestamp_ntz").alias("pub_ts"))


# ---------------------------------------------------------------------------
# Completion end to end
# ---------------------------------------------------------------------------
_PROMPTS = "SELECT doc_id, cast(length(text) AS varchar) || '|' || text AS answer FROM documents"


@query("complete_twice", oracle=f"""
WITH p AS ({_PROMPTS}) SELECT doc_id, answer, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END::INTEGER AS run FROM p""")
def complete_twice(spark, sf_dir):
    """A first run that got a third of the way, a second that only does the rest."""
    path = shared_dir(spark, "answers")
    todo = Tables(spark, sf_dir).documents.select("doc_id", F.col("text").alias("prompt"))
    run1 = complete.batch_complete(todo.where("doc_id % 3 = 0"), "doc_id", "prompt", stub_completer)
    schema = "doc_id bigint, raw string, error string"
    files.write_json_by_bucket(run1, f"{path}/run=1", "doc_id", 4, 1)
    done = spark.read.schema(schema).json(f"{path}/run=1")
    run2 = complete.batch_complete(complete.resume(todo, done, "doc_id"), "doc_id", "prompt", stub_completer)
    files.write_json_by_bucket(run2, f"{path}/run=2", "doc_id", 4, 1)
    return spark.read.schema(schema + ", run int").json(path).where("error IS NULL").select(
        "doc_id", F.col("raw").alias("answer"), "run")


@query("resume_either", oracle="""
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)""")
def resume_either(spark, sf_dir):
    """An input is done when either of its two outputs exists."""
    t = Tables(spark, sf_dir)
    return complete.resume(t.documents.select("doc_id"), t.labels.where("quality = 1").select("doc_id"), "doc_id",
                           t.labels.where("toxic = 1").select("doc_id"))
