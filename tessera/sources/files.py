"""File sources (S1 S2 S3 S5 S7) and sinks (K1 K3 K4 K5 K6).

All readers are lazy Spark reads with explicit schemas (column pruning at
parse time); a bad file yields null rows that are filtered, it never stops
the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, StringType, StructField, StructType)

from tessera.functions.jsonx import json_kind
from tessera.functions.text import ustrip
from tessera.session import small_files

# ---------------------------------------------------------------------------
# RSS feeds
# ---------------------------------------------------------------------------
ITEM = StructType([StructField(n, StringType()) for n in ("title", "link", "description", "pubDate")])
CHANNEL = StructType([StructField("title", StringType()), StructField("item", ArrayType(ITEM))])


def read_feeds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per ``<item>`` of every feed, in feed order and item order.

    ``feed_pos`` is the (first) position of the feed in ``paths`` (the fixed feed
    order), ``item_pos`` the position inside the feed.  The channel title is
    the ``source``, falling back to the feed path.  A file that is not XML
    produces a row without items and so contributes nothing (U1: no dedup
    across feeds).  Title/link/description are stripped; the date stays raw.
    """
    first = {}
    for i, p in enumerate(paths):
        first.setdefault(_local(p), i)
    table = spark.createDataFrame(list(first.items()), "path string, feed_pos int")
    raw = _channels(spark).load(list(dict.fromkeys(paths)))
    return _in_feed_order(raw, F.broadcast(table))  # the driver holds the list as it is


def read_listed_feeds(spark: SparkSession, folder: str, feeds: DataFrame) -> DataFrame:
    """As ``read_feeds``, for a feed list that is a table: ``path`` (a file, or the
    folder of a feed's files, below ``folder``; unique) and ``feed_pos``.  Files of
    feeds that are not listed are left out; the list never passes the driver."""
    path = F.regexp_replace("path", "^file:/+", "/")
    with small_files(spark):
        raw = _channels(spark).option("recursiveFileLookup", "true").load(folder)
    table = feeds.select(path.alias("path"), F.col("feed_pos").cast("int").alias("feed_pos"))
    return _in_feed_order(raw, table).filter(F.col("feed_pos").isNotNull())


def _channels(spark: SparkSession):
    return spark.read.format("xml").option("rowTag", "channel").schema(CHANNEL)


def _in_feed_order(raw: DataFrame, table: DataFrame) -> DataFrame:
    path = F.regexp_replace("feed", "^file:/+", "/")
    items = feed_items(raw).withColumns({"_file": path, "_folder": F.regexp_replace(path, "/[^/]*$", "")})
    for kind in ("_file", "_folder"):  # a path is a file or its folder
        items = items.join(table.select(F.col("path").alias(kind), F.col("feed_pos").alias(f"_pos{kind}")), kind, "left")
    return items.select(F.coalesce("_pos_file", "_pos_folder").alias("feed_pos"), "item_pos", "feed", "source", "title",
                        "link", "description", "pub_date_raw")


def feed_items(channels: DataFrame) -> DataFrame:
    """Items of the channels that an XML read or stream yields.  ``feed`` is
    the file's path; the metadata give it URL-encoded, so it is decoded."""
    return channel_items(channels.withColumn("feed", _decoded(F.col("_metadata.file_path"))))


def channel_items(channels: DataFrame) -> DataFrame:
    """Items of ``feed, title, item`` rows, stripped, with their place in the feed."""
    items = channels.select(
        "feed", F.coalesce(ustrip(F.col("title")), F.col("feed")).alias("source"),
        F.posexplode("item").alias("item_pos", "it"))
    text = lambda name: F.coalesce(ustrip(F.col(f"it.{name}")), F.lit("")).alias(name)
    return items.select("feed", "source", "item_pos", text("title"), text("link"), text("description"),
                        F.col("it.pubDate").alias("pub_date_raw"))


RSS = StructType([StructField("channel", CHANNEL), StructField("_corrupt_record", StringType())])


def parse_feeds(docs: DataFrame) -> DataFrame:
    """Whole feed files (``feed``, ``text``) parsed: ``feed, text, broken, title, item``.

    A file is ``broken`` when it is not well-formed XML, as one cut off on its
    way, or has no channel; none of its items are used then, so that the file
    can be taken whole when it comes again.
    """
    rss = F.from_xml("text", RSS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    whole = F.col("rss._corrupt_record").isNull() & F.col("rss.channel").isNotNull()
    return docs.select("feed", "text", rss.alias("rss")).select(
        "feed", "text", (~F.coalesce(whole, F.lit(False))).alias("broken"), "rss.channel.title", "rss.channel.item")


def _decoded(path):
    """URL-decoded path (``url_decode`` alone would turn ``+`` into a space)."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _base_name():
    return F.regexp_extract(_decoded(F.col("_metadata.file_path")), r"([^/]*)$", 1)


def _local(p: str) -> str:
    """``file:`` URIs and plain paths compare as plain paths."""
    import re
    return re.sub(r"^file:/+", "/", p)


# ---------------------------------------------------------------------------
# Folders of JSON card arrays
# ---------------------------------------------------------------------------
def read_json_arrays(spark: SparkSession, folder: str, element_schema: StructType,
                     glob: str = "*.json") -> dict[str, DataFrame]:
    """``rows`` = one row per array element with ``file`` and ``idx``;
    ``files`` = per file: valid JSON? array? element count (A5).

    Whole-file read (``wholetext``): one file is one JSON document.
    """
    txt = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder, wholetext=True)
           .select(_base_name().alias("file"), "value"))
    kind = json_kind(F.col("value"))
    files = txt.select("file", "value", kind.isNotNull().alias("valid"),
                       F.coalesce(kind == "array", F.lit(False)).alias("is_array"))
    arr = F.from_json("value", ArrayType(element_schema))
    rows = files.filter("is_array").select("file", F.posexplode(arr).alias("idx", "card")) \
        .select("file", F.col("idx").cast("long").alias("idx"), "card.*")
    stats = files.select("file", "valid", "is_array",
                         F.when(F.col("is_array"), F.json_array_length("value")).otherwise(0).alias("n_cards"))
    return {"rows": rows, "files": stats}


def file_totals(files: DataFrame) -> DataFrame:
    """A5: valid JSON counts as a file; only arrays add cards."""
    return files.agg(F.count_if("valid").cast("bigint").alias("total_files"),
                     F.sum("n_cards").cast("bigint").alias("total_cards"))


# ---------------------------------------------------------------------------
# S3: text corpus, S5: sent log, S7: word lists
# ---------------------------------------------------------------------------
def read_texts(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """One row per file: ``name`` (base name), ``path`` and whole ``text``."""
    return (spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
            .select(_base_name().alias("name"), _decoded(F.col("_metadata.file_path")).alias("path"),
                    F.col("value").alias("text")))


def read_sent_log(spark: SparkSession, path: str) -> DataFrame:
    """Stripped, non-blank URLs as a set; a missing log is an empty set."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "url string")
    u = ustrip(F.col("value"))
    return lines.select(u.alias("url")).filter(F.col("url") != "").distinct()


WORD_LINE = r"^(.*?)(?:\s+-\s+|\s*\()(.*?)\)?$"


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``term``, ``term - gloss`` or ``Term (gloss - note)``."""
    lines = spark.read.text(path).select(ustrip(F.col("value")).alias("line")).filter(F.col("line") != "")
    has_gloss = F.col("line").rlike(WORD_LINE)
    return lines.select(
        F.when(has_gloss, ustrip(F.regexp_extract("line", WORD_LINE, 1))).otherwise(F.col("line")).alias("term"),
        F.when(has_gloss, ustrip(F.regexp_extract("line", WORD_LINE, 2))).alias("gloss"))


# ---------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------
def _row_salt(df: DataFrame, n: int):
    """Deterministic salt in [0, n) from the whole row (retries write the same rows)."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(n))


def write_json_by_bucket(df: DataFrame, path: str, key: str, buckets: int = 64,
                         files_per_bucket: int = 8) -> None:
    """K1: JSON records (non-ASCII kept), grouped into ``buckets`` folders by
    key hash; never one file per key at scale.  A salt spreads a bucket that
    holds a hot key over ``files_per_bucket`` writing tasks."""
    out = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    out.repartition("bucket", _row_salt(df, files_per_bucket)) \
        .write.mode("overwrite").partitionBy("bucket").json(path)


def write_json_arrays(df: DataFrame, path: str, order: str, per_file: int = 1000) -> None:
    """K1: JSON array files of ``per_file`` records each, in ``order`` (unique);
    the counterpart of ``read_json_arrays``."""
    from tessera.operators.ordering import global_rank

    ranked = global_rank(df, [order])
    one = F.struct("rank", F.struct(*df.columns).alias("r"))
    files = ranked.groupBy(F.floor((F.col("rank") - 1) / per_file).alias("file")).agg(
        F.to_json(F.array_sort(F.collect_list(one))["r"]).alias("value"))
    files.repartition("file").write.mode("overwrite").partitionBy("file").text(path)


def append_sent(urls: DataFrame, path: str) -> None:
    """K3: append stripped URLs to the sent log (duplicates allowed; reads
    de-duplicate)."""
    urls.select(ustrip(F.col("url")).alias("value")).write.mode("append").text(path)


def append_queue_events(events: DataFrame, path: str) -> None:
    """K4: append enqueue / pop events to the queue log."""
    events.write.mode("append").parquet(path)


def write_by_level(cards: DataFrame, path: str, level: str = "level", files_per_level: int = 8) -> None:
    """K5: one output folder per level (missing level -> Uncategorized); a
    salt spreads a level holding most cards over ``files_per_level`` tasks."""
    out = cards.withColumn(level, F.coalesce(F.col(level), F.lit("Uncategorized")))
    out.repartition(level, _row_salt(cards, files_per_level)) \
        .write.mode("overwrite").partitionBy(level).parquet(path)


def write_transcripts(segments: DataFrame, rendered: DataFrame, path: str) -> None:
    """K6: full segment table and readable text, written from the same input."""
    segments.write.mode("overwrite").parquet(f"{path}/segments")
    rendered.write.mode("overwrite").parquet(f"{path}/text")
