"""Page operators: readable article text per crawled page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.html import clean_lines, extract_body, strip_markup


def pages_to_text(pages: DataFrame, html_col: str = "html", keep=("page_id",)) -> DataFrame:
    """One row per page with ``text`` = cleaned article text (null if none).

    Narrow projections only: every page is handled inside its own task.  The
    steps are separate projections on purpose: the line steps use SQL
    higher-order functions, which run interpreted and would otherwise
    re-evaluate the whole regex chain for every reference to their input.
    Catalyst keeps such projections apart (it does not collapse projects
    when that would duplicate non-trivial expressions).
    """
    keep = list(keep)
    staged = pages.select(*keep, extract_body(F.col(html_col)).alias("_body"))
    staged = staged.select(*keep, "_body", strip_markup(F.col("_body")).alias("_markup"))
    staged = staged.select(*keep, "_body", clean_lines(F.col("_markup")).alias("_lines"))
    text = F.nullif(F.array_join(F.col("_lines"), "\n"), F.lit(""))
    return staged.select(*keep, F.when(F.col("_body").isNull(), F.lit(None).cast("string"))
                         .otherwise(text).alias("text"))


def page_lines(pages: DataFrame, html_col: str = "html", keep=("page_id",)) -> DataFrame:
    """Kept lines of each page with their position (``posexplode``)."""
    lines = clean_lines(strip_markup(extract_body(F.col(html_col))))
    return pages.select(*keep, F.posexplode(lines).alias("line_no", "line"))


def skip_blocks(lines: DataFrame, key: str, pos: str, text: str, chunk: int = 1 << 16) -> DataFrame:
    """W3 + E7 + F8 for text that arrives as rows of lines (one row per line,
    ``pos`` ordered within ``key``): returns the kept lines, stripped.

    Both kinds of block are states of one automaton: a marker opens or closes
    the most-read block, and the podcast block's markers count only on lines the
    first kind lets through.  The last marker before a line decides each state,
    so a running max of ``2*pos + is_open`` over marker lines is odd inside a
    block.  Lines are cut into chunks of ``chunk`` positions.  Inside a chunk the
    podcast markers are followed for both states the chunk may begin with; a
    chunk's summary (last marker of the first kind, last of the second kind for
    either beginning) is its map from the state before it to the state after it,
    and the maps are composed by running maxima over the summaries.  So a very
    long document is spread over many tasks, and one scan serves both kinds.

    Null texts are kept out as empty lines are; lines with a null key are left out.
    """
    from pyspark.sql import Window

    from tessera.functions.html import (MOST_READ_CLOSE, MOST_READ_OPEN, PODCAST_CLOSE, PODCAST_OPEN,
                                        _is_noise)
    from tessera.functions.text import ustrip

    t = F.col("_t")

    def mark(opens, closes):
        return F.when(opens, F.col(pos) * 2 + 1).when(closes, F.col(pos) * 2)

    def inside(last):  # null: no marker yet
        return last % 2 != 0

    base = lines.select(key, pos, ustrip(F.col(text)).alias("_t")).filter(F.col(key).isNotNull()).withColumns({
        "_c": F.floor(F.col(pos) / F.lit(chunk)),
        "_o1": t.contains(MOST_READ_OPEN) & ~t.contains(MOST_READ_CLOSE),
        "_o2": t.contains(PODCAST_OPEN)})
    base = base.withColumns({"_m1": mark(F.col("_o1"), t.contains(MOST_READ_CLOSE)),
                             "_m2": mark(F.col("_o2"), t.contains(PODCAST_CLOSE))})
    before = Window.partitionBy(key, "_c").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumn("_s1", inside(F.max("_m1").over(before)))

    def counted(entry: bool):  # podcast markers of lines let through if the chunk begins in this state
        return F.when(~F.col("_o1") & ~F.coalesce(F.col("_s1"), F.lit(entry)), F.col("_m2"))

    local = local.withColumns({"_out": counted(False), "_in": counted(True)})
    maps = local.groupBy(key, "_c").agg(F.max("_m1").alias("_m1"), F.max("_out").alias("_out"), F.max("_in").alias("_in"))
    earlier = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("_e1", F.coalesce(inside(F.max("_m1").over(earlier)), F.lit(False)))
    maps = maps.withColumn("_last", F.when(F.col("_e1"), F.col("_in")).otherwise(F.col("_out")))
    entry = maps.select(key, "_c", "_e1", F.coalesce(inside(F.max("_last").over(earlier)), F.lit(False)).alias("_e2"))

    seen = local.select(key, pos, "_t", "_c", "_o1", "_o2", "_s1", inside(F.max("_out").over(before)).alias("_s2_out"),
                        inside(F.max("_in").over(before)).alias("_s2_in")).join(entry, [key, "_c"])
    in_first = F.col("_o1") | F.coalesce("_s1", "_e1")
    in_second = F.col("_o2") | F.coalesce(F.when(F.col("_e1"), F.col("_s2_in")).otherwise(F.col("_s2_out")), F.col("_e2"))
    return seen.filter(~in_first & ~in_second & ~_is_noise(t)).select(key, pos, t.alias("line"))
