"""Transcripts: speaker assignment by interval overlap, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ustrip
from tessera.operators.ordering import global_rank
from tessera.session import materialize, ship_package

UNKNOWN = "UNKNOWN"  # fixed value: label of a segment no turn overlaps


def _bins(start: str, end: str, bin_us: int):
    """Bins an interval [start, end) covers (at least one)."""
    lo = F.floor(F.col(start) / F.lit(bin_us)).cast("bigint")
    hi = F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / F.lit(bin_us)).cast("bigint")
    return F.explode(F.sequence(lo, hi)).alias("bin")


def assign_speakers_binned(segments: DataFrame, turns: DataFrame, bin_us: int = 3_600_000_000) -> DataFrame:
    """J9 (alternative): each segment gets the speaker whose turns overlap it most.

    ``segments(track, seg_id, start_us, end_us)``, ``turns(track, speaker,
    start_us, end_us)``; times in integer microseconds.  Spark has no range
    join, so both sides are exploded into time bins of ``bin_us`` and joined on
    ``(track, bin)``; a pair is counted only in the bin where its overlap
    starts, so it is counted once.  Candidate pairs grow with the density of
    a bin; ``assign_speakers`` avoids pairs altogether.  Ties go to the smaller speaker name; no
    positive overlap gives ``UNKNOWN``.  Output: track, seg_id, speaker,
    overlap_us.
    """
    s = segments.select("track", "seg_id", F.col("start_us").alias("s1"), F.col("end_us").alias("e1"),
                        _bins("start_us", "end_us", bin_us))
    t = turns.select("track", "speaker", F.col("start_us").alias("s2"), F.col("end_us").alias("e2"),
                     _bins("start_us", "end_us", bin_us))
    ov_start = F.greatest("s1", "s2")
    ov = F.least("e1", "e2") - ov_start
    pairs = s.join(t, ["track", "bin"]).filter(
        (ov > 0) & (F.floor(ov_start / F.lit(bin_us)).cast("bigint") == F.col("bin")))
    per_speaker = pairs.groupBy("track", "seg_id", "speaker").agg(F.sum(ov).alias("ov"))
    best = per_speaker.groupBy("track", "seg_id").agg(
        F.min(F.struct((-F.col("ov")).alias("neg"), F.col("speaker"))).alias("b"))
    return segments.select("track", "seg_id").join(best, ["track", "seg_id"], "left").select(
        "track", "seg_id", F.coalesce(F.col("b.speaker"), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(-F.col("b.neg"), F.lit(0)).cast("bigint").alias("overlap_us"))


def assign_speakers(segments: DataFrame, turns: DataFrame, chunk_rows: int = 8192) -> DataFrame:
    """Each segment gets the speaker whose turns overlap it most.

    ``segments(track, seg_id, start_us, end_us)``, ``turns(track, speaker,
    start_us, end_us)``.  The endpoints of all intervals are ranked by (track,
    time) and cut into chunks of ``chunk_rows`` endpoints, so a dense or long
    track is spread over many tasks of equal size.  An interval has pieces in
    its first and last chunk only.  Turns that stay open over a whole chunk
    enter it as one row per speaker with their number (a running sum over
    chunks); what a segment meets in the whole chunks it spans comes from
    the speakers' totals per chunk, summed over runs of 1, 2, 4, ... chunks,
    once for all segments that span the same ones.  Inside a chunk the
    overlap of a segment with a speaker comes from prefix sums of the turns'
    endpoints (relative to the chunk, so nothing overflows).

    Of the speakers of the whole chunks only the first can be the best unless
    it is met in the segment's first or last chunk too, so a segment has as many
    rows as speakers there, and one more: no (segment, turn) pairs, and
    long or nested intervals cost no more than short ones.
    Overlapping turns of one speaker count twice, as a sum of intersections
    does.  Intervals of segments with the same ``seg_id`` are taken together.  Ties
    go to the smaller speaker name; no overlap gives ``UNKNOWN``; empty and
    null intervals overlap nothing.
    """
    fields = {f.name: f.dataType.simpleString() for f in segments.schema}
    spark = segments.sparkSession
    intervals = turns.select("track", "speaker", F.lit(0).cast(fields["seg_id"]).alias("seg_id"), F.col("start_us").alias("s"),
                             F.col("end_us").alias("e")).where("speaker IS NOT NULL").unionByName(
        segments.select("track", F.lit(None).cast("string").alias("speaker"), "seg_id", F.col("start_us").alias("s"),
                        F.col("end_us").alias("e"))).where("e > s").withColumn("uid", F.monotonically_increasing_id())
    points = intervals.select("*", F.explode(F.array("s", "e")).alias("t"))
    points = points.withColumn("side", (F.col("t") == F.col("e")).cast("int"))
    ranked = global_rank(points, ["track", "t", "uid", "side"]).withColumn(
        "chunk", F.floor((F.col("rank") - 1) / chunk_rows))
    borders = ranked.groupBy("track", "chunk").agg(F.min("t").alias("begin"))
    borders = borders.withColumn("until", F.lead("begin").over(Window.partitionBy("track").orderBy("chunk")))
    whole = materialize(ranked.groupBy("uid").agg(
        *[F.any_value(c).alias(c) for c in ("track", "speaker", "seg_id", "s", "e")],
        F.min("chunk").alias("c0"), F.max("chunk").alias("c1")), "speaker-intervals")
    ends = whole.select("*", F.explode(F.array_distinct(F.array("c0", "c1"))).alias("chunk")).join(borders, ["track", "chunk"]).select(
        "chunk", "track", "speaker", "seg_id", F.when(F.col("chunk") == F.col("c0"), F.col("s")).otherwise(F.col("begin")).alias("s"),
        F.when(F.col("chunk") == F.col("c1"), F.col("e")).otherwise(F.col("until")).alias("e"), F.lit(0).cast("long").alias("open"))
    pieces = ends.unionByName(_open_turns(whole).join(borders, ["track", "chunk"]).select(
        "chunk", "track", "speaker", F.lit(0).cast(fields["seg_id"]).alias("seg_id"), F.col("begin").alias("s"), F.col("until").alias("e"), "open"))
    ship_package(spark)
    found = pieces.groupBy("chunk").applyInPandas(
        _chunk_overlaps, f"track {fields['track']}, seg_id {fields['seg_id']}, speaker string, ov long")
    total = found.groupBy("track", "seg_id", "speaker").agg(F.sum(F.col("ov").cast("decimal(38,0)")).alias("ov"))
    total = _with_whole_chunks(total, whole, pieces)
    best = total.groupBy("track", "seg_id").agg(
        F.min(F.struct((-F.col("ov")).alias("neg"), F.col("speaker"))).alias("b"))
    return segments.select("track", "seg_id").join(best, ["track", "seg_id"], "left").select(
        "track", "seg_id", F.coalesce(F.col("b.speaker"), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(-F.col("b.neg"), F.lit(0)).cast("bigint").alias("overlap_us"))


def _open_turns(whole: DataFrame) -> DataFrame:
    """Per (track, chunk, speaker) the number of turns that cover the whole chunk."""
    steps = whole.where("speaker IS NOT NULL AND c1 - c0 > 1").select("track", "speaker", F.explode(F.array(
        F.struct((F.col("c0") + 1).alias("chunk"), F.lit(1).alias("d")), F.struct(F.col("c1").alias("chunk"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy("track", "speaker", "x.chunk").agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("track", "speaker").orderBy("chunk")
    runs = steps.select("track", "speaker", "chunk", F.sum("d").over(w).alias("open"), F.lead("chunk").over(w).alias("next"))
    return runs.where("open > 0").select("track", "speaker", "open", F.explode(F.sequence("chunk", F.col("next") - 1)).alias("chunk"))


def _with_whole_chunks(total: DataFrame, whole: DataFrame, pieces: DataFrame) -> DataFrame:
    """Add to the overlaps in first and last chunks what lies in the whole chunks between."""
    spans = whole.where("speaker IS NULL AND c1 - c0 > 1").groupBy(
        "track", "seg_id", (F.col("c0") + 1).alias("lo"), F.col("c1").alias("hi")).agg(F.count(F.lit(1)).alias("times"))
    # runs of 2^level chunks that make up [lo, hi): at each level at most one at either end
    size = F.pow(F.lit(2), F.col("level")).cast("long")
    parts = spans.select("track", "lo", "hi").distinct().select("*", F.explode(F.sequence(F.lit(0), F.log2(F.col("hi") - F.col("lo")).cast("int") + 1)).alias("level"))
    parts = parts.withColumns({"a": F.ceil(F.col("lo") / size), "b": F.floor(F.col("hi") / size)}).where("a < b").select(
        "track", "lo", "hi", "level", F.explode(F.array_compact(F.array(
            F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)))).alias("run"))
    parts = materialize(parts, "speaker-runs")
    top = parts.agg(F.max("level")).first()[0]
    if top is None:  # no segment spans a whole chunk
        return total
    long = F.col("e").cast("decimal(38,0)") - F.col("s")
    said = pieces.where("speaker IS NOT NULL").groupBy("track", "chunk", "speaker").agg(F.sum(long * F.greatest("open", F.lit(1))).alias("ov"))
    runs = said.select("*", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")).groupBy(
        "track", "level", F.floor(F.col("chunk") / size).alias("run"), "speaker").agg(F.sum("ov").alias("ov"))
    inner = materialize(parts.join(runs, ["track", "level", "run"]).groupBy("track", "lo", "hi", "speaker").agg(
        F.sum("ov").cast("decimal(38,0)").alias("inner")), "speaker-spans")
    first = inner.groupBy("track", "lo", "hi").agg(F.min(F.struct((-F.col("inner")).alias("neg"), "speaker"))["speaker"].alias("speaker"))
    several = spans.groupBy("track", "seg_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    span = ["track", "lo", "hi"]
    names = total.select("track", "seg_id", "speaker", "ov").unionByName(
        spans.join(first, span).unionByName(spans.join(several, ["track", "seg_id"]).join(inner.drop("inner"), span)).select(
            "track", "seg_id", "speaker", F.lit(0).cast("decimal(38,0)").alias("ov")))
    names = names.groupBy("track", "seg_id", "speaker").agg(F.sum("ov").cast("decimal(38,0)").alias("ov"))
    between = names.join(spans, ["track", "seg_id"]).join(inner, [*span, "speaker"]).select(
        "track", "seg_id", "speaker", (F.col("inner") * F.col("times")).cast("decimal(38,0)").alias("ov"))
    return names.unionByName(between).groupBy("track", "seg_id", "speaker").agg(F.sum("ov").cast("decimal(38,0)").alias("ov")).where("ov > 0")


def _chunk_overlaps(pdf):
    """Overlap of every segment piece with every speaker it meets inside one chunk."""
    import numpy as np
    import pandas as pd

    out = []
    for track, rows in pdf.groupby("track", sort=False):
        segs, said = rows[rows["speaker"].isna()], rows[rows["speaker"].notna()]
        if segs.empty or said.empty:
            continue
        zero = rows["s"].min()
        lo, hi = segs["s"].to_numpy() - zero, segs["e"].to_numpy() - zero
        for speaker, mine in said.groupby("speaker", sort=False):
            ov = (hi - lo) * mine["open"].sum()  # turns over the whole chunk
            mine = mine[mine["open"] == 0]
            starts, ends = (np.sort(mine[c].to_numpy() - zero) for c in ("s", "e"))
            for sign, at in ((1, hi), (-1, lo)):  # time talked up to a point
                for times, kind in ((starts, 1), (ends, -1)):
                    n = np.searchsorted(times, at, side="right")
                    ov += sign * kind * (at * n - np.r_[0, np.cumsum(times)][n])
            out += [(track, i, speaker, int(x)) for i, x in zip(segs["seg_id"].tolist(), ov.tolist()) if x > 0]
    return pd.DataFrame(out, columns=["track", "seg_id", "speaker", "ov"]).astype({"speaker": object})


def segment_line(start, end, speaker, text):
    """``[start s - end s] SPK: text`` + newline, rounded to 2 digits."""
    return F.concat(F.lit("["), F.round(start, 2).cast("string"), F.lit("s - "),
                    F.round(end, 2).cast("string"), F.lit("s] "),
                    F.coalesce(speaker, F.lit(UNKNOWN)), F.lit(": "), ustrip(text), F.lit("\n"))


def render_transcripts(segments: DataFrame, block: int = 1024) -> DataFrame:
    """Segment lines concatenated in ``seg_no`` order per track.

    Two levels: lines are first joined per ``(track, seg_no div block)`` -
    many tasks work on one long track in parallel - then the block strings
    are joined in order per track.  The last step holds only the output
    text of a track (one value per track is the result), never its rows.
    """
    lines = segments.select("track", "seg_no", segment_line(
        F.col("start"), F.col("end"), F.col("speaker"), F.col("text")).alias("line"))
    blocks = lines.groupBy("track", F.floor(F.col("seg_no") / block).alias("blk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "line"))),
                                 lambda x: x["line"]), "").alias("part"),
        F.count(F.lit(1)).alias("n"))
    return blocks.groupBy("track").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", "part"))),
                                 lambda x: x["part"]), "").alias("text"),
        F.sum("n").alias("n_segments"))
