"""Candidate lists and matching the model's answer back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import cap, ustrip


def numbered_list(items: DataFrame, batch: str = "batch", pos: str = "pos") -> DataFrame:
    """A8 + W1: ``[i] title / Fuente | Fecha / description[:300]`` joined by a
    blank line, one string per batch (batches are bounded candidate lists)."""
    # Build the (capped) block text before the window so the shuffle carries
    # at most ~300 characters of description per item, not whole texts.
    body = F.concat(F.lit("] "), F.col("title"), F.lit("\n    Fuente: "), F.col("source"),
                    F.lit(" | Fecha: "), F.col("pub_date"), F.lit("\n    "), cap(F.col("description"), 300))
    slim = items.select(batch, pos, body.alias("_body"))
    i = F.row_number().over(Window.partitionBy(batch).orderBy(pos))
    numbered = slim.select(batch, i.alias("i"),
                           F.concat(F.lit("["), i.cast("string"), F.col("_body")).alias("block"))
    return numbered.groupBy(batch).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "block"))),
                                 lambda s: s["block"]), "\n\n").alias("story_list"),
        F.count(F.lit(1)).alias("n_items"))


def match_title(candidates: DataFrame, answers: DataFrame, batch: str = "batch",
                pos: str = "pos", title: str = "title", answer: str = "answer") -> DataFrame:
    """Per batch, the first candidate (by ``pos``) whose stripped title
    equals the stripped answer or contains it (case-insensitive); otherwise
    the first candidate.  An equi-join on the batch, then ``min_by`` with a
    filter: partial aggregation, no candidate list is collected."""
    j = candidates.join(answers.select(batch, answer), batch)
    t, a = ustrip(F.col(title)), ustrip(F.col(answer))
    hit = (t == a) | F.contains(F.lower(t), F.lower(a))
    order = F.struct(F.col(pos), F.col(title))
    return j.groupBy(batch).agg(
        F.min(F.when(hit, order)).alias("_m"), F.min(order).alias("_f")
    ).select(batch,
             F.coalesce(F.col("_m"), F.col("_f"))[pos].alias("chosen_pos"),
             F.coalesce(F.col("_m"), F.col("_f"))[title].alias("chosen_title"),
             F.col("_m").isNotNull().alias("matched"))
