"""Feed items: validity, age cut-off, candidates, never-send-twice."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import TimestampNTZType

from tessera.functions.dates import ts_literal
from tessera.functions.text import ustrip


def valid_items(items: DataFrame, title: str = "title", link: str = "link") -> DataFrame:
    """drop items whose title or link is empty after stripping."""
    return items.filter((F.coalesce(ustrip(F.col(title)), F.lit("")) != "")
                        & (F.coalesce(ustrip(F.col(link)), F.lit("")) != ""))


def recent(items: DataFrame, now, max_age_hours: float = 24, ts: str = "ts") -> DataFrame:
    """keep ``ts >= now - max_age``; inclusive, no upper bound (future
    items stay).  ``now`` is a job parameter (the source reads the wall clock).
    A literal bound, so Parquet gets the predicate pushed down."""
    if isinstance(now, str):
        now = _dt.datetime.fromisoformat(now)
    cutoff = now - _dt.timedelta(hours=max_age_hours)
    ntz = isinstance(items.schema[ts].dataType, TimestampNTZType)
    return items.filter(F.col(ts) >= ts_literal(cutoff, ntz))


def sent_set(sent: DataFrame, url: str = "url") -> DataFrame:
    """The sent log as a set: stripped, blanks dropped, distinct."""
    u = ustrip(F.col(url))
    return sent.select(u.alias("url")).filter(F.col("url").isNotNull() & (F.col("url") != "")).distinct()


def _link_key(link: str) -> Column:
    return ustrip(F.col(link))


def unsent(items: DataFrame, sent: DataFrame, link: str = "link") -> DataFrame:
    """Items whose stripped link is not in the sent set; item values,
    order columns and duplicates are kept.  Spark chooses the join from the
    measured sizes."""
    s = sent_set(sent)
    return items.join(s, _link_key(link) == s["url"], "left_anti")


def sent_flag(items: DataFrame, sent: DataFrame, link: str = "link") -> DataFrame:
    """Every item with ``is_sent``."""
    s = sent_set(sent).withColumn("_sent", F.lit(True))
    return items.join(s, _link_key(link) == s["url"], "left").drop("url") \
        .withColumn("is_sent", F.coalesce(F.col("_sent"), F.lit(False))).drop("_sent")


def first_n(items: DataFrame, n: int = 15, order=("feed_pos", "item_pos")) -> DataFrame:
    """O2: the first ``n`` items in feed order.  The limit is the feature and
    comes *before* the unsent filter (so fewer than ``n`` may remain)."""
    return items.orderBy(*order).limit(n)


def with_pub_ts(items: DataFrame, raw: str = "pub_date_raw", observation=None) -> DataFrame:
    """E1 + F2: parse the feed date; items whose date does not parse are
    dropped.  With a ``pyspark.sql.Observation`` the rejects are counted as
    a side metric of the same job (the source logs each one)."""
    from tessera.functions.dates import parse_rfc822

    parsed = items.withColumn("pub_ts", parse_rfc822(F.col(raw)))
    if observation is not None:
        parsed = parsed.observe(observation, F.count_if(F.col("pub_ts").isNull()).alias("bad_dates"),
                                F.count(F.lit(1)).alias("items"))
    return parsed.filter(F.col("pub_ts").isNotNull())


def feed_candidates(items: DataFrame, sent: DataFrame, now, max_age_hours: float = 24, n: int = 15,
                    observation=None) -> DataFrame:
    """The scheduled flow: valid items (F1) -> dates (E1/F2) -> age cut-off
    (F3) -> first ``n`` in feed order (O2) -> not yet sent (J4)."""
    fresh = recent(with_pub_ts(valid_items(items), observation=observation), now, max_age_hours, ts="pub_ts")
    return unsent(first_n(fresh, n), sent)
