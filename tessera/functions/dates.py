"""RFC 822 / RFC 2822 date strings -> UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import ustrip

# ---------------------------------------------------------------------------
# Named zones of RFC 822 and their offsets, month names.
# ---------------------------------------------------------------------------
ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "AST": "-0400", "ADT": "-0300", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600",
    "PST": "-0800", "PDT": "-0700",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
          "december")
# ---------------------------------------------------------------------------


# the usual form, of fixed width but for the zone; anything else goes through the general steps
_USUAL = (r"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?\d\d (?:" + "|".join(m[:3].title() for m in MONTHS)
          + r") [1-9]\d{3} \d\d:\d\d:\d\d (?:" + "|".join(ZONES) + r"|(?!-0000)[+-](?:0\d|1[0-7])[0-5]\d)$")
_SHAPE = r"^(\d{1,2}),? ([A-Za-z]+),? (\d{1,4}),? (\d{1,2})[:.](\d{1,2})(?:[:.](\d{1,2}))?(?:,? ?([+-]\d+|[A-Za-z]+))?(?: .*)?$"


def parse_rfc822(c: Column, naive_zone: str = "+0000") -> Column:
    """``parsedate_to_datetime`` as a column (an instant, or null).

    Read: a day name (unchecked; short, or anything that ends in a comma) or
    none; ``d Mon yyyy``, ``Mon d yyyy`` or ``d-Mon-yyyy`` with short or full
    English month names and commas after any part; years of two digits (69 to
    99: 19xx, else 20xx); ``H:MM`` or ``H:MM:SS``, also with dots; a numeric or
    named zone; anything after the zone (comments) is ignored.  An unknown
    zone, ``-0000`` or none is read in ``naive_zone`` (deviation V6: the source
    uses the host's local zone).  Blank, null, incomplete and impossible dates
    give null.

    Dates of the usual form are read by position in generated code; the
    regular expressions run for the others alone.
    """
    return F.when(c.rlike(_USUAL), _usual(c)).otherwise(_general(c, naive_zone))


def _usual(c: Column) -> Column:
    """The instant of a date of the form ``_USUAL``."""
    at = F.when(F.substring(c, 4, 1) == ",", 6).otherwise(1)
    zone = F.substr(c, at + 21, F.lit(5))
    offset = zone
    for name, value in ZONES.items():
        offset = F.when(zone == name, value).otherwise(offset)
    return F.try_to_timestamp(F.concat(F.substr(c, at, F.lit(20)), F.lit(" "), offset), F.lit("dd MMM yyyy HH:mm:ss Z"))


def _general(c: Column, naive_zone: str) -> Column:
    s = F.regexp_replace(ustrip(c), r"\s+", " ")
    s = F.regexp_replace(s, r"^(?:\S*,(?: |$)|(?i:mon|tue|wed|thu|fri|sat|sun) )", "")
    s = F.regexp_replace(s, r"^[A-Za-z]+,(?=\d)", "")
    s = F.regexp_replace(s, r"^(\d+)-([A-Za-z]+)-(\d+)(?= )", "$1 $2 $3")
    # the month may come first, the time before the year
    s = F.regexp_replace(s, r"^([A-Za-z]+),? (\d+)(,?) ", "$2 $1$3 ")
    s = F.regexp_replace(s, r"^(\d+,? [A-Za-z]+,?) (\d+[:.][\d:.]+),? (\d+)(?= |$)", "$1 $3 $2")
    # the parts are taken inside a lambda, so the steps above run once per date
    return F.get(F.transform(F.array(s), lambda x: _instant(x, naive_zone)), F.lit(0))


def _instant(s: Column, naive_zone: str) -> Column:
    """The instant of a date whose parts stand in the order of ``_SHAPE``."""
    part = [F.regexp_extract(s, _SHAPE, i) for i in range(8)]
    name = F.lower(part[2])
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(name, 1, 3))
    month = F.when(name.isin(*MONTHS, *[m[:3] for m in MONTHS]), month)
    year = part[3].try_cast("int")
    year = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
    zone = F.coalesce(
        F.element_at(F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.lit(v))]), F.upper(part[7])),
        F.when(part[7].rlike(r"^[+-]\d+$") & (part[7] != "-0000"), part[7]), F.lit(naive_zone))
    digits = F.substring(zone, 2, 10).try_cast("int")
    east = (F.floor(digits / 100) * 3600 + digits % 100 * 60) * F.when(zone.startswith("-"), -1).otherwise(1)
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month.cast("int"), part[1].try_cast("int"),
                           part[4].try_cast("int"), part[5].try_cast("int"), F.coalesce(part[6].try_cast("int"), F.lit(0)))
    wall = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit("yyyy-MM-dd HH:mm:ss Z"))
    return F.when(month.isNotNull() & (F.abs(east) < 86_400), F.timestamp_add("SECOND", -east, wall))


def utc_wall_clock(instant: Column) -> Column:
    """TIMESTAMP (an instant) -> TIMESTAMP_NTZ of its UTC wall-clock time,
    independent of the session time zone."""
    return _utc_ntz(instant)


def _utc_ntz(instant: Column) -> Column:
    # epoch micros are zone-free; NTZ epoch + micros is the UTC wall clock
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.to_timestamp_ntz(F.lit(_EPOCH_NTZ)))


def epoch_micros_ntz(ts: Column) -> Column:
    """TIMESTAMP_NTZ read as UTC -> microseconds since the epoch (zone-free)."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit(_EPOCH_NTZ)), ts)


def ts_literal(value, like_ntz: bool) -> Column:
    """A timestamp literal of the column's kind, parsed without a zone shift
    for TIMESTAMP_NTZ columns."""
    s = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.to_timestamp_ntz(F.lit(s)) if like_ntz else F.to_timestamp(F.lit(s))


_EPOCH_NTZ = "1970-01-01 00:00:00"
