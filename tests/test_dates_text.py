"""RFC 822 dates (FIXTURES 1.1) and Python string parity helpers."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import one_col
from tessera.functions.dates import parse_rfc822, utc_wall_clock
from tessera.functions.text import first_line, output_key, splitlines, urlsafe_b64, ustrip


def parse(spark, s):
    v = one_col(spark, utc_wall_clock(parse_rfc822(F.col("x"))), s)
    return v


def test_rfc822(spark):
    assert parse(spark, "Fri, 08 May 2026 12:00:00 GMT") == dt.datetime(2026, 5, 8, 12, 0)
    assert parse(spark, "Sat, 02 Jan 2026 09:30:00 +0000") == dt.datetime(2026, 1, 2, 9, 30)  # wrong weekday
    assert parse(spark, "Fri, 08 May 2026 12:00:00 EST") == dt.datetime(2026, 5, 8, 17, 0)  # fixed -5
    assert parse(spark, "8 May 2026 12:00 +0200") == dt.datetime(2026, 5, 8, 10, 0)
    for bad in (None, "", "not a valid date"):
        assert parse(spark, bad) is None


def test_python_strip_and_lines(spark):
    assert one_col(spark, ustrip(F.col("x")), "\t\x1f a b 　\n") == "a b"
    assert one_col(spark, splitlines(F.col("x")), "a\r\nb\x1cc\n") == ["a", "b", "c"]
    assert one_col(spark, first_line(F.col("x")), "t1 t2") == "t1"


def test_keys(spark):
    import base64
    s = "https://x.example/ä?q=1&r=~" * 5
    assert one_col(spark, urlsafe_b64(F.col("x")), s) == base64.urlsafe_b64encode(s.encode()).decode()
    assert one_col(spark, output_key(F.col("x"), "_vocab.json"), "a/b/track01.txt") == "track01_vocab.json"


SHAPES = ["Fri, 08 May 2026 12:00:00 GMT", "08 May 26 12:00:00 GMT", "08 May 99 12:00:00 GMT", "08 May 69 1:00:00 EST",
          "Fri, 08 May 2026 12:00:00 GMT (UTC)", "Friday, 08 May 2026 12:00:00 GMT", "08-May-2026 12:00:00 GMT",
          "Friday, 08-May-26 12:00:00 GMT", "May 08 2026 12:00:00 GMT", "May 08, 2026 12:00:00 +0200", "8 May 2026 12:00 +0200",
          "8 May 2026 12:00", "8 May 2026", "Fri 08 May 2026 12:00:00 PDT", "Friday 08 May 2026 12:00:00 GMT",
          "08 May 2026 12:00:00 -0000", "08 May 2026 12:00:00 XYZ", "08 May 2026 12:00:00 z", "08 August 2026 12:00:00 GMT",
          "08 Augusto 2026 12:00:00 GMT", "31 Feb 2026 12:00:00 GMT", "08 May 2026 25:00:00 GMT", "08 May 2026 12.30.15 GMT",
          "Fri,08 May 2026 12:00:00 GMT", "08 May 2026 12:00:00+0530", "08 May 2026 12:00:00 +0530", "08 May 2026 12:00:00 -0330",
          "08 May 2026 12:00:60 GMT", "", "not a valid date", "08 MAY 2026 12:00:00 gmt", "Fri, 8 May 2026  12:00:00   GMT",
          "08 May 12:00:00 2026 GMT", "08 May 2026 12:00:00 +02:00", "1 Jan 0026 00:00:00 GMT", "8 May 2026, 12:00 GMT",
          "2026-05-08 12:00:00", "08 May 2026 7:5:3 GMT", "08 May 126 12:00:00 GMT"]


def test_dates_agree_with_the_standard_parser(spark):
    from email.utils import parsedate_to_datetime
    df = spark.createDataFrame([(x,) for x in SHAPES], "x string")
    got = {r.x: r.t for r in df.select("x", utc_wall_clock(parse_rfc822(F.col("x"))).alias("t")).collect()}
    for x in SHAPES:
        try:
            want = parsedate_to_datetime(x)
            want = want.astimezone(dt.timezone.utc).replace(tzinfo=None) if want.tzinfo else want
        except Exception:
            want = None
        assert got[x] == want, x


def test_json_is_strict_like_the_standard_parser(spark):
    import json
    from tessera.functions.jsonx import json_kind
    texts = ['{"k":1}\nHope this helps!', '{"k":1,"k":2}', '{"k":1} {"k":2}', "1,2", "", "  ", " [1,2] ", '{"k":1}]',
             '1],"a":[2', "nan", '"x"', "null", "true", "[1,", '{"a":"b\nc"}', "{'a':1}", "\ufeff{}", '[{"k":1,"k":2}]', "01", "1.",
             '{"k":1,}', "[1,2,]", "12345678901234567890123", '"\\u12"', "[]", "{}", "1]", '1,"end of text"]', '"it\'s"', '"a\\"b"',
             '"' + "\\n" * 50_000 + '"', "\x00", '\t{"a" :\r\n[1, "b"]}\n']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: r.k for r in df.select("i", json_kind(F.col("x")).alias("k")).collect()}
    for i, x in enumerate(texts):
        try:
            v = json.loads(x)
            want = "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "scalar"
        except ValueError:
            want = None
        assert got[i] == want, x[:40]


def test_usual_dates_are_read_alike_by_position_and_by_the_general_steps(spark):
    import random
    from pyspark.sql import functions as F
    from tessera.functions import dates
    rnd = random.Random(2)
    zones = [*dates.ZONES, "+0200", "-0330", "-0000", "+1759", "+2359", "+2400", "+0060", "gmt", ""]
    rows = [(f"{rnd.choice(['Mon, ', 'Fri, ', '', 'Xyz, '])}{rnd.randrange(34):02d} {rnd.choice(dates.MONTHS)[:3].title()} "
             f"{rnd.choice([1970, 2024, 1900, 23, 1582, 9999])} {rnd.randrange(26):02d}:{rnd.randrange(62):02d}:{rnd.randrange(62):02d} "
             f"{rnd.choice(zones)}",) for _ in range(5000)] + [(None,), ("",)]
    got = spark.createDataFrame(rows, "s string").select(
        "s", F.coalesce(F.col("s").rlike(dates._USUAL), F.lit(False)).alias("usual"), dates.parse_rfc822(F.col("s")).alias("a"),
        dates._general(F.col("s"), "+0000").alias("b"))
    assert got.where("NOT (a <=> b)").count() == 0
    assert got.where("usual AND a IS NOT NULL").count() > 1500 and got.where("NOT usual AND a IS NOT NULL").count() > 200
