from datetime import datetime

import pytest
from pyspark.sql import functions as F

from geoledger.functions import ids, times


@pytest.mark.parametrize("text, start, end", [
    ("2020-02-01T00:00:00Z/2020-02-03T00:00:00+01:00", datetime(2020, 2, 1), datetime(2020, 2, 2, 23)),
    ("../2020-02-01T00:00:00Z", times.NANOS_MIN, datetime(2020, 2, 1)),
    ("2020-02-01T00:00:00Z/..", datetime(2020, 2, 1), times.NANOS_MAX),
    ("2020-02-01T10:00:00.5Z", datetime(2020, 2, 1, 10, 0, 0, 500000), datetime(2020, 2, 1, 10, 0, 0, 500000)),
    (None, times.NANOS_MIN, times.NANOS_MAX),
    ("1900-01-01T00:00:00Z/2500-01-01T00:00:00Z", times.NANOS_MIN, times.NANOS_MAX),
    ("/", times.NANOS_MIN, times.NANOS_MAX),
])
def test_intervals(text, start, end):
    assert times.parse_interval(text) == (start, end)


def test_interval_on_the_calendar_clock():
    assert times.parse_interval(None, nanos=False) == (times.CALENDAR_MIN, times.CALENDAR_MAX)
    got = times.parse_interval("1900-01-01T00:00:00.123987Z/..", nanos=False)
    assert got == (datetime(1900, 1, 1, 0, 0, 0, 123000), times.CALENDAR_MAX)


@pytest.mark.parametrize("text", ["2020-02-01", "yesterday", "2020-02-01T00:00:00Z/soon"])
def test_bad_intervals(text):
    with pytest.raises(ValueError):
        times.parse_interval(text)


def test_utc_columns_ignore_the_session_zone(spark):
    rows = spark.createDataFrame(
        [("2020-02-01T10:00:00Z",), ("2020-02-01T12:00:00.25+02:00",), ("2020-03-08T02:30:00Z",), ("never",), (None,)],
        "t string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        parsed = rows.select(times.parse_utc(F.col("t")).alias("u"))
        got = [r["u"] for r in parsed.collect()]
        text = [r[0] for r in parsed.select(times.rfc3339(F.col("u"))).collect()]
        hours = [r[0] for r in parsed.select(times.trunc_utc("hour", F.col("u"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [datetime(2020, 2, 1, 10), datetime(2020, 2, 1, 10, 0, 0, 250000), datetime(2020, 3, 8, 2, 30), None, None]
    assert text == ["2020-02-01T10:00:00Z", "2020-02-01T10:00:00.250000Z", "2020-03-08T02:30:00Z", None, None]
    assert hours[:3] == [datetime(2020, 2, 1, 10), datetime(2020, 2, 1, 10), datetime(2020, 3, 8, 2)]


@pytest.mark.parametrize("pattern, yes, no", [
    ("", [""], ["a"]),
    ("Lands%", ["landsat", "LANDS", "lands\nat"], ["xlands"]),
    ("a_c", ["abc", "A.C"], ["ac", "abbc"]),
    (r"50\%", ["50%"], ["500", "50x"]),
    (r"a\_b", ["a_b"], ["axb"]),
    ("a\\\\b", ["a\\b"], ["a\\\\b", "ab"]),
    ("te?t*", ["test", "text-item"], ["tet"]),
    ("a.b", ["a.b"], ["axb"]),
])
def test_like(spark, pattern, yes, no):
    regex = ids.like_regex(pattern)
    rows = spark.createDataFrame([(v,) for v in yes + no], "v string")
    got = {r["v"] for r in rows.filter(F.col("v").rlike(regex)).collect()}
    assert got == set(yes)


@pytest.mark.parametrize("pattern", ["\\", "\\1", "abc\\", "a\\*"])
def test_bad_escapes(pattern):
    with pytest.raises(ValueError):
        ids.like_regex(pattern)
