from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from litmill.operators.timestamps import normalise_moments

PUBLISHERS = [("Berlin House", "Europe/Berlin"), ("NY Press", "America/New_York"), ("Lost", "Nowhere/Atlantis"), ("Lord", "Australia/Lord_Howe")]


def us(*a):
    return int((datetime(*a, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1_000_000)


CASES = [
    ("2020-05-26", None, us(2020, 5, 26)),
    ("2020/05/26 12:30", "berlin house ", us(2020, 5, 26, 10, 30)),
    (" 2020-05-26T12:00:00.123456789Z ", "Berlin House", us(2020, 5, 26, 12) + 123456),
    ("20200526120059", "NY Press", us(2020, 5, 26, 16, 0, 59)),
    ("26 May 2020", "Unlisted", us(2020, 5, 26)),
    ("Tue, 26 May 2020 12:00:00 +0530", None, us(2020, 5, 26, 6, 30)),
    ("May 6, 2020 at 12:05 AM", None, us(2020, 5, 6, 0, 5)),
    ("05/26/2020 12:05 PM", None, us(2020, 5, 26, 12, 5)),
    ("26.05.2020", None, us(2020, 5, 26)),
    ("2020年5月6日 14:05", None, us(2020, 5, 6, 14, 5)),
    ("1590451200", "NY Press", 1590451200 * 1_000_000),
    ("1590451200123", None, 1590451200123 * 1000),
    ("2020-01-01 10:00:00 EST", "Berlin House", us(2020, 1, 1, 15)),
    ("2020-01-01 10:00:00 UTC-08:00", None, us(2020, 1, 1, 18)),
    ("2021-10-31 02:30:00", "Berlin House", us(2021, 10, 31, 0, 30)),  # twice: the first
    ("2021-03-28 02:30:00", "Berlin House", us(2021, 3, 28, 1, 30)),  # skipped: the offset before
    ("2020-06-01 00:00", "Lost", us(2020, 6, 1)),  # unknown zone: UTC
    ("2021-02-29", None, None), ("2020-13-01", None, None), ("2020-05", None, None), ("2020", None, None), ("Spring 2021", None, None),
    ("", None, None), ("   ", None, None), ("null", None, None), ("2020-05-26 25:00", None, None), ("x" * 50_000, None, None), (None, "NY Press", None),
    ("2020-01-01 10:00:00 XQZT", None, None),
]


def test_forms(spark):
    rows = [(i, v, p) for i, (v, p, _) in enumerate(CASES)] * 2  # repeated rows keep their values
    df = spark.createDataFrame(rows, "id int, value string, publisher string")
    out = normalise_moments(df, spark.createDataFrame(PUBLISHERS, "publisher string, time_zone string"))
    got = out.collect()
    assert len(got) == 2 * len(CASES) and set(out.columns) == {"id", "value", "publisher", "utc_us", "reading"}
    for r in got:
        assert r.utc_us == CASES[r.id][2], CASES[r.id]


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe"])
def test_every_half_hour_around_changes(spark, zone):
    start = [datetime(2021, 3, 13), datetime(2021, 3, 27), datetime(2021, 10, 2), datetime(2021, 10, 30), datetime(2021, 11, 6), datetime(2021, 4, 3)]
    local = [s + timedelta(minutes=30 * i) for s in start for i in range(96)]
    df = spark.createDataFrame([(x.strftime("%Y-%m-%dT%H:%M:%S"), "P") for x in local], "value string, publisher string")
    got = {r.value: r.utc_us for r in normalise_moments(df, spark.createDataFrame([("P", zone)], "publisher string, time_zone string")).collect()}
    for x in local:
        want = x.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(UTC)
        assert got[x.strftime("%Y-%m-%dT%H:%M:%S")] == us(want.year, want.month, want.day, want.hour, want.minute), x


def test_empty_and_extra_columns(spark):
    p = spark.createDataFrame([], "publisher string, time_zone string")
    df = spark.createDataFrame([("2020-01-01", None, 1, "z")], "value string, publisher string, zone int, local_year string")
    assert normalise_moments(df.limit(0), p).count() == 0
    assert normalise_moments(df, p).first().utc_us == us(2020, 1, 1)
