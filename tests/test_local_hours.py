"""Local hours against zoneinfo: half-hour zone, repeated and missing hours."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from hydroseries.config import SeriesSpec
from hydroseries.functions.time import local_hour
from hydroseries.operators import timegrid

UTC = dt.timezone.utc
CASES = [("Asia/Kolkata", dt.datetime(2024, 3, 30)), ("Europe/Berlin", dt.datetime(2024, 3, 30, 12)), ("Europe/Berlin", dt.datetime(2024, 10, 26, 12)),
         ("Asia/Kathmandu", dt.datetime(2024, 1, 1)), ("America/St_Johns", dt.datetime(2024, 11, 2, 12))]


def begin(t, tz):
    """Step back from the instant while the local clock shows the same hour of the same offset."""
    z, now = ZoneInfo(tz), t.replace(tzinfo=UTC)
    local = now.astimezone(z)
    while True:
        before = now - dt.timedelta(minutes=1)
        b = before.astimezone(z)
        if (b.date(), b.hour, b.utcoffset()) != (local.date(), local.hour, local.utcoffset()):
            return now.replace(second=0, tzinfo=None)
        now = before


@pytest.mark.parametrize("tz, start", CASES)
def test_buckets_and_grid(spark, tz, start):
    times = [start + dt.timedelta(minutes=7 * i) for i in range(300)]
    df = spark.createDataFrame([("a", t, 1.0) for t in times], "site_id string, ts timestamp_ntz, v double")
    got = {r["ts"]: r["b"] for r in df.select("ts", local_hour("ts", tz).alias("b")).collect()}
    assert got == {t: begin(t, tz) for t in times}
    counts = {r["ts"]: r["n"] for r in timegrid.resample_local(df, {"n": F.count("v")}, tz).collect()}
    want = {}
    for t in times:
        want[begin(t, tz)] = want.get(begin(t, tz), 0) + 1
    assert counts == want
    end = start + dt.timedelta(hours=34, minutes=59)
    spans = spark.createDataFrame([("a", start, end), ("b", start, start)], "site_id string, start timestamp_ntz, end timestamp_ntz")
    minutes = [start + dt.timedelta(minutes=i) for i in range(35 * 60)]
    hours = [m for m in minutes if begin(m, tz) == m]
    for spec in (SeriesSpec(chunk_hours=8), SeriesSpec()):
        grid = sorted(r["ts"] for r in timegrid.local_hourly_grid(spans, tz, spec).filter("site_id = 'a'").collect())
        assert grid == hours
