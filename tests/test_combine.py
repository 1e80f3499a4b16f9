"""As-of attach with tolerance and source order (FIXTURES.md: a 30-hour hole
with tolerance 24, two readings in one hour, last value before the grid end)."""

import datetime as dt

import pytest

from conftest import T0, column
from hydroseries.config import SeriesSpec
from hydroseries.operators import combine, timegrid


def grid(spark, n, spec):
    spans = spark.createDataFrame([("a", T0, T0 + dt.timedelta(hours=n - 1))],
                                  "site_id string, start timestamp_ntz, end timestamp_ntz")
    return timegrid.hourly_grid(spans, spec)


@pytest.mark.parametrize("spec", [SeriesSpec(chunk_hours=8), SeriesSpec(chunk_hours=None), SeriesSpec()])
def test_asof_tolerance_and_source_end(spark, spec):
    h = lambda i, m=0: T0 + dt.timedelta(hours=i, minutes=m)
    src = spark.createDataFrame(
        [("a", h(0, 10), 1.0), ("a", h(0, 40), 3.0),      # two readings in one hour -> mean 2.0
         ("a", h(30, 5), 5.0)],                           # after a 30-hour hole
        "site_id string, ts timestamp_ntz, v double")
    out = combine.asof_attach(grid(spark, 40, spec), src, ["v"], spec, tolerance_hours=24)
    got = column(out, "v")
    assert got[0] == 2.0
    assert got[1:25] == [2.0] * 24           # carried at most 24 hours
    assert got[25:30] == [None] * 5           # beyond the tolerance
    assert got[30] == 5.0
    assert got[31:] == [None] * 9             # the carry ends at the source's last hour
    unlimited = column(combine.asof_attach(grid(spark, 40, spec), src, ["v"], spec, tolerance_hours=None), "v")
    assert unlimited[25:30] == [2.0] * 5 and unlimited[31:] == [None] * 9


def test_combine_order(spark):
    spec = SeriesSpec()
    g = grid(spark, 3, spec)
    mk = lambda vals, name: spark.createDataFrame(
        [("a", T0 + dt.timedelta(hours=i), v) for i, v in enumerate(vals)], f"site_id string, ts timestamp_ntz, {name} double")
    out = combine.combine_sources(g, [
        ("attach", mk([1.0, None, 3.0], "x"), {}),
        ("upsert", mk([9.0, 8.0, None], "x"), {}),
        ("fill", mk([7.0, 7.0, 7.0], "x"), {}),
        ("attach", mk([0.5, 0.5, 0.5], "y"), {}),
    ], spec)
    assert column(out, "x") == [9.0, 8.0, 3.0]
    assert column(out, "y") == [0.5, 0.5, 0.5]
    with pytest.raises(ValueError):
        combine.combine_sources(g, [("merge", g, {})], spec)
