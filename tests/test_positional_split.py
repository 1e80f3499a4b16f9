"""Positional cuts: rows of one time may stand in different parts; equal to row_number() in SQL."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest

from hydroseries.operators import split


@pytest.mark.parametrize("by", [[], ["site_id"]])
def test_equals_row_numbers(spark, by):
    r = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(r.choice("abc"), t0 + dt.timedelta(hours=r.randrange(12)), i) for i in range(203)]
    df = spark.createDataFrame(rows, "site_id string, ts timestamp_ntz, n long").repartition(5)
    got = sorted(map(tuple, split.positional_split(df, "ts", by, ["site_id", "n"]).collect()))
    con = duckdb.connect()
    con.register("x", pd.DataFrame(rows, columns=["site_id", "ts", "n"]))
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    want = con.sql(f"""SELECT site_id, ts, n, CASE WHEN r < floor(floor(c * 0.8) * 0.8) THEN 'train' WHEN r < floor(c * 0.8) THEN 'val' ELSE 'test' END
        FROM (SELECT *, row_number() OVER ({part} ORDER BY ts, site_id, n) - 1 AS r, count(*) OVER ({part}) AS c FROM x)""").fetchall()
    assert got == sorted(want)
    shared = {}
    for s, t, _, part_ in got:
        shared.setdefault((t, s) if by else t, set()).add(part_)
    assert any(len(v) > 1 for v in shared.values())  # a time is cut through
    assert split.positional_split(df.limit(0), "ts", by, ["site_id"]).count() == 0
