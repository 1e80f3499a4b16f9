"""Stored daily sketches, merged over any span, against exact quantiles."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.operators import sketch, stats

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [("a", T0 + dt.timedelta(minutes=int(m)), float(v)) for m, v in zip(rng.integers(0, 10 * 1440, 20_000), rng.gamma(2.0, 3.0, 20_000))]
    rows += [("b", T0 + dt.timedelta(hours=i), 7.0 if i % 2 else None) for i in range(50)] + [("c", T0, None)]
    return rows, spark.createDataFrame(rows, "site_id string, ts timestamp_ntz, v double")


@pytest.mark.parametrize("first, last", [(None, None), (2, 5)])
def test_rank_error_within_the_bound(spark, table, tmp_path, first, last):
    rows, df = table
    sketch.daily_sketches(df, ["v"]).write.parquet(str(tmp_path / "s"))
    day = lambda d: None if d is None else (T0 + dt.timedelta(days=d)).date()
    spans = sketch.merged(spark.read.parquet(str(tmp_path / "s")), ["site_id"], day(first), day(last))
    qs = {f"q{i}": i / 100 for i in (1, 10, 25, 50, 75, 90, 99)}
    got = {r["site_id"]: r for r in sketch.quantiles(spans, qs).collect()}
    values = np.sort([v for s, t, v in rows if s == "a" and (first is None or day(first) <= t.date() <= day(last))])
    assert got["a"]["n"] == len(values) and got["a"]["mean"] == pytest.approx(values.mean())
    for name, q in qs.items():
        rank = np.searchsorted(values, got["a"][name], side="right") / len(values)
        assert abs(rank - q) <= sketch.RANK_ERROR[sketch.K]
    assert "c" not in got


def test_approx_forms_are_near_the_exact_ones(spark, table):
    df = table[1]
    exact = {r["site_id"]: r for r in stats.column_stats(df, ["v"]).collect()}
    near = {r["site_id"]: r for r in sketch.approx_column_stats(df, ["v"]).collect()}
    assert near["a"]["mean"] == pytest.approx(exact["a"]["mean"]) and near["a"]["median"] == pytest.approx(exact["a"]["median"], rel=0.06)
    assert near["b"]["median"] == 7.0
    flag = lambda x: x.groupBy("site_id").agg(F.count_if("is_outlier").alias("n")).collect()
    a = {r["site_id"]: r["n"] for r in flag(stats.iqr_outliers(df, "v", 1.5, ["site_id"]))}
    b = {r["site_id"]: r["n"] for r in flag(sketch.approx_iqr_outliers(df, "v"))}
    assert a["b"] == b["b"] == 0 and abs(a["a"] - b["a"]) < 0.3 * a["a"]
