"""Plans and driver data that can fail the operators."""

import datetime as dt

from pyspark.sql import functions as F

from hydroseries.operators import combine, fill
from hydroseries.plans import catalog_series as cs
from hydroseries.plans import pipeline
from hydroseries.plans.catalog import QUERIES
from hydroseries.session import materialize

SF = "/root/testdata/sf0.01"


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_combine_reads_events_once(spark):
    assert "events.parquet" not in _plan(QUERIES["combine_sources"](spark, SF))  # only the cut hourly table


def test_time_range_is_pushed(spark):
    plan = _plan(QUERIES["time_range"](spark, SF))
    assert "GreaterThanOrEqual(ts,2024-01-08T00:00)" in plan and "LessThan(ts,2024-01-22T00:00)" in plan


def test_limit_binds_on_gaps(spark):
    x = cs._dense_by_user(spark, SF)
    n = [fill.ffill(x, ["local_water_level_m"], cs.SPEC, limit=k).filter(F.col("local_water_level_m").isNull()).count()
         for k in (24, None)]
    assert n[0] > n[1] == 0


def test_realtime_interpolates_every_listed_column(spark):
    t = dt.datetime(2024, 1, 10)
    rows = [("a", t + dt.timedelta(hours=h), None if h == 1 else float(h), "x") for h in range(3)]
    df = spark.createDataFrame(rows, "site_id string, ts timestamp_ntz, dew_point double, weather_main string")
    window, _ = pipeline.build_realtime_window(df, ["dew_point", "rain_1h"], t + dt.timedelta(hours=2), 3)
    got = [(r["dew_point"], r["rain_1h"]) for r in window.orderBy("ts").collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]


def _initial(df):
    """The plan before it adapts: one line per node."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("== Initial Plan =="):] if "== Initial Plan ==" in text else text


def test_sources_are_merged_in_four_exchanges(spark):
    """The merge shuffles the union once and a narrow summary once; the inputs' own shuffles come on top."""
    h = materialize(cs.obs(spark, SF), "checkpoint")
    g = h.select("site_id", "ts")
    sparse = h.select("site_id", "ts", F.col("rain_1h").alias("sat"))
    out = combine.combine_sources(g, [("attach", h, {}), ("upsert", h, {}), ("fill", h, {}),
                                      ("asof", sparse, {"value_cols": ["sat"]}), ("asof", sparse, {"value_cols": ["sat"], "tolerance_hours": None})], cs.SPEC)
    plan = _initial(out)
    assert plan.count("Exchange hashpartitioning") <= 4 and plan.count("REPARTITION_BY_COL") == 2
    assert _initial(QUERIES["combine_sources"](spark, SF)).count("Exchange hashpartitioning") <= 9


def test_drop_report_reads_history_once(spark):
    report, feats = QUERIES["drop_report"](spark, SF), QUERIES["features_full"](spark, SF)
    count = lambda df: _initial(df).count("Scan ")
    assert count(report) <= count(feats)


def test_observation_counts_with_the_job_itself(spark):
    from pyspark.sql import Observation

    from hydroseries.operators import features
    seen = Observation("drops")
    hist = cs.history(spark, SF)
    out = features.build_features(hist, cs.FEATURES_CFG, cs.SPEC, observation=seen)
    n = out.count()
    assert seen.get["rows_after"] == n and seen.get["rows_before"] == hist.count() > n
