"""Guards at scoring and empty-split rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hydroseries.config import FeatureConfig, TrainConfig
from hydroseries.operators import learn
from hydroseries.plans import pipeline
from hydroseries.plans.catalog import QUERIES
from hydroseries.streaming import hourly as H

SF = "/root/testdata/sf0.01"
SCHEMA = "site_id string, ts timestamp_ntz, water_level_next_1h double, is_flood_next_1h int, x double"


def _feats(spark, n):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=i), float(i % 5), int(i % 5 > 2), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n, cfg, text", [
    (0, TrainConfig(), "feature table is empty"),
    (1, TrainConfig(), "training split"),           # the only row is the test row
    (20, TrainConfig(validation_ratio=0.0), "validation split"),
])
def test_empty_splits_stop(spark, n, cfg, text):
    with pytest.raises(ValueError, match=text):
        learn.train_and_evaluate(_feats(spark, n), "regression", cfg, learner="linear")


@pytest.mark.parametrize("model_type", ["classification", "regression"])
def test_empty_test_skips_evaluation(spark, model_type):
    res = learn.train_and_evaluate(_feats(spark, 30), model_type, TrainConfig(test_ratio=0.0, max_iter=3), learner="linear")
    assert res.metrics == {} and res.scored_test.count() == 0


def test_preprocess_needs_rows(spark):
    empty = spark.createDataFrame([], "site_id string, ts timestamp_ntz, rain_1h double, local_water_level_m double")
    cfg = FeatureConfig(lag_features=("rain_1h", "local_water_level_m"))
    with pytest.raises(ValueError, match="empty"):
        pipeline.preprocess(empty, "train", cfg)
    short = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h), 0.0, 1.0) for h in range(5)], empty.schema)
    with pytest.raises(ValueError, match="complete features"):
        pipeline.preprocess(short, "train", cfg)


def test_score_guard_has_both_kinds(spark):
    rows = QUERIES["score_guard"](spark, SF).collect()
    scored = [r for r in rows if r["error"] is None]
    assert scored and len(scored) < len(rows)
    assert all(r["predicted_water_level_m"] is not None for r in scored)
    assert {r["error"].split("got ")[1] for r in rows if r["error"]} > {"0."}  # dead sites and short ones


def test_short_site_is_an_error_row_in_the_stream(spark):
    t = dt.datetime(2024, 1, 10)
    rows = [("full", t + dt.timedelta(hours=h), 1.0, 0.0, 5.0) for h in range(30)] + [("short", t + dt.timedelta(hours=29), 9.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "site_id string, ts timestamp_ntz, local_water_level_m double, rain_1h double, humidity double")
    base = H.scratch(spark, "guard")
    cfg = FeatureConfig(lag_features=("rain_1h", "local_water_level_m"), require_target=False)
    fn = H.scoring_batch(spark, f"{base}/hourly", f"{base}/predictions", ["local_water_level_m", "rain_1h", "humidity"], 30, cfg,
                         pipeline.SeriesSpec(), H.persistence_scorer())
    for _ in range(2):  # a retried batch replaces its own output
        fn(df, 0)
    got = {r["site_id"]: r for r in spark.read.schema(H.PREDICTION_SCHEMA).parquet(f"{base}/predictions").collect()}
    assert spark.read.parquet(f"{base}/predictions").agg(F.count("*")).first()[0] == 2
    assert got["full"]["predicted_water_level_m"] == 1.0 and got["full"]["error"] is None
    assert got["short"]["predicted_water_level_m"] is None and "got 1." in got["short"]["error"]
