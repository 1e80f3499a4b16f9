"""Driver contract, pipeline compositions, learning and streaming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from hydroseries.config import FeatureConfig, TrainConfig
from hydroseries.operators import learn
from hydroseries.plans import pipeline, staging
from hydroseries.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"site_id", "ts", "is_flood_next_1h", "water_level_next_1h", "lunar_phase"} <= set(df.columns)
    assert df.columns == E.entry(spark).columns


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60
    own = {n for n in qs if n in QUERIES}
    assert own - set(sql) <= {"train_score_class", "train_score_level"}


@pytest.mark.parametrize("name", ["features_full", "combine_sources", "water_extent", "roc_auc", "stream_hourly"])
def test_queries_run_small(spark, name):
    assert E.queries()[name](spark, SMALL).count() > 0


def test_realtime_score_all_sites(spark, tmp_path):
    cols = list(staging.OBS_COLS)
    hourly = staging.obs(spark, SMALL)
    hist = pipeline.build_history(hourly, cols)
    cfg = FeatureConfig(lag_features=("rain_1h", "local_water_level_m"))
    feats = pipeline.feature_table(hist, cfg, sites=staging.sites(spark, SMALL))
    res = learn.train_and_evaluate(feats, "classification", TrainConfig(max_iter=5, max_depth=3), learner="gbt")
    assert res.metrics["accuracy"].collect()[0]["n"] > 0
    path = learn.save_model(res.model, str(tmp_path / "m"), "classification")
    again = learn.load_model(str(tmp_path / "m"), "classification")
    a = res.scored_test.orderBy("site_id", "ts").select("prediction_score").collect()
    b = learn.score(res.scored_test.drop("prediction_score"), again, "classification") \
        .orderBy("site_id", "ts").select("prediction_score").collect()
    assert a == b and path.endswith("classification")
    as_of = dt.datetime(2024, 1, 30, 12)
    window, report = pipeline.build_realtime_window(hourly, cols, as_of, 30)
    assert window.groupBy("site_id").count().agg(F.min("count")).collect()[0][0] == 30
    assert {"n_rows", "needed", "sufficient"} <= set(report.columns)
    preds = pipeline.score_latest(window, again, "classification", res.scaler, res.features, cfg, as_of)
    out = preds.collect()
    assert len(out) == window.select("site_id").distinct().count()
    assert all(r["ts"] == as_of for r in out) and all(0.0 <= r["prediction_score"] <= 1.0 for r in out)


def test_stateful_stream_equals_windowed_stream(spark):
    qs = E.queries()
    a = qs["stream_hourly"](spark, SMALL)
    b = qs["stream_hourly_stateful"](spark, SMALL)
    key = ["site_id", "ts"]
    pa = a.orderBy(*key).toPandas()
    pb = b.select(*a.columns).orderBy(*key).toPandas()
    assert len(pa) > 0
    import pandas as pd
    pd.testing.assert_frame_equal(pa, pb, check_exact=False, rtol=1e-9)


def test_preprocess_modes(spark):
    cols = list(staging.OBS_COLS)
    hist = pipeline.build_history(staging.obs(spark, SMALL), cols)
    cfg = FeatureConfig(lag_features=("rain_1h", "local_water_level_m"))
    x, scaler, order = pipeline.preprocess(hist, "train", cfg)
    assert "is_flood_next_1h" in x.columns and len(order) == scaler.count()
    mins = x.agg(*[F.min(c).alias(c) for c in order[:5]]).collect()[0]
    assert all(v == 0.0 for v in mins)
    y, _, _ = pipeline.preprocess(hist.drop("humidity"), "predict", cfg, scaler=scaler, order=order)
    assert y.columns[-len(order):] == order
    with pytest.raises(ValueError):
        pipeline.preprocess(hist, "predict", cfg)


def test_report_has_dead_sites(spark):
    rows = [("live", dt.datetime(2024, 1, 2, h), 1.0) for h in range(24)] + [("dead", dt.datetime(2023, 1, 1), 1.0)]
    hourly = spark.createDataFrame(rows, "site_id string, ts timestamp_ntz, local_water_level_m double")
    _, report = pipeline.build_realtime_window(hourly, ["local_water_level_m"], dt.datetime(2024, 1, 2, 23), 30, rows_needed=20)
    got = {r["site_id"]: (r["n_rows"], r["sufficient"]) for r in report.collect()}
    assert got == {"live": (24, True), "dead": (0, False)}


def test_k_value_is_the_json_value(spark):
    df = spark.createDataFrame([('{"k": 69}',), ('{"k": -3.5}',), ('{"k":7}',), ('{"k": "12"}',), ("junk",), (None,), ('{"k": 007}',)],
                               "props string")
    got = [r[0] for r in df.select(staging.k_value("props")).collect()]
    want = [r[0] for r in df.select(F.get_json_object("props", "$.k").try_cast("double")).collect()]
    assert got == want == [69.0, -3.5, 7.0, 12.0, None, None, None]


def test_normalize_time(spark):
    from hydroseries.functions.time import normalize_time
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 7),)], "ts timestamp_ntz")
    assert normalize_time(df, "Asia/Bangkok").collect()[0][0] == dt.datetime(2024, 1, 1, 0)


def test_state_function_is_shipped_by_value():
    """Executors must not need this package: the pandas state function is
    pickled by value (checked end-to-end by running the driver from /tmp)."""
    from pyspark import cloudpickle
    from hydroseries.streaming import hourly
    hourly.hourly_stream_stateful  # registration happens when the stream is built
    import pickle
    cloudpickle.register_pickle_by_value(hourly)
    blob = cloudpickle.dumps(hourly._hourly_state_fn)
    plain = pickle.dumps(staging.k_value)
    assert len(blob) > 10 * len(plain)  # the code itself, not a name to import
    assert callable(pickle.loads(blob))
