"""Small golden cases (FIXTURES.md section 2)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import column, series
from hydroseries.config import FeatureConfig, SeriesSpec
from hydroseries.functions.time import lunar_phase
from hydroseries.operators import combine, features, fill, scaling, score, split, stats

SPEC = SeriesSpec()
UNCHUNKED = SeriesSpec(chunk_hours=None)


@pytest.fixture(scope="module")
def three(spark):
    return series(spark, {"col1": [1, 2, None, 4, 5], "col2": [None, 20, 30, None, 50],
                          "col3": [100, 110, 120, 130, 140]})


@pytest.mark.parametrize("spec", [SPEC, UNCHUNKED])
def test_ffill(three, spec):
    out = fill.fill_missing(three, "ffill", spec=spec)
    assert column(out, "col1") == [1, 2, 2, 4, 5]
    assert column(out, "col2") == [None, 20, 30, 30, 50]
    assert column(out, "col3") == [100, 110, 120, 130, 140]


def test_mean_fill_one_column(three):
    out = fill.fill_missing(three, "mean", ["col2"])
    got = column(out, "col2")
    assert got[0] == pytest.approx(100 / 3) and got[3] == pytest.approx(100 / 3)
    assert got[1:3] == [20, 30] and got[4] == 50
    assert column(out, "col1")[2] is None


def test_unknown_strategy_and_column(three):
    assert fill.fill_missing(three, "zero", ["nope"]).count() == 5
    with pytest.warns(UserWarning, match="unknown fill strategy"):
        assert fill.fill_missing(three, "mode", ["col1"]).collect() == three.collect()
    with pytest.raises(ValueError):
        fill.fill_missing(three, "mode", ["col1"], strict=True)


def test_text_columns_are_not_imputed(three):
    df = three.withColumn("weather_main", F.lit("Rain"))
    out = fill.impute_series(df, ["col1", "weather_main"])
    assert {r["weather_main"] for r in out.collect()} == {"Rain"}


@pytest.mark.parametrize("buckets", [1, 4, 256])
def test_iqr(spark, buckets):
    vals = [1, 2, 3, 4, 5, 100, 6, 7, 8, 9, 10]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, v double")
    out = stats.iqr_outliers(df, "v", 1.5, buckets=buckets).orderBy("i").collect()
    assert out[0]["q1"] == pytest.approx(3.5) and out[0]["q3"] == pytest.approx(8.5)
    assert out[0]["lower"] == pytest.approx(-4) and out[0]["upper"] == pytest.approx(16)
    assert [r["v"] for r in out if r["is_outlier"]] == [100.0]


def test_lunar_phase(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 10, 28, 11),), (dt.datetime(2000, 1, 6, 12),)],
                               "ts timestamp_ntz")
    got = [r[0] for r in df.select(lunar_phase("ts")).collect()]
    assert got[0] == pytest.approx(3.783321, abs=1e-6)
    assert got[1] == pytest.approx(0.0, abs=1e-12)


def test_upsert(spark):
    base = series(spark, {"x": [1, None, 3]})
    src = series(spark, {"x": [9, 8, None]})
    assert column(combine.upsert(base, src), "x") == [9, 8, 3]
    assert column(combine.fill_from(base, src), "x") == [1, 8, 3]


@pytest.mark.parametrize("spec", [SPEC, UNCHUNKED])
def test_exceedance_label(spark, spec):
    df = series(spark, {"local_water_level_m": [1.0, 2.0, None]})
    out = features.label_level(df, threshold=1.5, horizon=1, spec=spec)
    assert column(out, "water_level_next_1h") == [2.0, None, None]
    assert column(out, "is_flood_next_1h") == [1, 0, 0]


@pytest.mark.parametrize("spec", [SPEC, UNCHUNKED])
def test_rolling_sum_and_std(spark, spec):
    df = series(spark, {"x": [1, 2, 3, 4]})
    assert column(features.rolling(df, ["x"], [3], "sum", spec), "x_sum_3h") == [None, 1, 3, 6]
    std = column(features.rolling(df, ["x"], [3], "std", spec), "x_std_3h")
    assert std[:2] == [None, None]
    assert std[2] == pytest.approx(0.707107, abs=1e-6) and std[3] == pytest.approx(1.0)


def test_minmax_constant(spark):
    df = series(spark, {"c": [5, 5], "v": [1, 3]})
    sc = scaling.fit_minmax(df, ["c", "v"])
    out = scaling.apply_minmax(df, sc, keep=["ts"])
    assert column(out, "c") == [0.0, 0.0]
    assert column(out, "v") == [0.0, 1.0]
    assert [tuple(r) for r in sc.orderBy("ordinal").collect()] == [(0, "c", 5.0, 5.0), (1, "v", 1.0, 3.0)]


def test_align_absent(spark):
    df = series(spark, {"a": [None]})
    out = scaling.align_columns(df, ["a", "b"]).collect()[0]
    assert (out["a"], out["b"]) == (0.0, 0.0)


def test_all_null_imputation(spark):
    df = series(spark, {"rain_1h": [None, None], "humidity": [None, None]})
    out = fill.impute_series(df, ["rain_1h", "humidity"])
    assert column(out, "rain_1h") == [0.0, 0.0]
    assert column(out, "humidity") == [None, None]


def test_certainty(spark):
    df = spark.createDataFrame([(0.8,), (0.3,)], "p double")
    out = score.interpret_class(df, "p", 0.5).orderBy(F.desc("p")).collect()
    assert out[0]["certainty"] == pytest.approx(0.8) and out[0]["predicted_is_flood"]
    assert out[1]["certainty"] == pytest.approx(0.7) and not out[1]["predicted_is_flood"]


def test_sufficiency(spark):
    assert FeatureConfig().history_rows_needed == 25
    df = series(spark, {"x": list(range(24))})
    r = split.require_history(df, 25, 30).collect()[0]
    assert (r["n_rows"], r["needed"], r["sufficient"]) == (24, 25, False)
    df = series(spark, {"x": list(range(25))})
    assert split.require_history(df, 25, 30).collect()[0]["sufficient"]


def test_clip_floor(spark):
    df = series(spark, {"x": [-1.0, 0.01, 0.5, None]})
    assert column(features.clip_floor(df, "x", 0.05, "max"), "x") == [0.05, 0.05, 0.5, None]
    assert column(features.clip_floor(df, "x", 0.05, "negative"), "x") == [0.05, 0.01, 0.5, None]


def test_missing_lag_feature_is_an_error(spark):
    df = series(spark, {"local_water_level_m": [1.0] * 30})
    with pytest.raises(ValueError):
        features.build_features(df, FeatureConfig())
    lenient = FeatureConfig(strict_columns=False)
    assert features.build_features(df, lenient).count() == 0  # parity: empty table
