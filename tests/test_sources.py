"""Sources and sinks: forecast JSON, CSV series, scaler storage."""

import datetime as dt
import json
import os

import pytest

from hydroseries.operators import timegrid
from hydroseries.operators.fill import impute_forecast
from hydroseries.sources import io

E0 = 1704067200  # 2024-01-01 00:00:00 UTC


def item(dt_s, temp, rain=None, weather=True):
    it = {"dt": dt_s, "main": {"temp": temp, "humidity": 80.0, "pressure": 1010.0},
          "wind": {"speed": 2.0, "deg": 90.0}, "clouds": {"all": 40.0},
          "weather": [{"main": "Rain", "description": "light rain"}] if weather else []}
    if rain is not None:
        it["rain"] = rain
    return it


@pytest.fixture(scope="module")
def forecast_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("forecast")
    docs = {
        "a.json": {"site_id": "a", "list": [item(E0, 30.0, {"1h": 1.5}), item(E0 + 3 * 3600, 33.0, {"3h": 6.0})]},
        "b.json": {"site_id": "b", "list": [item(E0, 25.0, None, weather=False)]},
        "c.json": {"site_id": "c", "list": []},
    }
    for name, doc in docs.items():
        (d / name).write_text(json.dumps(doc, indent=2))
    return str(d)


def test_read_forecast(spark, forecast_dir):
    rows = {(r["site_id"], r["ts"]): r for r in io.read_forecast(spark, forecast_dir).collect()}
    assert len(rows) == 3  # the empty list yields nothing
    a0 = rows[("a", dt.datetime(2024, 1, 1, 0))]
    assert (a0["rain_1h"], a0["rain_3h"], a0["weather_main"], a0["temperature"]) == (1.5, 0.0, "Rain", 30.0)
    a3 = rows[("a", dt.datetime(2024, 1, 1, 3))]
    assert (a3["rain_1h"], a3["rain_3h"]) == (0.0, 6.0)
    b0 = rows[("b", dt.datetime(2024, 1, 1, 0))]
    assert (b0["rain_1h"], b0["rain_3h"], b0["weather_main"], b0["weather_description"]) == (0.0, 0.0, None, None)


def test_forecast_extras(spark, forecast_dir):
    rows = io.read_forecast(spark, forecast_dir, extras=True).collect()
    assert {"temp_min", "temp_max", "dew_point", "visibility", "cloud_cover"} <= set(rows[0].asDict())
    assert all(r["cloud_cover"] == 40.0 and r["temp_min"] is None for r in rows)


def test_forecast_hourly_fill(spark, forecast_dir):
    flat = io.read_forecast(spark, forecast_dir).filter("site_id = 'a'")
    hourly = timegrid.densify(timegrid.resample_mean(flat, ["temperature", "rain_1h", "rain_3h"]))
    out = impute_forecast(hourly).orderBy("ts").collect()
    assert [r["temperature"] for r in out] == pytest.approx([30.0, 31.0, 32.0, 33.0])
    assert [r["rain_1h"] for r in out] == [1.5, 1.5, 1.5, 0.0]


def test_read_series_csv(spark, tmp_path):
    p = tmp_path / "base.csv"
    p.write_text("site_id,timestamp,temperature,humidity,pressure,wind_speed,rain_1h,sea_level_m,local_water_level_m\n"
                 "a,2024-01-01 07:00:00,30,80,1010,2,0,1.0,0.8\n"
                 "a,2024-01-01T08:00:00+07:00,31,81,1011,2,NaN,1.1,0.9\n")
    rows = io.read_series(spark, str(p)).orderBy("ts").collect()
    assert [r["ts"] for r in rows] == [dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 1)]
    assert rows[1]["rain_1h"] is None  # NaN becomes null at the source


def test_scaler_roundtrip_and_missing(spark, tmp_path):
    from hydroseries.operators.scaling import fit_minmax
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    sc = fit_minmax(df, ["a", "b"])
    io.save_scaler(sc, str(tmp_path / "scaler"))
    back = [tuple(r) for r in io.load_scaler(spark, str(tmp_path / "scaler")).collect()]
    assert back == [(0, "a", 1.0, 3.0), (1, "b", 2.0, 2.0)]
    with pytest.raises(FileNotFoundError):
        io.load_scaler(spark, str(tmp_path / "nope"))


def test_write_table_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 2), 2.0)],
                               "site_id string, date date, x double")
    io.write_table(df, str(tmp_path / "t"), partition_by=["date"])
    parts = sorted(n for n in os.listdir(tmp_path / "t") if n.startswith("date="))
    assert parts == ["date=2024-01-01", "date=2024-01-02"]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
