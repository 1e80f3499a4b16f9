"""The hourly table of the scoring stream: few folders listed, compaction; windows of the last hours as state."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from hydroseries.config import FeatureConfig, SeriesSpec
from hydroseries.streaming import hourly as H

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "site_id string, ts timestamp_ntz, local_water_level_m double, rain_1h double"


def test_compaction_keeps_every_hour_once(spark, tmp_path):
    path = str(tmp_path / "hours")
    for batch in range(4):
        rows = [("a", T0 + dt.timedelta(hours=12 * batch + h), float(h), 0.0) for h in range(12)]
        (spark.createDataFrame(rows, SCHEMA).withColumns({"date": F.to_date("ts"), "batch_id": F.lit(batch).cast("long")})
         .write.mode("append").partitionBy("date", "batch_id").parquet(path))
    read = lambda: sorted(map(tuple, H.read_hours(spark, path, T0, T0 + dt.timedelta(days=5)).collect()))
    before = read()
    assert len(before) == 48
    assert H.compact_hours(spark, path, T0, T0 + dt.timedelta(hours=5)) == 1
    assert read() == before
    batches = spark.read.parquet(path).groupBy("date").agg(F.collect_set("batch_id").alias("b")).orderBy("date").collect()
    assert batches[0]["b"] == [-1] and sorted(batches[1]["b"]) == [2, 3]
    assert H.compact_hours(spark, path, T0 - dt.timedelta(days=3), T0 - dt.timedelta(days=2)) == 0
    one = H.read_hours(spark, path, T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=1))
    assert one.inputFiles() and all("date=2024-03-02" in f for f in one.inputFiles())  # the other date is not listed


def test_last_hours_by_running_sums_and_dead_sites(spark, tmp_path):
    r = random.Random(3)
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = [("a", T0 + dt.timedelta(hours=h), None if r.random() < 0.2 else r.random(), r.random()) for h in range(60) if r.random() < 0.8]
    dead = [("dead", T0 + dt.timedelta(hours=h), 1.0, 1.0) for h in range(3)]
    later = [("a", T0 + dt.timedelta(hours=200 + h), 1.0, 1.0) for h in range(3)], [("a", T0 + dt.timedelta(hours=300), 1.0, 1.0)]
    for part in (rows[:20] + dead, rows[20:], *later):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        H.run_available_now(H.last_hours_stream(spark.readStream.schema(SCHEMA).parquet(src), 6), out, ck)
    got = {(x["site_id"], x["ts"]): x for x in spark.read.parquet(out).collect()}
    every = rows + dead + later[0] + later[1]
    assert len(got) == len(every)
    for s, t, _, _ in every:
        w = [x for x in every if x[0] == s and t - dt.timedelta(hours=6) < x[1] <= t]
        levels = [x[2] for x in w if x[2] is not None]
        g = got[s, t]
        assert g["n_hours"] == len(w) and abs(g["rain_sum"] - sum(x[3] for x in w)) < 1e-9
        assert (g["level_mean"] is None) == (not levels) and (not levels or abs(g["level_mean"] - sum(levels) / len(levels)) < 1e-9)
    state = spark.read.format("statestore").load(ck)
    assert {x[0] for x in state.select("key.site_id").collect()} == {"a"}  # the dead site left no state


def test_batch_is_written_in_few_files_and_not_cached(spark, monkeypatch):
    """What a batch sends to the driver follows its dates and sites, not these times its tasks."""
    rows = [(s, T0 + dt.timedelta(hours=h), 1.0 + h % 3, 0.0, 5.0) for s in "ab" for h in range(96)]
    df = spark.createDataFrame(rows, "site_id string, ts timestamp_ntz, local_water_level_m double, rain_1h double, humidity double").repartition(16)
    base = H.scratch(spark, "few-files")
    cfg = FeatureConfig(lag_features=("rain_1h", "local_water_level_m"), require_target=False)
    fn = H.scoring_batch(spark, f"{base}/hourly", f"{base}/predictions", ["local_water_level_m", "rain_1h", "humidity"], 30, cfg, SeriesSpec(), H.persistence_scorer())
    monkeypatch.setattr(type(df), "persist", lambda *a, **k: pytest.fail("the plan of the stream is cached"))
    fn(df, 0)
    fn(df.limit(0), 1)
    hourly = spark.read.parquet(f"{base}/hourly")
    assert hourly.count() == len(rows) and len(hourly.inputFiles()) == 4
    got = spark.read.schema(H.PREDICTION_SCHEMA).parquet(f"{base}/predictions").orderBy("site_id").collect()
    assert [(r["site_id"], r["ts"], r["predicted_water_level_m"]) for r in got] == [(s, T0 + dt.timedelta(hours=95), 3.0) for s in "ab"]
    left = os.path.join(H.checkpoint_dir(spark), "tables").removeprefix("file:")
    assert not [f for f in os.listdir(left) if f.startswith("batch-")]


def test_partitions_of_state_are_bounded(spark):
    name = "spark.sql.shuffle.partitions"
    kept = spark.conf.get(name)
    try:
        spark.conf.set(name, "500")
        with H.state_partitions(spark):
            assert spark.conf.get(name) == "64"
        assert spark.conf.get(name) == "500"
        spark.conf.set(name, "8")
        with H.state_partitions(spark):
            assert spark.conf.get(name) == "8"
    finally:
        spark.conf.set(name, kept)
