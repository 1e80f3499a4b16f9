"""Driver queries for Structured Streaming (T1, T2): the ``events`` table is
read as a file stream, run to completion with ``availableNow`` into scratch
sinks under the session's checkpoint folder, and the sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroseries.plans import sqlkit as S
from hydroseries.plans import staging
from hydroseries.plans.registry import finish, register
from hydroseries.streaming import hourly as H

_SEALED = ("m AS (SELECT max(ts) AS mx FROM events), "
           "sealed AS (SELECT obs.* FROM obs, m WHERE obs.ts + INTERVAL 1 HOUR <= m.mx - INTERVAL 5 HOUR)")


def _events_stream(spark, d):
    src = f"{d}/events*.parquet"  # a file stream source needs a directory or a glob
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(src)


def stream_hourly(spark, d):
    base = H.scratch(spark, "hourly")
    out = H.hourly_stream(_events_stream(spark, d), staging.obs_aggs(), F.col("event_type"))
    H.run_available_now(out, f"{base}/sink", f"{base}/checkpoint")
    return finish(spark.read.parquet(f"{base}/sink"))


register("stream_hourly", S.with_(S.OBS, _SEALED) + S.final(list(staging.OBS_COLS), ["site_id", "ts"], "sealed"))(
    stream_hourly)


def stream_score(spark, d):
    path = H.stream_score(spark, _events_stream(spark, d), staging.obs_aggs(), F.col("event_type"),
                          list(staging.OBS_COLS), window_hours=30)
    return finish(spark.read.schema(H.PREDICTION_SCHEMA).parquet(path).drop("batch_id"))


_HOURS = ("hours AS (SELECT *, max(ts) OVER (PARTITION BY site_id) AS newest FROM sealed), "
          "last AS (SELECT site_id, ts, local_water_level_m AS level, "
          "(SELECT count(*) FROM hours h WHERE h.site_id = hours.site_id AND h.ts > h.newest - INTERVAL 30 HOUR) AS n "
          "FROM hours WHERE ts = newest)")

register("stream_score", S.with_(S.OBS, _SEALED, _HOURS) + S.final(
    ["predicted_water_level_m", "flood_threshold_m"], ["site_id", "ts", "threshold_exceeded", "message", "model_type", "error"],
    "(SELECT site_id, ts, level AS predicted_water_level_m, CAST(1.5 AS DOUBLE) AS flood_threshold_m, "
    "level > 1.5 AS threshold_exceeded, CASE WHEN level > 1.5 THEN "
    "'High water level predicted for next hour.' ELSE 'Normal water level predicted for next hour.' END AS message, "
    "'regression' AS model_type, CAST(NULL AS VARCHAR) AS error FROM last WHERE n >= 25 UNION ALL "
    "SELECT site_id, ts, NULL, NULL, NULL, NULL, NULL, 'Not enough real-time data in window. Need at least 25 hours, got ' "
    "|| CAST(n AS VARCHAR) || '.' FROM last WHERE n < 25)"))(stream_score)


def stream_hourly_stateful(spark, d):
    base = H.scratch(spark, "hourly-state")
    out = H.hourly_stream_stateful(_events_stream(spark, d), F.col("event_type"))
    H.run_available_now(out, f"{base}/sink", f"{base}/checkpoint")
    return finish(spark.read.parquet(f"{base}/sink"))


register("stream_hourly_stateful", S.with_(S.OBS, _SEALED) + S.final(list(staging.OBS_COLS), ["site_id", "ts"],
                                                                     "sealed"))(stream_hourly_stateful)


def stream_last_hours(spark, d):
    base = H.scratch(spark, "last-hours")
    hourly = H.hourly_stream(_events_stream(spark, d), staging.obs_aggs(), F.col("event_type"))
    H.run_available_now(hourly, f"{base}/hourly", f"{base}/hourly-checkpoint")
    table = spark.readStream.schema(spark.read.parquet(f"{base}/hourly").schema).parquet(f"{base}/hourly")
    H.run_available_now(H.last_hours_stream(table, 30), f"{base}/sink", f"{base}/checkpoint")
    return finish(spark.read.parquet(f"{base}/sink"))


_LAST30 = "OVER (PARTITION BY site_id ORDER BY ts RANGE BETWEEN INTERVAL 29 HOUR PRECEDING AND CURRENT ROW)"

register("stream_last_hours", S.with_(S.OBS, _SEALED) + S.final(
    ["level_mean", "rain_sum"], ["site_id", "ts", "n_hours"],
    f"(SELECT site_id, ts, count(*) {_LAST30} AS n_hours, avg(local_water_level_m) {_LAST30} AS level_mean, "
    f"sum(rain_1h) {_LAST30} AS rain_sum FROM sealed)"))(stream_last_hours)
