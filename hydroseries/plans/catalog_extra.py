"""Driver queries for the documented extras (D4, D5), the drop report (A8),
the realtime window (J1+J7+P5+F1+P1+A6) and source/sink round trips (S1, S4,
S7), each with its oracle SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from hydroseries.operators import features, score, split
from hydroseries.plans import pipeline
from hydroseries.plans import sqlkit as S
from hydroseries.plans import staging
from hydroseries.plans.catalog_series import (BASE, COLS, DI, SPEC, _combine_sources, features_full_sql,
                                              history, imputed, obs)
from hydroseries.plans.registry import finish, register
from hydroseries.session import scratch_path
from hydroseries.sources import io

AS_OF = dt.datetime(2024, 1, 30, 12, 0, 0)
_MSG = ("CASE WHEN count(*) < 25 THEN 'Not enough real-time data in window. Need at least 25 hours, got ' "
        "|| CAST(count(*) AS VARCHAR) || '.' END AS message")
WIN = 30

# --- D4, D5 -----------------------------------------------------------------

register("rolling_avg_humidity_6h", DI + S.final(
    ["humidity", "humidity_avg_6h"], BASE,
    f"(SELECT site_id, ts, humidity, avg(humidity) OVER ({S.W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) "
    "AS humidity_avg_6h FROM imputed)"))(
    lambda spark, d: finish(features.rolling(imputed(spark, d), ["humidity"], [6], "avg", SPEC)
                            .select(*BASE, "humidity", "humidity_avg_6h")))


def _flood_flag(spark, d):
    cs = _combine_sources(spark, d)
    return features.flood_flag(cs, "local_water_level_m", "rain_1h", "satellite_soil_moisture").select(
        *BASE, "is_flood")


_CS_SQL = None  # filled below from the combine_sources oracle


def _register_flood_flag():
    from hydroseries.plans.registry import ORACLE
    cs = ORACLE["combine_sources"]
    sql = ("SELECT site_id, ts, CAST(coalesce(local_water_level_m > 1.5, false) OR coalesce(rain_1h >= 20.0, false) "
           "OR coalesce(satellite_soil_moisture >= 0.45, false) AS INTEGER) AS is_flood FROM (" + cs + ")")
    register("flood_flag", sql)(_flood_flag)


_register_flood_flag()


# --- A8 ---------------------------------------------------------------------

def _drop_report(spark, d):
    from hydroseries.plans.catalog_series import FEATURES_CFG
    h = history(spark, d)
    feats = features.build_features(h, FEATURES_CFG, SPEC, sites=staging.sites(spark, d), drop=False)
    return features.drop_report(feats, require_target=FEATURES_CFG.require_target)


register("drop_report", DI + (
    "SELECT b.site_id, b.rows_before, coalesce(a.rows_after, 0) AS rows_after, "
    "b.rows_before - coalesce(a.rows_after, 0) AS rows_dropped FROM "
    "(SELECT site_id, count(*) AS rows_before FROM imputed GROUP BY 1) b LEFT JOIN "
    "(SELECT site_id, count(*) AS rows_after FROM (" + features_full_sql() + ") GROUP BY 1) a "
    "ON a.site_id = b.site_id"))(_drop_report)


# --- realtime window --------------------------------------------------------

_START = AS_OF - dt.timedelta(hours=WIN - 1)
_RT = (f"recent AS (SELECT * FROM obs WHERE ts BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{AS_OF}'), "
       f"rgrid AS (SELECT site_id, unnest(generate_series(TIMESTAMP '{_START}', TIMESTAMP '{AS_OF}', "
       "INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT site_id FROM recent)), "
       "rdense AS (SELECT g.site_id, g.ts, r.local_water_level_m, r.rain_1h, r.humidity FROM rgrid g "
       "LEFT JOIN recent r ON g.site_id = r.site_id AND g.ts = r.ts)")

def _known(spark, d):
    """Known sites: those with readings, and the nations, which have none in the window."""
    ev = staging.table(spark, d, "events").select(F.col("event_type").alias("site_id"))
    return ev.union(staging.table(spark, d, "nation").select("n_name")).distinct()


def _recent(spark, d):
    raw = staging.events_as_series(staging.table(spark, d, "events"))
    return pipeline.recent_hourly(raw, staging.obs_aggs(), AS_OF, WIN, SPEC)


register("realtime_window", S.with_(S.OBS, _RT, S.imputed_cte("rimp", "rdense")) + S.final(COLS, BASE, "rimp"))(
    lambda spark, d: finish(pipeline.build_realtime_window(_recent(spark, d), COLS, AS_OF, WIN, SPEC)[0]
                            .select(*BASE, *COLS)))

register("realtime_sufficiency", S.with_(S.OBS, _RT) + (
    "SELECT s.site_id, count(r.ts) AS n_rows, CAST(25 AS BIGINT) AS needed, count(r.ts) >= 25 AS sufficient, "
    + _MSG.replace("count(*)", "count(r.ts)") + " FROM (SELECT DISTINCT event_type AS site_id FROM events UNION SELECT n_name FROM nation) s "
    "LEFT JOIN recent r ON r.site_id = s.site_id GROUP BY 1"))(
    lambda spark, d: pipeline.build_realtime_window(_recent(spark, d), COLS, AS_OF, WIN, SPEC, sites=_known(spark, d))[1])


# --- S1 + S4, S7 round trips ------------------------------------------------

def _csv_roundtrip(spark, d):
    """Write the hourly table as a CSV history (local wall-clock text, as the
    reference stores it), read it back with the declared schema."""
    path = scratch_path(spark, f"history-csv-{uuid.uuid4().hex[:12]}")
    o = obs(spark, d)
    text = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Bangkok"), F.col("ts")), "yyyy-MM-dd HH:mm:ss")
    out = o.select("site_id", text.alias("timestamp"),
                   *[(F.col(c) if c in o.columns else F.lit(None).cast("double")).alias(c)
                     for c in io.SERIES_SCHEMA.fieldNames()[2:]])
    io.write_table(out, path, fmt="csv")
    back = io.read_series(spark, path, tz="Asia/Bangkok")
    return finish(back.select(*BASE, *COLS))


register("history_csv_roundtrip", S.with_(S.OBS) + S.final(COLS, BASE, "obs"))(_csv_roundtrip)


def _predictions_roundtrip(spark, d):
    path = scratch_path(spark, f"predictions-{uuid.uuid4().hex[:12]}")
    latest = split.latest(obs(spark, d), SPEC).select(*BASE, F.col("local_water_level_m").alias("predicted_water_level_m"))
    preds = score.interpret_level(latest, "predicted_water_level_m", 1.5, AS_OF)
    io.write_predictions(preds, path, "json", mode="overwrite")
    return finish(spark.read.schema(preds.schema).json(path))


register("predictions_json_roundtrip", S.with_(S.OBS, "last AS (SELECT * FROM obs QUALIFY row_number() OVER "
                                                      "(PARTITION BY site_id ORDER BY ts DESC) = 1)") + S.final(
    ["predicted_water_level_m", "flood_threshold_m"],
    BASE + ["threshold_exceeded", "message", "model_type", "prediction_time_utc", "prediction_time_local"],
    "(SELECT site_id, ts, local_water_level_m AS predicted_water_level_m, CAST(1.5 AS DOUBLE) AS flood_threshold_m, "
    "local_water_level_m > 1.5 AS threshold_exceeded, CASE WHEN local_water_level_m > 1.5 THEN "
    "'High water level predicted for next hour.' ELSE 'Normal water level predicted for next hour.' END AS message, "
    f"'regression' AS model_type, TIMESTAMP '{AS_OF}' AS prediction_time_utc, "
    f"TIMESTAMP '{AS_OF}' + INTERVAL 7 HOUR AS prediction_time_local FROM last)"))(_predictions_roundtrip)
