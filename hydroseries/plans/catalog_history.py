"""Driver query for the history build from end to end (E-1): CSV base, forecast
documents, level feed and two sparse satellite sources, imputed, written
partitioned by date and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hydroseries.operators import scaling, timegrid
from hydroseries.plans import pipeline
from hydroseries.plans import sqlkit as S
from hydroseries.plans import staging
from hydroseries.plans.catalog_model import _FC_SQL, forecast_docs
from hydroseries.plans.catalog_series import _SAT_SQL, _SOIL_SQL, BASE, SPEC, _sat_rain, _soil
from hydroseries.plans.registry import finish, register
from hydroseries.session import scratch_path
from hydroseries.sources import io

SERIES = ["temperature", "humidity", "pressure", "wind_speed", "rain_1h", "local_water_level_m",
          "satellite_rainfall_mm_hr", "satellite_soil_moisture", "dew_point"]
FORECAST = ["temperature", "humidity", "pressure"]


def _build_history_full(spark, d):
    base = scratch_path(spark, f"history-{uuid.uuid4().hex[:12]}")
    first = staging.feed(spark, d, 0)
    text = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Bangkok"), F.col("ts")), "yyyy-MM-dd HH:mm:ss")
    io.write_table(first.select("site_id", text.alias("timestamp"),
                                *[(F.col(c) if c in first.columns else F.lit(None).cast("double")).alias(c)
                                  for c in io.SERIES_SCHEMA.fieldNames()[2:]]), f"{base}/base", fmt="csv")
    hourly = scaling.ensure_columns(io.read_series(spark, f"{base}/base"), SERIES)
    hourly = hourly.select(*BASE, *[c for c in SERIES if not c.startswith("satellite")])
    forecast = timegrid.resample_mean(io.parse_forecast(forecast_docs(spark, d), "doc"), FORECAST, SPEC)
    level = staging.feed(spark, d, 1).select(*BASE, "local_water_level_m")
    out = pipeline.build_history(hourly, SERIES, SPEC, sources=[
        ("upsert", forecast, {}),
        ("fill", level, {}),
        ("asof", _sat_rain(spark, d), {"value_cols": ["satellite_rainfall_mm_hr"], "tolerance_hours": 24}),
        ("asof", _soil(spark, d), {"value_cols": ["satellite_soil_moisture"], "tolerance_hours": 24}),
    ])
    io.write_table(out.withColumn("date", F.to_date("ts")), f"{base}/history", partition_by=["date"])
    return finish(spark.read.parquet(f"{base}/history").select(*BASE, *SERIES))


_CONT = [c for c in SERIES if c not in ("wind_speed", "dew_point")]
_ZERO_END = ("rain_1h", "satellite_rainfall_mm_hr")

register("build_history_full", S.with_(
    S.FEED0, S.FEED1, _FC_SQL, _SAT_SQL, _SOIL_SQL,
    "fh AS (SELECT site_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, "
    + ", ".join(f"avg({c}) AS {c}" for c in FORECAST) + " FROM fc GROUP BY 1, 2)",
    "sp AS (SELECT site_id, min(ts) AS s, max(ts) AS e FROM feed0 GROUP BY 1)",
    "g AS (SELECT site_id, unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS ts FROM sp)",
    "merged AS (SELECT g.site_id, g.ts, fh.temperature, coalesce(fh.humidity, f0.humidity) AS humidity, fh.pressure, f0.rain_1h, "
    "coalesce(f0.local_water_level_m, f1.local_water_level_m) AS local_water_level_m, "
    "sat.v AS satellite_rainfall_mm_hr, soil.v AS satellite_soil_moisture FROM g "
    "LEFT JOIN feed0 f0 ON g.site_id = f0.site_id AND g.ts = f0.ts LEFT JOIN fh ON g.site_id = fh.site_id AND g.ts = fh.ts "
    "LEFT JOIN feed1 f1 ON g.site_id = f1.site_id AND g.ts = f1.ts LEFT JOIN sat ON g.site_id = sat.site_id AND g.ts = sat.ts "
    "LEFT JOIN soil ON g.site_id = soil.site_id AND g.ts = soil.ts)",
    "nb AS (SELECT *, " + ", ".join(S.neighbours(c) for c in _CONT) + " FROM merged)")
    + S.final(SERIES, BASE, "(SELECT site_id, ts, " + ", ".join(
        f"{S.impute_expr(c, True, '0.0' if c in _ZERO_END else None)} AS {c}" for c in _CONT)
        + ", CAST(NULL AS DOUBLE) AS wind_speed, CAST(0.0 AS DOUBLE) AS dew_point FROM nb)"))(_build_history_full)
