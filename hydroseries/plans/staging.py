"""Staging of the driver tables into the engine's data model.

The driver ships TPC-H-like tables, not sensor feeds.  These functions derive
the engine's inputs from them with ordinary Spark transformations, so every
query's work grows with the tables:

* ``obs``: the ``events`` table as hourly sensor series; ``site_id`` is the
  event type, the hour is ``date_trunc('hour', ts)`` (UTC), the level is the
  mean value / 40, rain the sum of ``max(value - 100, 0)`` / 10 and humidity the
  mean of the ``k`` field of ``props``.
* ``sites``: one row per site, joined to ``nation`` on
  ``n_nationkey = length(site_id)`` for a static elevation.
* sources for the merge operators: ``events`` split into two sensor feeds by
  reading time — minutes 0-29 and 30-59 of each hour (every row lands in
  exactly one feed, together they are the whole table).
* raster stand-ins: ``embeddings`` rows as pixels, ``label`` as the scene;
  QA bits and scene properties are computed from the embedding values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries import config as C
from hydroseries.config import SeriesSpec
from hydroseries.functions.time import floor_hour
from hydroseries.operators.timegrid import resample

SPEC = SeriesSpec()
OBS_COLS = ("local_water_level_m", "rain_1h", "humidity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_value(props: str = "props"):
    """The number under ``k`` of a JSON document, null if there is none."""
    return F.get_json_object(F.col(props), "$.k").try_cast("double")


def obs_aggs(value: str = "value", props: str = "props") -> dict:
    v = F.col(value)
    return {
        "local_water_level_m": F.avg(v) / F.lit(40.0),
        "rain_1h": F.sum(F.greatest(v - F.lit(100.0), F.lit(0.0))) / F.lit(10.0),
        "humidity": F.avg(k_value(props)),
    }


def events_as_series(events: DataFrame) -> DataFrame:
    """Raw events with the series key; one row per event."""
    return events.select(F.col("event_type").alias("site_id"), "ts", "value", "props", "user_id")


def obs(spark: SparkSession, sf_dir: str, sea: bool = False) -> DataFrame:
    """``sea`` adds a fourth sensor, ``sea_level_m``: the greatest value of the hour / 50."""
    ev = events_as_series(table(spark, sf_dir, "events"))
    more = {"sea_level_m": F.max("value") / F.lit(50.0)} if sea else {}
    return resample(ev, obs_aggs() | more, SPEC)


def obs_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings keyed more finely, by event type and user id modulo 40:
    many short series with gaps of more than a day."""
    ev = events_as_series(table(spark, sf_dir, "events"))
    key = F.concat_ws("-", "site_id", (F.col("user_id") % 40).cast("string"))
    return resample(ev.withColumn("site_id", key), obs_aggs(), SPEC)


def obs_from(events: DataFrame) -> DataFrame:
    return resample(events_as_series(events), obs_aggs(), SPEC)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("site_id")).distinct()
    nation = table(spark, sf_dir, "nation")
    return (ev.join(nation, F.length("site_id") == F.col("n_nationkey"), "inner")
              .select("site_id", F.col("n_name").alias("site_name"),
                      (F.col("n_regionkey") * F.lit(10.0) + F.col("n_nationkey") * F.lit(0.5)).alias("elevation_m"),
                      (F.col("n_nationkey") * F.lit(0.01)).alias("lon"),
                      (F.col("n_regionkey") * F.lit(0.01)).alias("lat")))


def _half(half: int):
    m = F.minute("ts")
    return m < 30 if half == 0 else m >= 30


def feed(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    """Hourly series of one of the two sensor feeds (readings in the first or
    the second half of each hour)."""
    return resample(raw_feed(spark, sf_dir, half), obs_aggs(), SPEC)


def raw_feed(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    return events_as_series(table(spark, sf_dir, "events")).filter(_half(half))


__all__ = ["SPEC", "OBS_COLS", "table", "obs", "obs_from", "sites", "feed", "raw_feed",
           "events_as_series", "obs_aggs", "floor_hour"]


# --- raster stand-ins from ``embeddings`` -----------------------------------

def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding row is a pixel of scene ``label``: green = element 0,
    nir = element 1, lon / lat = elements 2 / 3 (degrees), VV = element 4; the
    QA60 cloud bit (1024) is set where element 5 exceeds 0.15 and the cirrus
    bit (2048) where element 6 does.  Rainfall is element 9 where it is not negative,
    soil moisture the absolute value of element 10."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pixel_id"), F.col("label").alias("scene_id"),
        e[2].cast("double").alias("lon"), e[3].cast("double").alias("lat"),
        e[0].cast("double").alias("B3"), e[1].cast("double").alias("B8"), e[4].cast("double").alias("VV"),
        (F.when(e[5] > 0.15, 1024).otherwise(0) + F.when(e[6] > 0.15, 2048).otherwise(0)).cast("int").alias("QA60"),
        e[7].cast("double").alias("_pol"), e[8].cast("double").alias("_mode"),
        F.when(e[9] >= 0, e[9].cast("double")).alias(C.RAINFALL_BAND), F.abs(e[10].cast("double")).alias(C.SOIL_MOISTURE_BAND))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene properties aggregated from its pixels: acquisition time 36 h per
    scene number, cloud percentage = share of pixels with a QA cloud or cirrus
    bit, VV in the polarisation list when the mean of element 7 is positive,
    mode EW when the mean of element 8 exceeds 0.01 (else IW)."""
    px = pixels(spark, sf_dir)
    s = F.col("scene_id")
    return px.groupBy("scene_id").agg(
        (F.avg(F.when((F.col("QA60").bitwiseAND(3072)) != 0, 1.0).otherwise(0.0)) * 100.0).alias("cloud_pct"),
        F.avg("_pol").alias("_pol"), F.avg("_mode").alias("_mode")).select(
        s,
        F.timestamp_seconds(F.lit(1704067200) + s * F.lit(36 * 3600)).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("_pol") > 0, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("VH")))
         .alias("polarisations"),
        F.when(F.col("_mode") > 0.01, F.lit("EW")).otherwise(F.lit("IW")).alias("instrument_mode"),
        "cloud_pct")
