"""A pixel store that scene and place filters can prune.

Pixels are partitioned by the date of their scene and sorted by a Z-order key of
their position inside a date, so that a scene filter skips folders by dynamic
partition pruning and a place filter skips row groups by their least and greatest lon and lat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.operators.raster import DATE

CELL = "_cell"
BITS = 16  # per axis


def z_order(lon: Column, lat: Column) -> Column:
    """Bits of the quantised longitude and latitude, interleaved (null for a null position, which sorts first)."""
    span = 2 ** BITS
    q = lambda x, low, width: F.least(F.greatest(F.floor((x - low) / width * span), F.lit(0)), F.lit(span - 1)).cast("long")
    east, north = q(lon, -180.0, 360.0), q(lat, -90.0, 180.0)

    def spread(v):  # a free bit after every bit, by the usual halving shifts
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v
    known = lon.isNotNull() & lat.isNotNull()
    return F.when(known, spread(east).bitwiseOR(F.shiftleft(spread(north), 1)))


def write_pixels(pixels: DataFrame, scenes: DataFrame, path: str, rows_per_group: int | None = None) -> None:
    """Store ``pixels`` under the dates of their scenes (pixels without a scene are left out).

    A date is dealt over several tasks by ranges of (date, cell), so a date with
    many pixels is not one task's work and files still cover compact areas."""
    dated = pixels.join(scenes.select("scene_id", F.to_date("ts").alias(DATE)), "scene_id")
    placed = dated.withColumn(CELL, z_order(F.col("lon"), F.col("lat")))
    w = placed.repartitionByRange(DATE, CELL).sortWithinPartitions(DATE, CELL).write.mode("overwrite")
    if rows_per_group:
        w = w.option("parquet.block.row.count.limit", rows_per_group)
    w.partitionBy(DATE).parquet(path)


def read_pixels(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The stored pixels, with ``_date`` (the raster operators join scenes on it too, which prunes folders);
    ``box`` (west, south, east, north) is a filter that skips row groups."""
    px = spark.read.parquet(path).drop(CELL)
    if box is not None:
        west, south, east, north = box
        px = px.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    return px
