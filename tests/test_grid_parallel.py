"""The dense grid is made by many tasks, also under AQE."""

import datetime as dt

from pyspark.sql import functions as F

from hydroseries.operators import timegrid


def test_grid_is_spread_over_tasks(spark):
    spans = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("site_id"),
                                     F.lit(dt.datetime(2022, 1, 1)).cast("timestamp_ntz").alias("start"),
                                     F.lit(dt.datetime(2023, 12, 31, 23)).cast("timestamp_ntz").alias("end"))
    grid = timegrid.hourly_grid(spans)
    sizes = [r["count"] for r in grid.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 2000 * 730 * 24
    assert len(sizes) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
