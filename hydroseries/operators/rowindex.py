"""Positions of rows in one global order, without sorting the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.session import materialize

_BITS = 33  # monotonically_increasing_id: partition above, row in the partition below


def row_index(df: DataFrame, by: list[str | Column], name: str = "row_index") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of ``by`` (nulls first); rows equal in all of ``by``
    stand in any one order of their own.

    The rows are range-partitioned and sorted, ties being dealt by a row id so
    that no number of equal rows lands in one partition; a row's position is
    its place in its partition plus the rows of the partitions before.  The
    sorted rows are checkpointed, since the places must not change between the
    two reads; what the second read sees in one task is one row per partition."""
    place = F.col("_place")
    sorted_ = (df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*by, "_tie").drop("_tie")
               .withColumn("_place", F.monotonically_increasing_id()))
    kept = materialize(sorted_).withColumn("_part", F.shiftrightunsigned(place, _BITS))
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # one row per partition of the sorted table: bounded by the number of partitions
    return (kept.join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + place.bitwiseAND(F.lit(2 ** _BITS - 1)))
            .drop("_part", "_place", "_start"))
