"""As-of join of two tables at irregular times (J6 without a grid).

Cost follows the rows of both sides, not the hours they span: both sides are
unioned, shuffled once on (keys, time chunk), ordered by time inside a chunk, and
the last right row is carried; what a chunk starts with comes from a table of
one row per chunk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, values: Sequence[str],
              right_on: str | None = None, tolerance_seconds: float | None = None, exact: bool = True,
              chunk_seconds: int = 7 * 86_400, matched_on: str | None = None) -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` of the same
    keys whose time is not after the left row's (``exact=False``: before it), null
    where there is none or it is older than ``tolerance_seconds``.

    Of right rows of one time the one with the greatest ``values`` (in their
    order, nulls first) counts.  Left rows may repeat; a null time or key matches nothing.
    ``matched_on`` adds the time of the right row.  A chunk is what one task sorts of one
    key: choose ``chunk_seconds`` by the densest key.
    """
    right_on = right_on or on
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    k = [f"_k{i}" for i in range(len(keys))]
    key = [F.col(c).alias(n) for c, n in zip(keys, k)]
    own = [c for c in left.columns]
    taken = F.struct(micros(right_on).alias("t"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)],
                     F.col(right_on).alias("at")).alias("_r")
    known = F.col(right_on).isNotNull()
    for c in keys:
        known &= F.col(c).isNotNull()
    here = right.filter(known).select(*key, micros(right_on).alias("_t"), taken)
    rows = left.select(*key, micros(on).alias("_t"), F.struct(*own).alias("_l"))
    # at one time, right rows stand before left rows where equal times match, else after them
    side = lambda df, n: df.withColumn("_side", F.lit(n))
    both = side(here, 0 if exact else 2).unionByName(side(rows, 1), allowMissingColumns=True)
    both = both.withColumn("_c", F.floor(F.col("_t") / F.lit(chunk_seconds * 1_000_000)))
    part = Window.partitionBy(*k, "_c").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.select(*k, "_c", "_t", "_side", "_l", F.last("_r", True).over(part).alias("_near")).filter("_side = 1")
    # one row per (key, chunk) of either side: the greatest right row in it, carried over later chunks
    chunks = both.groupBy(*k, "_c").agg(F.max("_r").alias("_m"))
    before = Window.partitionBy(*k).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*k, "_c", F.last("_m", True).over(before).alias("_far"))
    joined = near.join(carried, [*k, "_c"], "left").withColumn("_r", F.coalesce("_near", "_far"))
    ok = F.col("_r").isNotNull()
    if tolerance_seconds is not None:
        ok &= F.col("_t") - F.col("_r.t") <= F.lit(int(tolerance_seconds * 1_000_000))
    out = {c: F.when(ok, F.col(f"_r.v{i}")) for i, c in enumerate(values)}
    if matched_on:
        out[matched_on] = F.when(ok, F.col("_r.at"))
    clash = set(out) & set(own)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}; rename them first")
    return joined.select(*[F.col(f"_l.`{c}`") for c in own], *[v.alias(c) for c, v in out.items()])
