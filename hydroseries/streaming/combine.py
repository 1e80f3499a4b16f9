"""Hourly merge of several live sources (T2's input; J3-J5 on streams).

Each feed is aggregated per (site, sealed hour); the hours that any feed has are
the left side, and every feed's aggregate is joined to it by a stream-stream
left outer join on (site, hour).  All streams carry a watermark, so the state
of an hour is dropped once it is sealed, and an hour that a feed lacks comes out
with nulls for that feed.  An hour is sealed when its end is not after the
smallest of the feeds' newest times less the lateness allowance: a feed
that stands still holds the others back, late readings of it are not lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feed:
    """A stream of raw readings: ``aggs`` are its hourly columns, ``how`` their
    precedence over the feeds before it (``upsert``: over them; ``fill``, ``attach``: under them)."""
    stream: DataFrame
    aggs: dict[str, Column]
    key: Column
    how: str = "attach"
    ts: str = "ts"


def combined_hourly_stream(feeds: Sequence[Feed], late: str = "5 hours") -> DataFrame:
    """``site_id, ts`` and the merged columns, one row per site and sealed hour of any feed (append mode)."""
    for f in feeds:
        if f.how not in ("upsert", "fill", "attach"):
            raise ValueError(f"unknown merge {f.how!r}")
    hour = F.window("_t", "1 hour").alias("_w")
    timed = [f.stream.withColumn("_t", F.col(f.ts).cast("timestamp")).withColumn("_site", f.key) for f in feeds]
    times = timed[0].select("_site", "_t")
    for t in timed[1:]:
        times = times.union(t.select("_site", "_t"))
    # the global watermark is the least of all streams' ones, whatever this one says
    out = times.withWatermark("_t", late).groupBy(hour, F.col("_site").alias("site_id")).agg(F.count(F.lit(1)).alias("_n"))
    for i, (f, t) in enumerate(zip(feeds, timed)):
        one = t.withWatermark("_t", late).groupBy(hour, F.col("_site").alias("site_id")).agg(
            *[e.alias(f"_f{i}_{n}") for n, e in f.aggs.items()])
        out = out.join(one, ["_w", "site_id"], "left")
    merged: dict[str, Column] = {}
    for i, f in enumerate(feeds):
        for n in f.aggs:
            v = F.col(f"_f{i}_{n}")
            merged[n] = v if n not in merged else F.coalesce(v, merged[n]) if f.how == "upsert" else F.coalesce(merged[n], v)
    return out.select("site_id", F.col("_w.start").cast("timestamp_ntz").alias("ts"), *[v.alias(n) for n, v in merged.items()])
