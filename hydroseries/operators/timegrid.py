"""Hourly resampling, dense grids and reindexing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.config import SeriesSpec
from hydroseries.functions.time import floor_hour, from_hour_index, hour_index, local_hour

_SPEC = SeriesSpec()
CHUNK = "_chunk"  # same name as windows.CHUNK


def chunk_of(ts, chunk_hours: int) -> Column:
    return F.floor(hour_index(ts) / F.lit(chunk_hours)).cast("bigint")


def resample_mean(df: DataFrame, value_cols: Iterable[str], spec: SeriesSpec = _SPEC,
                  ts: str | None = None) -> DataFrame:
    """A1: hourly mean per series, bins labelled by their start.

    Only non-empty hours come out; ``reindex`` onto ``hourly_grid`` adds the
    empty ones.  The aggregate is partial (map side) + final.
    """
    ts = ts or spec.ts
    return (df.groupBy(*spec.keys, floor_hour(ts).alias(spec.ts))
              .agg(*[F.avg(c).alias(c) for c in value_cols]))


def resample(df: DataFrame, aggs: dict[str, Column], spec: SeriesSpec = _SPEC,
             ts: str | None = None) -> DataFrame:
    """A1 with arbitrary aggregate expressions per output column."""
    ts = ts or spec.ts
    return (df.groupBy(*spec.keys, floor_hour(ts).alias(spec.ts))
              .agg(*[e.alias(n) for n, e in aggs.items()]))


def resample_local(df: DataFrame, aggs: dict[str, Column], tz: str, spec: SeriesSpec = _SPEC,
                   ts: str | None = None) -> DataFrame:
    """A1 by the hours of zone ``tz``: bins are labelled by the instant (UTC) at which
    the local hour began (``functions.time.local_hour``)."""
    ts = ts or spec.ts
    return (df.groupBy(*spec.keys, local_hour(ts, tz).alias(spec.ts))
              .agg(*[e.alias(n) for n, e in aggs.items()]))


def local_hourly_grid(spans: DataFrame, tz: str, spec: SeriesSpec = _SPEC) -> DataFrame:
    """J1 by the hours of zone ``tz``: every local hour that begins in ``[start, end]``, as the instant of its
    beginning.  An hour that the clock skips does not occur, one that it repeats occurs twice.

    Zones lie off UTC by whole quarters of an hour, so the quarter hours of the UTC grid are
    tried, in parallel by (keys, chunk) like ``hourly_grid``."""
    s, e = hour_index("start"), hour_index("end")
    hours = hourly_grid(spans.select(*spec.keys, "start", "end"), spec, from_hour_index(s - 1), from_hour_index(e + 1), carry=["start", "end"])
    quarter = F.explode(F.array(*[F.lit(q) for q in range(4)]))
    tried = hours.withColumn("_q", quarter).withColumn(spec.ts, F.timestamp_seconds(F.unix_seconds(F.col(spec.ts).cast("timestamp")) + F.col("_q") * 900).cast("timestamp_ntz"))
    return (tried.filter((local_hour(spec.ts, tz) == F.col(spec.ts)) & F.col(spec.ts).between(F.col("start"), F.col("end")))
            .select(*spec.keys, spec.ts))


def series_spans(df: DataFrame, spec: SeriesSpec = _SPEC) -> DataFrame:
    """First and last hour of each series: ``keys, start, end``."""
    return df.groupBy(*spec.keys).agg(F.min(spec.ts).alias("start"), F.max(spec.ts).alias("end"))


def hourly_grid(spans: DataFrame, spec: SeriesSpec = _SPEC, start: str | Column = "start",
                end: str | Column = "end", keep_chunk: bool = False,
                carry: Sequence[str] = ()) -> DataFrame:
    """Every hour between ``start`` and ``end`` (inclusive, floored to the
    hour) for each row of ``spans`` (``keys`` plus the two bounds).

    Generated in two levels, chunks then hours, so no single row explodes into
    a whole history; the chunk rows are hash-partitioned on ``(keys, chunk)``
    first, so hours are generated in parallel and already sit where the
    chunked window operators want them.  ``carry`` columns of ``spans`` (per
    series constants) are copied onto every hour.
    """
    s = hour_index(F.col(start) if isinstance(start, str) else start)
    e = hour_index(F.col(end) if isinstance(end, str) else end)
    carry = list(carry)
    x = spans.select(*spec.keys, s.alias("_s"), e.alias("_e"), *carry).filter(F.col("_s") <= F.col("_e"))
    if spec.chunk_hours:
        n = F.lit(spec.chunk_hours)
        x = x.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_s") / n), F.floor(F.col("_e") / n))))
        # an explicit count: the chunk rows are tiny, and AQE would coalesce them into one task
        # before each becomes a chunk of hours
        n_parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        x = x.repartition(n_parts, *spec.keys, "_c")
        lo = F.greatest(F.col("_s"), F.col("_c") * n)
        hi = F.least(F.col("_e"), F.col("_c") * n + n - 1)
        x = x.select(*spec.keys, *carry, F.col("_c").alias(CHUNK), F.explode(F.sequence(lo, hi)).alias("_h"))
    else:
        x = x.select(*spec.keys, *carry, F.explode(F.sequence(F.col("_s"), F.col("_e"))).alias("_h"))
    out = x.select(*spec.keys, from_hour_index("_h").alias(spec.ts), *carry,
                   *([CHUNK] if CHUNK in x.columns else []))
    return out if keep_chunk else out.drop(CHUNK)


def reindex(grid: DataFrame, df: DataFrame, spec: SeriesSpec = _SPEC) -> DataFrame:
    """Put a series on the grid; empty hours become null rows and rows off
    the grid vanish."""
    return grid.join(df, [*spec.keys, spec.ts], "left")


def densify(df: DataFrame, spec: SeriesSpec = _SPEC, keep_chunk: bool = False,
            static: DataFrame | None = None) -> DataFrame:
    """J1 + J2 over each series' own first..last hour.

    With chunking on, the grid rows and the data rows (unique per series and
    hour) are unioned, shuffled ONCE on ``(keys, chunk)`` and merged per hour
    by an aggregate that this partitioning already satisfies.  With
    ``keep_chunk`` the ``_chunk`` column stays, and the fill passes
    (``windows.carry_both``) reuse the partitioning: grid, reindex and both
    carries then cost one shuffle of the hourly table instead of three.

    ``static``: per-series constants (e.g. the site table, P10), joined to the
    one-row-per-series spans and copied onto every hour by the grid generator,
    so the big table is never joined with it.
    """
    spans = series_spans(df, spec)
    st_cols = []
    if static is not None:
        st_cols = [c for c in static.columns if c not in spec.keys and c not in df.columns]
        spans = spans.join(static.select(*spec.keys, *st_cols), list(spec.keys), "left")
    if not spec.chunk_hours:
        return reindex(hourly_grid(spans, spec, carry=st_cols), df, spec)
    vals = [c for c in df.columns if c not in spec.keys and c != spec.ts]
    types = dict(df.dtypes)
    grid = hourly_grid(spans, spec, keep_chunk=True, carry=st_cols).select(
        *spec.keys, spec.ts, CHUNK, F.lit(1).alias("_g"), *[F.lit(None).cast(types[c]).alias(c) for c in vals],
        *st_cols)
    data = df.select(*spec.keys, spec.ts, chunk_of(spec.ts, spec.chunk_hours).alias(CHUNK), F.lit(0).alias("_g"),
                     *vals, *[F.lit(None).cast(t).alias(c) for c, t in grid.select(*st_cols).dtypes])
    u = grid.unionByName(data).repartition(*spec.keys, CHUNK)
    out = (u.groupBy(*spec.keys, CHUNK, spec.ts)
             .agg(F.max("_g").alias("_g"), *[F.max(c).alias(c) for c in vals + st_cols])
             .filter(F.col("_g") == 1)
             .select(*spec.keys, spec.ts, *vals, *st_cols, CHUNK))
    return out if keep_chunk else out.drop(CHUNK)


def time_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Inclusive ``[start, end]`` filter (pushed to the scan when possible)."""
    return df.filter(F.col(ts).between(F.lit(start), F.lit(end)))
