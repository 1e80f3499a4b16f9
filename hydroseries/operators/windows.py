"""Chunked window passes over keyed hourly series.

A window partitioned by site alone puts a whole series in one task; a site
that holds a third of all rows would then be sorted by one core.  Every window
operator of the engine therefore runs over ``(keys, chunk)`` partitions, where
``chunk`` is a fixed, epoch-aligned block of ``SeriesSpec.chunk_hours`` hours:

* bounded frames (lags, leads, rolling frames, limited fills) run on the chunk
  plus a *halo*: the last ``before`` rows of the previous chunk and the first
  ``after`` rows of the next one are copied in by one ``explode`` and dropped
  after the window (no join, one shuffle);
* unbounded fills run inside the chunk, then the last (or first) non-null value
  of each chunk is carried across chunks through a small per-chunk table whose
  size is ``rows / chunk_hours``, and joined back on ``(keys, chunk)`` — the
  big side is already partitioned on that key, so it is not shuffled again.

Row frames equal hours only on a dense grid, so callers reindex first.

On a dense grid a site has one row per hour, so the chunk table of a site has
``history_hours / chunk_hours`` rows (about 330 for a century at the default
2,688 h) however much raw data fed it: the cross-chunk window is small by
construction.  Skew in the raw input (one site with a third of all events) is
absorbed before that by the hourly partial aggregate keyed on (site, hour).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroseries.config import SeriesSpec
from hydroseries.functions.time import hour_index

CHUNK = "_chunk"
PART = "_part"
OWN = "_own"


def chunk_id(spec: SeriesSpec) -> Column:
    return F.floor(hour_index(spec.ts) / F.lit(spec.chunk_hours)).cast("bigint")


def with_chunk(df: DataFrame, spec: SeriesSpec) -> tuple[DataFrame, bool]:
    """Add the chunk column unless the input already carries it (then its
    partitioning, e.g. from ``timegrid.densify(keep_chunk=True)``, is reused)."""
    if CHUNK in df.columns:
        return df, True
    return df.withColumn(CHUNK, chunk_id(spec)), False


def bounded(df: DataFrame, spec: SeriesSpec, before: int, after: int,
            build: Callable[[DataFrame, Window], DataFrame]) -> DataFrame:
    """Run ``build(df, w)`` with ``w`` ordered by time over each series.

    ``build`` may use row frames reaching at most ``before`` rows back and
    ``after`` rows ahead; it must keep all input columns (``select('*', ...)``).

    If the input still carries ``_chunk`` (hash-partitioned on ``(keys,
    chunk)`` by ``timegrid.densify(keep_chunk=True)``), only the halo copies
    (about ``(before + after) / chunk_hours`` of the rows) are shuffled; the
    own rows keep their partitioning through the union, so the table itself
    is not shuffled again.
    """
    if not spec.chunk_hours:
        return build(df, Window.partitionBy(*spec.keys).orderBy(spec.ts))
    n = spec.chunk_hours
    if before >= n or after >= n:
        raise ValueError(f"frame ({before}, {after}) must be shorter than chunk_hours={n}")
    h = hour_index(spec.ts)
    pos = h - F.floor(h / F.lit(n)) * F.lit(n)
    if CHUNK in df.columns:
        # Own rows: the chunk column is renamed (not copied), so the existing
        # hash partitioning is exactly (keys, _part) and survives the union.
        own = df.withColumnRenamed(CHUNK, PART).withColumn("_is_own", F.lit(True))
        copies = []
        if before > 0:
            copies.append(F.when(pos >= n - before, F.col(CHUNK) + 1))
        if after > 0:
            copies.append(F.when(pos < after, F.col(CHUNK) - 1))
        x = own
        if copies:
            arr = F.array_compact(F.array(*copies))
            halo = (df.filter(F.size(arr) > 0).withColumn(PART, F.explode(arr)).drop(CHUNK)
                      .withColumn("_is_own", F.lit(False)).repartition(*spec.keys, PART))
            x = own.unionByName(halo)
        out = build(x, Window.partitionBy(*spec.keys, PART).orderBy(spec.ts))
        return out.filter(F.col("_is_own")).drop("_is_own").withColumnRenamed(PART, CHUNK)
    own = F.floor(h / F.lit(n)).cast("bigint")
    x = df.withColumn(OWN, own)
    parts = [F.col(OWN)]
    if before > 0:
        parts.append(F.when(pos >= n - before, F.col(OWN) + 1))
    if after > 0:
        parts.append(F.when(pos < after, F.col(OWN) - 1))
    if len(parts) == 1:
        x = x.withColumn(PART, F.col(OWN))
    else:
        x = x.withColumn(PART, F.explode(F.array_compact(F.array(*parts))))
    w = Window.partitionBy(*spec.keys, PART).orderBy(spec.ts)
    out = build(x, w)
    return out.filter(F.col(PART) == F.col(OWN)).drop(PART, OWN)


def carry(df: DataFrame, spec: SeriesSpec, values: dict[str, Column],
          direction: str = "forward") -> DataFrame:
    """Add ``values[name]`` carried over nulls along each series.

    ``forward``: the last non-null value at or before the row (unbounded
    forward fill); ``backward``: the first non-null value at or after it.
    Carry a value's time as a second column with the same null pattern (both
    come from the same row); scalar columns keep the chunk summary a hash
    aggregate.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(direction)
    if direction == "forward":
        return carry_both(df, spec, values, {})
    return carry_both(df, spec, {}, values)


def carry_both(df: DataFrame, spec: SeriesSpec, forward: dict[str, Column],
               backward: dict[str, Column], summary_rows: DataFrame | None = None) -> DataFrame:
    """Forward and backward carries in ONE pass: one exchange on
    ``(keys, chunk)``, an ascending and a descending sort inside it, one
    partial aggregate for the per-chunk summary, a window over the small
    chunk table, and one join back on ``(keys, chunk)``.

    The input is read twice (window and summary); callers that feed an
    expensive plan should materialize it first (``session.materialize``), or give
    ``summary_rows``: a smaller table that holds every row whose values are not all
    null.  Rows in chunks before its first or after its last one get nothing carried.
    """
    names = [("f", n, e) for n, e in forward.items()] + [("b", n, e) for n, e in backward.items()]
    if not names:
        return df
    tmp = {(d, n): f"_cv_{i}" for i, (d, n, _) in enumerate(names)}
    x = df.withColumns({tmp[(d, n)]: e for d, n, e in names})
    asc = (Window.unboundedPreceding, Window.currentRow)
    if not spec.chunk_hours:
        wf = Window.partitionBy(*spec.keys).orderBy(F.col(spec.ts).asc()).rowsBetween(*asc)
        wb = Window.partitionBy(*spec.keys).orderBy(F.col(spec.ts).desc()).rowsBetween(*asc)
        return (x.withColumns({n: F.last(tmp[(d, n)], True).over(wf if d == "f" else wb) for d, n, _ in names})
                 .drop(*tmp.values()))
    x, had_chunk = with_chunk(x, spec)
    wf = Window.partitionBy(*spec.keys, CHUNK).orderBy(F.col(spec.ts).asc()).rowsBetween(*asc)
    wb = Window.partitionBy(*spec.keys, CHUNK).orderBy(F.col(spec.ts).desc()).rowsBetween(*asc)
    loc = {k: f"_cl_{i}" for i, k in enumerate(tmp)}
    local = x.withColumns({loc[(d, n)]: F.last(tmp[(d, n)], True).over(wf if d == "f" else wb)
                           for d, n, _ in names})
    # Per chunk: last (forward) / first (backward) non-null value.  max_by /
    # min_by on scalar columns keep this a hash aggregate (no sort).
    if summary_rows is not None:
        x = with_chunk(summary_rows.withColumns({tmp[(d, n)]: e for d, n, e in names}), spec)[0]
    summary = x.groupBy(*spec.keys, CHUNK).agg(*[
        (F.max_by if d == "f" else F.min_by)(
            F.col(tmp[(d, n)]), F.when(F.col(tmp[(d, n)]).isNotNull(), F.col(spec.ts))).alias(tmp[(d, n)])
        for d, n, _ in names])
    if summary_rows is not None:  # chunks between those with values get empty rows, to take what is carried over them
        following = F.lead(CHUNK).over(Window.partitionBy(*spec.keys).orderBy(CHUNK))
        gap = (summary.withColumn("_next", following)
               .withColumn("_gap", F.explode(F.sequence(CHUNK, F.coalesce(F.col("_next") - 1, F.col(CHUNK))))))
        summary = gap.select(*spec.keys, F.col("_gap").alias(CHUNK), *[F.when(F.col("_gap") == F.col(CHUNK), F.col(c)).alias(c) for c in tmp.values()])
    cf = Window.partitionBy(*spec.keys).orderBy(F.col(CHUNK).asc()).rowsBetween(Window.unboundedPreceding, -1)
    cb = Window.partitionBy(*spec.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    cc = {k: f"_cc_{i}" for i, k in enumerate(tmp)}
    carried = summary.select(*spec.keys, CHUNK, *[
        F.last(F.col(tmp[(d, n)]), True).over(cf if d == "f" else cb).alias(cc[(d, n)])
        for d, n, _ in names])
    out = local.join(carried, [*spec.keys, CHUNK], "left")
    out = (out.withColumns({n: F.coalesce(F.col(loc[(d, n)]), F.col(cc[(d, n)])) for d, n, _ in names})
              .drop(*tmp.values(), *loc.values(), *cc.values()))
    return out if had_chunk else out.drop(CHUNK)
