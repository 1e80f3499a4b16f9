"""Merging sources onto the hourly grid.

Every source shares the key ``(keys, ts)``.  A single source is a left join on
it; several are merged by one shuffle of their union (``combine_sources``).
Column-level precedence is a ``coalesce`` in the wanted order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.config import SeriesSpec
from hydroseries.functions.time import floor_hour, hour_index
from hydroseries.operators.timegrid import chunk_of
from hydroseries.operators.windows import CHUNK, carry_both

_SPEC = SeriesSpec()


def _values(df: DataFrame, spec: SeriesSpec) -> list[str]:
    return [c for c in df.columns if c not in spec.keys and c != spec.ts]


def attach(df: DataFrame, src: DataFrame, spec: SeriesSpec = _SPEC,
           prefer: str = "base") -> DataFrame:
    """Left join of a source's columns on time.  Columns that exist on
    both sides are merged: ``prefer='base'`` keeps the base value where it is
    not null (J5), ``prefer='source'`` lets the source overwrite (J4)."""
    key = [*spec.keys, spec.ts]
    shared = [c for c in _values(src, spec) if c in df.columns]
    s = src.select(*key, *[F.col(c).alias(f"_src_{c}") if c in shared else F.col(c)
                           for c in _values(src, spec)])
    x = df.join(s, key, "left")
    merged = {}
    for c in shared:
        b, o = F.col(c), F.col(f"_src_{c}")
        merged[c] = F.coalesce(o, b) if prefer == "source" else F.coalesce(b, o)
    return x.withColumns(merged).drop(*[f"_src_{c}" for c in shared])


def upsert(df: DataFrame, src: DataFrame, spec: SeriesSpec = _SPEC) -> DataFrame:
    """Non-null source values overwrite, other rows keep the base value,
    new columns are added (pandas ``update`` then a fill from the suffixed
    join): ``coalesce(source, base)``."""
    return attach(df, src, spec, prefer="source")


def fill_from(df: DataFrame, src: DataFrame, spec: SeriesSpec = _SPEC,
              cols: Iterable[str] | None = None) -> DataFrame:
    """Take the source where the base is null: ``coalesce(base, source)``."""
    if cols is not None:
        src = src.select(*spec.keys, spec.ts, *cols)
    return attach(df, src, spec, prefer="base")


def asof_attach(df: DataFrame, sparse: DataFrame, value_cols: Sequence[str],
                spec: SeriesSpec = _SPEC, tolerance_hours: int | None = 24,
                ts: str | None = None) -> DataFrame:
    """Hourly mean of a sparse source, carried forward at most
    ``tolerance_hours`` (None: without limit) up to the source's own last hour,
    and attached to the rows of ``df`` (full hours, unique per series)."""
    return combine_sources(df, [("asof", sparse, {"value_cols": list(value_cols), "tolerance_hours": tolerance_hours, "ts": ts})], spec)


def combine_sources(grid: DataFrame, sources: Sequence[tuple[str, DataFrame, dict]],
                    spec: SeriesSpec = _SPEC, keep_chunk: bool = False) -> DataFrame:
    """Merge sources onto the grid in order.  Each source is
    ``(how, df, options)`` with ``how`` in ``upsert``, ``fill`` (option
    ``cols``), ``attach``, ``asof`` (options: ``value_cols``, ``tolerance_hours``, ``ts``).

    The grid and all sources are unioned, every source under its own columns,
    shuffled once on ``(keys, chunk)`` and brought together by one aggregate per
    hour; precedence is then a ``coalesce`` in source order.  The sparse
    sources' values, the times of these values and the sources' ends are
    carried in one pass over the rows that exist (no grid of the source is
    made); a value older than the tolerance, or past its source's last hour,
    is not attached.  Grid rows and the rows of the other sources are unique
    per series and hour; several rows of one hour merge by their greatest values.
    """
    grid_cols = [c for c in _values(grid, spec) if c != CHUNK]
    frames = [grid.select(*spec.keys, spec.ts, F.lit(True).alias("_on"), *[F.col(c).alias(f"_g_{c}") for c in grid_cols])]
    aggs = {c: F.max for c in ["_on", *[f"_g_{c}" for c in grid_cols]]}
    merges, sparse, forward, backward = [], [], {}, {}
    for i, (how, src, opt) in enumerate(sources):
        if how not in ("upsert", "fill", "attach", "asof"):
            raise ValueError(f"unknown merge {how!r}")
        asof = how == "asof"
        cols = list(opt["value_cols"] if asof else (opt.get("cols") if how == "fill" else None) or _values(src, spec))
        at = floor_hour(opt.get("ts") or spec.ts) if asof else F.col(spec.ts)
        here = [F.lit(True).alias(f"_h{i}")] if asof else []
        frame = src.select(*spec.keys, at.alias(spec.ts), *here, *[F.col(c).alias(f"_s{i}_{c}") for c in cols])
        frames.append(frame.filter(F.col(spec.ts).isNotNull()))
        aggs |= {f"_s{i}_{c}": F.avg if asof else F.max for c in cols}
        value = {c: F.col(f"_s{i}_{c}") for c in cols}
        if asof:
            sparse.append(frames[-1])
            aggs[f"_h{i}"] = F.max
            backward[f"_e{i}"] = F.when(F.col(f"_h{i}"), F.col(spec.ts))
            limit = opt.get("tolerance_hours", 24)
            for c in cols:
                forward[f"_c{i}_{c}"] = F.col(f"_s{i}_{c}")
                forward[f"_t{i}_{c}"] = F.when(F.col(f"_s{i}_{c}").isNotNull(), F.col(spec.ts))
                near = F.col(f"_e{i}").isNotNull()
                if limit is not None:
                    near &= hour_index(spec.ts) - hour_index(f"_t{i}_{c}") <= limit
                value[c] = F.when(near, F.col(f"_c{i}_{c}"))
        merges.append((how, value))
    per_hour = _per_hour(frames, aggs, spec)
    if forward:
        # the chunk summaries need the sparse sources only; past a source's ends nothing of it is attached
        some = {x for f in sparse for x in f.columns}
        summary = _per_hour(sparse, {n: a for n, a in aggs.items() if n in some}, spec)
        per_hour = carry_both(per_hour, spec, forward, backward, summary)
    values = {c: F.col(f"_g_{c}") for c in grid_cols}
    for how, value in merges:
        for c, v in value.items():
            values[c] = v if c not in values else F.coalesce(v, values[c]) if how == "upsert" else F.coalesce(values[c], v)
    keep = [CHUNK] if keep_chunk and spec.chunk_hours else []
    return per_hour.filter("_on").select(*spec.keys, spec.ts, *[v.alias(c) for c, v in values.items()], *keep)


def _per_hour(frames: list[DataFrame], aggs: dict, spec: SeriesSpec) -> DataFrame:
    """One row per series and hour of all frames, hash-partitioned on (keys, chunk)."""
    aggs = [fn(c).alias(c) for c, fn in aggs.items()]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    if not spec.chunk_hours:
        return rows.groupBy(*spec.keys, spec.ts).agg(*aggs)
    rows = rows.withColumn(CHUNK, chunk_of(spec.ts, spec.chunk_hours)).repartition(*spec.keys, CHUNK)
    return rows.groupBy(*spec.keys, CHUNK, spec.ts).agg(*aggs)
