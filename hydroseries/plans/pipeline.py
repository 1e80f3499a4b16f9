"""Entry-level compositions: history build, feature table, realtime window
and scoring of the newest hour for ALL sites in one job.

    hourly -> (checkpoint) -> dense grid -> merge sources -> impute -> features
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries import config as C
from hydroseries.config import FeatureConfig, SeriesSpec
from hydroseries.operators import combine, features, fill, learn, scaling, score, split, stats, timegrid
from hydroseries.session import materialize

_SPEC = SeriesSpec()


def build_history(hourly: DataFrame, cols: Sequence[str], spec: SeriesSpec = _SPEC,
                  sources: Sequence[tuple[str, DataFrame, dict]] = (), start=None, end=None,
                  cut: str | None = "checkpoint", static: DataFrame | None = None,
                  keep_chunk: bool = False, policy: Mapping[str, tuple[str, float | None]] | None = None) -> DataFrame:
    """``build_history``: base hourly table on a dense grid per site (each
    site's own first..last hour, or ``[start, end]``), merged with the sources
    in order, imputed by the column policy (by name, or as ``policy`` says).  ``static`` per-site columns
    (e.g. elevation) ride on the grid, not on a join with the big table.
    ``keep_chunk`` keeps the (site, chunk) partitioning column, so a following
    ``feature_table`` shuffles only its halo rows.

    The hourly table is read several times (grid bounds, join, both fill
    passes), so it is cut once (``cut``) to avoid rescanning the raw input.
    """
    hourly = materialize(hourly, cut)
    observed = None
    if start is not None and end is not None:
        spans = hourly.select(*spec.keys).distinct().withColumns(
            {"start": F.lit(start).cast("timestamp_ntz"), "end": F.lit(end).cast("timestamp_ntz")})
        hourly = timegrid.time_range(hourly, start, end, spec.ts)
        carry = []
        if static is not None:
            carry = [c for c in static.columns if c not in spec.keys and c not in hourly.columns]
            spans = spans.join(static.select(*spec.keys, *carry), list(spec.keys), "left")
        grid = timegrid.reindex(timegrid.hourly_grid(spans, spec, carry=carry), hourly, spec)
    else:
        # One shuffle on (site, chunk) for grid + reindex + both fill passes
        # when no source joins come in between.
        grid = timegrid.densify(hourly, spec, keep_chunk=not sources, static=static)
        observed = hourly if not sources else None
    merged = combine.combine_sources(grid, list(sources), spec) if sources else grid
    st = set(static.columns) if static is not None else set()
    present = [c for c in merged.columns
               if c not in spec.keys and c not in (spec.ts, timegrid.CHUNK) and c not in st]
    out = fill.impute_series(merged, [c for c in present if c in cols or not cols], spec, policy, observed)
    return out if keep_chunk else out.drop(timegrid.CHUNK)


def feature_table(history: DataFrame, cfg: FeatureConfig = FeatureConfig(), spec: SeriesSpec = _SPEC,
                  sites: DataFrame | None = None) -> DataFrame:
    """M3 over a history table."""
    return features.build_features(history, cfg, spec, sites)


def window_bounds(as_of: dt.datetime, window_hours: int) -> tuple[dt.datetime, dt.datetime]:
    """First and last hour of the realtime window ending at ``as_of``."""
    end = dt.datetime(as_of.year, as_of.month, as_of.day, as_of.hour)
    return end - dt.timedelta(hours=window_hours - 1), end


def recent_hourly(raw: DataFrame, aggs: dict, as_of: dt.datetime, window_hours: int,
                  spec: SeriesSpec = _SPEC, ts: str | None = None) -> DataFrame:
    """Hourly table of the realtime window from RAW readings: the time range is
    applied to the raw timestamp first, so it reaches the parquet scan as a
    pushed filter (row groups outside the window are skipped) instead of
    filtering after aggregating all history."""
    start, end = window_bounds(as_of, window_hours)
    t = F.col(ts or spec.ts)
    raw = raw.filter((t >= F.lit(start)) & (t < F.lit(end + dt.timedelta(hours=1))))
    return timegrid.resample(raw, aggs, spec, ts=ts)


def build_realtime_window(hourly: DataFrame, cols: Sequence[str], as_of: dt.datetime, window_hours: int,
                          spec: SeriesSpec = _SPEC, rows_needed: int = FeatureConfig().history_rows_needed,
                          sites: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``build_realtime_window``: the last ``window_hours`` hours up to
    ``as_of`` (floored to the hour) for every site, on a dense grid, absent
    columns added as null, imputed; plus the sufficiency report (Z4).

    The report has a row for every known site, with 0 rows for one that is
    absent from the window: the keys of ``sites``, or else of all of ``hourly``
    (give ``sites`` if ``hourly`` is already cut to the window)."""
    start, end = window_bounds(as_of, window_hours)
    recent = timegrid.time_range(hourly, start, end, spec.ts)
    recent = scaling.ensure_columns(recent, cols)
    # here every listed column is interpolated and carried, whatever its name
    policy = {c: ("continuous", 0.0 if any(p in c for p in C.RAIN_NAME_PARTS) else None) for c in cols}
    window = build_history(recent, cols, spec, start=start, end=end, cut=None, policy=policy)
    known = (hourly if sites is None else sites).select(*spec.keys).distinct()
    counts = recent.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = known.join(counts, list(spec.keys), "left").select(*spec.keys, F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_rows"))
    report = stats.with_sufficiency(counts, rows_needed)
    return window, report


def score_latest(window: DataFrame, model, model_type: str, scaler: DataFrame, order: Sequence[str],
                 cfg: FeatureConfig, as_of: dt.datetime, spec: SeriesSpec = _SPEC,
                 sites: DataFrame | None = None, threshold: float = 0.5,
                 report: DataFrame | None = None) -> DataFrame:
    """M5 + Z1-Z3: features without the target requirement, newest row per
    site, align to the saved order (absent and null -> 0), scale, score and
    interpret.  With the sufficiency ``report`` of the window only sufficient
    sites are scored; the others, dead ones too, come out as error rows."""
    if report is not None:
        enough = report.filter("sufficient").select(*spec.keys)
        window = window.join(enough, list(spec.keys), "left_semi")
    x = prepare_latest(window, scaler, order, cfg, spec, sites)
    scored = learn.score(x, model, model_type)
    if model_type == "classification":
        out = score.interpret_class(scored, "prediction_score", threshold, as_of, cfg.tz)
    else:
        out = score.interpret_level(scored, "predicted_water_level_m", cfg.flood_threshold_m, as_of, cfg.tz)
    return out if report is None else score.with_errors(out, report, spec.keys)


def preprocess(df: DataFrame, mode: str, cfg: FeatureConfig = FeatureConfig(), spec: SeriesSpec = _SPEC,
               scaler: DataFrame | None = None, order: Sequence[str] | None = None,
               sites: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """M4: features, then min-max.  ``mode='train'`` fits the scaler on the
    feature columns (targets kept aside); ``mode='predict'`` aligns to the saved
    order (absent and null -> 0 in raw units) and applies the saved scaler.
    Returns ``(scaled table with keys and targets, scaler table, order)``.
    An empty input, or one without a complete feature row, raises ``ValueError``."""
    if df.isEmpty():
        raise ValueError("input table is empty")
    feats = features.build_features(df, cfg, spec, sites)
    if feats.isEmpty():
        raise ValueError("no row has complete features")
    keep = [*spec.keys, spec.ts, *[c for c in C.ALL_TARGET_COLUMNS if c in feats.columns]]
    if mode == "train":
        order = scaling.feature_columns(feats)
        scaler = scaling.fit_minmax(feats, order)
        return scaling.apply_minmax(feats, scaler, keep=keep), scaler, list(order)
    if mode == "predict":
        if scaler is None or order is None:
            raise ValueError("predict mode needs the saved scaler and feature order")
        aligned = scaling.align_columns(feats, order, keep=keep)
        return scaling.apply_minmax(aligned, scaler, keep=keep), scaler, list(order)
    raise ValueError(f"unknown mode {mode!r}")


def prepare_latest(window: DataFrame, scaler: DataFrame, order: Sequence[str], cfg: FeatureConfig,
                   spec: SeriesSpec = _SPEC, sites: DataFrame | None = None) -> DataFrame:
    """M5: features of a realtime window (target not required), drop the
    targets, newest row per site, align to the saved order, scale."""
    cfg = FeatureConfig(**{**cfg.__dict__, "require_target": False})
    feats = features.build_features(window, cfg, spec, sites).drop(*C.ALL_TARGET_COLUMNS)
    latest = split.latest(feats, spec)
    keys = [*spec.keys, spec.ts]
    return scaling.apply_minmax(scaling.align_columns(latest, order, keep=keys), scaler, keep=keys)
