"""Feature and label builder.

``build_features`` computes every lag, rolling statistic and label of a dense
hourly table in ONE window pass: one halo explode, one exchange on
``(keys, chunk)``, one sort, one Window node; calendar, lunar, static and
interaction columns are plain projections in the same stage.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from hydroseries import config as C
from hydroseries.config import FeatureConfig, SeriesSpec
from hydroseries.functions.time import calendar_columns, cyclic_columns, is_day, lunar_phase
from hydroseries.operators import windows

_SPEC = SeriesSpec()
_FC = FeatureConfig()


# --- window expressions (used inside one pass) ------------------------------

def lag_columns(df_cols: Sequence[str], feats: Iterable[str], depth: int, w: Window,
                strict: bool = True) -> dict[str, Column]:
    """``{f}_lag_{i}h`` for i in 1..depth; absent feature -> null columns
    (which empties the table after ``drop_incomplete``) unless ``strict``."""
    out = {}
    for f in feats:
        if f not in df_cols:
            if strict:
                raise ValueError(f"lag feature {f!r} is absent; the feature table would be empty")
            out.update({f"{f}_lag_{i}h": F.lit(None).cast("double") for i in range(1, depth + 1)})
            continue
        out.update({f"{f}_lag_{i}h": F.lag(f, i).over(w) for i in range(1, depth + 1)})
    return out


_ROLL = {"sum": F.sum, "avg": F.avg, "std": F.stddev_samp}


def rolling_columns(df_cols: Sequence[str], cols: Iterable[str], windows_h: Iterable[int],
                    how: str, w: Window) -> dict[str, Column]:
    """Statistic over the previous ``n`` rows, current row excluded;
    ``{c}_{how}_{n}h``.  Absent column -> 0.0, as the reference does."""
    out = {}
    for c in cols:
        for n in windows_h:
            name = f"{c}_{how}_{n}h"
            if c not in df_cols:
                out[name] = F.lit(0.0)
            else:
                out[name] = _ROLL[how](F.col(c)).over(w.rowsBetween(-n, -1))
    return out


def label_columns(df_cols: Sequence[str], level: str, horizon: int, threshold: float,
                  w: Window, strict: bool = True) -> dict[str, Column]:
    """The level ``horizon`` hours ahead and its exceedance flag
    (a missing future value counts as 0)."""
    if level not in df_cols:
        if strict:
            raise ValueError(f"level column {level!r} is absent; no labels can be made")
        return {C.TARGET_REGRESSION: F.lit(None).cast("double"),
                C.TARGET_CLASSIFICATION: F.lit(None).cast("int")}
    ahead = F.lead(level, horizon).over(w)
    return {C.TARGET_REGRESSION: ahead,
            C.TARGET_CLASSIFICATION: F.coalesce((ahead > F.lit(float(threshold))).cast("int"), F.lit(0))}


# --- single-purpose operators -----------------------------------------------

def lags(df: DataFrame, feats: Iterable[str], depth: int = 24, spec: SeriesSpec = _SPEC,
         strict: bool = True) -> DataFrame:
    feats = list(feats)
    return windows.bounded(df, spec, depth, 0,
                           lambda x, w: x.withColumns(lag_columns(df.columns, feats, depth, w, strict)))


def rolling(df: DataFrame, cols: Iterable[str], windows_h: Iterable[int], how: str,
            spec: SeriesSpec = _SPEC) -> DataFrame:
    cols, windows_h = list(cols), list(windows_h)
    return windows.bounded(df, spec, max(windows_h), 0,
                           lambda x, w: x.withColumns(rolling_columns(df.columns, cols, windows_h, how, w)))


def label_level(df: DataFrame, level: str = "local_water_level_m", horizon: int = 1,
                threshold: float = C.FLOOD_WATER_LEVEL_THRESHOLD_M, spec: SeriesSpec = _SPEC) -> DataFrame:
    """W9 + W10 together (they share the window)."""
    return windows.bounded(df, spec, 0, horizon,
                           lambda x, w: x.withColumns(label_columns(df.columns, level, horizon, threshold, w)))


def label_exceeds(df: DataFrame, level: str = "local_water_level_m", horizon: int = 1,
                  threshold: float = C.FLOOD_WATER_LEVEL_THRESHOLD_M, spec: SeriesSpec = _SPEC) -> DataFrame:
    return label_level(df, level, horizon, threshold, spec).drop(C.TARGET_REGRESSION)


def calendar_features(df: DataFrame, tz: str = _FC.tz, ts: str = "ts") -> DataFrame:
    return df.withColumns(calendar_columns(ts, tz))


def with_lunar_phase(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("lunar_phase", lunar_phase(ts))


def cyclic_features(df: DataFrame, tz: str = _FC.tz, ts: str = "ts") -> DataFrame:
    """D1 + D2."""
    return df.withColumns({**cyclic_columns(ts, tz), "is_day": is_day(ts, tz).cast("int")})


def interactions(df: DataFrame, pairs: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Product of two columns; 0.0 if either is absent."""
    out = {}
    for a, b, name in pairs:
        out[name] = (F.col(a) * F.col(b)) if a in df.columns and b in df.columns else F.lit(0.0)
    return df.withColumns(out)


def with_static(df: DataFrame, sites: DataFrame, cols: Iterable[str] = ("elevation_m",),
                keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """P10: constant per-site columns by an equi-join on the site key.  The
    planner (AQE) broadcasts the site table when its measured size is small and
    falls back to a shuffle join otherwise."""
    return df.join(sites.select(*keys, *cols), list(keys), "left")


def clip_floor(df: DataFrame, col: str, floor: float = C.LEVEL_FLOOR_M, mode: str = "max") -> DataFrame:
    """``max(x, floor)`` (mode ``max``) or ``x < 0 -> floor`` (mode ``negative``)."""
    c = F.col(col)
    if mode == "max":
        e = F.when(c.isNull(), None).otherwise(F.greatest(c, F.lit(float(floor))))
    elif mode == "negative":
        e = F.when(c < 0, F.lit(float(floor))).otherwise(c)
    else:
        raise ValueError(mode)
    return df.withColumn(col, e)


def incomplete_columns(cols: Iterable[str], require_target: bool = True) -> list[str]:
    out = [c for c in cols if any(p in c for p in C.INCOMPLETE_NAME_PARTS)]
    targets = C.ALL_TARGET_COLUMNS if require_target else ()
    return out + [t for t in targets if t in cols]


def complete(df: DataFrame, cols: Iterable[str] | None = None, require_target: bool = True) -> Column:
    """P8's condition: no lag, rolling or target column is null (or NaN)."""
    ok, kinds = F.lit(True), dict(df.dtypes)
    for c in cols if cols is not None else incomplete_columns(df.columns, require_target):
        ok &= F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            ok &= ~F.isnan(c)
    return ok


def drop_incomplete(df: DataFrame, cols: Iterable[str] | None = None, require_target: bool = True,
                    observation: Observation | None = None) -> DataFrame:
    """Drop rows with a null lag / rolling / target column; other nulls stay.

    A8: an ``observation`` receives ``rows_before`` and ``rows_after`` from the job
    that computes the result, without a job of its own."""
    ok = complete(df, cols, require_target)
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("rows_before"), F.count_if(ok).alias("rows_after"))
    return df.filter(ok)


def drop_report(features: DataFrame, by: Sequence[str] = ("site_id",), require_target: bool = True) -> DataFrame:
    """A8 per group, from features that still hold their incomplete rows
    (``build_features(drop=False)``): one pass over one plan."""
    ok = complete(features, None, require_target)
    counts = features.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(ok).alias("rows_after"))
    return counts.withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def flood_flag(df: DataFrame, level: str = "local_water_level_m", rain: str = "rain_1h",
               soil: str = "satellite_soil_moisture", name: str = "is_flood") -> DataFrame:
    """Composite flag from level, rain and soil thresholds (OR of the
    present ones; the reference names the thresholds but not the rule)."""
    parts = []
    if level in df.columns:
        parts.append(F.col(level) > F.lit(C.FLOOD_WATER_LEVEL_THRESHOLD_M))
    if rain in df.columns:
        parts.append(F.col(rain) >= F.lit(C.RAIN_THRESHOLD_FOR_FLOOD_MM_HR))
    if soil in df.columns:
        parts.append(F.col(soil) >= F.lit(C.SOIL_MOISTURE_FLOOD_THRESHOLD))
    e = F.lit(False)
    for p in parts:
        e = e | F.coalesce(p, F.lit(False))
    return df.withColumn(name, e.cast("int"))


# --- the composition --------------------------------------------------------

def build_features(df: DataFrame, cfg: FeatureConfig = _FC, spec: SeriesSpec = _SPEC,
                   sites: DataFrame | None = None, drop: bool = True, observation: Observation | None = None) -> DataFrame:
    """M3: calendar, lunar, lags, rolling sums / means / stds, static,
    interactions, both labels, then P8 — one window pass.  An input that still
    carries ``_chunk`` (``densify(keep_chunk=True)`` + fills) is not shuffled
    again: only the halo rows move (``windows.bounded``).  ``observation``: as in ``drop_incomplete``."""
    cols = df.columns
    before = max([cfg.lag_depth, *cfg.rolling_windows])
    after = cfg.horizon_hours

    def build(x: DataFrame, w: Window) -> DataFrame:
        exprs: dict[str, Column] = {}
        exprs.update(calendar_columns(spec.ts, cfg.tz))
        exprs["lunar_phase"] = lunar_phase(spec.ts)
        exprs.update(lag_columns(cols, cfg.lag_features, cfg.lag_depth, w, cfg.strict_columns))
        exprs.update(rolling_columns(cols, cfg.rainfall_columns, cfg.rolling_windows, "sum", w))
        exprs.update(rolling_columns(cols, cfg.level_columns, cfg.rolling_windows, "avg", w))
        exprs.update(rolling_columns(cols, cfg.level_columns, cfg.rolling_windows, "std", w))
        exprs.update(label_columns(cols, cfg.target_level_column, cfg.horizon_hours,
                                   cfg.flood_threshold_m, w, cfg.strict_columns))
        return x.select("*", *[e.alias(n) for n, e in exprs.items()])

    out = windows.bounded(df, spec, before, after, build)
    if sites is not None:
        out = with_static(out, sites, [c for c in cfg.static_columns if c in sites.columns], spec.keys)
    out = interactions(out, cfg.interaction_pairs)
    if drop:
        out = drop_incomplete(out, require_target=cfg.require_target, observation=observation)
    return out.drop(windows.CHUNK)
