"""Gap filling over dense hourly series.

All operators expect a dense grid (see ``timegrid.reindex``): row frames are
hours.  Unbounded fills use ``windows.carry`` (chunk-local pass + carry across
chunks); limited fills use a halo pass.  Interpolation needs, per row, the
previous and the next observed ``(time, value)``: one forward and one backward
carry of a struct, for all columns at once.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries import config as C
from hydroseries.config import SeriesSpec
from hydroseries.functions.time import to_epoch
from hydroseries.operators import windows
from hydroseries.operators.stats import group_quantiles

_SPEC = SeriesSpec()


def ffill(df: DataFrame, cols: Iterable[str], spec: SeriesSpec = _SPEC,
          limit: int | None = None) -> DataFrame:
    """Forward fill; with ``limit`` at most that many rows after a value."""
    cols = list(cols)
    if limit is None:
        return windows.carry(df, spec, {c: F.col(c) for c in cols}, "forward")
    if spec.chunk_hours and limit >= spec.chunk_hours:
        # Longer than a chunk: carry (hour, value) and keep it while young enough.
        h = F.floor(to_epoch(spec.ts) / 3600)
        vals = {}
        for c in cols:
            vals[f"_lh_{c}"] = F.when(F.col(c).isNotNull(), h)
            vals[f"_lv_{c}"] = F.col(c)
        x = windows.carry(df, spec, vals, "forward")
        return x.withColumns({c: F.when(h - F.col(f"_lh_{c}") <= limit, F.col(f"_lv_{c}")) for c in cols}).drop(
            *vals)

    def build(x, w):
        fw = w.rowsBetween(-limit, Window.currentRow)
        return x.withColumns({c: F.last(c, True).over(fw) for c in cols})
    return windows.bounded(df, spec, limit, 0, build)


def bfill(df: DataFrame, cols: Iterable[str], spec: SeriesSpec = _SPEC) -> DataFrame:
    """Backward fill (descending-order carry, never an unbounded-following
    frame, which is quadratic)."""
    cols = list(cols)
    return windows.carry(df, spec, {c: F.col(c) for c in cols}, "backward")


def _neighbours(df: DataFrame, cols: list[str], spec: SeriesSpec, observed: DataFrame | None = None) -> DataFrame:
    """Adds ``_pt_{c}, _pv_{c}`` (time and value of the previous non-null at or
    before the row) and ``_nt_{c}, _nv_{c}`` (the next one at or after it), for
    all columns in one forward + backward pass.  ``observed``: the rows that the dense grid
    was made from (its first and last row included); what chunks hand on is then
    read from them, not from the grid a second time."""
    t = to_epoch(spec.ts).cast("double")
    fwd, bwd = {}, {}
    for c in cols:
        tc, vc = F.when(F.col(c).isNotNull(), t), F.col(c).cast("double")
        fwd[f"_pt_{c}"], fwd[f"_pv_{c}"] = tc, vc
        bwd[f"_nt_{c}"], bwd[f"_nv_{c}"] = tc, vc
    return windows.carry_both(df, spec, fwd, bwd, observed)


def _tmp(cols) -> list[str]:
    return [f"_{s}_{c}" for c in cols for s in ("pt", "pv", "nt", "nv")]


def _interp(c: str, spec: SeriesSpec) -> Column:
    t = to_epoch(spec.ts).cast("double")
    pt, pv, nt, nv = (F.col(f"_{s}_{c}") for s in ("pt", "pv", "nt", "nv"))
    return F.when(nt == pt, pv).otherwise(pv + (nv - pv) * (t - pt) / (nt - pt))


def interpolate_time(df: DataFrame, cols: Iterable[str], spec: SeriesSpec = _SPEC) -> DataFrame:
    """Linear-in-time interpolation inside gaps only; edges stay null."""
    cols = list(cols)
    x = _neighbours(df, cols, spec)
    return (x.withColumns({c: F.coalesce(F.col(c).cast("double"), _interp(c, spec)) for c in cols})
             .drop(*_tmp(cols)))


def interpolate_linear(df: DataFrame, cols: Iterable[str], spec: SeriesSpec = _SPEC) -> DataFrame:
    """Interpolation inside gaps, then the nearest value at both edges
    (equal to by-row linear interpolation on a dense grid)."""
    cols = list(cols)
    x = _neighbours(df, cols, spec)
    return (x.withColumns({c: F.coalesce(F.col(c).cast("double"), _interp(c, spec),
                                         F.col(f"_pv_{c}"), F.col(f"_nv_{c}")) for c in cols})
             .drop(*_tmp(cols)))


# --- policies ---------------------------------------------------------------

def default_policy(col: str) -> tuple[str, float | None]:
    """The name rule of the reference: continuous sensors are interpolated,
    then carried both ways; rain columns end with 0.0 where nothing is left.
    Other numeric columns are set to 0.  Returns ``(method, fallback)``."""
    if any(p in col for p in C.CONTINUOUS_NAME_PARTS):
        fallback = 0.0 if any(p in col for p in C.RAIN_NAME_PARTS) else None
        return "continuous", fallback
    return "zero", 0.0


def impute_series(df: DataFrame, cols: Iterable[str], spec: SeriesSpec = _SPEC,
                  policy: Mapping[str, tuple[str, float | None]] | None = None, observed: DataFrame | None = None) -> DataFrame:
    """F1 + F2: per-column policy in one forward and one backward pass
    (``observed``: the rows that ``df`` was densified from, if at hand).

    ``continuous``: time interpolation inside gaps, then forward fill, then
    backward fill, then the fallback constant.  After both carries a null is
    left only where the whole series is null; the reference's mean / median
    fallbacks are null there as well, so only a constant fallback changes it.
    ``zero``: nulls become 0.
    """
    # text has no policy: such a column stays as it is
    cols = [c for c in cols if c in df.columns and isinstance(df.schema[c].dataType, T.NumericType)]
    pol = {c: (policy or {}).get(c) or default_policy(c) for c in cols}
    cont = [c for c in cols if pol[c][0] == "continuous"]
    x = _neighbours(df, cont, spec, observed) if cont else df
    out = {}
    for c in cols:
        method, fb = pol[c]
        if method == "continuous":
            e = F.coalesce(F.col(c).cast("double"), _interp(c, spec), F.col(f"_pv_{c}"), F.col(f"_nv_{c}"))
        elif method == "zero":
            e = F.col(c)
            fb = 0.0 if fb is None else fb
        else:
            raise ValueError(f"unknown fill method {method!r} for {c}")
        out[c] = F.coalesce(e, F.lit(fb)) if fb is not None else e
    return x.withColumns(out).drop(*_tmp(cont))


def fill_missing(df: DataFrame, strategy: str = "ffill", cols: Iterable[str] | None = None,
                 spec: SeriesSpec = _SPEC, buckets: int | None = None, strict: bool = False) -> DataFrame:
    """one strategy for the listed columns (all non-key columns if None):
    ``ffill``, ``bfill``, ``mean``, ``median`` (per series) or ``zero``.
    Unknown columns are skipped; an unknown strategy warns and leaves the table
    as it is, or raises if ``strict``."""
    skip = set(spec.keys) | {spec.ts, windows.CHUNK}
    cols = [c for c in (cols if cols is not None else df.columns) if c in df.columns and c not in skip]
    if not cols:
        return df
    if strategy == "ffill":
        return ffill(df, cols, spec)
    if strategy == "bfill":
        return bfill(df, cols, spec)
    if strategy == "zero":
        return df.fillna(0, subset=cols)
    keys = list(spec.keys)
    if strategy == "mean":
        stats = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_f_{c}") for c in cols])
    elif strategy == "median":
        # All columns in one distributed-rank pass, pivoted back to one row per series.
        med = group_quantiles(df, cols, keys, {"m": 0.5}, buckets=buckets)
        stats = med.groupBy(*keys).pivot("column", cols).agg(F.first("m"))
        stats = stats.select(*keys, *[F.col(c).alias(f"_f_{c}") for c in cols])
    else:
        if strict:
            raise ValueError(f"unknown fill strategy {strategy!r}")
        warnings.warn(f"unknown fill strategy {strategy!r}: nothing filled", stacklevel=2)
        return df
    x = df.join(stats, keys, "left")
    return x.withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in cols}).drop(
        *[f"_f_{c}" for c in cols])


def impute_forecast(df: DataFrame, spec: SeriesSpec = _SPEC,
                    continuous: Iterable[str] = ("temperature", "humidity", "pressure",
                                                 "wind_speed", "wind_deg", "clouds_all"),
                    rain: Iterable[str] = ("rain_1h", "rain_3h"), observed: DataFrame | None = None) -> DataFrame:
    """forecast rows on an hourly grid: sensors by W8, rain by forward
    fill then 0.0 — all in one forward + backward pass (``observed`` as in ``impute_series``)."""
    cont = [c for c in continuous if c in df.columns]
    rain = [c for c in rain if c in df.columns]
    t = to_epoch(spec.ts).cast("double")
    fwd, bwd = {}, {}
    for c in cont:
        tc, vc = F.when(F.col(c).isNotNull(), t), F.col(c).cast("double")
        fwd[f"_pt_{c}"], fwd[f"_pv_{c}"] = tc, vc
        bwd[f"_nt_{c}"], bwd[f"_nv_{c}"] = tc, vc
    for c in rain:
        fwd[f"_ff_{c}"] = F.col(c)
    x = windows.carry_both(df, spec, fwd, bwd, observed)
    out = {c: F.coalesce(F.col(c).cast("double"), _interp(c, spec), F.col(f"_pv_{c}"), F.col(f"_nv_{c}"))
           for c in cont}
    out.update({c: F.coalesce(F.col(f"_ff_{c}"), F.lit(0.0)) for c in rain})
    return x.withColumns(out).drop(*_tmp(cont), *[f"_ff_{c}" for c in rain])
