"""Driver queries over the hourly series staged from ``events`` (and the
calendar functions over ``events`` / ``orders``), each with its oracle SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries import config as C
from hydroseries.config import FeatureConfig
from hydroseries.functions import time as T
from hydroseries.operators import combine, features, fill, stats, timegrid
from hydroseries.plans import sqlkit as S
from hydroseries.plans import staging
from hydroseries.plans.registry import finish, register
from hydroseries.session import materialize

SPEC = staging.SPEC
COLS = list(staging.OBS_COLS)
TZ = "Asia/Bangkok"
LOCAL = "ts + INTERVAL 7 HOUR"          # Asia/Bangkok has no DST
RANGE = ("2024-01-08 00:00:00", "2024-01-21 23:00:00")


# --- shared Spark staging ---------------------------------------------------

def obs(spark, d):
    return staging.obs(spark, d)


def grid(spark, d):
    return timegrid.hourly_grid(timegrid.series_spans(obs(spark, d), SPEC), SPEC)


def dense(spark, d, spec=SPEC, static=None, sea=False):
    """Hourly table cut once (reliable checkpoint) so the grid bounds and the
    union do not rescan ``events``; densified with one shuffle on
    ``(site, chunk)``, keeping ``_chunk`` so the fill passes reuse it (every
    query selects its output columns explicitly)."""
    return _dense_of(materialize(staging.obs(spark, d, sea), "checkpoint"), spec, static)


def _dense_of(hourly, spec, static=None):
    return timegrid.densify(hourly, spec, keep_chunk=True, static=static)


def imputed(spark, d, spec=SPEC, static=None, keep_chunk=False, sea=False):
    hourly = materialize(staging.obs(spark, d, sea), "checkpoint")
    out = fill.impute_series(_dense_of(hourly, spec, static), COLS + ["sea_level_m"] * sea, spec, observed=hourly)
    return out if keep_chunk else out.drop(timegrid.CHUNK)


def history(spark, d, spec=SPEC, static=None, keep_chunk=False):
    """Imputed series of all four sensors (and the static site columns when
    ``static`` is given, carried by the grid).
    ``keep_chunk`` keeps the (site, chunk) partitioning for the feature pass."""
    return imputed(spark, d, spec, static, keep_chunk, sea=True)


def _sel(df: DataFrame, cols) -> DataFrame:
    return finish(df.select(*cols))


BASE = ["site_id", "ts"]
D = S.with_(S.OBS, S.SPANS, S.GRID, S.DENSE)
DI = S.with_(S.OBS, S.SPANS, S.GRID, S.DENSE, S.imputed_cte())


# --- A1, J1, J2, P1, A5, A2 -------------------------------------------------

register("resample_hourly_mean", S.final(
    ["value"], ["site_id", "ts"],
    "(SELECT event_type AS site_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(value) AS value "
    "FROM events GROUP BY 1, 2)"))(
    lambda spark, d: finish(timegrid.resample_mean(
        staging.events_as_series(staging.table(spark, d, "events")), ["value"], SPEC)))

register("hourly_grid", S.with_(S.OBS, S.SPANS, S.GRID) + "SELECT site_id, ts FROM grid")(
    lambda spark, d: grid(spark, d))

register("reindex_gaps", D + S.final(COLS, BASE, "dense"))(
    lambda spark, d: _sel(dense(spark, d), BASE + COLS))

def _time_range(spark, d):
    """The range bounds the raw scan (a pushed filter); the spans of the series
    come from a scan of key and time alone."""
    raw = staging.events_as_series(staging.table(spark, d, "events"))
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in RANGE)
    spans = timegrid.series_spans(raw.select("site_id", T.floor_hour("ts").alias("ts")), SPEC).select(
        "site_id", F.greatest("start", lo).alias("start"), F.least("end", hi).alias("end")).filter("start <= end")
    inside = raw.filter((F.col("ts") >= lo) & (F.col("ts") < hi + F.make_dt_interval(hours=F.lit(1))))
    return timegrid.reindex(timegrid.hourly_grid(spans, SPEC), timegrid.resample(inside, staging.obs_aggs(), SPEC), SPEC)


register("time_range", D + S.final(COLS, BASE, "dense",
                                   f"ts BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'"))(
    lambda spark, d: _sel(timegrid.time_range(_time_range(spark, d), *RANGE), BASE + COLS))

register("null_profile", D + "SELECT site_id, count(*) AS n_rows, " + ", ".join(
    f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {c}_nulls" for c in COLS)
    + " FROM dense GROUP BY 1")(
    lambda spark, d: stats.null_profile(dense(spark, d), COLS))

register("column_stats", D + S.final(["mean", "median"], ["site_id", "feature"], "(" + " UNION ALL ".join(
    f"SELECT site_id, '{c}' AS feature, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median FROM dense GROUP BY 1"
    for c in COLS) + ")"))(
    lambda spark, d: finish(stats.column_stats(dense(spark, d), COLS).withColumnRenamed("column", "feature")))


# --- W5-W8, F1, F4 ----------------------------------------------------------

def _win_sql(exprs: dict[str, str], src: str = "dense") -> str:
    inner = f"(SELECT site_id, ts, {', '.join(f'{e} AS {c}' for c, e in exprs.items())} FROM {src})"
    return S.final(list(exprs), BASE, inner)


register("ffill", D + _win_sql({c: f"last_value({c} IGNORE NULLS) OVER {S.UP}" for c in COLS}))(
    lambda spark, d: _sel(fill.ffill(dense(spark, d), COLS, SPEC), BASE + COLS))

register("ffill_limit24", D + _win_sql(
    {c: f"last_value({c} IGNORE NULLS) OVER ({S.W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)" for c in COLS}))(
    lambda spark, d: _sel(fill.ffill(dense(spark, d), COLS, SPEC, limit=24), BASE + COLS))

register("bfill", D + _win_sql({c: f"first_value({c} IGNORE NULLS) OVER {S.DOWN}" for c in COLS}))(
    lambda spark, d: _sel(fill.bfill(dense(spark, d), COLS, SPEC), BASE + COLS))

_NB = "nb AS (SELECT site_id, ts, " + ", ".join(COLS) + ", " + ", ".join(S.neighbours(c) for c in COLS) + " FROM dense)"

register("interpolate_time", S.with_(S.OBS, S.SPANS, S.GRID, S.DENSE, _NB) + _win_sql(
    {c: S.impute_expr(c, edges=False) for c in COLS}, "nb"))(
    lambda spark, d: _sel(fill.interpolate_time(dense(spark, d), COLS, SPEC), BASE + COLS))

register("interpolate_linear", S.with_(S.OBS, S.SPANS, S.GRID, S.DENSE, _NB) + _win_sql(
    {c: S.impute_expr(c, edges=True) for c in COLS}, "nb"))(
    lambda spark, d: _sel(fill.interpolate_linear(dense(spark, d), COLS, SPEC), BASE + COLS))

register("impute_policy", DI + S.final(COLS, BASE, "imputed"))(
    lambda spark, d: _sel(imputed(spark, d), BASE + COLS))

register("fill_mean", D + _win_sql({c: f"coalesce({c}, avg({c}) OVER (PARTITION BY site_id))" for c in COLS}))(
    lambda spark, d: _sel(fill.fill_missing(dense(spark, d), "mean", COLS, SPEC), BASE + COLS))

register("fill_median", S.with_(S.OBS, S.SPANS, S.GRID, S.DENSE,
                                "med AS (SELECT site_id, " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in COLS)
                                + " FROM dense GROUP BY 1)")
         + S.final(COLS, ["d.site_id AS site_id", "d.ts AS ts"],
                   "(SELECT d.site_id, d.ts, " + ", ".join(f"coalesce(d.{c}, m.m_{c}) AS {c}" for c in COLS)
                   + " FROM dense d LEFT JOIN med m ON d.site_id = m.site_id) d"))(
    lambda spark, d: _sel(fill.fill_missing(dense(spark, d), "median", COLS, SPEC), BASE + COLS))

register("fill_zero", D + _win_sql({c: f"coalesce({c}, 0.0)" for c in COLS}))(
    lambda spark, d: _sel(fill.fill_missing(dense(spark, d), "zero", COLS, SPEC), BASE + COLS))


# --- J3-J7 ------------------------------------------------------------------

def _dense0(spark, d):
    return timegrid.reindex(grid(spark, d), staging.feed(spark, d, 0), SPEC)


_M = S.with_(S.OBS, S.SPANS, S.GRID, S.FEED0, S.FEED1,
             "d0 AS (SELECT g.site_id, g.ts, " + ", ".join(f"f.{c}" for c in COLS)
             + " FROM grid g LEFT JOIN feed0 f ON g.site_id = f.site_id AND g.ts = f.ts)")
_J1 = " FROM d0 LEFT JOIN feed1 s ON d0.site_id = s.site_id AND d0.ts = s.ts)"

register("upsert_prefer_source", _M + S.final(COLS, BASE, "(SELECT d0.site_id, d0.ts, " + ", ".join(
    f"coalesce(s.{c}, d0.{c}) AS {c}" for c in COLS) + _J1))(
    lambda spark, d: _sel(combine.upsert(_dense0(spark, d), staging.feed(spark, d, 1), SPEC), BASE + COLS))

register("fill_from_source", _M + S.final(COLS, BASE, "(SELECT d0.site_id, d0.ts, " + ", ".join(
    f"coalesce(d0.{c}, s.{c}) AS {c}" for c in COLS) + _J1))(
    lambda spark, d: _sel(combine.fill_from(_dense0(spark, d), staging.feed(spark, d, 1), SPEC), BASE + COLS))


def _sat_rain(spark, d):
    """A point source with gaps: every event's value / 100 at its own time."""
    return (staging.events_as_series(staging.table(spark, d, "events"))
            .select("site_id", "ts", (F.col("value") / F.lit(100.0)).alias("satellite_rainfall_mm_hr")))


def _soil(spark, d):
    ev = staging.events_as_series(staging.table(spark, d, "events"))
    return (ev.groupBy("site_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
              .agg((F.avg("value") / F.lit(1000.0)).alias("satellite_soil_moisture")))


def _sparse_sql(name: str, select: str, limit: int | None) -> str:
    frame = "UNBOUNDED PRECEDING" if limit is None else f"{limit} PRECEDING"
    return (f"{name}_h AS ({select}), "
            f"{name}_sp AS (SELECT site_id, min(ts) AS s, max(ts) AS e FROM {name}_h GROUP BY 1), "
            f"{name}_g AS (SELECT site_id, unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS ts FROM {name}_sp), "
            f"{name} AS (SELECT g.site_id, g.ts, last_value(h.v IGNORE NULLS) OVER "
            f"(PARTITION BY g.site_id ORDER BY g.ts ROWS BETWEEN {frame} AND CURRENT ROW) AS v "
            f"FROM {name}_g g LEFT JOIN {name}_h h ON g.site_id = h.site_id AND g.ts = h.ts)")


_SAT_SQL = _sparse_sql("sat", "SELECT event_type AS site_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, "
                              "avg(value / 100.0) AS v FROM events GROUP BY 1, 2", 24)
_SAT_ALL_SQL = _sparse_sql("sat", "SELECT event_type AS site_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, "
                                  "avg(value / 100.0) AS v FROM events GROUP BY 1, 2", None)
_SOIL_SQL = _sparse_sql("soil", "SELECT event_type AS site_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, "
                                "avg(value) / 1000.0 AS v FROM events GROUP BY 1, 2", 24)

register("asof_attach_24h", S.with_(S.OBS, S.SPANS, S.GRID, _SAT_SQL) + S.final(
    ["satellite_rainfall_mm_hr"], BASE,
    "(SELECT g.site_id, g.ts, s.v AS satellite_rainfall_mm_hr FROM grid g "
    "LEFT JOIN sat s ON g.site_id = s.site_id AND g.ts = s.ts)"))(
    lambda spark, d: _sel(combine.asof_attach(grid(spark, d), _sat_rain(spark, d),
                                              ["satellite_rainfall_mm_hr"], SPEC, 24),
                          BASE + ["satellite_rainfall_mm_hr"]))

# The same operators on series with long gaps, where the limits bind.
_USER = S.OBS_SELECT.format(src="(SELECT * EXCLUDE (event_type), event_type || '-' || CAST(user_id % 40 AS VARCHAR) "
                                "AS event_type FROM events)")
_DU = S.with_(f"obs AS ({_USER})", S.SPANS, S.GRID, S.DENSE)


def _dense_by_user(spark, d):
    return timegrid.densify(materialize(staging.obs_by_user(spark, d), "checkpoint"), SPEC, keep_chunk=True)


register("ffill_limit24_gaps", _DU + _win_sql(
    {c: f"last_value({c} IGNORE NULLS) OVER ({S.W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)" for c in COLS}))(
    lambda spark, d: _sel(fill.ffill(_dense_by_user(spark, d), COLS, SPEC, limit=24), BASE + COLS))


def _asof_gaps(spark, d):
    """The level of every series attached to the grid of its own hours, carried at most a day."""
    hourly = materialize(staging.obs_by_user(spark, d), "checkpoint")
    g = timegrid.hourly_grid(timegrid.series_spans(hourly, SPEC), SPEC)
    return _sel(combine.asof_attach(g, hourly.select(*BASE, "local_water_level_m"), ["local_water_level_m"], SPEC, 24),
                BASE + ["local_water_level_m"])


register("asof_attach_24h_gaps", _DU + _win_sql(
    {"local_water_level_m": f"last_value(local_water_level_m IGNORE NULLS) OVER ({S.W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)"}))(
    _asof_gaps)

_CS_COLS = COLS + ["satellite_rainfall_mm_hr", "satellite_soil_moisture"]


def _hourly_sources(spark, d):
    """All sources at hourly grain from ONE scan of ``events``, cut once: the
    columns of either feed (suffixes 0 and 1) with its row count, and sum and
    count of the values for the satellite stand-ins."""
    raw = staging.events_as_series(staging.table(spark, d, "events"))
    k, v = staging.k_value("props"), F.col("value")
    aggs = {"v_sum": F.sum(v), "v_n": F.count(v)}
    for i, here in enumerate((F.minute("ts") < 30, F.minute("ts") >= 30)):
        aggs |= {f"n{i}": F.count_if(here),
                 f"local_water_level_m{i}": F.avg(F.when(here, v)) / F.lit(40.0),
                 f"rain_1h{i}": F.sum(F.when(here, F.greatest(v - F.lit(100.0), F.lit(0.0)))) / F.lit(10.0),
                 f"humidity{i}": F.avg(F.when(here, k))}
    return materialize(timegrid.resample(raw, aggs, SPEC), "checkpoint")


def _combine_sources(spark, d):
    h = _hourly_sources(spark, d)
    f0, f1 = (h.filter(F.col(f"n{i}") > 0).select(*BASE, *[F.col(f"{c}{i}").alias(c) for c in COLS]) for i in (0, 1))
    sat = h.select(*BASE, (F.col("v_sum") / F.col("v_n") / F.lit(100.0)).alias("satellite_rainfall_mm_hr"))
    soil = (h.groupBy("site_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
             .agg((F.sum("v_sum") / F.sum("v_n") / F.lit(1000.0)).alias("satellite_soil_moisture")))
    g = timegrid.hourly_grid(timegrid.series_spans(h, SPEC), SPEC)
    out = combine.combine_sources(g, [
        ("attach", f0, {}),
        ("upsert", f1.select("site_id", "ts", "humidity"), {}),
        ("fill", f1, {"cols": ["local_water_level_m", "rain_1h"]}),
        ("asof", sat, {"value_cols": ["satellite_rainfall_mm_hr"], "tolerance_hours": None}),
        ("asof", soil, {"value_cols": ["satellite_soil_moisture"], "tolerance_hours": 24}),
    ], SPEC)
    return _sel(out, BASE + _CS_COLS)


register("combine_sources", S.with_(S.OBS, S.SPANS, S.GRID, S.FEED0, S.FEED1, _SAT_ALL_SQL, _SOIL_SQL,
                                    "d0 AS (SELECT g.site_id, g.ts, " + ", ".join(f"f.{c}" for c in COLS)
                                    + " FROM grid g LEFT JOIN feed0 f ON g.site_id = f.site_id AND g.ts = f.ts)")
         + S.final(_CS_COLS, BASE,
                   "(SELECT d0.site_id, d0.ts, coalesce(d0.local_water_level_m, s.local_water_level_m) AS local_water_level_m, "
                   "coalesce(d0.rain_1h, s.rain_1h) AS rain_1h, coalesce(s.humidity, d0.humidity) AS humidity, "
                   "sat.v AS satellite_rainfall_mm_hr, soil.v AS satellite_soil_moisture "
                   "FROM d0 LEFT JOIN feed1 s ON d0.site_id = s.site_id AND d0.ts = s.ts "
                   "LEFT JOIN sat ON d0.site_id = sat.site_id AND d0.ts = sat.ts "
                   "LEFT JOIN soil ON d0.site_id = soil.site_id AND d0.ts = soil.ts)"))(_combine_sources)


# --- W1-W4, W9, W10, P8 -----------------------------------------------------

_LAGF = ["rain_1h", "local_water_level_m"]
_LAGS = [f"{f}_lag_{i}h" for f in _LAGF for i in range(1, 25)]

register("lags_24h", DI + _win_sql({**{c: c for c in COLS}, **{
    f"{f}_lag_{i}h": f"lag({f}, {i}) OVER ({S.W})" for f in _LAGF for i in range(1, 25)}}, "imputed"))(
    lambda spark, d: _sel(features.lags(imputed(spark, d, keep_chunk=True), _LAGF, 24, SPEC), BASE + COLS + _LAGS))

_WINS = [3, 6, 12, 24]
for _key, _col, _how, _fn in (("rolling_sum_rain", "rain_1h", "sum", "sum"),
                              ("rolling_avg_level", "local_water_level_m", "avg", "avg"),
                              ("rolling_std_level", "local_water_level_m", "std", "stddev_samp")):
    _names = [f"{_col}_{_how}_{n}h" for n in _WINS]
    register(_key, DI + _win_sql({_col: _col, **{
        f"{_col}_{_how}_{n}h": f"{_fn}({_col}) OVER ({S.W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in _WINS}},
        "imputed"))(
        (lambda c, h, names: lambda spark, d: _sel(features.rolling(imputed(spark, d, keep_chunk=True), [c], _WINS, h, SPEC),
                                                   BASE + [c] + names))(_col, _how, _names))

_LEAD = "lead(local_water_level_m, 1) OVER (PARTITION BY site_id ORDER BY ts)"

register("label_level", DI + S.final(
    ["local_water_level_m", "water_level_next_1h"], BASE + ["is_flood_next_1h"],
    f"(SELECT site_id, ts, local_water_level_m, {_LEAD} AS water_level_next_1h, "
    f"coalesce(CAST({_LEAD} > 1.5 AS INTEGER), 0) AS is_flood_next_1h FROM imputed)"))(
    lambda spark, d: _sel(features.label_level(imputed(spark, d, keep_chunk=True), spec=SPEC),
                          BASE + ["local_water_level_m", "water_level_next_1h", "is_flood_next_1h"]))

register("label_exceeds", DI + S.final(
    ["local_water_level_m"], BASE + ["is_flood_next_1h"],
    f"(SELECT site_id, ts, local_water_level_m, coalesce(CAST({_LEAD} > 1.5 AS INTEGER), 0) AS is_flood_next_1h "
    "FROM imputed)"))(
    lambda spark, d: _sel(features.label_exceeds(imputed(spark, d, keep_chunk=True), spec=SPEC),
                          BASE + ["local_water_level_m", "is_flood_next_1h"]))

_DI_LAGS = [f"local_water_level_m_lag_{i}h" for i in (1, 2, 3)]


def _drop_incomplete(spark, d):
    x = features.lags(dense(spark, d), ["local_water_level_m"], 3, SPEC)
    x = features.label_level(x, spec=SPEC)
    return _sel(features.drop_incomplete(x), BASE + ["local_water_level_m"] + _DI_LAGS
                + ["water_level_next_1h", "is_flood_next_1h"])


register("drop_incomplete", D + S.final(
    ["local_water_level_m"] + _DI_LAGS + ["water_level_next_1h"], BASE + ["is_flood_next_1h"],
    "(SELECT site_id, ts, local_water_level_m, "
    + ", ".join(f"lag(local_water_level_m, {i}) OVER ({S.W}) AS local_water_level_m_lag_{i}h" for i in (1, 2, 3))
    + f", {_LEAD} AS water_level_next_1h, coalesce(CAST({_LEAD} > 1.5 AS INTEGER), 0) AS is_flood_next_1h FROM dense)",
    " AND ".join(f"{c} IS NOT NULL" for c in _DI_LAGS + ["water_level_next_1h"])))(_drop_incomplete)


# --- C1-C5, C8, C10, D1 -----------------------------------------------------

_CAL = {
    "hour_of_day": f"hour({LOCAL})", "day_of_week": f"isodow({LOCAL}) - 1", "month": f"month({LOCAL})",
    "day_of_year": f"dayofyear({LOCAL})", "week_of_year": f"weekofyear({LOCAL})",
    "is_weekend": f"CASE WHEN isodow({LOCAL}) >= 6 THEN 1 ELSE 0 END", "quarter": f"quarter({LOCAL})",
}

register("calendar_local", "SELECT event_id, ts, " + ", ".join(
    f"CAST({e} AS INTEGER) AS {c}" for c, e in _CAL.items()) + " FROM events")(
    lambda spark, d: finish(features.calendar_features(
        staging.table(spark, d, "events").select("event_id", "ts"), TZ)))

_MS = C.SYNODIC_MONTH_DAYS * 24 * 3600
_LUNAR_SQL = (f"((((epoch_us(ts) / 1000000.0 - {float(C.LUNAR_REFERENCE_EPOCH_S)!r}) % {_MS!r}) + {_MS!r}) % {_MS!r})"
              f" / {_MS!r} * 8.0")

register("lunar_phase", f"SELECT event_id, ts, {S.rnd(_LUNAR_SQL)} AS lunar_phase FROM events")(
    lambda spark, d: finish(features.with_lunar_phase(staging.table(spark, d, "events").select("event_id", "ts"))))


def _epoch_roundtrip(spark, d):
    o = staging.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    o = o.withColumn("epoch_s", T.to_epoch("o_orderdate"))
    o = o.withColumn("roundtrip", T.from_epoch("epoch_s"))
    return finish(o.withColumn("local_ts", T.to_local("roundtrip", TZ))
                   .withColumn("same", F.col("roundtrip") == F.col("o_orderdate")))


register("epoch_roundtrip",
         "SELECT o_orderkey, o_orderdate, CAST(epoch(o_orderdate) AS BIGINT) AS epoch_s, "
         "TIMESTAMP '1970-01-01' + to_seconds(CAST(epoch(o_orderdate) AS BIGINT)) AS roundtrip, "
         "o_orderdate + INTERVAL 7 HOUR AS local_ts, "
         "(TIMESTAMP '1970-01-01' + to_seconds(CAST(epoch(o_orderdate) AS BIGINT))) = o_orderdate AS same FROM orders")(
    _epoch_roundtrip)


def _cyc_sql(x: str, period: float, fn: str) -> str:
    return f"{fn}(CAST({x} AS DOUBLE) * {2 * math.pi / period!r})"


_CYC = {}
for _n, _x, _p in (("hour", f"hour({LOCAL})", 24.0), ("dow", f"isodow({LOCAL}) - 1", 7.0),
                   ("month", f"month({LOCAL})", 12.0)):
    _CYC[f"{_n}_sin"] = _cyc_sql(_x, _p, "sin")
    _CYC[f"{_n}_cos"] = _cyc_sql(_x, _p, "cos")

register("cyclic_time", S.final(list(_CYC), ["event_id", "ts", "is_day"],
                                "(SELECT event_id, ts, " + ", ".join(f"{e} AS {c}" for c, e in _CYC.items())
                                + f", CAST(hour({LOCAL}) BETWEEN 6 AND 17 AS INTEGER) AS is_day FROM events)"))(
    lambda spark, d: finish(features.cyclic_features(staging.table(spark, d, "events").select("event_id", "ts"), TZ)))


def _harm_sql(t: str, h) -> str:
    per, amp, off = h
    return f"sin(CAST({t} AS DOUBLE) * {2 * math.pi / per!r}) * {float(amp)!r} + {float(off)!r}"


_HSQL = {"tide_m": _harm_sql("epoch(ts) / 3600", C.TIDE_HARMONIC),
         "daily_m": _harm_sql("epoch(ts) / 3600", C.DAILY_HARMONIC),
         "seasonal_m": _harm_sql(f"dayofyear({LOCAL})", C.SEASONAL_HARMONIC)}


def _harmonic(spark, d):
    g = grid(spark, d)
    h = T.hour_index("ts")
    doy = F.dayofyear(T.to_local("ts", TZ))
    return finish(g.withColumns({"tide_m": T.harmonic(h, *C.TIDE_HARMONIC),
                                 "daily_m": T.harmonic(h, *C.DAILY_HARMONIC),
                                 "seasonal_m": T.harmonic(doy, *C.SEASONAL_HARMONIC)}))


register("harmonic_baseline", S.with_(S.OBS, S.SPANS, S.GRID) + S.final(
    list(_HSQL), BASE, "(SELECT site_id, ts, " + ", ".join(f"{e} AS {c}" for c, e in _HSQL.items()) + " FROM grid)"))(
    _harmonic)

register("rainy_season", "SELECT o_orderkey, o_orderdate, month(o_orderdate) BETWEEN 5 AND 10 AS is_rainy_season "
                         "FROM orders")(
    lambda spark, d: staging.table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", T.is_rainy_season("o_orderdate").alias("is_rainy_season")))


# --- P4, P5, P10-P12 --------------------------------------------------------

_PAIRS = (("rain_1h", "humidity", "rain_x_humidity"),
          ("local_water_level_m", "rain_1h", "level_x_rain"),
          ("humidity", "temperature", "humidity_x_temperature"))

register("interactions", DI + S.final(["rain_x_humidity", "level_x_rain", "humidity_x_temperature"], BASE,
                                      "(SELECT site_id, ts, rain_1h * humidity AS rain_x_humidity, "
                                      "local_water_level_m * rain_1h AS level_x_rain, "
                                      "CAST(0.0 AS DOUBLE) AS humidity_x_temperature FROM imputed)"))(
    lambda spark, d: _sel(features.interactions(imputed(spark, d), _PAIRS),
                          BASE + [p[2] for p in _PAIRS]))

register("static_site_columns", S.with_(S.OBS, S.SPANS, S.GRID, S.DENSE, S.SITES) + S.final(
    ["elevation_m", "local_water_level_m"], BASE + ["site_name"],
    "(SELECT d.site_id, d.ts, s.site_name, s.elevation_m, d.local_water_level_m "
    "FROM dense d LEFT JOIN sites s ON d.site_id = s.site_id)"))(
    lambda spark, d: _sel(features.with_static(dense(spark, d), staging.sites(spark, d),
                                               ["site_name", "elevation_m"]),
                          BASE + ["site_name", "elevation_m", "local_water_level_m"]))


def _clip(spark, d):
    x = dense(spark, d).select(*BASE, "local_water_level_m",
                               F.col("local_water_level_m").alias("level_floor"),
                               F.col("local_water_level_m").alias("level_nonneg"))
    x = features.clip_floor(x, "level_floor", C.LEVEL_FLOOR_M, "max")
    return finish(features.clip_floor(x, "level_nonneg", C.LEVEL_FLOOR_M, "negative"))


register("clip_floor", D + S.final(["local_water_level_m", "level_floor", "level_nonneg"], BASE,
                                   "(SELECT site_id, ts, local_water_level_m, "
                                   "CASE WHEN local_water_level_m IS NULL THEN NULL ELSE greatest(local_water_level_m, 0.05) END AS level_floor, "
                                   "CASE WHEN local_water_level_m < 0 THEN 0.05 ELSE local_water_level_m END AS level_nonneg "
                                   "FROM dense)"))(_clip)

_ORDER = ["rain_1h", "humidity", "temperature", "local_water_level_m", "pressure"]


def _align(spark, d):
    from hydroseries.operators.scaling import align_columns
    return finish(align_columns(dense(spark, d), _ORDER, keep=BASE))


register("align_columns", D + S.final(_ORDER, BASE, "(SELECT site_id, ts, coalesce(rain_1h, 0.0) AS rain_1h, "
                                                    "coalesce(humidity, 0.0) AS humidity, CAST(0.0 AS DOUBLE) AS temperature, "
                                                    "coalesce(local_water_level_m, 0.0) AS local_water_level_m, "
                                                    "CAST(0.0 AS DOUBLE) AS pressure FROM dense)"))(_align)


# --- M3: the flagship -------------------------------------------------------

FEATURES_CFG = FeatureConfig()


def features_full(spark: SparkSession, d: str, spec=SPEC) -> DataFrame:
    """obs -> dense grid -> F1 imputation -> one-pass
    features and labels -> drop incomplete rows."""
    sites = staging.sites(spark, d).select("site_id", "elevation_m")
    out = features.build_features(history(spark, d, spec, static=sites, keep_chunk=True), FEATURES_CFG, spec)
    return finish(out.drop(timegrid.CHUNK))


def features_full_sql(cfg: FeatureConfig = FEATURES_CFG, names: list[str] | None = None) -> str:
    """``names``, if given, receives the output columns besides the keys."""
    hist = ("hist AS (SELECT i.*, s.elevation_m FROM imputed i LEFT JOIN sites s ON i.site_id = s.site_id)")
    base_cols = ["local_water_level_m", "rain_1h", "humidity", "sea_level_m"]
    ints = {c: f"CAST({e} AS INTEGER)" for c, e in _CAL.items()}
    dbl: dict[str, str] = {"lunar_phase": _LUNAR_SQL}
    for f in cfg.lag_features:
        for i in range(1, cfg.lag_depth + 1):
            dbl[f"{f}_lag_{i}h"] = f"lag({f}, {i}) OVER ({S.W})"
    for how, cols, fn in (("sum", cfg.rainfall_columns, "sum"), ("avg", cfg.level_columns, "avg"),
                          ("std", cfg.level_columns, "stddev_samp")):
        for c in cols:
            for n in cfg.rolling_windows:
                dbl[f"{c}_{how}_{n}h"] = (f"{fn}({c}) OVER ({S.W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
                                          if c in base_cols else "CAST(0.0 AS DOUBLE)")
    lead = f"lead({cfg.target_level_column}, {cfg.horizon_hours}) OVER ({S.W})"
    dbl["water_level_next_1h"] = lead
    ints["is_flood_next_1h"] = f"coalesce(CAST({lead} > {cfg.flood_threshold_m!r} AS INTEGER), 0)"
    dbl["elevation_m"] = "elevation_m"
    for a, b, name in cfg.interaction_pairs:
        dbl[name] = f"{a} * {b}" if a in base_cols and b in base_cols else "CAST(0.0 AS DOUBLE)"
    inner = ("(SELECT site_id, ts, " + ", ".join(base_cols) + ", "
             + ", ".join(f"{e} AS {c}" for c, e in {**ints, **dbl}.items()) + " FROM hist)")
    if names is not None:
        names += base_cols + list(ints) + list(dbl)
    need = [c for c in dbl if any(p in c for p in C.INCOMPLETE_NAME_PARTS)] + ["water_level_next_1h", "is_flood_next_1h"]
    return (S.with_(S.OBS_SEA, S.SPANS, S.GRID, S.DENSE_SEA, S.imputed_cte(cols=(*S.COLS, "sea_level_m")), S.SITES, hist)
            + S.final(base_cols + list(dbl), BASE + list(ints), inner,
                      " AND ".join(f"{c} IS NOT NULL" for c in need)))


register("features_full", features_full_sql())(features_full)

# The same pipeline cut into 48-hour chunks (15 chunk boundaries inside the
# month of data): halos and cross-chunk carries checked against the same SQL.
register("features_full_chunk48", features_full_sql())(
    lambda spark, d: features_full(spark, d, SPEC.with_chunk(48)))
