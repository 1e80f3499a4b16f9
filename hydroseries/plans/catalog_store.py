"""Driver queries for stored tables: late rows, quarantined documents, pixel store, sketches, as-of join,
positional split, local hours, scaler store."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from hydroseries import config as C
from hydroseries.functions.time import hour_index
from hydroseries.operators import asof, sketch, split, timegrid
from hydroseries.plans import catalog_raster as raster_queries
from hydroseries.plans import pipeline
from hydroseries.plans import sqlkit as S
from hydroseries.plans import staging
from hydroseries.plans.catalog_model import _FC_NUM, _FC_SQL, forecast_docs
from hydroseries.plans.catalog_series import BASE, COLS, DI, FEATURES_CFG, SPEC, _sel, features_full_sql, history, obs
from hydroseries.plans.registry import ORACLE, finish, register
from hydroseries.session import materialize, scratch_path
from hydroseries.sources import history as store
from hydroseries.sources import io, pixels


def _folder(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


# --- S4 / E-1: late rows ----------------------------------------------------

def _history_late_rows(spark, d):
    """Every fifth hour and the last days arrive after the build, in two appends."""
    hourly = materialize(obs(spark, d), "checkpoint")
    h, path, spec = hour_index("ts"), _folder(spark, "late"), SPEC.with_chunk(48)
    last = hourly.agg(F.max(h)).first()[0] or 0
    late, newest = F.pmod(h, F.lit(5)) == 0, h > last - 72
    store.create(hourly.filter(~late & ~newest), path, COLS, spec, buckets=4)
    store.append(spark, path, hourly.filter(late & ~newest), COLS, spec)
    store.append(spark, path, hourly.filter(newest), COLS, spec)
    return _sel(store.read(spark, path), BASE + COLS)


register("history_late_rows", DI + S.final(COLS, BASE, "imputed"))(_history_late_rows)


# --- S2 with quarantine, D6 -------------------------------------------------

def _landing(spark, d):
    """The forecast documents, some cut off, some with a text for the time, some without list or time."""
    k = F.pmod(F.get_json_object("doc", "$.list[0].dt").cast("long"), F.lit(11))
    doc = F.col("doc")
    broken = (F.when(k == 0, F.substring(doc, F.lit(1), F.length(doc) - 3))
              .when(k == 1, F.regexp_replace(doc, r'"dt":(\d+)', '"dt":"at $1"'))
              .when(k == 2, F.replace(doc, F.lit('"list"'), F.lit('"rows"')))
              .when(k == 3, F.regexp_replace(doc, r'"dt":\d+,', ""))
              .otherwise(doc))
    return forecast_docs(spark, d).select("site_id", broken.alias("doc"))


def _landed(spark, d):
    path = _folder(spark, "landed")
    io.land_documents(_landing(spark, d), path)
    return path


register("forecast_quarantine", (
    "SELECT event_type AS site_id, CASE CAST(floor(epoch(ts)) AS BIGINT) % 11 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'corrupt' "
    "WHEN 2 THEN 'no list' ELSE 'no time' END AS error, count(*) AS n FROM events "
    "WHERE CAST(floor(epoch(ts)) AS BIGINT) % 11 < 4 GROUP BY 1, 2"))(
    lambda spark, d: io.quarantined(spark, _landed(spark, d)).groupBy("site_id", "error").agg(F.count(F.lit(1)).alias("n")))

register("forecast_landed", S.with_(_FC_SQL) + S.final(
    _FC_NUM, BASE + ["weather_main", "weather_description"], "fc", "CAST(epoch(ts) AS BIGINT) % 11 >= 4"))(
    lambda spark, d: finish(io.landed_forecast(spark, _landed(spark, d))))


def _forecast_extras(spark, d):
    """Documents with the optional fields, one per event, landed as files and read back."""
    path = _folder(spark, "extras")
    v = F.col("value")
    item = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
                    F.struct((v / 10.0).alias("temp"), (v / 20.0).alias("temp_min"), (v / 5.0).alias("temp_max"), (v / 40.0).alias("dew_point")).alias("main"),
                    F.when(v > 100, v * 10.0).alias("visibility"), F.struct((v / 8.0).alias("all")).alias("clouds"))
    ev = staging.events_as_series(staging.table(spark, d, "events"))
    ev.select(F.to_json(F.struct("site_id", F.array(item).alias("list"))).alias("value")).write.text(path)
    out = io.read_forecast(spark, path, multiline=False, extras=True)
    return finish(out.select(*BASE, "temperature", "temp_min", "temp_max", "dew_point", "visibility", "cloud_cover"))


register("forecast_extras", S.final(
    ["temperature", "temp_min", "temp_max", "dew_point", "visibility", "cloud_cover"], BASE,
    "(SELECT event_type AS site_id, date_trunc('second', ts) AS ts, value / 10.0 AS temperature, value / 20.0 AS temp_min, "
    "value / 5.0 AS temp_max, value / 40.0 AS dew_point, CASE WHEN value > 100 THEN value * 10.0 END AS visibility, "
    "value / 8.0 AS cloud_cover FROM events)"))(_forecast_extras)


# --- R1, R5: pixel store ----------------------------------------------------

def _stored_water_extent(spark, d):
    px, sc, st = raster_queries._inputs(spark, d)
    path = _folder(spark, "pixels")
    pixels.write_pixels(px, sc, path)
    return raster_queries.water_extents(pixels.read_pixels(spark, path), sc, st)


register("pixel_store", ORACLE["water_extent"])(_stored_water_extent)


# --- A2, A3: sketches -------------------------------------------------------

_QS = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _sketch_error(spark, d):
    """Whether the quantiles merged from daily sketches lie within the stated rank error of the exact ones."""
    raw = staging.events_as_series(staging.table(spark, d, "events")).select("site_id", "ts", "value")
    path = _folder(spark, "sketches")
    sketch.daily_sketches(raw, ["value"]).write.partitionBy("date").parquet(path)  # stored, then merged over all days
    got = sketch.quantiles(sketch.merged(spark.read.parquet(path)), _QS).select("site_id", "n", *_QS)
    known = raw.join(got.drop("n"), "site_id")
    ranks = known.groupBy("site_id").agg(*[f(q).alias(f"{s}_{q}") for q in _QS for s, f in (
        ("lo", lambda q: F.avg((F.col("value") < F.col(q)).cast("double"))), ("hi", lambda q: F.avg((F.col("value") <= F.col(q)).cast("double"))))])
    bound = sketch.RANK_ERROR[sketch.K]
    near = F.lit(True)
    for q, p in _QS.items():  # the rank interval of the estimate reaches within the bound
        near &= (F.col(f"lo_{q}") <= p + bound) & (F.col(f"hi_{q}") >= p - bound)
    return got.join(ranks, "site_id").select("site_id", "n", near.alias("within_bound"))


register("quantile_sketch", "SELECT event_type AS site_id, count(value) AS n, true AS within_bound FROM events GROUP BY 1")(_sketch_error)


# --- J6 at irregular times --------------------------------------------------

def _asof_orders(spark, d):
    """Each order's last event of its customer group within six hours, at minutes, so times tie."""
    o = staging.table(spark, d, "orders")
    minute = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("o_orderkey") * 7919, F.lit(43200)) * 60).cast("timestamp_ntz")
    left = o.select("o_orderkey", (F.col("o_custkey") % 100).alias("grp"), minute.alias("t"))
    ev = staging.table(spark, d, "events")
    right = ev.select((F.col("user_id") % 100).alias("grp"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("s"), "value")
    return finish(asof.asof_join(left, right, ["grp"], "t", ["value"], "s", 6 * 3600, matched_on="event_minute"))


register("asof_orders", (
    "WITH l AS (SELECT o_orderkey, o_custkey % 100 AS grp, TIMESTAMP '2024-01-01' + to_minutes(CAST((o_orderkey * 7919) % 43200 AS INTEGER)) AS t FROM orders), "
    "r AS (SELECT user_id % 100 AS grp, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS s, max(value) AS value FROM events GROUP BY 1, 2), "
    "j AS (SELECT l.*, r.s, r.value FROM l ASOF LEFT JOIN r ON l.grp = r.grp AND l.t >= r.s) "
    "SELECT o_orderkey, grp, t, CASE WHEN t - s <= INTERVAL 6 HOUR THEN round(value, 9) + 0.0 END AS value, "
    "CASE WHEN t - s <= INTERVAL 6 HOUR THEN s END AS event_minute FROM j"))(_asof_orders)


# --- W12 by position, A1 by local hours -------------------------------------

def _split_position(spark, d):
    ev = staging.table(spark, d, "events").select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return split.positional_split(ev, "ts", [], ["event_id"])


def _position_sql(src: str, order: str, part: str) -> str:
    return ("SELECT * EXCLUDE (r, c), CASE WHEN r < floor(floor(c * CAST(0.8 AS DOUBLE)) * CAST(0.8 AS DOUBLE)) THEN 'train' "
            "WHEN r < floor(c * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, "
            f"row_number() OVER ({part} ORDER BY {order}) - 1 AS r, count(*) OVER ({part}) AS c FROM {src})")


register("time_split_position", _position_sql(
    "(SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts FROM events)", "ts, event_id", ""))(_split_position)

register("time_split_position_groups", _position_sql(
    "(SELECT event_type AS site_id, event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts FROM events)", "ts, event_id", "PARTITION BY site_id"))(
    lambda spark, d: split.positional_split(staging.table(spark, d, "events").select(
        F.col("event_type").alias("site_id"), "event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")), "ts", ["site_id"], ["event_id"]))

_KOLKATA = "date_trunc('hour', ts + INTERVAL 330 MINUTE) - INTERVAL 330 MINUTE"  # no clock changes there


def _kolkata(spark, d):
    """Hourly means by the hours of a zone half an hour off, on that zone's grid."""
    ev = staging.events_as_series(staging.table(spark, d, "events"))
    hourly = materialize(timegrid.resample_local(ev, {"value_mean": F.avg("value"), "n": F.count("value")}, "Asia/Kolkata", SPEC), "checkpoint")
    grid = timegrid.local_hourly_grid(timegrid.series_spans(hourly, SPEC), "Asia/Kolkata", SPEC)
    return finish(timegrid.reindex(grid, hourly, SPEC).select(*BASE, "value_mean", "n"))


register("local_hours_kolkata", (
    f"WITH h AS (SELECT event_type AS site_id, CAST({_KOLKATA} AS TIMESTAMP) AS ts, avg(value) AS value_mean, count(value) AS n FROM events GROUP BY 1, 2), "
    "g AS (SELECT site_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY site_id) "
    "SELECT g.site_id, g.ts, round(value_mean, 9) + 0.0 AS value_mean, n FROM g LEFT JOIN h ON g.site_id = h.site_id AND g.ts = h.ts"))(_kolkata)


# --- M4, S5, P3, P4: scaler stored and applied ------------------------------

def _preprocess_stored(spark, d):
    """Scaler and feature order fitted in train mode, stored, loaded and applied in predict mode."""
    hist = materialize(history(spark, d, static=staging.sites(spark, d).select("site_id", "elevation_m")), "checkpoint")
    _, scaler, _ = pipeline.preprocess(hist, "train", FEATURES_CFG, SPEC)
    path = _folder(spark, "scaler")
    io.save_scaler(scaler, path)
    loaded = io.load_scaler(spark, path)
    order = [r["feature"] for r in loaded.select("feature", "ordinal").orderBy("ordinal").collect()]
    scaled, _, _ = pipeline.preprocess(hist, "predict", FEATURES_CFG, SPEC, loaded, order)
    return finish(scaled.withColumns({c: F.round(c, 6) for c in order}))


def _preprocess_sql() -> str:
    names: list[str] = []
    # the features unrounded: scaling would enlarge the rounding
    full = re.sub(r"\(round\((\w+), 9\) \+ 0\.0\) AS \1", r"\1", features_full_sql(names=names))
    out = []
    for c in names:
        if c in C.ALL_TARGET_COLUMNS:
            out.append(f"round({c}, 9) + 0.0 AS {c}" if c == C.TARGET_REGRESSION else c)
        else:
            x = f"coalesce(CAST({c} AS DOUBLE), 0.0)"
            out.append(f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN {x} - min({c}) OVER () "
                       f"ELSE ({x} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 6) + 0.0 AS {c}")
    return f"SELECT site_id, ts, {', '.join(out)} FROM ({full})"


register("preprocess_stored", _preprocess_sql())(_preprocess_stored)
