"""Driver queries for scaling, splitting, guards, outliers, evaluation,
interpretation and the forecast JSON source, each with its oracle SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hydroseries.operators import evaluate, features, fill, scaling, score, split, stats, timegrid
from hydroseries.plans import sqlkit as S
from hydroseries.plans import staging
from hydroseries.plans.catalog_series import BASE, DI, SPEC, imputed, obs
from hydroseries.plans.registry import finish, register
from hydroseries.session import materialize
from hydroseries.sources import io

AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
_MSG = ("CASE WHEN count(*) < 25 THEN 'Not enough real-time data in window. Need at least 25 hours, got ' "
        "|| CAST(count(*) AS VARCHAR) || '.' END AS message")
D8 = "CAST(0.8 AS DOUBLE)"

# --- M1, M2 (lineitem) ------------------------------------------------------

_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "has_line"]


def _lineitem(spark, d):
    li = staging.table(spark, d, "lineitem")
    return li.withColumn("has_line", (F.col("l_linenumber") >= 1).cast("double"))


_LI_SQL = "li AS (SELECT *, CAST(l_linenumber >= 1 AS DOUBLE) AS has_line FROM lineitem)"

register("minmax_fit", S.with_(_LI_SQL) + S.final(["min", "max"], ["ordinal", "feature"], "(" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS feature, min({c}) AS min, max({c}) AS max FROM li"
    for i, c in enumerate(_LI)) + ")"))(
    lambda spark, d: finish(scaling.fit_minmax(_lineitem(spark, d), _LI)))


def _minmax_apply(spark, d):
    li = _lineitem(spark, d)
    return finish(scaling.apply_minmax(li, scaling.fit_minmax(li, _LI), keep=["l_orderkey", "l_linenumber"]))


register("minmax_apply", S.with_(_LI_SQL, "mm AS (SELECT " + ", ".join(
    f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _LI) + " FROM li)") + S.final(
    _LI, ["l_orderkey", "l_linenumber"], "(SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"CASE WHEN mx_{c} = mn_{c} THEN {c} - mn_{c} ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END AS {c}"
        for c in _LI) + " FROM li, mm)"))(_minmax_apply)


# --- W12, W11, Z4 -----------------------------------------------------------

def _split_sql(src: str, keys: str, part: str) -> str:
    over = f"OVER ({part} ORDER BY ts)" if part else "OVER (ORDER BY ts)"
    cnt = f"OVER ({part})" if part else "OVER ()"
    return (f"SELECT {keys}, ts, CASE WHEN rk < floor(floor(n * {D8}) * {D8}) THEN 'train' "
            f"WHEN rk < floor(n * {D8}) THEN 'val' ELSE 'test' END AS split FROM "
            f"(SELECT {keys}, ts, row_number() {over} - 1 AS rk, count(*) {cnt} AS n FROM {src})")


register("time_split", S.with_(S.OBS) + _split_sql("obs", "site_id", "PARTITION BY site_id"))(
    lambda spark, d: split.time_split(obs(spark, d).select(*BASE), "ts", ["site_id"], 0.2, 0.2))

register("time_split_global", _split_sql("events", "event_id", ""))(
    lambda spark, d: split.time_split(staging.table(spark, d, "events").select("event_id", "ts"), "ts", [], 0.2, 0.2))

register("latest_row", S.with_(S.OBS) + S.final(list(staging.OBS_COLS), BASE,
                                               "(SELECT * FROM obs QUALIFY row_number() OVER "
                                               "(PARTITION BY site_id ORDER BY ts DESC) = 1)"))(
    lambda spark, d: finish(split.latest(obs(spark, d), SPEC)))

register("require_history", S.with_(S.OBS, "e AS (SELECT site_id, max(ts) AS e FROM obs GROUP BY 1)")
         + "SELECT o.site_id, count(*) AS n_rows, CAST(25 AS BIGINT) AS needed, count(*) >= 25 AS sufficient, "
           + _MSG + " FROM obs o JOIN e ON o.site_id = e.site_id WHERE o.ts > e.e - INTERVAL 30 HOUR GROUP BY 1")(
    lambda spark, d: split.require_history(obs(spark, d), 25, 30, SPEC))


# --- Q1 ---------------------------------------------------------------------

_IQR_OUT = ["q1", "q3", "lower", "upper"]


def _iqr_sql(src: str, by: str, v: str, keys: list[str]) -> str:
    q = (f"q AS (SELECT {by}, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 "
         f"FROM {src} GROUP BY 1)")
    inner = (f"(SELECT {', '.join('x.' + k + ' AS ' + k for k in keys)}, x.{v} AS {v}, q.q1, q.q3, "
             f"q.q1 - 1.5 * (q.q3 - q.q1) AS lower, q.q3 + 1.5 * (q.q3 - q.q1) AS upper, "
             f"coalesce(x.{v} < q.q1 - 1.5 * (q.q3 - q.q1) OR x.{v} > q.q3 + 1.5 * (q.q3 - q.q1), false) AS is_outlier "
             f"FROM {src} x LEFT JOIN q ON x.{by} = q.{by})")
    return q, S.final([v] + _IQR_OUT, keys + ["is_outlier"], inner)


_q, _f = _iqr_sql("lineitem", "l_returnflag", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_returnflag"])
register("iqr_outliers", S.with_(_q) + _f)(
    lambda spark, d: finish(stats.iqr_outliers(
        staging.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"),
        "l_extendedprice", 1.5, ["l_returnflag"])))

_q, _f = _iqr_sql("imputed", "site_id", "local_water_level_m", BASE)
register("iqr_outliers_level", DI[:-1] + ",\n" + _q + "\n" + _f)(
    lambda spark, d: finish(stats.iqr_outliers(imputed(spark, d).select(*BASE, "local_water_level_m"),
                                               "local_water_level_m", 1.5, ["site_id"])))


# --- E1-E6, Z2, Z3 ----------------------------------------------------------

def eval_base(spark, d):
    """Labels of the imputed series and a score = min-max scaled current level."""
    # The labelled table feeds the scaler fit and the metrics: cut it once.
    x = materialize(features.label_level(imputed(spark, d), spec=SPEC)
                    .withColumn("score", F.col("local_water_level_m")), "checkpoint")
    keep = BASE + ["local_water_level_m", "water_level_next_1h", "is_flood_next_1h"]
    x = scaling.apply_minmax(x, scaling.fit_minmax(x, ["score"]), keep=keep)
    x = x.withColumnRenamed("is_flood_next_1h", "label")
    return evaluate.to_class(x, "score", 0.5)


_LEAD = "lead(local_water_level_m, 1) OVER (PARTITION BY site_id ORDER BY ts)"
EV = DI[:-1] + ",\n" + (
    f"lab AS (SELECT site_id, ts, local_water_level_m, {_LEAD} AS water_level_next_1h, "
    f"coalesce(CAST({_LEAD} > 1.5 AS INTEGER), 0) AS label FROM imputed),\n"
    "mm AS (SELECT min(local_water_level_m) AS mn, max(local_water_level_m) AS mx FROM lab),\n"
    "ev0 AS (SELECT lab.*, CASE WHEN mx = mn THEN local_water_level_m - mn "
    "ELSE (local_water_level_m - mn) / (mx - mn) END AS score FROM lab, mm),\n"
    "ev AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS prediction FROM ev0),\n"
    "cnt AS (SELECT count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 0 AND prediction = 1) AS fp, "
    "count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 1 AND prediction = 1) AS tp FROM ev)\n")

register("confusion_matrix", EV + "SELECT a.actual, a.predicted, CAST(count(e.label) AS BIGINT) AS n "
                                  "FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) a(actual, predicted) "
                                  "LEFT JOIN ev e ON e.label = a.actual AND e.prediction = a.predicted GROUP BY 1, 2")(
    lambda spark, d: evaluate.confusion_matrix(eval_base(spark, d), "label", "prediction"))


def _dv(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def _f1(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END"


_PR = (f"pr AS (SELECT {_dv('tn', 'tn + fn')} AS p0, {_dv('tn', 'tn + fp')} AS r0, "
       f"{_dv('tp', 'tp + fp')} AS p1, {_dv('tp', 'tp + fn')} AS r1, tn + fp AS s0, tp + fn AS s1, "
       "tn + fp + tp + fn AS n FROM cnt), "
       f"pf AS (SELECT *, {_f1('p0', 'r0')} AS f0, {_f1('p1', 'r1')} AS f1 FROM pr)\n")

register("classification_report", EV[:-1] + ",\n" + _PR + S.final(
    ["precision", "recall", "f1_score"], ["class", "support"], "(" + " UNION ALL ".join([
        "SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, CAST(s0 AS BIGINT) AS support FROM pf",
        "SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM pf",
        "SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(n AS BIGINT) FROM pf",
        f"SELECT 'weighted avg', {_dv('p0 * s0 + p1 * s1', 'n')}, {_dv('r0 * s0 + r1 * s1', 'n')}, "
        f"{_dv('f0 * s0 + f1 * s1', 'n')}, CAST(n AS BIGINT) FROM pf"]) + ")"))(
    lambda spark, d: finish(evaluate.classification_report(eval_base(spark, d), "label", "prediction")))

register("accuracy", EV + S.final(["accuracy"], ["n"], "(SELECT avg(CAST(label = prediction AS DOUBLE)) AS accuracy, "
                                                       "count(*) AS n FROM ev)"))(
    lambda spark, d: finish(evaluate.accuracy(eval_base(spark, d), "label", "prediction")))

register("roc_auc", EV[:-1] + ",\n" + (
    "g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM ev GROUP BY score), "
    "c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS nb FROM g)\n") + S.final(["roc_auc"], ["n_pos", "n_neg"], (
        "(SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (nb + neg / 2.0)) / "
        "(CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS roc_auc, CAST(sum(pos) AS BIGINT) AS n_pos, "
        "CAST(sum(neg) AS BIGINT) AS n_neg FROM c)")))(
    lambda spark, d: finish(evaluate.roc_auc(eval_base(spark, d), "label", "score")))

register("regression_metrics", EV + S.final(["rmse", "mse", "mae"], ["n"], (
    "(SELECT sqrt(avg((local_water_level_m - water_level_next_1h) * (local_water_level_m - water_level_next_1h))) AS rmse, "
    "avg((local_water_level_m - water_level_next_1h) * (local_water_level_m - water_level_next_1h)) AS mse, "
    "avg(abs(local_water_level_m - water_level_next_1h)) AS mae, count(*) AS n FROM ev "
    "WHERE water_level_next_1h IS NOT NULL)")))(
    lambda spark, d: finish(evaluate.regression_metrics(eval_base(spark, d), "water_level_next_1h",
                                                        "local_water_level_m")))

_TIMES = f"{AS_OF_SQL} AS prediction_time_utc, {AS_OF_SQL} + INTERVAL 7 HOUR AS prediction_time_local"

register("interpret_class", EV + S.final(
    ["prediction_score", "certainty"],
    BASE + ["predicted_is_flood", "message", "model_type", "prediction_time_utc", "prediction_time_local"],
    "(SELECT site_id, ts, score > 0.5 AS predicted_is_flood, score AS prediction_score, "
    "CASE WHEN score > 0.5 THEN score ELSE 1.0 - score END AS certainty, "
    "CASE WHEN score > 0.5 THEN 'Flood predicted for next hour.' ELSE 'No flood predicted for next hour.' END AS message, "
    f"'classification' AS model_type, {_TIMES} FROM ev)"))(
    lambda spark, d: finish(score.interpret_class(eval_base(spark, d).select(*BASE, F.col("score").alias("prediction_score")),
                                                  "prediction_score", 0.5, AS_OF)))

register("interpret_level", EV + S.final(
    ["predicted_water_level_m", "flood_threshold_m"],
    BASE + ["threshold_exceeded", "message", "model_type", "prediction_time_utc", "prediction_time_local"],
    "(SELECT site_id, ts, local_water_level_m AS predicted_water_level_m, CAST(1.5 AS DOUBLE) AS flood_threshold_m, "
    "local_water_level_m > 1.5 AS threshold_exceeded, "
    "CASE WHEN local_water_level_m > 1.5 THEN 'High water level predicted for next hour.' "
    "ELSE 'Normal water level predicted for next hour.' END AS message, "
    f"'regression' AS model_type, {_TIMES} FROM ev)"))(
    lambda spark, d: finish(score.interpret_level(
        eval_base(spark, d).select(*BASE, F.col("local_water_level_m").alias("predicted_water_level_m")),
        "predicted_water_level_m", 1.5, AS_OF)))


# --- S2, C6, C7, F3: forecast documents -------------------------------------

def forecast_docs(spark, d):
    """One forecast JSON document per event, written by Spark (``to_json``)."""
    ev = staging.events_as_series(staging.table(spark, d, "events"))
    v = F.col("value")
    k = staging.k_value("props")
    dbl = lambda x: F.lit(x).cast("double")
    weather_t = "array<struct<main:string,description:string>>"
    item = F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
        F.struct((v / 10.0).alias("temp"), k.alias("humidity"), (F.lit(1000.0) + k / 10.0).alias("pressure")).alias("main"),
        F.struct((v / 100.0).alias("speed"), (k * 3.6).alias("deg")).alias("wind"),
        F.struct(k.alias("all")).alias("clouds"),
        F.when(v > 100, F.array(F.struct(F.lit("Rain").alias("main"), F.lit("rain").alias("description"))))
         .otherwise(F.array().cast(weather_t)).alias("weather"),
        F.when(v > 200, F.struct((v / 100.0).alias("1h"), dbl(None).alias("3h")))
         .when(v > 100, F.struct(dbl(None).alias("1h"), (v / 50.0).alias("3h"))).alias("rain"))
    # documents land in many files: a table of one small file is dealt out before they are made
    ev, cores = ev.select("site_id", "ts", "value", "props"), spark.sparkContext.defaultParallelism
    if ev.rdd.getNumPartitions() < cores:
        ev = ev.repartition(cores)
    return ev.select("site_id", F.to_json(F.struct(F.array(item).alias("list"))).alias("doc"))


_FC_SQL = ("fc AS (SELECT event_type AS site_id, date_trunc('second', ts) AS ts, value / 10.0 AS temperature, "
           "k AS humidity, 1000.0 + k / 10.0 AS pressure, value / 100.0 AS wind_speed, k * CAST(3.6 AS DOUBLE) AS wind_deg, "
           "k AS clouds_all, CASE WHEN value > 100 THEN 'Rain' END AS weather_main, "
           "CASE WHEN value > 100 THEN 'rain' END AS weather_description, "
           "CASE WHEN value > 200 THEN value / 100.0 ELSE 0.0 END AS rain_1h, "
           "CASE WHEN value > 200 THEN 0.0 WHEN value > 100 THEN value / 50.0 ELSE 0.0 END AS rain_3h "
           "FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))")
_FC_NUM = ["temperature", "humidity", "pressure", "wind_speed", "wind_deg", "clouds_all", "rain_1h", "rain_3h"]

register("forecast_json", S.with_(_FC_SQL) + S.final(_FC_NUM, BASE + ["weather_main", "weather_description"], "fc"))(
    lambda spark, d: finish(io.parse_forecast(forecast_docs(spark, d), "doc")))

_FC_CONT = _FC_NUM[:6]


def _impute_forecast(spark, d):
    flat = io.parse_forecast(forecast_docs(spark, d), "doc")
    # The hourly table feeds the grid bounds, the join and both carries: cut once.
    hourly = materialize(timegrid.resample_mean(flat, _FC_NUM, SPEC), "checkpoint")
    return finish(fill.impute_forecast(timegrid.densify(hourly, SPEC, keep_chunk=True), SPEC, observed=hourly).select(*BASE, *_FC_NUM))


register("impute_forecast", S.with_(
    _FC_SQL,
    "fh AS (SELECT site_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, "
    + ", ".join(f"avg({c}) AS {c}" for c in _FC_NUM) + " FROM fc GROUP BY 1, 2)",
    "sp AS (SELECT site_id, min(ts) AS s, max(ts) AS e FROM fh GROUP BY 1)",
    "g AS (SELECT site_id, unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS ts FROM sp)",
    "dense AS (SELECT g.site_id, g.ts, " + ", ".join(f"fh.{c}" for c in _FC_NUM)
    + " FROM g LEFT JOIN fh ON g.site_id = fh.site_id AND g.ts = fh.ts)",
    "nb AS (SELECT *, " + ", ".join(S.neighbours(c) for c in _FC_CONT) + " FROM dense)")
    + S.final(_FC_NUM, BASE, "(SELECT site_id, ts, " + ", ".join(
        [f"{S.impute_expr(c)} AS {c}" for c in _FC_CONT]
        + [f"coalesce(last_value({c} IGNORE NULLS) OVER {S.UP}, 0.0) AS {c}" for c in _FC_NUM[6:]]) + " FROM nb)"))(
    _impute_forecast)
