"""Driver queries for guarded scoring with a trained model (A6, Z4 in Z1-Z3) and
the one-feature linear learner (M7), whose coefficients SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroseries import config as C
from hydroseries.config import FeatureConfig
from hydroseries.operators import features, learn, scaling
from hydroseries.plans import pipeline
from hydroseries.plans import sqlkit as S
from hydroseries.plans import staging
from hydroseries.plans.catalog_extra import _RT, AS_OF, WIN
from hydroseries.plans.catalog_series import BASE, COLS, DI, SPEC, imputed
from hydroseries.plans.registry import finish, register
from hydroseries.session import materialize

LEVEL = "local_water_level_m"
CFG = FeatureConfig(lag_features=("rain_1h", LEVEL), require_target=False)


def _linear(history):
    """Scaler and linear model of the next level on the current one."""
    lab = features.label_level(history, spec=SPEC).select(*BASE, LEVEL, C.TARGET_REGRESSION).dropna()
    lab = materialize(lab, "checkpoint")
    scaler = scaling.fit_minmax(lab, [LEVEL])
    x = scaling.apply_minmax(lab, scaler, keep=[*BASE, C.TARGET_REGRESSION])
    model = learn.train_regressor(x.withColumn(learn.VAL_COL, F.lit(False)), [LEVEL], learner="linear")
    return x, scaler, model


def _linear_level(spark, d):
    x, _, model = _linear(imputed(spark, d))
    return finish(learn.score(x, model, "regression").select(*BASE, C.TARGET_REGRESSION, "predicted_water_level_m"))


_FIT = ("lab AS (SELECT site_id, ts, local_water_level_m AS x, lead(local_water_level_m, 1) OVER "
        "(PARTITION BY site_id ORDER BY ts) AS y FROM {src}), "
        "fit AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM lab)")

register("linear_level", DI[:-1] + ",\n" + _FIT.format(src="imputed") + (
    "\nSELECT site_id, ts, round(y, 9) + 0.0 AS water_level_next_1h, round(a * x + b, 9) + 0.0 AS predicted_water_level_m "
    "FROM lab, fit WHERE y IS NOT NULL"))(_linear_level)


# --- guarded scoring ----------------------------------------------------------

def _stations(spark, d):
    """Each event type as a dense station (users whose id is no multiple of 4) and a sparse one."""
    ev = staging.events_as_series(staging.table(spark, d, "events"))
    part = F.when(F.col("user_id") % 4 == 0, "sparse").otherwise("dense")
    return ev.withColumn("site_id", F.concat_ws("-", "site_id", part))


def _score_guard(spark, d):
    raw = _stations(spark, d)
    _, scaler, model = _linear(imputed(spark, d))
    recent = materialize(pipeline.recent_hourly(raw, staging.obs_aggs(), AS_OF, WIN, SPEC), "checkpoint")
    known = raw.select("site_id").union(staging.table(spark, d, "nation").select("n_name")).distinct()
    window, report = pipeline.build_realtime_window(recent, COLS, AS_OF, WIN, SPEC, CFG.history_rows_needed, sites=known)
    out = pipeline.score_latest(window, model, "regression", scaler, [LEVEL], CFG, AS_OF, SPEC, report=report)
    return finish(out.select(*BASE, "predicted_water_level_m", "threshold_exceeded", "message", "error"), 6)


_STATIONS = ("(SELECT * EXCLUDE (event_type), event_type || CASE WHEN user_id % 4 = 0 THEN '-sparse' ELSE '-dense' END "
             "AS event_type FROM events)")

register("score_guard", DI[:-1] + ",\n" + _FIT.format(src="imputed") + ",\n"
         + "sobs AS (" + S.OBS_SELECT.format(src=_STATIONS) + "),\n" + _RT.replace("FROM obs", "FROM sobs") + ",\n"
         + S.imputed_cte("rimp", "rdense") + ",\n" + (
    f"known AS (SELECT DISTINCT event_type AS site_id FROM {_STATIONS} UNION SELECT n_name FROM nation),\n"
    "rep AS (SELECT k.site_id, count(r.ts) AS n FROM known k LEFT JOIN recent r ON r.site_id = k.site_id GROUP BY 1),\n"
    f"sc AS (SELECT i.site_id, i.ts, a * local_water_level_m + b AS p FROM rimp i, fit WHERE ts = TIMESTAMP '{AS_OF}' "
    "AND site_id IN (SELECT site_id FROM rep WHERE n >= 25))\n"
    "SELECT site_id, ts, round(p, 6) + 0.0 AS predicted_water_level_m, p > 1.5 AS threshold_exceeded, "
    "CASE WHEN p > 1.5 THEN 'High water level predicted for next hour.' ELSE 'Normal water level predicted for next hour.' END "
    "AS message, CAST(NULL AS VARCHAR) AS error FROM sc UNION ALL SELECT site_id, NULL, NULL, NULL, NULL, "
    "'Not enough real-time data in window. Need at least 25 hours, got ' || CAST(n AS VARCHAR) || '.' FROM rep WHERE n < 25"))(
    _score_guard)
