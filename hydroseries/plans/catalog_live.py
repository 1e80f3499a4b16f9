"""Driver queries for several live feeds: their merge on sealed hours, scoring with a stored
model, the salted stateful series; and a logistic learner whose probabilities SQL can state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hydroseries import config as C
from hydroseries.config import TrainConfig
from hydroseries.operators import evaluate, features, learn
from hydroseries.plans import sqlkit as S
from hydroseries.plans import staging
from hydroseries.plans.catalog_guard import _FIT, CFG, LEVEL, _linear
from hydroseries.plans.catalog_model import eval_base
from hydroseries.plans.catalog_series import BASE, COLS, DI, SPEC, imputed
from hydroseries.plans.catalog_stream import _SEALED, _events_stream
from hydroseries.plans.registry import finish, register
from hydroseries.session import scratch_path
from hydroseries.sources import io
from hydroseries.streaming import hourly as H
from hydroseries.streaming import stateful
from hydroseries.streaming.combine import Feed, combined_hourly_stream


def _merged_feeds(spark, d):
    """Two file streams, the readings of the first and the second half of each hour."""
    aggs = staging.obs_aggs()

    def feed(half, how, cols):
        stream = _events_stream(spark, d).filter(staging._half(half))
        return Feed(stream, {c: aggs[c] for c in cols}, F.col("event_type"), how)
    return combined_hourly_stream([feed(0, "attach", COLS), feed(1, "upsert", ["humidity"]), feed(1, "fill", [LEVEL, "rain_1h"])])


def _stream_combine(spark, d):
    base = H.scratch(spark, "combine")
    H.run_available_now(_merged_feeds(spark, d), f"{base}/sink", f"{base}/checkpoint")
    return finish(spark.read.parquet(f"{base}/sink").select(*BASE, *COLS))


_MERGED = (
    "ends AS (SELECT least(max(ts) FILTER (minute(ts) < 30), max(ts) FILTER (minute(ts) >= 30)) AS mx FROM events), "
    "hours AS (SELECT site_id, ts FROM feed0 UNION SELECT site_id, ts FROM feed1), "
    "merged AS (SELECT h.site_id, h.ts, coalesce(a.local_water_level_m, b.local_water_level_m) AS local_water_level_m, "
    "coalesce(a.rain_1h, b.rain_1h) AS rain_1h, coalesce(b.humidity, a.humidity) AS humidity FROM hours h "
    "LEFT JOIN feed0 a ON a.site_id = h.site_id AND a.ts = h.ts LEFT JOIN feed1 b ON b.site_id = h.site_id AND b.ts = h.ts, ends "
    "WHERE h.ts + INTERVAL 1 HOUR <= ends.mx - INTERVAL 5 HOUR)")

register("stream_combine", S.with_(S.FEED0, S.FEED1, _MERGED) + S.final(COLS, BASE, "merged"))(_stream_combine)


def _stream_score_model(spark, d):
    """A linear model trained on the history, stored, loaded in the batch function and applied to both feeds' newest hours."""
    base = scratch_path(spark, f"live-{uuid.uuid4().hex[:12]}")
    _, scaler, model = _linear(imputed(spark, d))
    learn.save_model(model, base, "regression")
    io.save_scaler(scaler, f"{base}/scaler")
    scorer = H.stored_model_scorer(spark, base, "regression", [LEVEL], CFG)
    path = H.score_stream(spark, _merged_feeds(spark, d), COLS, 30, CFG, SPEC, scorer, H.scratch(spark, "live"))
    return finish(spark.read.schema(H.PREDICTION_SCHEMA).parquet(path).drop("batch_id"), 6)


register("stream_score_model", DI[:-1] + ",\n" + _FIT.format(src="imputed") + ", " + S.FEED0 + ", " + S.FEED1 + ", " + _MERGED + ",\n" + (
    "newest AS (SELECT *, max(ts) OVER (PARTITION BY site_id) AS newest FROM merged), "
    "last AS (SELECT site_id, ts, local_water_level_m AS level, (SELECT count(*) FROM newest h WHERE h.site_id = newest.site_id "
    "AND h.ts > h.newest - INTERVAL 30 HOUR) AS n FROM newest WHERE ts = newest)\n"
    "SELECT site_id, ts, round(a * level + b, 6) + 0.0 AS predicted_water_level_m, CAST(1.5 AS DOUBLE) AS flood_threshold_m, "
    "a * level + b > 1.5 AS threshold_exceeded, CASE WHEN a * level + b > 1.5 THEN 'High water level predicted for next hour.' "
    "ELSE 'Normal water level predicted for next hour.' END AS message, 'regression' AS model_type, CAST(NULL AS VARCHAR) AS error "
    "FROM last, fit WHERE n >= 25 UNION ALL SELECT site_id, ts, NULL, NULL, NULL, NULL, NULL, "
    "'Not enough real-time data in window. Need at least 25 hours, got ' || CAST(n AS VARCHAR) || '.' FROM last WHERE n < 25"))(_stream_score_model)


def _stream_hourly_salted(spark, d):
    base = H.scratch(spark, "hourly-salted")
    out = stateful.hourly_stream_salted(_events_stream(spark, d), F.col("event_type"))
    with stateful.rocksdb_state(spark):
        H.run_available_now(out, f"{base}/sink", f"{base}/checkpoint")
    return finish(spark.read.parquet(f"{base}/sink"))


register("stream_hourly_salted", S.with_(S.OBS, _SEALED) + S.final(COLS, BASE, "sealed"))(_stream_hourly_salted)


# --- M6, M8: a logistic learner on one 0/1 feature ----------------------------
# With one such feature and no penalty the fitted probability of a group is its share of positives.

_TRAIN = TrainConfig(max_iter=200, tolerance=1e-12)


def _high_now(spark, d):
    x = features.label_level(imputed(spark, d), spec=SPEC)
    return x.select(*BASE, (F.col(LEVEL) > 1.0).cast("double").alias("high_now"), C.TARGET_REGRESSION, C.TARGET_CLASSIFICATION)


def _trained(spark, d):
    return learn.train_and_evaluate(_high_now(spark, d), "classification", _TRAIN, learner="linear")


def _logistic_score(spark, d):
    return finish(_trained(spark, d).scored_test.select(*BASE, F.col(C.TARGET_CLASSIFICATION).alias("label"), "prediction_score"), 5)


def _logistic_metrics(spark, d):
    """All metrics of the run as rows (metric, value)."""
    m = _trained(spark, d).metrics
    one = lambda df, **cols: df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).cast("double").alias("value")) for k, c in cols.items()])))
    cells = m["confusion_matrix"].select(F.format_string("n_%d%d", F.col("actual").cast("int"), F.col("predicted").cast("int")).alias("metric"), F.col("n").cast("double").alias("value"))
    return finish(one(m["accuracy"], accuracy="accuracy").unionByName(one(m["roc_auc"], roc_auc="roc_auc")).unionByName(cells), 6)


_SPLIT = (
    "lab AS (SELECT site_id, ts, CAST(local_water_level_m > 1.0 AS DOUBLE) AS x, "
    "CAST(coalesce(lead(local_water_level_m, 1) OVER w > 1.5, false) AS INTEGER) AS y, "
    "row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY site_id) AS n FROM imputed WINDOW w AS (PARTITION BY site_id ORDER BY ts)), "
    "cutrow AS (SELECT *, floor(n * CAST(0.8 AS DOUBLE)) AS trval, floor(floor(n * CAST(0.8 AS DOUBLE)) * CAST(0.8 AS DOUBLE)) AS train FROM lab), "
    "fitted AS (SELECT x, avg(y) AS p FROM cutrow WHERE r < train GROUP BY x), "
    "test AS (SELECT c.site_id, c.ts, c.y, f.p FROM cutrow c JOIN fitted f ON f.x = c.x WHERE r >= trval)")

register("logistic_score", DI[:-1] + ",\n" + _SPLIT + (
    "\nSELECT site_id, ts, y AS label, round(p, 5) + 0.0 AS prediction_score FROM test"))(_logistic_score)

register("logistic_metrics", DI[:-1] + ",\n" + _SPLIT + (
    ", pairs AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END * a.n * b.n) AS s, sum(a.n * b.n) AS m "
    "FROM (SELECT p, count(*) AS n FROM test WHERE y = 1 GROUP BY p) a, (SELECT p, count(*) AS n FROM test WHERE y = 0 GROUP BY p) b)\n"
    "SELECT metric, round(CAST(value AS DOUBLE), 6) + 0.0 AS value FROM ("
    "SELECT 'accuracy' AS metric, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS value FROM test "
    "UNION ALL SELECT 'roc_auc', s / m FROM pairs "
    "UNION ALL SELECT 'n_00', count(*) FILTER (y = 0 AND p <= 0.5) FROM test UNION ALL SELECT 'n_01', count(*) FILTER (y = 0 AND p > 0.5) FROM test "
    "UNION ALL SELECT 'n_10', count(*) FILTER (y = 1 AND p <= 0.5) FROM test UNION ALL SELECT 'n_11', count(*) FILTER (y = 1 AND p > 0.5) FROM test)"))(
    _logistic_metrics)


# --- A7: a test set of one class has no ranking to measure ----------------------

register("roc_auc_one_class", DI[:-1] + "\nSELECT CAST(NULL AS DOUBLE) AS roc_auc, CAST(0 AS BIGINT) AS n_pos, count(*) AS n_neg FROM imputed")(
    lambda spark, d: finish(evaluate.roc_auc(eval_base(spark, d).withColumn("label", F.lit(0)), "label", "score")))
