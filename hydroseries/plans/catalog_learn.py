"""Driver queries for training and scoring (M6-M8, Z1, S5, S6).  Learned
scores have no SQL oracle; the driver checks their rows only."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hydroseries import config as C
from hydroseries.config import TrainConfig
from hydroseries.operators import features, learn
from hydroseries.plans import staging
from hydroseries.plans.catalog_series import FEATURES_CFG, SPEC, history
from hydroseries.plans.registry import finish, register
from hydroseries.session import scratch_path
from hydroseries.sources import io

CFG = TrainConfig()


def feature_table(spark, d):
    return features.build_features(history(spark, d), FEATURES_CFG, SPEC, sites=staging.sites(spark, d))


def _train_score(model_type: str):
    def run(spark, d):
        res = learn.train_and_evaluate(feature_table(spark, d), model_type, CFG)
        # Round trip through storage: the stored model and scaler must score alike.
        base = scratch_path(spark, f"models-{model_type}-{uuid.uuid4().hex[:12]}")
        learn.save_model(res.model, base, model_type)
        io.save_scaler(res.scaler, f"{base}/scaler")
        model = learn.load_model(base, model_type)
        test = res.scored_test.drop("prediction_score", "predicted_water_level_m")
        scored = learn.score(test, model, model_type)
        label = C.TARGET_CLASSIFICATION if model_type == "classification" else C.TARGET_REGRESSION
        out = "prediction_score" if model_type == "classification" else "predicted_water_level_m"
        return finish(scored.select("site_id", "ts", F.col(label).alias("label"), out))
    return run


register("train_score_class")(_train_score("classification"))
register("train_score_level")(_train_score("regression"))
