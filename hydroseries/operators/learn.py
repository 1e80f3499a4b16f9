"""Training, scoring and model storage.

The reference trains a Keras network on one machine; here the learners are
MLlib's distributed gradient-boosted trees (with a validation indicator for
early stopping, i.e. "stop on validation loss, keep the best") and linear
baselines.  Same contract: features in, probability of exceedance or level
one hour ahead out.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries import config as C
from hydroseries.config import TrainConfig
from hydroseries.operators import evaluate, scaling
from hydroseries.operators.split import time_split
from hydroseries.session import materialize, scratch_path

VAL_COL = "_is_val"


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def train_classifier(train_val: DataFrame, features: Sequence[str], label: str = C.TARGET_CLASSIFICATION,
                     cfg: TrainConfig = TrainConfig(), learner: str = "gbt") -> PipelineModel:
    """M6: probability of exceedance.  ``train_val`` holds training and
    validation rows, the latter flagged by ``_is_val``: the trees stop early by
    them, the linear learners choose their penalty."""
    if learner == "gbt":
        est = GBTClassifier(labelCol=label, featuresCol="features", maxIter=cfg.max_iter, maxDepth=cfg.max_depth,
                            stepSize=cfg.step_size, seed=cfg.seed, validationIndicatorCol=VAL_COL)
        data = train_val
    else:
        p = vector_to_array("probability")[F.col(label).cast("int")]
        return _best_linear(train_val, features, cfg, -F.log(F.greatest(p, F.lit(1e-15))), lambda reg: LogisticRegression(
            labelCol=label, featuresCol="features", maxIter=cfg.max_iter, regParam=reg, tol=cfg.tolerance))
    return Pipeline(stages=[_assembler(features), est]).fit(data)


def _best_linear(train_val: DataFrame, features: Sequence[str], cfg: TrainConfig, loss, make) -> PipelineModel:
    """The model with the least mean ``loss`` on the validation rows among the
    penalties of ``cfg`` (the smallest of equal ones), each fitted on the training rows."""
    train, val = train_val.filter(~F.col(VAL_COL)), train_val.filter(F.col(VAL_COL))
    best = None
    for reg in sorted(cfg.reg_params):
        model = _without_summary(Pipeline(stages=[_assembler(features), make(reg)]).fit(train), train)
        if len(cfg.reg_params) == 1:
            return model
        got = model.transform(val).agg(F.avg(loss)).first()[0]
        if best is None or (got is not None and got < best[0]):
            best = (float("inf") if got is None else got, model)
    return best[1]


def _without_summary(model: PipelineModel, df: DataFrame) -> PipelineModel:
    """The model without its training summary, by way of storage.  A summary holds the session, and the session
    cannot be shipped to executors once an ``Observation`` was used in it."""
    path = scratch_path(df.sparkSession, f"model-{uuid.uuid4().hex}")
    model.write().save(path)
    return PipelineModel.load(path)


def train_regressor(train_val: DataFrame, features: Sequence[str], label: str = C.TARGET_REGRESSION,
                    cfg: TrainConfig = TrainConfig(), learner: str = "gbt") -> PipelineModel:
    """M7: level one hour ahead, squared loss."""
    if learner == "gbt":
        est = GBTRegressor(labelCol=label, featuresCol="features", maxIter=cfg.max_iter, maxDepth=cfg.max_depth,
                           stepSize=cfg.step_size, seed=cfg.seed, validationIndicatorCol=VAL_COL)
        data = train_val
    else:
        return _best_linear(train_val, features, cfg, F.pow(F.col("prediction") - F.col(label), 2), lambda reg: LinearRegression(
            labelCol=label, featuresCol="features", maxIter=cfg.max_iter, regParam=reg, tol=cfg.tolerance))
    return Pipeline(stages=[_assembler(features), est]).fit(data)


def score(df: DataFrame, model: PipelineModel, model_type: str) -> DataFrame:
    """``prediction_score`` (probability of class 1) or
    ``predicted_water_level_m``."""
    out = model.transform(df)
    if model_type == "classification":
        out = out.withColumn("prediction_score", vector_to_array("probability")[1])
    else:
        out = out.withColumn("predicted_water_level_m", F.col("prediction"))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def save_model(model: PipelineModel, path: str, model_type: str) -> str:
    """One directory per model type, so the two never overwrite each other."""
    p = f"{path.rstrip('/')}/{model_type}"
    model.write().overwrite().save(p)
    return p


def load_model(path: str, model_type: str) -> PipelineModel:
    return PipelineModel.load(f"{path.rstrip('/')}/{model_type}")


@dataclass
class TrainResult:
    model: PipelineModel
    scaler: DataFrame
    features: list[str]
    scored_test: DataFrame
    metrics: dict[str, DataFrame]


def train_and_evaluate(feats: DataFrame, model_type: str = "classification", cfg: TrainConfig = TrainConfig(),
                       by: Sequence[str] = ("site_id",), learner: str = "gbt",
                       cut: str | None = "checkpoint") -> TrainResult:
    """M8: chronological split, min-max scaler (fit on the training rows, or
    on all rows for parity), train with validation, evaluate on test.  Empty
    features, training or validation rows raise ``ValueError``; without test
    rows the evaluation is skipped (no metrics)."""
    if model_type not in ("classification", "regression"):
        raise ValueError(model_type)
    label = C.TARGET_CLASSIFICATION if model_type == "classification" else C.TARGET_REGRESSION
    names = scaling.feature_columns(feats)
    # The split table feeds the scaler fit, the learner (several passes) and
    # the test scoring: cut it once so the feature pipeline runs only once.
    x = materialize(time_split(feats, "ts", by, cfg.test_ratio, cfg.validation_ratio), cut)
    n = x.agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]).first()
    if not any(n):
        raise ValueError("feature table is empty")
    for part, title in (("train", "training"), ("val", "validation")):
        if not n[part]:
            raise ValueError(f"{title} split is empty; adjust the ratios or give more rows")
    fit_rows = x if cfg.scaler_fit_on == "all" else x.filter(F.col("split") == "train")
    scaler = scaling.fit_minmax(fit_rows, names)
    keep = [*by, "ts", "split", *C.ALL_TARGET_COLUMNS]
    xs = scaling.apply_minmax(x, scaler, keep=keep)
    tv = xs.filter(F.col("split") != "test").withColumn(VAL_COL, F.col("split") == "val")
    trainer = train_classifier if model_type == "classification" else train_regressor
    model = trainer(tv, names, label, cfg, learner)
    test = score(xs.filter(F.col("split") == "test"), model, model_type)
    if not n["test"]:
        return TrainResult(model, scaler, names, test, {})
    if model_type == "classification":
        t = evaluate.to_class(test.withColumnRenamed(label, "label"), "prediction_score", cfg.classification_threshold)
        metrics = {"confusion_matrix": evaluate.confusion_matrix(t), "report": evaluate.classification_report(t),
                   "accuracy": evaluate.accuracy(t), "roc_auc": evaluate.roc_auc(t, "label", "prediction_score")}
    else:
        metrics = {"regression": evaluate.regression_metrics(test, label, "predicted_water_level_m")}
    return TrainResult(model, scaler, names, test, metrics)
