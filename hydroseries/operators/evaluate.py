"""Evaluation metrics as aggregates.

Every metric is one pass of partial aggregation; ROC AUC needs the order of
all scores, which ``stats.cumulative_by_value`` supplies without a
single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.operators.stats import cumulative_by_value


def to_class(df: DataFrame, score: str = "score", threshold: float = 0.5,
             name: str = "prediction") -> DataFrame:
    """``score > threshold`` as 0/1."""
    return df.withColumn(name, (F.col(score) > F.lit(float(threshold))).cast("int"))


def _counts(df: DataFrame, y: str, yhat: str) -> DataFrame:
    a, b = F.col(y).cast("int"), F.col(yhat).cast("int")
    return df.agg(F.count_if((a == 0) & (b == 0)).alias("tn"), F.count_if((a == 0) & (b == 1)).alias("fp"),
                  F.count_if((a == 1) & (b == 0)).alias("fn"), F.count_if((a == 1) & (b == 1)).alias("tp"))


def confusion_matrix(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """Long form ``actual, predicted, n`` with all four cells."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return _counts(df, y, yhat).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).cast("bigint").alias("n"))
        for a, p, n in cells])))


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def classification_report(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """Per-class precision, recall, F1 and support, plus macro and
    support-weighted means; a zero denominator gives 0.0."""
    c = _counts(df, y, yhat)
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    f1 = lambda p, r: F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1
    rows = [
        ("0", p0, r0, f1(p0, r0), s0),
        ("1", p1, r1, f1(p1, r1), s1),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1(p0, r0) + f1(p1, r1)) / 2, n),
        ("weighted avg", _div(p0 * s0 + p1 * s1, n), _div(r0 * s0 + r1 * s1, n),
         _div(f1(p0, r0) * s0 + f1(p1, r1) * s1, n), n),
    ]
    return c.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                 s.cast("bigint").alias("support")) for k, p, r, f, s in rows])))


def accuracy(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """E4."""
    return df.agg(F.avg((F.col(y).cast("int") == F.col(yhat).cast("int")).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def roc_auc(df: DataFrame, y: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """E5: exact ROC AUC with ties (trapezoid = probability a positive
    outranks a negative, ties counting one half); null with one class."""
    cum = cumulative_by_value(df, [], score, {"pos": F.col(y).cast("long"),
                                              "neg": F.lit(1) - F.col(y).cast("long")}, buckets=buckets)
    agg = cum.agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))).alias("_s"),
                  F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                             F.col("_s") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"),
                      F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"))


def regression_metrics(df: DataFrame, y: str = "label", pred: str = "prediction") -> DataFrame:
    """RMSE, MSE, MAE over rows with both values."""
    d = F.col(pred).cast("double") - F.col(y).cast("double")
    x = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    return (x.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.count(F.lit(1)).alias("n"))
             .select(F.sqrt("mse").alias("rmse"), "mse", "mae", "n"))
