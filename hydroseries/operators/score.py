"""Scoring and interpretation of predictions.

The scoring time ``as_of`` is an argument; no operator reads the clock.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries import config as C
from hydroseries.functions.time import to_local


def _times(as_of: dt.datetime, tz: str) -> dict:
    t = F.lit(as_of).cast("timestamp_ntz")
    return {"prediction_time_utc": t, "prediction_time_local": to_local(t, tz)}


def with_errors(preds: DataFrame, report: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """A6 + Z4 at scoring: predictions plus one row for every insufficient
    series of ``report``, whose ``error`` is the message of the report and
    whose other columns are null (those the report shares with ``preds`` are kept)."""
    kept = [c for c in report.columns if c in preds.columns and c not in keys and c not in ("message", "error")]
    short = report.filter(~F.col("sufficient")).select(*keys, *kept, F.col("message").alias("error"))
    return preds.withColumn("error", F.lit(None).cast("string")).unionByName(short, allowMissingColumns=True)


def interpret_class(df: DataFrame, score: str = "prediction_score", threshold: float = 0.5,
                    as_of: dt.datetime | None = None, tz: str = "Asia/Bangkok") -> DataFrame:
    """Flag ``p > threshold``, certainty ``p`` or ``1 - p``, message."""
    p = F.col(score).cast("double")
    flood = p > F.lit(float(threshold))
    out = {
        "predicted_is_flood": flood,
        "prediction_score": p,
        "certainty": F.when(flood, p).otherwise(F.lit(1.0) - p),
        "message": F.when(flood, F.lit(C.MSG_FLOOD)).otherwise(F.lit(C.MSG_NO_FLOOD)),
        "model_type": F.lit("classification"),
    }
    if as_of is not None:
        out.update(_times(as_of, tz))
    return df.withColumns(out)


def interpret_level(df: DataFrame, pred: str = "predicted_water_level_m",
                    threshold: float = C.FLOOD_WATER_LEVEL_THRESHOLD_M,
                    as_of: dt.datetime | None = None, tz: str = "Asia/Bangkok") -> DataFrame:
    """Z3: predicted level against the flood threshold, message."""
    p = F.col(pred).cast("double")
    hit = p > F.lit(float(threshold))
    out = {
        "predicted_water_level_m": p,
        "flood_threshold_m": F.lit(float(threshold)),
        "threshold_exceeded": hit,
        "message": F.when(hit, F.lit(C.MSG_HIGH_LEVEL)).otherwise(F.lit(C.MSG_NORMAL_LEVEL)),
        "model_type": F.lit("regression"),
    }
    if as_of is not None:
        out.update(_times(as_of, tz))
    return df.withColumns(out)
