"""Min-max scaling and column alignment.

The fitted scaler is a small table ``(ordinal, feature, min, max)`` — one row
per feature, so its size is bounded by the feature count, not the data — and
applying it is a projection of plain column expressions.  MLlib's
``MinMaxScaler`` is not used: it maps a constant feature to 0.5, whereas the
reference maps it to ``x - min`` (0 on the training data).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries import config as C


def feature_columns(df: DataFrame, targets: Iterable[str] = C.ALL_TARGET_COLUMNS,
                    exclude: Iterable[str] = ("site_id", "ts")) -> list[str]:
    """Every column that is neither a target nor a key."""
    drop = set(targets) | set(exclude)
    return [c for c in df.columns if c not in drop]


def ensure_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """P5: add absent columns as null doubles."""
    return df.withColumns({c: F.lit(None).cast("double") for c in names if c not in df.columns})


def align_columns(df: DataFrame, order: Sequence[str], fill: float = 0.0,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Project to a saved feature order; absent columns become ``fill``
    and so do nulls (in raw units, before scaling)."""
    out = [F.col(k) for k in keep]
    for c in order:
        if c in df.columns:
            out.append(F.coalesce(F.col(c).cast("double"), F.lit(float(fill))).alias(c))
        else:
            out.append(F.lit(float(fill)).alias(c))
    return df.select(*out)


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M1: min and max of each column (nulls ignored) in ONE aggregate,
    unpivoted to ``(ordinal, feature, min, max)``."""
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c).cast("double")).alias(f"mn{len(aggs)//2}"),
                 F.max(F.col(c).cast("double")).alias(f"mx{len(aggs)//2}")]
    row = df.agg(*aggs)
    stacked = F.inline(F.array(*[F.struct(F.lit(i).cast("int").alias("ordinal"), F.lit(c).alias("feature"),
                                          F.col(f"mn{i}").alias("min"), F.col(f"mx{i}").alias("max"))
                                 for i, c in enumerate(cols)]))
    return row.select(stacked)


def scaler_from_rows(spark: SparkSession, rows: Sequence[tuple[int, str, float, float]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "ordinal int, feature string, min double, max double")


def apply_minmax(df: DataFrame, scaler: DataFrame | Sequence, keep: Sequence[str] = (),
                 fill_absent: float | None = None) -> DataFrame:
    """M2: ``(x - min) / (max - min)``; a constant feature gives ``x - min``;
    no clipping of unseen values; null stays null.

    The scaler table holds one row per feature (bounded by the feature count),
    so it is read once on the driver and inlined as literals: the projection
    then stays inside whole-stage codegen with no join.
    """
    rows = scaler.orderBy("ordinal").collect() if isinstance(scaler, DataFrame) else list(scaler)
    out = [F.col(k) for k in keep]
    for r in rows:
        feat, mn, mx = r[1], r[2], r[3]
        if feat in df.columns:
            x = F.col(feat).cast("double")
        elif fill_absent is not None:
            x = F.lit(float(fill_absent))
        else:
            raise ValueError(f"feature {feat!r} is absent")
        if mn is None or mx is None:
            e = F.lit(None).cast("double")
        elif mx == mn:
            e = x - F.lit(float(mn))
        else:
            e = (x - F.lit(float(mn))) / F.lit(float(mx) - float(mn))
        out.append(e.alias(feat))
    return df.select(*out)
