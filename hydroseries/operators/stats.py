"""Aggregates: exact quantiles without hot groups, column statistics, null
profiles, row guards and the IQR outlier flag (A2, A3, A5, A6, A8, Q1).

Exact quantiles and ranks need an order over all values of a group.  A window
partitioned by the group would sort a hot group (say a third of all rows) in one
task, and Spark's exact ``percentile`` aggregate merges every distinct value of
a group in one task.  ``cumulative_by_value`` instead

1. collapses equal values per group with a partial (map side) aggregate,
2. cuts each group into value buckets whose bounds come from a bounded-memory
   ``percentile_approx`` sketch, so buckets hold about equally many distinct
   values and a hot group is spread over many tasks; by default the bucket
   count grows with the largest group (``auto_buckets``) so a bucket holds
   about two million distinct values at most,
3. runs the ordered window inside ``(group, bucket)`` only, and adds the
   bucket prefix from a tiny ``(group, bucket)`` table.

The result is exact; the sketch only decides where the work is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroseries import config as C
from hydroseries.session import materialize

_G0 = "_g0"


def _with_bucket(df: DataFrame, bounds: str, v: str, fan: int, out: str = "_bk") -> DataFrame:
    """Number of the ``fan**2 - 1`` sorted bounds below ``v``, by a two-level
    search: ``fan - 1`` coarse comparisons pick a block, ``fan - 1`` fine ones
    count inside it.  Plain comparisons keep it inside whole-stage codegen (a
    higher-order ``filter`` over all bounds would be interpreted); the coarse
    block is its own projection, so the expression stays O(fan)."""
    one = lambda e: F.when(e, F.lit(1)).otherwise(F.lit(0))
    b, x = F.col(bounds), F.col(v)
    coarse = sum(one(F.get(b, F.lit(fan * i - 1)) < x) for i in range(1, fan))
    df = df.withColumn("_bc", coarse)
    fine = sum(one(F.get(b, F.col("_bc") * fan + F.lit(j - 1)) < x) for j in range(1, fan))
    return df.withColumn(out, F.col("_bc") * fan + fine).drop("_bc")


def auto_buckets(df: DataFrame, group_cols: list[str], value_col: str, target: int = 2_000_000,
                 lo: int = 16, hi: int = 65536) -> int:
    """Bucket count so that the largest group's buckets hold about ``target``
    distinct values (a one-number planning aggregate, like range sampling)."""
    m = (df.groupBy(*group_cols).agg(F.approx_count_distinct(value_col).alias("_d"))
           .agg(F.max("_d")).first()[0]) or 0
    return int(min(hi, max(lo, math.ceil(m / target))))


def cumulative_by_value(df: DataFrame, group_cols: Iterable[str], value_col: str,
                        weights: Mapping[str, Column], buckets: int | None = None,
                        accuracy: int | None = None, cut: str | None = "checkpoint") -> DataFrame:
    """For every distinct ``(group, value)``: the sum of each weight at that
    value (column ``name``), over all smaller values of the group (column
    ``name_before``) and over the whole group (``name_total``).  Null values
    are skipped.

    The distinct-value table feeds the bounds, the bucket totals and the
    ordered window; it is cut once (``cut``, a reliable checkpoint) so the
    input plan is not recomputed for each branch."""
    g = list(group_cols)
    x = df.where(F.col(value_col).isNotNull())
    added = not g
    if added:
        x = x.withColumn(_G0, F.lit(0))
        g = [_G0]
    names = list(weights)
    if buckets is None:
        buckets = auto_buckets(x, g, value_col)
    agg = materialize(x.groupBy(*g, value_col).agg(*[F.sum(w).alias(n) for n, w in weights.items()]), cut)
    if buckets > 1:
        fan = max(2, math.ceil(math.sqrt(buckets)))
        n_b = fan * fan
        splits = [i / n_b for i in range(1, n_b)]
        acc = accuracy or max(10000, 4 * n_b)
        bounds = agg.groupBy(*g).agg(F.percentile_approx(value_col, splits, acc).alias("_b"))
        agg = _with_bucket(agg.join(bounds, g, "left"), "_b", value_col, fan).drop("_b")
    else:
        agg = agg.withColumn("_bk", F.lit(0))
    prev = Window.unboundedPreceding
    bk = agg.groupBy(*g, "_bk").agg(*[F.sum(n).alias(n) for n in names])
    wb = Window.partitionBy(*g).orderBy("_bk").rowsBetween(prev, -1)
    wt = Window.partitionBy(*g)
    bk = bk.select(*g, "_bk", *[F.coalesce(F.sum(n).over(wb), F.lit(0)).alias(f"_pb_{n}") for n in names],
                   *[F.sum(n).over(wt).alias(f"{n}_total") for n in names])
    wi = Window.partitionBy(*g, "_bk").orderBy(value_col).rowsBetween(prev, -1)
    agg = agg.withColumns({f"_in_{n}": F.coalesce(F.sum(n).over(wi), F.lit(0)) for n in names})
    out = agg.join(bk, [*g, "_bk"], "inner").select(
        *g, value_col, *names,
        *[(F.col(f"_pb_{n}") + F.col(f"_in_{n}")).alias(f"{n}_before") for n in names],
        *[F.col(f"{n}_total") for n in names])
    return out.drop(_G0) if added else out


def exact_quantiles(df: DataFrame, group_cols: Iterable[str], value_col: str,
                    qs: Mapping[str, float], buckets: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (as pandas / numpy
    ``linear``): one row per group, one column per name in ``qs``."""
    g = list(group_cols)
    added = not g
    if added:
        df = df.withColumn(_G0, F.lit(0))
        g = [_G0]
    cum = cumulative_by_value(df, g, value_col, {"_n": F.lit(1)}, buckets=buckets)
    x = cum.withColumnRenamed("_n_total", "_tot")
    lo_hi = []
    for name, q in qs.items():
        h = (F.col("_tot") - 1) * F.lit(float(q))
        for side, r in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("_n_before") <= r) & (r < F.col("_n_before") + F.col("_n"))
            lo_hi.append(F.max(F.when(hit, F.col(value_col))).alias(f"_{side}_{name}"))
    agg = x.groupBy(*g).agg(F.first("_tot").alias("_tot"), *lo_hi)
    out = []
    for name, q in qs.items():
        h = (F.col("_tot") - 1) * F.lit(float(q))
        frac = h - F.floor(h)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * frac).alias(name))
    res = agg.select(*g, *out)
    return res.drop(_G0) if added else res


def unpivot(df: DataFrame, id_cols: Iterable[str], value_cols: Iterable[str],
            name_col: str = "column", value_col: str = "value") -> DataFrame:
    cols = list(value_cols)
    return df.unpivot(list(id_cols), cols, name_col, value_col)


def group_quantiles(df: DataFrame, cols: Iterable[str], by: Iterable[str], qs: Mapping[str, float],
                    buckets: int | None = None) -> DataFrame:
    """Exact quantiles of several columns per group in ONE pass: long form
    ``by..., column, <q names>``."""
    by, cols = list(by), list(cols)
    long = unpivot(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]), by, cols)
    return exact_quantiles(long, [*by, "column"], "value", qs, buckets=buckets)


def column_stats(df: DataFrame, cols: Iterable[str], by: Iterable[str] = ("site_id",),
                 buckets: int | None = None) -> DataFrame:
    """A2: mean and exact median of each column per group, long form
    ``by..., column, mean, median``."""
    by = list(by)
    cols = list(cols)
    long = unpivot(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]), by, cols)
    means = long.groupBy(*by, "column").agg(F.avg("value").alias("mean"))
    med = group_quantiles(df, cols, by, {"median": 0.5}, buckets=buckets)
    return means.join(med, [*by, "column"], "left")


def null_profile(df: DataFrame, cols: Iterable[str], by: Iterable[str] = ("site_id",)) -> DataFrame:
    """A5: rows and null count per column per group (one partial aggregate)."""
    by = list(by)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def require_rows(df: DataFrame, n: int, by: Iterable[str] = ("site_id",)) -> DataFrame:
    """A6 per group: ``by..., n_rows, needed, sufficient``."""
    by = list(by)
    return with_sufficiency(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")), n)


def with_sufficiency(counts: DataFrame, n: int) -> DataFrame:
    """``needed``, ``sufficient`` and, for short series, the error message."""
    x = counts.withColumn("needed", F.lit(n).cast("bigint")).withColumn(
        "sufficient", F.col("n_rows") >= F.col("needed"))
    msg = F.format_string(C.MSG_SHORT_HISTORY, F.col("needed"), F.col("n_rows"))
    return x.withColumn("message", F.when(~F.col("sufficient"), msg))


def iqr_outliers(df: DataFrame, value_col: str, k: float = 1.5,
                 by: Iterable[str] = (), buckets: int | None = None) -> DataFrame:
    """Q1: flag values strictly outside ``[Q1 - k IQR, Q3 + k IQR]`` of their
    group; nulls are not outliers.  Adds ``q1, q3, lower, upper, is_outlier``."""
    by = list(by)
    added = not by
    if added:
        df = df.withColumn(_G0, F.lit(0))
        by = [_G0]
    q = exact_quantiles(df, by, value_col, {"q1": 0.25, "q3": 0.75}, buckets=buckets)
    q = q.select(*by, "q1", "q3",
                 (F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))).alias("lower"),
                 (F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))).alias("upper"))
    x = df.join(q, by, "left")
    v = F.col(value_col)
    x = x.withColumn("is_outlier",
                     F.coalesce((v < F.col("lower")) | (v > F.col("upper")), F.lit(False)))
    return x.drop(_G0) if added else x
