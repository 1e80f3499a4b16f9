"""Newest row, chronological split and history guard.

None of these uses a window over a whole series: the newest row is a
``max_by`` aggregate (partial per partition), and the split ranks come from
``stats.cumulative_by_value``, which cuts every series into value buckets.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.config import SeriesSpec
from hydroseries.operators.rowindex import row_index
from hydroseries.operators.stats import cumulative_by_value, with_sufficiency

_SPEC = SeriesSpec()
_G0 = "_g0"


def latest(df: DataFrame, spec: SeriesSpec = _SPEC) -> DataFrame:
    """The row with the greatest time per series (rows are unique per
    series and time).  The maxima are one small row per series, joined back, so the table is not sorted."""
    rest = [c for c in df.columns if c not in spec.keys]
    newest = df.groupBy(*spec.keys).agg(F.max(spec.ts).alias("_newest"))
    return (df.join(newest, list(spec.keys)).filter(F.col(spec.ts) == F.col("_newest"))
              .select(*spec.keys, *rest))


def time_split(df: DataFrame, ts: str = "ts", by: Iterable[str] = ("site_id",),
               test: float = 0.2, val: float = 0.2, name: str = "split",
               buckets: int | None = None) -> DataFrame:
    """Chronological split per group (``by=()``: one global order).

    Row rank r (0-based, by time) goes to ``test`` if ``r >= int(n*(1-test))``,
    else to ``val`` if ``r >= int(int(n*(1-test))*(1-val))``, else to
    ``train`` — the reference's positional cuts.  The two cut times per group
    are found from distributed ranks, then applied by a join on the group key.
    Rows sharing a time share a split.
    """
    g = list(by)
    x = df.withColumn("_v", F.unix_micros(F.col(ts).cast("timestamp")))
    added = not g
    if added:
        x = x.withColumn(_G0, F.lit(0))
        g = [_G0]
    cum = cumulative_by_value(x.select(*g, "_v"), g, "_v", {"_n": F.lit(1)}, buckets=buckets)
    tot = cum.groupBy(*g).agg(F.sum("_n").alias("_tot"))
    n_trval = F.floor(F.col("_tot") * F.lit(1.0 - test))
    n_train = F.floor(n_trval * F.lit(1.0 - val))
    c = cum.join(tot, g, "inner")
    hit = lambda r: (F.col("_n_before") <= r) & (r < F.col("_n_before") + F.col("_n"))
    cuts = c.groupBy(*g).agg(F.min(F.when(hit(n_train), F.col("_v"))).alias("_cut_val"),
                             F.min(F.when(hit(n_trval), F.col("_v"))).alias("_cut_test"))
    big = F.lit(2 ** 62)
    out = x.join(cuts, g, "left").withColumn(
        name, F.when(F.col("_v") < F.coalesce("_cut_val", big), F.lit("train"))
               .when(F.col("_v") < F.coalesce("_cut_test", big), F.lit("val"))
               .otherwise(F.lit("test")))
    out = out.drop("_v", "_cut_val", "_cut_test")
    return out.drop(_G0) if added else out


def positional_split(df: DataFrame, ts: str = "ts", by: Iterable[str] = ("site_id",), ties: Iterable[str] = (),
                     test: float = 0.2, val: float = 0.2, name: str = "split") -> DataFrame:
    """W12 by position: rows are numbered by ``(ts, ties)`` within each group
    (``by=()``: over the whole table), and the reference's cuts fall between two
    rows even where both share a time.  The numbers come from one distributed sort
    (``rowindex.row_index``), so no group is one task's window."""
    g = list(by)
    if not g:
        numbered = row_index(df, [ts, *ties], "_row")
        n = numbered.agg(F.count(F.lit(1))).first()[0]
        x = numbered.withColumns({"_start": F.lit(0).cast("long"), "_n": F.lit(n).cast("long")})
    else:
        numbered = row_index(df, [*g, ts, *ties], "_row")
        k = [f"_g{i}" for i in range(len(g))]
        sizes = numbered.groupBy(*[F.col(c).alias(n) for c, n in zip(g, k)]).agg(F.min("_row").alias("_start"), F.count(F.lit(1)).alias("_n"))
        same = F.lit(True)
        for c, n in zip(g, k):
            same &= F.col(c).eqNullSafe(F.col(n))
        x = numbered.join(sizes, same).drop(*k)
    at = F.col("_row") - F.col("_start")
    n_trval = F.floor(F.col("_n") * F.lit(1.0 - test))
    n_train = F.floor(n_trval * F.lit(1.0 - val))
    return (x.withColumn(name, F.when(at < n_train, "train").when(at < n_trval, "val").otherwise("test"))
            .drop("_row", "_start", "_n"))


def require_history(df: DataFrame, rows_needed: int, window_hours: int,
                    spec: SeriesSpec = _SPEC) -> DataFrame:
    """Rows present in the last ``window_hours`` hours of each series
    (ending at its newest hour) against ``rows_needed``."""
    end = df.groupBy(*spec.keys).agg(F.max(spec.ts).alias("_end"))
    x = df.join(end, list(spec.keys), "inner").filter(
        F.col(spec.ts) > F.col("_end") - F.make_dt_interval(hours=F.lit(window_hours)))
    return with_sufficiency(x.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n_rows")), rows_needed)
