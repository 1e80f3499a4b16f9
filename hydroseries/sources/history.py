"""A stored history that late rows are added to without rebuilding it (S4, E-1).

Three tables under one folder, over the same hours:

* ``hourly``: observed rows, partitioned by ``(_chunk, _bucket)``: a fixed block of hours,
  and a hash of the series key that groups small series into files of useful size;
* ``chunks``: one row per series and chunk, the first and last observation of every column,
  partitioned by ``_bucket``;
* ``history``: the dense, imputed rows, partitioned like ``hourly``.

``append`` merges late rows into their chunks, finds with ``chunks`` alone which
other chunks took values over the places that changed, recomputes those from their own rows
and the nearest observations outside, and replaces their partitions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroseries.config import SeriesSpec
from hydroseries.functions.time import from_hour_index, hour_index
from hydroseries.operators import fill, timegrid
from hydroseries.operators.windows import CHUNK
from hydroseries.session import materialize

BUCKET = "_bucket"
_SPEC = SeriesSpec()


def _placed(df: DataFrame, spec: SeriesSpec, buckets: int) -> DataFrame:
    return df.withColumns({CHUNK: timegrid.chunk_of(spec.ts, spec.chunk_hours),
                           BUCKET: F.pmod(F.xxhash64(*spec.keys), F.lit(buckets)).cast("int")})


def _write(df: DataFrame, path: str, parts: Sequence[str], mode: str = "overwrite") -> None:
    (df.repartition(*parts).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(path))


def _summary(rows: DataFrame, cols: Sequence[str], spec: SeriesSpec) -> DataFrame:
    """Per series and chunk: span of its rows, and per column the first and last observation."""
    seen = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(spec.ts).alias("t"), F.col(c).cast("double").alias("v")))
    aggs = {"_first": F.min(spec.ts), "_last": F.max(spec.ts)}
    for i, c in enumerate(cols):
        aggs |= {f"_f{i}": F.min(seen(c)), f"_l{i}": F.max(seen(c))}
    return rows.groupBy(*spec.keys, CHUNK, BUCKET).agg(*[e.alias(n) for n, e in aggs.items()])


def create(hourly: DataFrame, path: str, cols: Sequence[str], spec: SeriesSpec = _SPEC, buckets: int = 64) -> None:
    """Full build: ``hourly`` (unique per series and hour) stored, densified over each series' own span and imputed."""
    spark = hourly.sparkSession
    _write(_placed(hourly.select(*spec.keys, spec.ts, *cols), spec, buckets), f"{path}/hourly", [CHUNK, BUCKET])
    spark.createDataFrame([(spec.chunk_hours, buckets)], "chunk_hours int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    stored = spark.read.parquet(f"{path}/hourly")
    _write(_summary(stored, cols, spec), f"{path}/chunks", [BUCKET])
    rows = stored.drop(CHUNK, BUCKET)
    dense = fill.impute_series(timegrid.densify(rows, spec, keep_chunk=True), cols, spec, observed=rows).drop(CHUNK)
    _write(_placed(dense, spec, buckets), f"{path}/history", [CHUNK, BUCKET])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/history").drop(CHUNK, BUCKET)


def _parts(spark: SparkSession, path: str, pairs: DataFrame) -> DataFrame:
    """Rows of the partitions that ``pairs`` names: chunk and bucket numbers, which are few
    (chunks of the whole span, hash buckets), prune the folders."""
    found = pairs.agg(F.collect_set(CHUNK).alias("c"), F.collect_set(BUCKET).alias("b")).first()
    return (spark.read.parquet(path).filter(F.col(CHUNK).isin(found["c"]) & F.col(BUCKET).isin(found["b"]))
            .join(pairs.select(CHUNK, BUCKET).distinct(), [CHUNK, BUCKET], "left_semi"))


def affected_chunks(chunks: DataFrame, touched: DataFrame, n_cols: int, spec: SeriesSpec) -> DataFrame:
    """keys, chunk of every chunk whose imputed rows can change when the ``touched`` ones do: from the chunk with
    the observation before to that with the observation after, over all columns and over the rows themselves.
    A column without one reaches to the end of the series."""
    whole = Window.partitionBy(*spec.keys)
    before = (Window.unboundedPreceding, -1)
    back, ahead = (whole.orderBy(o).rowsBetween(*before) for o in (F.col(CHUNK).asc(), F.col(CHUNK).desc()))
    has = [F.col("_first").isNotNull(), *[F.col(f"_f{i}").isNotNull() for i in range(n_cols)]]
    here = lambda ok: F.when(ok, F.col(CHUNK))
    low = [F.coalesce(F.last(here(ok), True).over(back), F.min(CHUNK).over(whole)) for ok in has]
    high = [F.coalesce(F.last(here(ok), True).over(ahead), F.max(CHUNK).over(whole)) for ok in has]
    reach = chunks.select(*spec.keys, CHUNK, BUCKET, F.least(*low, CHUNK).alias("_lo"), F.greatest(*high, CHUNK).alias("_hi"))
    return (reach.join(touched, [*spec.keys, CHUNK, BUCKET], "left_semi")
            .select(*spec.keys, BUCKET, F.explode(F.sequence("_lo", "_hi")).alias(CHUNK)).distinct())


def append(spark: SparkSession, path: str, late: DataFrame, cols: Sequence[str], spec: SeriesSpec = _SPEC,
           cut: str = "checkpoint") -> dict[str, int]:
    """Add ``late`` hourly rows (non-null values overwrite stored ones).  Running it again after a failure gives
    the same tables.  Returns how many (series, chunk) pairs were touched and recomputed, the rows
    recomputed and the partitions replaced."""
    layout = spark.read.parquet(f"{path}/layout").first()
    spec, buckets = replace(spec, chunk_hours=layout["chunk_hours"]), layout["buckets"]
    key = [*spec.keys, CHUNK, BUCKET]
    late = materialize(_placed(late.select(*spec.keys, spec.ts, *cols), spec, buckets), cut)
    touched = materialize(late.select(*key).distinct(), cut)
    if touched.isEmpty():
        return dict.fromkeys(("touched", "recomputed", "rows", "partitions"), 0)

    # observed rows of the touched partitions, the new ones over the old ones
    old = _parts(spark, f"{path}/hourly", touched)
    both = late.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)))
    merged = both.groupBy(*key, spec.ts).agg(*[
        F.coalesce(F.max(F.when(F.col("_new"), F.col(c))), F.max(F.when(~F.col("_new"), F.col(c)))).alias(c) for c in cols])
    merged = materialize(merged, cut)
    _write(merged, f"{path}/hourly", [CHUNK, BUCKET])

    # chunk summaries of the touched buckets
    numbers = [r[0] for r in touched.select(BUCKET).distinct().collect()]  # hash buckets: few
    kept = spark.read.parquet(f"{path}/chunks").filter(F.col(BUCKET).isin(numbers)).join(touched, key, "left_anti")
    fresh = _summary(merged.join(touched, key, "left_semi"), cols, spec)
    chunks = materialize(kept.unionByName(fresh), cut)
    _write(chunks, f"{path}/chunks", [BUCKET])

    # what to recompute: hours of the affected chunks, their rows, the nearest observations outside
    chunks = chunks.join(touched.select(*spec.keys).distinct(), list(spec.keys), "left_semi")
    affected = materialize(affected_chunks(chunks, touched, len(cols), spec), cut)
    spans = chunks.groupBy(*spec.keys).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    n = F.lit(spec.chunk_hours)
    lo, hi = F.greatest(hour_index("_first"), F.col(CHUNK) * n), F.least(hour_index("_last"), F.col(CHUNK) * n + n - 1)
    hours = (affected.join(spans, list(spec.keys)).withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")
             .select(*spec.keys, F.explode(F.sequence("_lo", "_hi")).alias("_h"))
             .select(*spec.keys, from_hour_index("_h").alias(spec.ts)))
    own = _parts(spark, f"{path}/hourly", affected).join(affected, key, "left_semi").select(*spec.keys, spec.ts, *cols)
    outside = chunks.join(affected, key, "left_anti")
    seen = F.array_compact(F.array(*[F.when(F.col(f"_{s}{i}").isNotNull(), F.struct(F.lit(i).alias("i"), F.col(f"_{s}{i}.t").alias("t"), F.col(f"_{s}{i}.v").alias("v")))
                                     for i in range(len(cols)) for s in "fl"]))
    edges = (outside.select(*spec.keys, F.explode(seen).alias("x")).groupBy(*spec.keys, F.col("x.t").alias(spec.ts))
             .agg(*[F.max(F.when(F.col("x.i") == i, F.col("x.v"))).alias(c) for i, c in enumerate(cols)]))
    rows = timegrid.reindex(hours, own, spec).withColumn("_edge", F.lit(False)).unionByName(edges.withColumn("_edge", F.lit(True)))
    filled = fill.impute_series(rows, cols, spec).filter(~F.col("_edge")).drop("_edge")
    again = materialize(_placed(filled, spec, buckets), cut)
    rest = _parts(spark, f"{path}/history", affected).join(affected, key, "left_anti")
    _write(materialize(again.unionByName(rest), cut), f"{path}/history", [CHUNK, BUCKET])
    return {"touched": touched.count(), "recomputed": affected.count(), "rows": again.count(),
            "partitions": affected.select(CHUNK, BUCKET).distinct().count()}
