"""Structured Streaming variants.

T1: hourly tumbling aggregates of a sensor stream with a late-data bound
(watermark); append mode emits an hour once the watermark passes its end.

T2: realtime scoring per micro-batch (``foreachBatch``): the sealed hours of the
batch are appended to the hourly table (partitioned by date), then for the
sites touched by the batch the last ``window_hours`` hours are densified,
imputed and turned into features, the newest row per site is scored, and the
predictions are appended; a site with too few hours in the window gets an error row.  Both sinks are idempotent per batch id, so a
restarted batch does not duplicate rows.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.config import FeatureConfig, SeriesSpec
from hydroseries.operators import features, fill, learn, scaling, score, split, stats, timegrid
from hydroseries.session import checkpoint_dir, scratch_path
from hydroseries.sources import io


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's (shared) checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def hourly_stream(stream: DataFrame, aggs: dict[str, Column], key: Column, ts: str = "ts",
                  late: str = "5 hours") -> DataFrame:
    """``(site_id, ts, aggregates...)`` per sealed hour.  The watermark
    needs a ``TIMESTAMP`` column, so NTZ times are cast (the session zone is
    UTC, so the instant is unchanged)."""
    s = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    g = s.groupBy(F.window("_t", "1 hour").alias("_w"), key.alias("site_id")).agg(
        *[e.alias(n) for n, e in aggs.items()])
    return g.select("site_id", F.col("_w.start").cast("timestamp_ntz").alias("ts"), *aggs)


def run_available_now(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                      partition_by: tuple[str, ...] = ()) -> None:
    w = (df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
           .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start(sink).awaitTermination()


def latest_window_features(hourly: DataFrame, cols: list[str], window_hours: int,
                           cfg: FeatureConfig, spec: SeriesSpec) -> tuple[DataFrame, DataFrame]:
    """Last ``window_hours`` hours per site -> dense -> F1 -> features
    (target not required) -> newest row per site, for the sites with enough
    hours; and the sufficiency report (A6) with the newest hour of each site."""
    end = hourly.groupBy(*spec.keys).agg(F.max(spec.ts).alias("end"))
    spans = end.withColumn("start", F.col("end") - F.make_dt_interval(hours=F.lit(window_hours - 1)))
    grid = timegrid.hourly_grid(spans, spec)
    recent = hourly.join(spans.select(*spec.keys, "start"), list(spec.keys)).filter(
        F.col(spec.ts) >= F.col("start")).drop("start")
    counts = recent.groupBy(*spec.keys).agg(F.max(spec.ts).alias(spec.ts), F.count(F.lit(1)).alias("n_rows"))
    report = stats.with_sufficiency(counts, cfg.history_rows_needed)
    enough = report.filter("sufficient").select(*spec.keys)
    grid = grid.join(enough, list(spec.keys), "left_semi")
    recent = recent.join(enough, list(spec.keys), "left_semi")
    dense = fill.impute_series(timegrid.reindex(grid, recent, spec), cols, spec)
    feats = features.build_features(dense, cfg, spec)
    return split.latest(feats, spec), report


def _folders(spark: SparkSession, path: str, lo: dt.datetime, hi: dt.datetime) -> list[str]:
    """The date folders of an hourly table that exist between two times."""
    days = [(lo.date() + dt.timedelta(days=i)).isoformat() for i in range((hi.date() - lo.date()).days + 1)]
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    made = [f"{path}/date={d}" for d in days]
    return [f for f in made if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f))]


def read_hours(spark: SparkSession, path: str, lo: dt.datetime, hi: dt.datetime, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Sealed hours of the dates from ``lo`` to ``hi``: other dates' folders are not even listed.  An hour stands once,
    also while a compaction is under way (it does not change once it is sealed)."""
    rows = spark.read.option("basePath", path).parquet(*_folders(spark, path, lo, hi)).drop("date", "batch_id")
    return rows.dropDuplicates([*spec.keys, spec.ts])


def compact_hours(spark: SparkSession, path: str, lo: dt.datetime, hi: dt.datetime, spec: SeriesSpec = SeriesSpec()) -> int:
    """Brings the batches of each sealed date in ``[lo, hi]`` together in one folder (batch -1) and removes theirs; returns the
    dates compacted.  Readers see every hour once at any time, and a run that was cut off can be repeated."""
    folders = _folders(spark, path, lo, hi)
    if not folders:
        return 0
    (read_hours(spark, path, lo, hi, spec).withColumns({"date": F.to_date(spec.ts), "batch_id": F.lit(-1).cast("long")}).repartition("date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(path))
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in folders:
        for s in fs.listStatus(hadoop.Path(f)):
            if s.getPath().getName() != "batch_id=-1":
                fs.delete(s.getPath(), True)
    return len(folders)


@contextlib.contextmanager
def state_partitions(spark: SparkSession, most: int = 64):
    """Queries started inside have ``most`` partitions of state at most.  Every task of a stateful query sends the driver a
    metric for each partition of each store, so what the driver gets grows with the square of their number."""
    name = "spark.sql.shuffle.partitions"
    kept = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(kept))))
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def scoring_batch(spark: SparkSession, hourly_path: str, pred_path: str, cols: list[str],
                  window_hours: int, cfg: FeatureConfig, spec: SeriesSpec,
                  scorer: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function."""
    def run(batch: DataFrame, batch_id: int) -> None:
        # The batch is used several times below: it is written once and read from there.  Each task over the stateful plan
        # itself, cached or not, sends the driver the metrics of all its state stores.
        path = scratch_path(spark, f"batch-{uuid.uuid4().hex}")
        try:
            batch.write.parquet(path)
            _score_batch(spark.read.schema(batch.schema).parquet(path), batch_id)
        finally:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _score_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        # Overwrite only this batch's partitions: a retried batch replaces its
        # own output instead of appending it twice.  A date's rows come together, so that files
        # and what the writing tasks report follow the dates, not dates times tasks.
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("date", F.to_date("ts"))
              .hint("rebalance", F.col("date"))
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("date", "batch_id").parquet(hourly_path))
        touched = batch.select(*spec.keys).distinct()
        # Only the dates the realtime window can reach are listed and read.
        span = batch.agg(F.min(spec.ts), F.max(spec.ts)).first()
        hourly = read_hours(spark, hourly_path, span[0] - dt.timedelta(hours=window_hours), span[1], spec).join(touched, list(spec.keys), "left_semi")
        latest, report = latest_window_features(hourly, cols, window_hours, cfg, spec)
        preds = score.with_errors(scorer(latest), report, spec.keys).withColumn("batch_id", F.lit(batch_id).cast("long"))
        (preds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("batch_id").parquet(pred_path))
    return run


def persistence_scorer(level: str = "local_water_level_m", as_of: dt.datetime | None = None,
                       threshold: float = 1.5) -> Callable[[DataFrame], DataFrame]:
    """A model-free scorer: the level one hour ahead equals the current one."""
    def f(df: DataFrame) -> DataFrame:
        x = df.select("site_id", "ts", F.col(level).alias("predicted_water_level_m"))
        return score.interpret_level(x, "predicted_water_level_m", threshold, as_of)
    return f


def stored_model_scorer(spark: SparkSession, base: str, model_type: str, order: list[str], cfg: FeatureConfig,
                        as_of: dt.datetime | None = None, threshold: float = 0.5) -> Callable[[DataFrame], DataFrame]:
    """A scorer with the model and scaler stored under ``base`` (S5, S6): they are loaded
    once, in the first batch; newest rows are aligned to ``order``, scaled, scored and interpreted."""
    loaded: dict = {}

    def f(df: DataFrame) -> DataFrame:
        if not loaded:
            loaded["model"] = learn.load_model(base, model_type)
            loaded["scaler"] = io.load_scaler(spark, f"{base}/scaler").collect()  # one row per feature
        keys = ["site_id", "ts"]
        x = scaling.apply_minmax(scaling.align_columns(df, order, keep=keys), loaded["scaler"], keep=keys)
        x = learn.score(x, loaded["model"], model_type)
        if model_type == "classification":
            return score.interpret_class(x.select(*keys, "prediction_score"), "prediction_score", threshold, as_of, cfg.tz)
        return score.interpret_level(x.select(*keys, "predicted_water_level_m"), "predicted_water_level_m", cfg.flood_threshold_m, as_of, cfg.tz)
    return f


def score_stream(spark: SparkSession, hourly: DataFrame, cols: list[str], window_hours: int, cfg: FeatureConfig,
                 spec: SeriesSpec, scorer: Callable[[DataFrame], DataFrame], base: str) -> str:
    """T2 over a stream of sealed hours (of one feed, ``hourly_stream``, or several, ``combine.combined_hourly_stream``),
    run to completion on what is available; returns the prediction path."""
    fn = scoring_batch(spark, f"{base}/hourly", f"{base}/predictions", cols, window_hours, cfg, spec, scorer)
    with state_partitions(spark):
        query = (hourly.writeStream.foreachBatch(fn).option("checkpointLocation", f"{base}/checkpoint")
                 .trigger(availableNow=True).start())
    query.awaitTermination()
    return f"{base}/predictions"


def stream_score(spark: SparkSession, stream: DataFrame, aggs: dict[str, Column], key: Column,
                 cols: list[str], window_hours: int = 30, cfg: FeatureConfig | None = None,
                 spec: SeriesSpec = SeriesSpec(), scorer: Callable[[DataFrame], DataFrame] | None = None,
                 late: str = "5 hours", base: str | None = None) -> str:
    """Run T2 to completion on what is available; returns the prediction path."""
    base = base or scratch(spark, "score")
    cfg = cfg or FeatureConfig(lag_features=tuple(c for c in cols if c != "humidity"), require_target=False)
    hourly = hourly_stream(stream, aggs, key, late=late)
    return score_stream(spark, hourly, cols, window_hours, cfg, spec, scorer or persistence_scorer(), base)


PREDICTION_SCHEMA = T.StructType([
    T.StructField("site_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("predicted_water_level_m", T.DoubleType()), T.StructField("flood_threshold_m", T.DoubleType()),
    T.StructField("threshold_exceeded", T.BooleanType()), T.StructField("message", T.StringType()),
    T.StructField("model_type", T.StringType()), T.StructField("error", T.StringType()), T.StructField("batch_id", T.LongType()),
])


# --- T3: the same hourly series with explicit per-site state ------------------

STATE_SCHEMA = ("hours array<bigint>, n array<double>, v_sum array<double>, r_sum array<double>, "
                "k_sum array<double>, k_n array<double>, emitted bigint")
HOURLY_SCHEMA = ("site_id string, ts timestamp, local_water_level_m double, rain_1h double, humidity double")


def _hourly_state_fn(key, batches, state):
    """Per site: fold new readings into the partial sums of their hours, emit
    every hour whose end the watermark has passed, keep the rest.  State holds
    only the hours that are still open (bounded by the lateness allowance)."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout  # noqa: F401

    cols = ["n", "v_sum", "r_sum", "k_sum", "k_n"]
    if state.exists:
        h, n, v, r, ks, kn, emitted = state.get
        acc = pd.DataFrame({"h": list(h), "n": list(n), "v_sum": list(v), "r_sum": list(r),
                            "k_sum": list(ks), "k_n": list(kn)})
    else:
        acc, emitted = pd.DataFrame({"h": [], **{c: [] for c in cols}}), -(2 ** 62)
    for pdf in batches:
        if pdf.empty:
            continue
        g = pdf.assign(k_n=pdf["k"].notna().astype(float), k=pdf["k"].fillna(0.0)).groupby("h").agg(
            n=("value", "size"), v_sum=("value", "sum"), r_sum=("rain", "sum"), k_sum=("k", "sum"),
            k_n=("k_n", "sum")).reset_index()
        g = g[g["h"] > emitted]
        acc = g if acc.empty else pd.concat([acc, g]).groupby("h", as_index=False)[cols].sum()
    wm_h = state.getCurrentWatermarkMs() // 3_600_000  # hours fully before the watermark
    sealed = acc[acc["h"] + 1 <= wm_h].sort_values("h")
    rest = acc[acc["h"] + 1 > wm_h]
    if not sealed.empty:
        emitted = int(sealed["h"].max())
    if rest.empty:
        state.remove()
    else:
        state.update((rest["h"].astype("int64").tolist(), *[rest[c].astype(float).tolist() for c in cols], emitted))
        state.setTimeoutTimestamp(int((rest["h"].min() + 1) * 3_600_000))
    if sealed.empty:
        return
    out = pd.DataFrame({
        "site_id": key[0],
        "ts": pd.to_datetime(sealed["h"].astype("int64") * 3600, unit="s"),
        "local_water_level_m": sealed["v_sum"].to_numpy() / sealed["n"].to_numpy() / 40.0,
        "rain_1h": sealed["r_sum"].to_numpy() / 10.0,
        "humidity": np.where(sealed["k_n"] > 0, sealed["k_sum"] / sealed["k_n"].where(sealed["k_n"] > 0, 1.0),
                             np.nan),
    })
    yield out


def hourly_stream_stateful(stream: DataFrame, key: Column, ts: str = "ts", value: str = "value",
                           props: str = "props", late: str = "5 hours") -> DataFrame:
    """The T1 series computed by an explicit stateful operator
    (``applyInPandasWithState``, event-time timeout).  Per-row work (JSON
    field, rain excess, hour index) stays in JVM expressions; the pandas
    function only adds up partial sums per hour."""
    import sys

    from pyspark import cloudpickle
    from pyspark.sql.streaming.state import GroupStateTimeout
    # Ship the state function by value: executors need not have this package
    # installed (it only imports numpy / pandas inside).
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    s = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    rows = s.select(key.alias("site_id"), "_t",
                    F.floor(F.unix_seconds("_t") / 3600).cast("bigint").alias("h"),
                    F.col(value).cast("double").alias("value"),
                    F.greatest(F.col(value) - F.lit(100.0), F.lit(0.0)).alias("rain"),
                    F.get_json_object(props, "$.k").try_cast("double").alias("k"))
    out = rows.groupBy("site_id").applyInPandasWithState(
        _hourly_state_fn, HOURLY_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- T3: the last hours of every site as state ---------------------------------

WINDOW_SCHEMA = "site_id string, ts timestamp, n_hours bigint, level_mean double, rain_sum double"
WINDOW_STATE = "h array<bigint>, level array<double>, rain array<double>"


def _last_hours_fn(window_hours: int):
    def run(key, batches, state):
        """Per site: append the newly sealed hours to the kept ones, emit one row
        per new hour, keep the hours that later windows reach."""
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:  # no hour for long: no later window reaches what is kept
            state.remove()
            return
        kept = pd.DataFrame(dict(zip(("h", "level", "rain"), state.get)) if state.exists else {"h": [], "level": [], "rain": []})
        new = pd.concat(list(batches)).sort_values("h")[["h", "level", "rain"]]
        rows = (pd.concat([kept, new]).sort_values("h") if len(kept) else new).reset_index(drop=True)
        hours, ends = rows["h"].to_numpy(), new["h"].to_numpy()
        first = np.searchsorted(hours, ends - window_hours, side="right")
        last = np.searchsorted(hours, ends, side="right")
        # sums over a window are differences of running sums
        sums = lambda x: np.concatenate([[0.0], np.cumsum(x)])
        level, rain = rows["level"].to_numpy(dtype=float), rows["rain"].to_numpy(dtype=float)
        known, total, wet = sums(~np.isnan(level)), sums(np.nan_to_num(level)), sums(np.nan_to_num(rain))
        n = known[last] - known[first]
        yield pd.DataFrame({"site_id": key[0], "ts": pd.to_datetime(ends.astype("int64") * 3600, unit="s"), "n_hours": last - first,
                            "level_mean": np.where(n > 0, (total[last] - total[first]) / np.where(n > 0, n, 1.0), np.nan),
                            "rain_sum": wet[last] - wet[first]})
        newest = int(hours.max())
        rows = rows[rows["h"] > newest - window_hours]
        state.update((rows["h"].astype("int64").tolist(), rows["level"].tolist(), rows["rain"].tolist()))
        state.setTimeoutTimestamp(max((newest + 1 + window_hours) * 3_600_000, state.getCurrentWatermarkMs() + 1))
    return run


def last_hours_stream(hourly: DataFrame, window_hours: int = 30) -> DataFrame:
    """Per sealed hour of a site the figures of its last ``window_hours``
    hours.  ``hourly`` streams the table that T1 writes, where raw readings are
    already aggregated per (site, hour) in the JVM and hours arrive in order; the
    per-site state holds at most ``window_hours`` rows, and none once the newest hour of the stream is so
    far on that no window reaches them.  (A stateful function
    cannot follow a streaming aggregate in the same query.)"""
    import sys

    from pyspark import cloudpickle
    from pyspark.sql.streaming.state import GroupStateTimeout
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    timed = hourly.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", f"{window_hours} hours")
    rows = timed.select(
        "site_id", "_t", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("bigint").alias("h"),
        F.col("local_water_level_m").alias("level"), F.col("rain_1h").alias("rain"))
    out = rows.groupBy("site_id").applyInPandasWithState(
        _last_hours_fn(window_hours), WINDOW_SCHEMA, WINDOW_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
