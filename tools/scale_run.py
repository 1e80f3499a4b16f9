"""Scale run on data Spark derives from the driver's ``events`` table.

    python tools/scale_run.py --copies 40 --mode sites     # 5 x 40 sites, 30 days each
    python tools/scale_run.py --copies 40 --mode history   # 5 sites, 40 x 30 days each (long, hot series)

``sites``: every copy of ``events`` becomes new sites (``site_id || copy``).
``history``: every copy is shifted by 30 days, so each of the five sites gets a
history ``copies`` times longer — the case where one series holds a large share
of all rows.  The run builds the hourly table, the dense imputed history and
the one-pass features, with chunking on (default) and off, and prints one JSON
line per configuration: seconds, rows, and tasks of the feature stage.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--copies", type=int, default=20)
    ap.add_argument("--mode", choices=["sites", "history", "hourly"], default="history")
    ap.add_argument("--site-copies", type=int, default=200, help="hourly mode: copies of the 5 sites")
    ap.add_argument("--time-copies", type=int, default=24, help="hourly mode: 30-day shifts per site")
    ap.add_argument("--chunk", type=int, default=2688, help="hourly mode: chunk hours (0 = per-site windows)")
    ap.add_argument("--cpus", default="8")
    a = ap.parse_args()
    from pyspark.sql import functions as F

    from hydroseries.config import FeatureConfig, SeriesSpec
    from hydroseries.plans import pipeline, staging
    from hydroseries.session import get_session
    spark = get_session(f"local[{a.cpus}]", shuffle_partitions=int(a.cpus) * 4, extra={
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    if a.mode == "hourly":
        return hourly_run(spark, a)
    ev = staging.table(spark, a.sf_dir, "events")
    x = ev.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(a.copies - 1))))
    if a.mode == "sites":
        x = x.withColumn("event_type", F.concat_ws("_", "event_type", F.col("copy").cast("string")))
    else:
        x = x.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.col("copy").cast("int") * 30))
    raw = staging.events_as_series(x)
    cfg = FeatureConfig(lag_features=("rain_1h", "local_water_level_m"))
    # Warm-up (JIT, codegen) on the first configuration, then alternate.
    for i, chunk in enumerate((672, None, 672, None)):
        spec = SeriesSpec(chunk_hours=chunk)
        t0 = time.perf_counter()
        hourly = staging.resample(raw, staging.obs_aggs(), spec)
        hist = pipeline.build_history(hourly, list(staging.OBS_COLS), spec)
        feats = pipeline.feature_table(hist, cfg, spec)
        feats.write.format("noop").mode("overwrite").save()
        secs = time.perf_counter() - t0
        n = feats.count()
        if i < 2:
            continue
        print(json.dumps({"mode": a.mode, "copies": a.copies, "events": a.copies * ev.count(),
                          "chunk_hours": chunk, "feature_rows": n, "sec": round(secs, 2)}))


def hourly_run(spark, a) -> None:
    """Sites x history built from the staged hourly table (sites copied,
    histories shifted by 30 days): e.g. 200 x 5 = 1,000 sites x 24 x 30 days.
    Times the dense imputed history and the one-pass features (chunked)."""
    from pyspark.sql import functions as F

    from hydroseries.config import FeatureConfig, SeriesSpec
    from hydroseries.plans import pipeline, staging
    spec = SeriesSpec(chunk_hours=a.chunk or None)
    obs = staging.obs(spark, a.sf_dir)
    x = (obs.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(a.site_copies - 1))))
            .withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(a.time_copies - 1))))
            .withColumn("site_id", F.concat_ws("_", "site_id", F.col("_s").cast("string")))
            .withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.col("_t").cast("int") * 30))
            .drop("_s", "_t"))
    cfg = FeatureConfig(lag_features=("rain_1h", "local_water_level_m"))
    t0 = time.perf_counter()
    hist = pipeline.build_history(x, list(staging.OBS_COLS), spec, keep_chunk=spec.chunk_hours is not None)
    t1 = time.perf_counter()
    hist = pipeline.materialize(hist, "checkpoint")   # timed separately from the feature pass
    t2 = time.perf_counter()
    feats = pipeline.feature_table(hist, cfg, spec)
    feats.write.format("noop").mode("overwrite").save()
    t3 = time.perf_counter()
    n_hist, n_feat = hist.count(), feats.count()
    print(json.dumps({"mode": "hourly", "chunk_hours": a.chunk or None, "sites": 5 * a.site_copies, "days": 30 * a.time_copies,
                      "dense_rows": n_hist, "feature_rows": n_feat, "feature_cols": len(feats.columns),
                      "sec_cut_input": round(t1 - t0, 2), "sec_history": round(t2 - t1, 2),
                      "sec_features": round(t3 - t2, 2),
                      "rows_per_sec_features": round(n_feat / (t3 - t2))}))


if __name__ == "__main__":
    main()
