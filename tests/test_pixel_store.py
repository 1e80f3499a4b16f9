"""Pixel store: folders pruned by the scene filter, row groups by the place filter; equal results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hydroseries.operators import raster
from hydroseries.sources import pixels

T0 = dt.datetime(2024, 1, 1)


def tables(spark):
    r = random.Random(2)
    scenes = spark.createDataFrame([(i, T0 + dt.timedelta(days=i, hours=5), ["VV"], "IW", 0.0) for i in range(20)],
                                   "scene_id long, ts timestamp_ntz, polarisations array<string>, instrument_mode string, cloud_pct double")
    px = spark.createDataFrame([(r.randrange(20), r.uniform(-180, 180), r.uniform(-90, 90), r.random()) for _ in range(20_000)],
                               "scene_id long, lon double, lat double, VV double")
    sites = spark.createDataFrame([("a", 10.0, 10.0), ("b", -179.9, 0.0), ("c", 100.0, 89.0)], "site_id string, lon double, lat double")
    return px, scenes, sites


def scanned(df):
    """Metrics of the file scans of an executed query, by their greatest size."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            return walk(p.executedPlan() if kind == "AdaptiveSparkPlanExec" else p.plan())
        if kind == "FileSourceScanExec":
            m = p.metrics()
            found.append({k: m.apply(k).value() for k in ("numFiles", "filesSize", "numOutputRows")})
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
    walk(plan)
    return max(found, key=lambda f: f["filesSize"])


def test_scene_and_place_filters_prune(spark, tmp_path):
    px, scenes, sites = tables(spark)
    path, kept = str(tmp_path / "px"), str(tmp_path / "scenes")
    pixels.write_pixels(px, scenes, path, rows_per_group=100)
    scenes.write.parquet(kept)
    stored, scenes2 = pixels.read_pixels(spark, path), spark.read.parquet(kept)
    options = dict(start=T0, end=T0 + dt.timedelta(days=3), radius_m=2e6)
    want = raster.water_extent(px, scenes, sites, "S1", **options)
    got = raster.water_extent(stored, scenes2, sites, "S1", **options)
    assert "dynamicpruning" in got._jdf.queryExecution().toString().lower()
    key = lambda r: (r["site_id"], r["ts"])
    a, b = sorted(want.collect(), key=key), sorted(got.collect(), key=key)
    assert len(a) and [key(r) for r in a] == [key(r) for r in b]
    assert all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(a, b))
    # three of twenty dates are read
    every = scanned(raster.water_extent(stored, scenes2, sites, "S1", radius_m=2e6))
    some = scanned(raster.water_extent(stored, scenes2, sites, "S1", **options))
    assert some["filesSize"] < 0.25 * every["filesSize"]
    # a box skips row groups: fewer rows leave the scan
    box = scanned(pixels.read_pixels(spark, path, (0.0, 0.0, 30.0, 30.0)).agg(F.count("VV")))
    assert box["numOutputRows"] < 0.5 * 20_000


def test_z_order_keeps_neighbours_together(spark):
    df = spark.createDataFrame([(-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (None, 1.0)], "lon double, lat double")
    z = [r[0] for r in df.select(pixels.z_order(F.col("lon"), F.col("lat"))).collect()]
    assert z[0] == 0 and z[1] == 2 ** 32 - 1 and z[2] == 3 << 30 and z[3] is None
