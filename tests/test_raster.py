"""Grid-cell spatial join against brute force, and the cloud / NDWI rules."""

import math

import numpy as np
import pytest

from hydroseries.operators import raster


def hav(lon1, lat1, lon2, lat2):
    r = math.radians
    a = math.sin(r(lat2 - lat1) / 2) ** 2 + math.cos(r(lat1)) * math.cos(r(lat2)) * math.sin(r(lon2 - lon1) / 2) ** 2
    return 2 * raster.EARTH_RADIUS_M * math.asin(math.sqrt(a))


@pytest.mark.parametrize("radius", [60.0, 5000.0, 40000.0])
def test_near_sites_equals_brute_force(spark, radius):
    rng = np.random.default_rng(11)
    n = 2000
    span = 4 * radius / 111195.0
    px = [(i, 0, float(x), float(y), 1.0) for i, (x, y) in
          enumerate(zip(rng.uniform(100.0, 100.0 + span, n), rng.uniform(13.0, 13.0 + span, n)))]
    sites = [(f"s{j}", float(x), float(y)) for j, (x, y) in
             enumerate(zip(rng.uniform(100.0, 100.0 + span, 6), rng.uniform(13.0, 13.0 + span, 6)))]
    pdf = spark.createDataFrame(px, "pixel_id int, scene_id int, lon double, lat double, VV double")
    sdf = spark.createDataFrame(sites, "site_id string, lon double, lat double")
    got = {(r["pixel_id"], r["site_id"]) for r in raster.near_sites(pdf, sdf, radius).collect()}
    want = {(p[0], s[0]) for p in px for s in sites if hav(p[2], p[3], s[1], s[2]) <= radius}
    assert got == want and len(want) > 0


@pytest.mark.parametrize("lon,lat", [(10.0, 75.0), (10.0, 85.0), (180.0, 0.0), (0.0, 90.0), (-180.0, -89.9)])
def test_near_sites_at_poles_and_date_line(spark, lon, lat):
    rng = np.random.default_rng(7)
    radius, n = 500.0, 1500
    wide = min(180.0, 0.02 / max(math.cos(math.radians(lat)), 1e-4))
    wrap = lambda x: (x + 180.0) % 360.0 - 180.0
    clip = lambda y: max(-90.0, min(90.0, y))
    px = [(i, wrap(lon + float(x)), clip(lat + float(y))) for i, (x, y) in enumerate(zip(rng.uniform(-wide, wide, n), rng.uniform(-0.02, 0.02, n)))]
    sites = [(f"s{j}", *px[j][1:]) for j in range(6)]
    got = {(r["pixel_id"], r["site_id"]) for r in raster.near_sites(
        spark.createDataFrame(px, "pixel_id int, lon double, lat double"),
        spark.createDataFrame(sites, "site_id string, lon double, lat double"), radius).collect()}
    assert got == {(p[0], s[0]) for p in px for s in sites if hav(p[1], p[2], s[1], s[2]) <= radius} and len(got) > 6


def test_cloud_mask_and_ndwi(spark):
    import datetime as dt
    scenes = spark.createDataFrame([
        ("s1", dt.datetime(2024, 1, 1), ["VV"], "IW", 19.9),
        ("s2", dt.datetime(2024, 1, 2), ["VH"], "EW", 20.0),
        ("s3", dt.datetime(2024, 1, 3), ["VV", "VH"], "IW", 80.0)],
        "scene_id string, ts timestamp_ntz, polarisations array<string>, instrument_mode string, cloud_pct double")
    pixels = spark.createDataFrame([
        (1, "s1", 0, 0.3, 0.1), (2, "s1", 1024, 0.3, 0.1), (3, "s1", 2048, 0.3, 0.1), (4, "s1", 3072, 0.3, 0.1),
        (5, "s1", 0, 0.2, -0.2), (6, "s2", 0, 0.3, 0.1), (7, "s3", 0, 0.3, 0.1)],
        "pixel_id int, scene_id string, QA60 int, B3 double, B8 double")
    kept = raster.cloud_mask(pixels, scenes)
    assert sorted(r[0] for r in kept.select("pixel_id").collect()) == [1, 5]
    nd = {r["pixel_id"]: r["NDWI"] for r in raster.ndwi(kept).collect()}
    assert nd[1] == pytest.approx(0.5) and nd[5] is None
    s1 = raster.scene_filter(scenes, "2024-01-01", "2024-01-03", "VV", "IW")
    assert [r[0] for r in s1.select("scene_id").collect()] == ["s1"]
    with pytest.raises(ValueError):
        raster.water_extent(pixels, scenes, scenes, "Landsat")
