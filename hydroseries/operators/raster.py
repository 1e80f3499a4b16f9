"""Satellite operators over landed scene and pixel tables.

``scenes(scene_id, ts, polarisations, instrument_mode, cloud_pct)`` and
``pixels(scene_id, lon, lat, <bands>, QA60)``.  The spatial restriction is a
grid-cell equi-join: each pixel gets the cell of its position, each site is
copied into its cell and the 8 neighbours, and the exact great-circle distance
is checked after the join.  Cells are at least as wide as the radius, so no
pair within the radius is missed and no site is compared with all pixels.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries import config as C

EARTH_RADIUS_M = 6371008.8
DATE = "_date"  # date of the scene, the partition column of a pixel store (sources.pixels)


def scene_filter(scenes: DataFrame, start=None, end=None, polarisation: str | None = None,
                 mode: str | None = None) -> DataFrame:
    """R1 + R2: scenes in ``[start, end)``, optionally with a polarisation in
    their list and a given instrument mode."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("ts") >= F.lit(start))
    if end is not None:
        cond = cond & (F.col("ts") < F.lit(end))
    if polarisation is not None:
        cond = cond & F.array_contains("polarisations", F.lit(polarisation))
    if mode is not None:
        cond = cond & (F.col("instrument_mode") == F.lit(mode))
    return scenes.filter(cond)


def of_scenes(pixels: DataFrame, scenes: DataFrame) -> DataFrame:
    """The pixels of these scenes.  Pixels from a store are joined on the scene's date too: its
    folders of other dates are pruned when the scene table is broadcast."""
    if DATE not in pixels.columns:
        return pixels.join(scenes.select("scene_id"), "scene_id", "left_semi")
    return pixels.join(scenes.select("scene_id", F.to_date("ts").alias(DATE)), ["scene_id", DATE], "left_semi")


def qa_clear(qa: str | Column = "QA60", bits: Sequence[int] = C.QA_CLOUD_BITS) -> Column:
    """All listed QA bits are 0."""
    q = F.col(qa) if isinstance(qa, str) else qa
    mask = sum(1 << b for b in bits)
    return q.bitwiseAND(F.lit(mask)) == 0


def cloud_mask(pixels: DataFrame, scenes: DataFrame, max_pct: float = C.CLOUD_PCT_LIMIT,
               qa: str = "QA60") -> DataFrame:
    """Keep pixels whose QA cloud and cirrus bits are clear, of scenes
    with cloud percentage strictly below ``max_pct``."""
    ok = scenes.filter(F.col("cloud_pct") < F.lit(float(max_pct)))
    return of_scenes(pixels.filter(qa_clear(qa)), ok)


def ndwi(pixels: DataFrame, green: str = "B3", nir: str = "B8", name: str = "NDWI") -> DataFrame:
    """(green - nir) / (green + nir); a zero denominator gives null."""
    g, n = F.col(green).cast("double"), F.col(nir).cast("double")
    return pixels.withColumn(name, F.when(g + n == 0, F.lit(None).cast("double")).otherwise((g - n) / (g + n)))


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    r = F.radians
    dlat, dlon = r(lat2 - lat1), r(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def _cell(lon: Column, lat: Column, side: float) -> list[Column]:
    """Cell of a point of the sphere in a grid of cubes of ``side`` metres."""
    east, north = F.radians(lon), F.radians(lat)
    xyz = F.cos(north) * F.cos(east), F.cos(north) * F.sin(east), F.sin(north)
    return [F.floor(c * F.lit(EARTH_RADIUS_M / side)) for c in xyz]


def near_sites(pixels: DataFrame, sites: DataFrame, radius_m: float = 2 * C.PIXEL_SCALE_M,
               site_cols: Sequence[str] = ("site_id",)) -> DataFrame:
    """Pixels within ``radius_m`` of each site, with ``dist_m``.

    Points are placed in cubes in space, a little larger than the radius (a
    chord is never longer than its arc), so the pixels near a site lie in its cube and
    the 26 around it, at the poles and the date line too.
    """
    side = radius_m * (1 + 1e-9) + 1e-3
    cell = ["_cx", "_cy", "_cz"]
    px = pixels.withColumns(dict(zip(cell, _cell(F.col("lon"), F.col("lat"), side))))
    offs = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "ijk")])
                     for o in itertools.product((-1, 0, 1), repeat=3)])
    st = (sites.select(*site_cols, F.col("lon").alias("_slon"), F.col("lat").alias("_slat"))
               .withColumn("_o", F.explode(offs)))
    st = st.select(*site_cols, "_slon", "_slat",
                   *[(c + F.col(f"_o.{n}")).alias(k) for c, n, k in zip(_cell(F.col("_slon"), F.col("_slat"), side), "ijk", cell)])
    j = px.join(st, cell, "inner")
    j = j.withColumn("dist_m", haversine_m(F.col("lon"), F.col("lat"), F.col("_slon"), F.col("_slat")))
    return j.filter(F.col("dist_m") <= F.lit(float(radius_m))).drop(*cell, "_slon", "_slat")


def zonal_mean(pixels: DataFrame, band: str, by: Sequence[str] = ("site_id", "scene_id"),
               name: str | None = None) -> DataFrame:
    """Mean of a band over the region per group (nulls skipped), the
    count of pixels, and the value of the nearest pixel (parity with a point
    reduction at pixel scale) when ``dist_m`` is present."""
    name = name or band
    aggs = [F.avg(band).alias(name), F.count(band).alias("n_pixels")]
    if "dist_m" in pixels.columns:
        aggs.append(F.min_by(band, F.struct("dist_m", band)).alias(f"{name}_nearest"))
    return pixels.groupBy(*by).agg(*aggs)


def band_series(zonal: DataFrame, scenes: DataFrame, value: str, name: str,
                keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """``(keys, ts, name)`` per scene, nulls dropped."""
    return (zonal.join(scenes.select("scene_id", "ts"), "scene_id", "inner")
                 .select(*keys, "ts", F.col(value).cast("double").alias(name))
                 .dropna(subset=[name]))


def _reduced(pixels: DataFrame, scenes: DataFrame, sites: DataFrame, band: str, name: str, radius_m: float,
             reduce: str) -> DataFrame:
    if reduce not in ("mean", "nearest"):
        raise ValueError(f"unknown reduction {reduce!r}; use mean or nearest")
    z = zonal_mean(near_sites(pixels, sites, radius_m), band)
    return band_series(z, scenes, band if reduce == "mean" else f"{band}_nearest", name)


def site_series(pixels: DataFrame, scenes: DataFrame, sites: DataFrame, band: str, name: str,
                start=None, end=None, radius_m: float = 2 * C.PIXEL_SCALE_M, reduce: str = "mean") -> DataFrame:
    """S3: ``(site_id, ts, name)``, one value per site and scene in ``[start,
    end)``: the mean of the band over the pixels within the radius, or
    (``nearest``) the pixel nearest to the site; nulls dropped."""
    sc = scene_filter(scenes, start, end)
    px = of_scenes(pixels, sc)
    return _reduced(px, sc, sites, band, name, radius_m, reduce)


def satellite_rainfall(pixels: DataFrame, scenes: DataFrame, sites: DataFrame, band: str = C.RAINFALL_BAND,
                       **options) -> DataFrame:
    """Rainfall series per site, ``satellite_rainfall_mm_hr`` (options of ``site_series``)."""
    return site_series(pixels, scenes, sites, band, "satellite_rainfall_mm_hr", **options)


def satellite_soil_moisture(pixels: DataFrame, scenes: DataFrame, sites: DataFrame, band: str = C.SOIL_MOISTURE_BAND,
                            **options) -> DataFrame:
    """Soil moisture series per site, ``satellite_soil_moisture`` (options of ``site_series``)."""
    return site_series(pixels, scenes, sites, band, "satellite_soil_moisture", **options)


def water_extent(pixels: DataFrame, scenes: DataFrame, sites: DataFrame, instrument: str,
                 start=None, end=None, radius_m: float = 2 * C.PIXEL_SCALE_M,
                 max_cloud_pct: float = C.CLOUD_PCT_LIMIT, reduce: str = "mean") -> DataFrame:
    """Water index series per site.  ``S1``: VV backscatter of
    VV-polarised, IW-mode scenes.  ``S2``: NDWI of cloud-masked pixels.
    ``reduce`` as in ``site_series``: the region's mean or its nearest pixel."""
    sc = scene_filter(scenes, start, end)
    if instrument in ("S1", "Sentinel-1"):
        sc = scene_filter(sc, polarisation="VV", mode="IW")
        px = of_scenes(pixels, sc)
        band, name = "VV", "satellite_water_index_s1_vv"
    elif instrument in ("S2", "Sentinel-2"):
        px = ndwi(cloud_mask(pixels, sc, max_cloud_pct))
        band, name = "NDWI", "satellite_water_index_s2_ndwi"
    else:
        raise ValueError(f"unknown instrument {instrument!r}; use S1 or S2")
    return _reduced(px, sc, sites, band, name, radius_m, reduce)
