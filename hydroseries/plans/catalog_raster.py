"""Driver queries for the satellite operators (R1-R8) over the ``embeddings``
stand-in for scenes and pixels, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroseries.operators import raster
from hydroseries.plans import sqlkit as S
from hydroseries.plans import staging
from hydroseries.plans.registry import finish, register
from hydroseries.session import materialize

RADIUS_M = 4500.0
GLOBAL_RADIUS_M = 900000.0
WINDOW = ("2024-01-02 00:00:00", "2024-01-12 00:00:00")

_PIXELS = ("pixels AS (SELECT vec_id AS pixel_id, label AS scene_id, CAST(embedding[3] AS DOUBLE) AS lon, "
           "CAST(embedding[4] AS DOUBLE) AS lat, CAST(embedding[1] AS DOUBLE) AS B3, CAST(embedding[2] AS DOUBLE) AS B8, "
           "CAST(embedding[5] AS DOUBLE) AS VV, CAST((CASE WHEN CAST(embedding[6] AS DOUBLE) > 0.15 THEN 1024 ELSE 0 END) + "
           "(CASE WHEN CAST(embedding[7] AS DOUBLE) > 0.15 THEN 2048 ELSE 0 END) AS INTEGER) AS QA60, "
           "CAST(embedding[8] AS DOUBLE) AS _pol, CAST(embedding[9] AS DOUBLE) AS _mode, CAST(CASE WHEN embedding[10] >= 0 THEN embedding[10] END AS DOUBLE) AS rain, "
           "abs(CAST(embedding[11] AS DOUBLE)) AS soil FROM embeddings)")
_SCENES = ("scenes AS (SELECT scene_id, TIMESTAMP '2024-01-01' + to_seconds(scene_id * 36 * 3600) AS ts, "
           "CASE WHEN avg(_pol) > 0 THEN ['VV', 'VH'] ELSE ['VH'] END AS polarisations, "
           "CASE WHEN avg(_mode) > 0.01 THEN 'EW' ELSE 'IW' END AS instrument_mode, "
           "avg(CASE WHEN (QA60 & 3072) <> 0 THEN 1.0 ELSE 0.0 END) * 100.0 AS cloud_pct "
           "FROM pixels GROUP BY scene_id)")
_R = 6371008.8


def _hav(lon1, lat1, lon2, lat2) -> str:
    return (f"{2 * _R!r} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))")


def _near_sql(src: str = "pixels") -> str:
    return (f"near AS (SELECT p.*, s.site_id, {_hav('p.lon', 'p.lat', 's.lon', 's.lat')} AS dist_m "
            f"FROM {src} p JOIN sites s ON {_hav('p.lon', 'p.lat', 's.lon', 's.lat')} <= {RADIUS_M!r})")


register("scene_filter", S.with_(_PIXELS, _SCENES) + S.final(
    ["cloud_pct"], ["scene_id", "ts", "instrument_mode"], "scenes",
    f"ts >= TIMESTAMP '{WINDOW[0]}' AND ts < TIMESTAMP '{WINDOW[1]}' AND list_contains(polarisations, 'VV') "
    "AND instrument_mode = 'IW'"))(
    lambda spark, d: finish(raster.scene_filter(staging.scenes(spark, d), WINDOW[0], WINDOW[1], "VV", "IW")
                            .select("scene_id", "ts", "instrument_mode", "cloud_pct")))

register("cloud_mask", S.with_(_PIXELS, _SCENES) + (
    "SELECT pixel_id, scene_id, QA60 FROM pixels WHERE (QA60 & 3072) = 0 "
    "AND scene_id IN (SELECT scene_id FROM scenes WHERE cloud_pct < 20)"))(
    lambda spark, d: raster.cloud_mask(staging.pixels(spark, d), staging.scenes(spark, d))
    .select("pixel_id", "scene_id", "QA60"))

register("ndwi", S.with_(_PIXELS) + S.final(
    ["NDWI"], ["pixel_id", "scene_id"],
    "(SELECT pixel_id, scene_id, CASE WHEN B3 + B8 = 0 THEN NULL ELSE (B3 - B8) / (B3 + B8) END AS NDWI FROM pixels)"))(
    lambda spark, d: finish(raster.ndwi(staging.pixels(spark, d)).select("pixel_id", "scene_id", "NDWI")))

register("near_sites", S.with_(_PIXELS, S.SITES, _near_sql()) + S.final(
    ["dist_m"], ["pixel_id", "scene_id", "site_id"], "near"))(
    lambda spark, d: finish(raster.near_sites(staging.pixels(spark, d), staging.sites(spark, d), RADIUS_M)
                            .select("pixel_id", "scene_id", "site_id", "dist_m")))

def _global_pixels(spark, d):
    """The pixels spread over the whole sphere, many at the poles and the date line."""
    e = F.col("embedding")
    at = lambda c, bound: F.greatest(F.lit(-bound), F.least(F.lit(bound), c))
    return staging.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("pixel_id"), at(e[2].cast("double") * F.lit(900.0), 180.0).alias("lon"),
        at(e[3].cast("double") * F.lit(400.0), 90.0).alias("lat"))


def _global_sites(spark, d):
    """The nations on a diagonal from one pole and the date line to near the others."""
    k = F.col("n_nationkey").cast("double")
    return staging.table(spark, d, "nation").select(F.col("n_name").alias("site_id"), (k * F.lit(15.0) - F.lit(180.0)).alias("lon"),
                                                    (k * F.lit(7.5) - F.lit(90.0)).alias("lat"))


register("near_sites_global", (
    "WITH p AS (SELECT vec_id AS pixel_id, greatest(-180.0, least(180.0, CAST(embedding[3] AS DOUBLE) * 900.0)) AS lon, "
    "greatest(-90.0, least(90.0, CAST(embedding[4] AS DOUBLE) * 400.0)) AS lat FROM embeddings), "
    "s AS (SELECT n_name AS site_id, CAST(n_nationkey AS DOUBLE) * 15.0 - 180.0 AS lon, "
    "CAST(n_nationkey AS DOUBLE) * 7.5 - 90.0 AS lat FROM nation), "
    f"j AS (SELECT pixel_id, site_id, {_hav('p.lon', 'p.lat', 's.lon', 's.lat')} AS dist_m FROM p, s) "
    f"SELECT pixel_id, site_id, round(dist_m, 3) AS dist_m FROM j WHERE dist_m <= {GLOBAL_RADIUS_M!r}"))(
    lambda spark, d: raster.near_sites(_global_pixels(spark, d), _global_sites(spark, d), GLOBAL_RADIUS_M)
    .select("pixel_id", "site_id", F.round("dist_m", 3).alias("dist_m")))

register("zonal_mean", S.with_(_PIXELS, S.SITES, _near_sql()) + S.final(
    ["VV", "VV_nearest"], ["site_id", "scene_id", "n_pixels"],
    "(SELECT site_id, scene_id, avg(VV) AS VV, count(VV) AS n_pixels, arg_min(VV, dist_m) AS VV_nearest "
    "FROM near GROUP BY 1, 2)"))(
    lambda spark, d: finish(raster.zonal_mean(
        raster.near_sites(staging.pixels(spark, d), staging.sites(spark, d), RADIUS_M), "VV")))


def _inputs(spark, d):
    """Pixels, scenes (one small row each, read several times: cut once) and sites."""
    return staging.pixels(spark, d), materialize(staging.scenes(spark, d), "checkpoint"), staging.sites(spark, d)


def _water_extent(spark, d, reduce="mean"):
    return water_extents(*_inputs(spark, d), reduce)


def water_extents(px, sc, st, reduce="mean"):
    """The series of both instruments in long form."""
    s1 = raster.water_extent(px, sc, st, "S1", radius_m=RADIUS_M, reduce=reduce)
    s2 = raster.water_extent(px, sc, st, "S2", radius_m=RADIUS_M, reduce=reduce)
    out = (s1.select("site_id", "ts", F.lit("satellite_water_index_s1_vv").alias("band"),
                     F.col("satellite_water_index_s1_vv").alias("value"))
           .unionByName(s2.select("site_id", "ts", F.lit("satellite_water_index_s2_ndwi").alias("band"),
                                  F.col("satellite_water_index_s2_ndwi").alias("value"))))
    return finish(out)


_S1 = ("s1 AS (SELECT n.site_id, sc.ts, 'satellite_water_index_s1_vv' AS band, avg(n.VV) AS value "
       "FROM near1 n JOIN scenes sc ON n.scene_id = sc.scene_id GROUP BY n.site_id, n.scene_id, sc.ts)")
_S2 = ("s2 AS (SELECT n.site_id, sc.ts, 'satellite_water_index_s2_ndwi' AS band, avg(n.NDWI) AS value "
       "FROM near2 n JOIN scenes sc ON n.scene_id = sc.scene_id GROUP BY n.site_id, n.scene_id, sc.ts)")
_P1 = ("px1 AS (SELECT * EXCLUDE (_pol, _mode) FROM pixels WHERE scene_id IN (SELECT scene_id FROM scenes "
       "WHERE list_contains(polarisations, 'VV') AND instrument_mode = 'IW'))")
_P2 = ("px2 AS (SELECT * EXCLUDE (_pol, _mode), CASE WHEN B3 + B8 = 0 THEN NULL ELSE (B3 - B8) / (B3 + B8) END AS NDWI FROM pixels "
       "WHERE (QA60 & 3072) = 0 AND scene_id IN (SELECT scene_id FROM scenes WHERE cloud_pct < 20))")

register("water_extent", S.with_(_PIXELS, _SCENES, S.SITES, _P1, _P2,
                                 _near_sql("px1").replace("near AS", "near1 AS"),
                                 _near_sql("px2").replace("near AS", "near2 AS"), _S1, _S2)
         + S.final(["value"], ["site_id", "ts", "band"],
                   "(SELECT * FROM s1 WHERE value IS NOT NULL UNION ALL SELECT * FROM s2 WHERE value IS NOT NULL)"))(
    _water_extent)

_NEAREST = ("(SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY site_id, scene_id ORDER BY dist_m, {v}) = 1)")

register("water_extent_point", S.with_(_PIXELS, _SCENES, S.SITES, _P1, _P2,
                                       _near_sql("px1").replace("near AS", "near1 AS"),
                                       _near_sql("px2").replace("near AS", "near2 AS"),
                                       _S1.replace("FROM near1", "FROM " + _NEAREST.format(src="near1", v="VV")),
                                       _S2.replace("FROM near2", "FROM " + _NEAREST.format(src="near2", v="NDWI")))
         + S.final(["value"], ["site_id", "ts", "band"],
                   "(SELECT * FROM s1 WHERE value IS NOT NULL UNION ALL SELECT * FROM s2 WHERE value IS NOT NULL)"))(
    lambda spark, d: _water_extent(spark, d, "nearest"))


def _series_sql(v: str, name: str, src: str = "near") -> str:
    return S.with_(_PIXELS, _SCENES, S.SITES, _near_sql()) + S.final(
        [name], ["site_id", "ts"], f"(SELECT n.site_id, sc.ts, avg(n.{v}) AS {name} FROM {src} n JOIN scenes sc "
        f"ON n.scene_id = sc.scene_id GROUP BY n.site_id, n.scene_id, sc.ts)", f"{name} IS NOT NULL")


register("satellite_rainfall", _series_sql("rain", "satellite_rainfall_mm_hr"))(
    lambda spark, d: finish(raster.satellite_rainfall(*_inputs(spark, d), radius_m=RADIUS_M)))

register("satellite_soil_moisture", _series_sql("soil", "satellite_soil_moisture", _NEAREST.format(src="near", v="soil")))(
    lambda spark, d: finish(raster.satellite_soil_moisture(*_inputs(spark, d), radius_m=RADIUS_M, reduce="nearest")))
