"""Queries on layers as they are read: bands, height pairs, imagery by year, outlines, extents, grids, tile subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, temporal, trajectory
from ..sources import config, rasters, sinks
from ..sources.scratch import Scratch
from . import pipelines
from . import views as V
from .views import r6

NZTM = "EPSG:2193"


def default_bands(spark, sf):
    """What a scene is loaded with unless bands are asked for, of the bands it has."""
    obs = V.px_obs(spark, sf, scene=True)
    held = [b for b in temporal.DEFAULT_BANDS if b in obs.columns]
    long = obs.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in held])).alias("o"))
    return long.groupBy("o.band").agg(F.count("o.v").alias("n"), F.sum("o.v").alias("total"))


def height_pair(spark, sf):
    """Surface and terrain of one grid, each with its own missing value."""
    px = V.chm_px(spark, sf)
    height, width = V.dims(px)
    sidecar = {"crs": NZTM, "rows": height, "cols": width}
    dsm = px.select("r", "c", F.coalesce("dsm", F.lit(-9999.0)).alias("value"))
    dem = px.select("r", "c", F.when(F.col("c") % 9 == 4, -32767.0).otherwise(F.col("dem")).alias("value"))
    got = rasters.height_pair(dsm, dem, sidecar, sidecar, -9999.0, -32767.0)
    return got.select("r", "c", *[r6(F.col(k)).alias(k) for k in ("dsm", "dem", "chm")])


def aerial_latest(spark, sf):
    """Imagery of the latest year that there is."""
    images = V.chm_px(spark, sf).withColumn("year", (2015 + F.col("size") % 7).cast("int"))
    return rasters.aerial(images).select("year", "r", "c", "red", "green", "blue")


def _outlines(df):
    """Outlines in degrees, some hundred metres wide, from customers or suppliers."""
    lon, lat = (172 + F.col("k") * 7 % 200 / 100).cast("double"), (-47 + F.col("k") * 11 % 1200 / 100).cast("double")
    wide, high = (F.col("k") % 3 + 1) / F.lit(1000.0), (F.col("k") % 2 + 1) / F.lit(1000.0)
    return df.select(F.col("k").alias("id"), lon.alias("x0"), lat.alias("y0"), (lon + wide).alias("x1"), (lat + high).alias("y1"))


def building_outlines(spark, sf):
    """Outlines of the first of two files, from degrees to the grid's system."""
    first = rasters.buildings(spark, [f"{sf}/supplier.parquet", f"{sf}/customer.parquet"])
    got = rasters.reprojected(_outlines(first.withColumnRenamed("c_custkey", "k")), 2193)
    return got.select("id", *[F.round(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")])


def working_extent(spark, sf):
    """The bounds of the surface model's pixels with a value."""
    px = V.chm_px(spark, sf).filter("dsm IS NOT NULL")
    return grid.extent(px.select((1000.0 + F.col("c")).alias("x"), (5100.0 - F.col("r")).alias("y")))


def grid_alignment(spark, sf):
    """Three grids against the surface model's: itself, one without its last column, one moved and coarser."""
    whole = V.chm_px(spark, sf)
    base = grid.grid_table(whole, NZTM, 1000.0, 5100.0, 1.0)
    other = {
        "same": base,
        "narrow": grid.grid_table(whole.filter("c < 49"), NZTM, 1000.0, 5100.0, 1.0),
        "moved": grid.grid_table(whole, "EPSG:32760", 1000.5, 5100.0, 10.0),
    }
    got = None
    for name, g in other.items():
        one = grid.alignment(base, g).select(F.lit(name).alias("layer"), "aligned", F.array_join("warnings", ", ").alias("warnings"))
        got = one if got is None else got.unionByName(one)
    return got


def tile_subset(spark, sf):
    """Training tiles by their manifest, read for one site of it."""
    made = pipelines.training_tiles(V.labelled(spark, sf), 24, 24, 4, ("b03", "b04", "b08"))
    tiles = Scratch(spark).put(made.withColumnRenamed("site", "aoi"))
    listed = sinks.manifest(tiles)
    ids = listed.filter((F.col("aoi") == "A") & (F.col("row") % 2 == 0)).select(F.col("id").alias("tile_id"))
    got = rasters.training_tiles(tiles, listed, ids)
    return got.select("tile_id", "aoi", "year", F.size("image").alias("n_image"), F.size("mask").alias("n_mask"))


def city_areas(spark, sf):
    """Areas with a city, and the tiles of that city."""
    tiles = V.tile_stats_docs(spark, sf).select(F.lower("city").alias("city"), "valid_px", "canopy_pct")
    by_city = tiles.groupBy("city").agg(F.count(F.lit(1)).alias("n_tiles"), F.sum("valid_px").cast("long").alias("valid_px"), r6(F.avg("canopy_pct")).alias("canopy_pct"))
    areas = config.aoi_dim(spark).select("name", "track", F.lower("city").alias("city"))
    return areas.join(by_city, "city").select("name", "track", "city", "n_tiles", "valid_px", "canopy_pct")


def recovery_fit_planted(spark, sf):
    """Curves of known parameters, a nation each, none that levels off at the target itself: the fit must give them back."""
    n = V.read(spark, sf, "nation").select(F.col("n_nationkey").alias("i"))
    year = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("t")
    level, rate, middle = 0.65 + F.col("i") % 5 / 10, 0.3 + F.col("i") % 4 / 10, 4 + F.col("i") % 7 / 2
    rows = n.select(F.format_string("n%02d", "i").alias("site"), "i", year)
    rows = rows.withColumn("recovery_fraction", level / (1 + F.exp(-rate * (F.col("t") - middle))))
    series = rows.select("site", F.make_date(1990 + F.col("t"), F.lit(1), F.lit(1)).alias("period_start"), "recovery_fraction")
    got = trajectory.recovery_time(series)
    return got.select("site", *[F.round(c, 4).alias(c) for c in ("L", "k", "t0", "years_to_target")])


def _corner(n: int, x: str, y: str) -> str:
    return f"SELECT id, {n} AS corner, {x} AS lon, {y} AS lat FROM o"


#: Powers of the longitude difference from the central meridian (173 degrees), on the GRS 80 ellipsoid.
_PROJECTED = """e AS (SELECT 6378137.0::DOUBLE AS a, (2 - 1 / 298.257222101::DOUBLE) / 298.257222101::DOUBLE AS e2),
h AS (SELECT g.*, a, e2, e2 / (1 - e2) AS ep, radians(lat) AS p, radians(lon - 173) * cos(radians(lat)) AS w, power(tan(radians(lat)), 2) AS t,
  a / sqrt(1 - e2 * power(sin(radians(lat)), 2)) AS nu FROM g, e),
m AS (SELECT *, ep * power(cos(p), 2) AS q, a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256 - 175 * e2 ** 4 / 16384) * p
  - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024 + 105 * e2 ** 4 / 4096) * sin(2 * p)
  + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024 + 525 * e2 ** 4 / 16384) * sin(4 * p)
  - (35 * e2 ** 3 / 3072 + 175 * e2 ** 4 / 12288) * sin(6 * p) + 315 * e2 ** 4 / 131072 * sin(8 * p)) AS arc FROM h),
f AS (SELECT id, corner, 1600000 + 0.9996 * nu * (w + (1 - t + q) * w ** 3 / 6
  + (5 - 18 * t + t ** 2 + 14 * q - 58 * t * q + 13 * q ** 2 + 4 * q ** 3 - 64 * q ** 2 * t - 24 * q ** 3 * t) * w ** 5 / 120
  + (61 - 479 * t + 179 * t ** 2 - t ** 3) * w ** 7 / 5040) AS e,
  10000000 + 0.9996 * (arc + nu * tan(p) * (w ** 2 / 2 + (5 - t + 9 * q + 4 * q ** 2) * w ** 4 / 24
  + (61 - 58 * t + t ** 2 + 270 * q - 330 * t * q + 445 * q ** 2 + 324 * q ** 3 - 680 * q ** 2 * t + 88 * q ** 4 - 600 * q ** 3 * t - 192 * q ** 4 * t) * w ** 6 / 720
  + (1385 - 3111 * t + 543 * t ** 2 - t ** 3) * w ** 8 / 40320)) AS n FROM m)"""
_CORNERS = " UNION ALL ".join(_corner(i, x, y) for i, (x, y) in enumerate((x, y) for x in ("x0", "x1") for y in ("y0", "y1")))
_CITIES = ", ".join(f"('{a['name']}', '{a['track']}', '{a['city'].lower()}')" for a in config.area_records() if a["city"])

QUERIES = {
    "default_bands": (default_bands, f"""WITH {V.PX}, o AS (UNPIVOT (SELECT b02, b03, b04, b05, b08, CAST(scl AS DOUBLE) AS scl FROM px) ON COLUMNS(*) INTO NAME band VALUE v)
        SELECT band, count(v) AS n, sum(v) AS total FROM o GROUP BY band"""),
    "height_pair": (height_pair, f"""WITH {V.CHM}, p AS (SELECT r, c, dsm, CASE WHEN c % 9 <> 4 THEN dem END AS dem FROM chm)
        SELECT r, c, round(dsm, 6) AS dsm, round(dem, 6) AS dem, round(dsm - dem, 6) AS chm FROM p"""),
    "aerial_latest": (aerial_latest, f"""WITH {V.CHM}, y AS (SELECT *, CAST(2015 + size % 7 AS INT) AS year FROM chm)
        SELECT year, r, c, red, green, blue FROM y WHERE year = (SELECT max(year) FROM y)"""),
    "building_outlines": (building_outlines, f"""WITH o0 AS (SELECT c_custkey AS id, CAST(172 + CAST(c_custkey * 7 % 200 AS DOUBLE) / 100 AS DOUBLE) AS x0,
          CAST(-47 + CAST(c_custkey * 11 % 1200 AS DOUBLE) / 100 AS DOUBLE) AS y0 FROM customer),
        o AS (SELECT *, x0 + (id % 3 + 1) / 1000::DOUBLE AS x1, y0 + (id % 2 + 1) / 1000::DOUBLE AS y1 FROM o0), g AS ({_CORNERS}), {_PROJECTED}
        SELECT id, round(min(e), 1) AS x0, round(min(n), 1) AS y0, round(max(e), 1) AS x1, round(max(n), 1) AS y1 FROM f GROUP BY id"""),
    "working_extent": (working_extent, f"""WITH {V.CHM} SELECT 1000.0::DOUBLE + min(c) AS "left", 5100.0::DOUBLE - max(r) AS bottom, 1000.0::DOUBLE + max(c) AS "right", 5100.0::DOUBLE - min(r) AS top
        FROM chm WHERE dsm IS NOT NULL"""),
    "grid_alignment": (grid_alignment, f"""WITH {V.CHM}, a AS (SELECT max(c) AS mc FROM chm), b AS (SELECT max(c) AS mc FROM chm WHERE c < 49)
        SELECT 'same' AS layer, true AS aligned, '' AS warnings UNION ALL SELECT 'narrow', a.mc = b.mc, CASE WHEN a.mc = b.mc THEN '' ELSE 'shape' END FROM a, b UNION ALL SELECT 'moved', false, 'crs, left, res'"""),
    "tile_subset": (tile_subset, f"""WITH {V.LABELLED}, t AS (SELECT *, CAST(y // 4 AS INT) AS row, CAST(x // 4 AS INT) AS col FROM lab)
        SELECT printf('%s_%d_%03d_%03d', site, year, row, col) AS tile_id, site AS aoi, year, CAST(48 AS INT) AS n_image, CAST(16 AS INT) AS n_mask FROM t WHERE site = 'A' AND row % 2 = 0
        GROUP BY site, year, row, col HAVING count(*) = 16 AND count_if(cls <> 0) / 16 >= 0.6"""),
    "city_areas": (city_areas, f"""WITH {V.TILE_DOCS}, areas(name, track, city) AS (VALUES {_CITIES})
        SELECT name, track, areas.city, count(*) AS n_tiles, CAST(sum(valid_px) AS BIGINT) AS valid_px, round(avg(canopy_pct), 6) AS canopy_pct
        FROM areas JOIN docs ON lower(docs.city) = areas.city GROUP BY ALL"""),
    "recovery_fit_planted": (recovery_fit_planted, """WITH p AS (SELECT printf('n%02d', CAST(n_nationkey AS INT)) AS site, CAST(0.65 + n_nationkey % 5 / 10 AS DOUBLE) AS l, CAST(0.3 + n_nationkey % 4 / 10 AS DOUBLE) AS k,
          CAST(4 + n_nationkey % 7 / 2 AS DOUBLE) AS t0 FROM nation)
        SELECT site, round(l, 4) AS L, round(k, 4) AS k, round(t0, 4) AS t0, CASE WHEN l > 0.8 THEN round(t0 - ln(l / 0.8 - 1) / k, 4) END AS years_to_target FROM p"""),
}
