"""Pixel tables from Parquet layers: mosaics, pairs, canopy heights, windows, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indices import canopy_height, height_in_range, no_data, quadkey, transverse_mercator
from ..operators.grid import require_crs


def mosaic(parts: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One pixel for each key: of overlapping parts the first in ``order`` wins, as a whole."""
    best = parts.groupBy(*keys).agg(F.min(F.struct(order, *values)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{v}").alias(v) for v in values])


def read_layer(spark: SparkSession, paths: Sequence[str], keys: Sequence[str] = ("r", "c"), values: Sequence[str] = ("value",)) -> DataFrame:
    """Files in sorted order, the first that has a pixel wins; one scan, whatever the number of files."""
    if not paths:
        raise FileNotFoundError("a layer without files")
    place = F.translate("_metadata.file_path", "/", "\x01")  # a folder's files come before longer names
    parts = spark.read.parquet(*paths).select(*keys, *values, place.alias("_file"))
    return mosaic(parts, keys, "_file", values)


def height_pair(dsm: DataFrame, dem: DataFrame, dsm_grid: dict, dem_grid: dict, dsm_nodata: float | None = None, dem_nodata: float | None = None) -> DataFrame:
    """r, c, dsm, dem, chm of two layers on one grid; another shape or reference system is an error."""
    require_crs(dsm_grid)
    require_crs(dem_grid)
    if (dsm_grid["rows"], dsm_grid["cols"]) != (dem_grid["rows"], dem_grid["cols"]):
        raise ValueError("surface and terrain differ in shape")
    pair = dsm.select("r", "c", no_data("value", dsm_nodata).alias("dsm")).join(dem.select("r", "c", no_data("value", dem_nodata).alias("dem")), ["r", "c"])
    return pair.withColumn("chm", canopy_height("dsm", "dem"))


def aerial(images: DataFrame, year: int | None = None) -> DataFrame:
    """The asked, else the latest, year: a partition filter."""
    if year is None:
        year = images.agg(F.max("year").alias("y")).first()["y"]
    return images.filter(F.col("year") == year)


def buildings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The outlines of the first file in sorted order."""
    if not paths:
        raise FileNotFoundError("no building outlines")
    return spark.read.parquet(sorted(paths)[0])


def reprojected(boxes: DataFrame, epsg: int) -> DataFrame:
    """Boxes x0, y0, x1, y1 from degrees to a transverse grid: the box around the four corners."""
    corners = [transverse_mercator(x, y, epsg) for x in ("x0", "x1") for y in ("y0", "y1")]
    east, north = [c[0] for c in corners], [c[1] for c in corners]
    return boxes.withColumns({"x0": F.least(*east), "y0": F.least(*north), "x1": F.greatest(*east), "y1": F.greatest(*north)})


def global_heights(layer: DataFrame, lon: float, lat: float, zoom: int = 9, most: float = 120.0) -> DataFrame:
    """Canopy heights of the tile around a place; heights out of range are NULL.

    ``layer`` is partitioned by ``quadkey``: the key is one row, so the filter prunes partitions.
    """
    key = layer.sparkSession.range(1).select(quadkey(F.lit(lon), F.lit(lat), zoom).alias("k")).first()["k"]
    return layer.filter(F.col("quadkey") == key).withColumn("h", height_in_range("h", most))


def window(pixels: DataFrame, row0: int, row1: int, col0: int, col1: int, row: str = "r", col: str = "c") -> DataFrame:
    return pixels.filter(F.col(row).between(row0, row1 - 1) & F.col(col).between(col0, col1 - 1))


def training_tiles(tiles: DataFrame, manifest: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Tiles (tile_id, image, mask) of the manifest (``sinks.manifest``), of ``ids`` (tile_id) only if given."""
    chosen = manifest.select(F.col("id").alias("tile_id"))
    if ids is not None:
        chosen = chosen.join(ids, "tile_id", "left_semi")
    return tiles.join(chosen, "tile_id", "left_semi")


def trajectory_records(csv: DataFrame) -> DataFrame:
    """A trajectory table as written to CSV: year, mean_ndvi, veg_cover_frac, recovery_fraction."""
    value = lambda c: F.col(c).cast("double").alias(c)
    rec = [value("recovery_fraction")] if "recovery_fraction" in csv.columns else [F.lit(None).cast("double").alias("recovery_fraction")]
    return csv.select(F.year(F.to_timestamp("time")).alias("year"), value("mean_ndvi"), value("veg_cover_frac"), *rec)
