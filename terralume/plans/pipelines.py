"""Pipelines that compose operators: pseudo-labels, tile audits, the satellite chain."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import slope_class
from ..operators import grid, morphology


def pseudo_labels(px: DataFrame, height: int, width: int, *, threshold: float = 2.0, boxes: DataFrame | None = None, buffer: float = 1.0, left: float = 0.0, top: float = 0.0,
                  res: float = 1.0, exg_threshold: float | None = 0.0, min_area: int = 4, roof_exg: float = 0.04, roof_area: int = 40) -> DataFrame:
    """``px`` (r, c, h, exg) with valid, raw, building, green, removed and final.

    Height threshold, minus buffered buildings, greenness gate (``None``: no imagery, no gate and no
    roof rule), opening and small components, then large components that are hardly green.
    """
    no = F.lit(False)
    planes = px.withColumns({"valid": F.col("h").isNotNull(), "raw": F.coalesce(F.col("h") >= threshold, no)})
    if boxes is None:
        planes = planes.withColumn("building", no)
    else:
        burned = morphology.burn_boxes(boxes, left, top, res, height, width, buffer).withColumn("building", F.lit(True))
        planes = planes.join(burned, ["r", "c"], "left").withColumn("building", F.coalesce("building", no))
    gate = F.coalesce("exg", F.lit(-1.0)) >= exg_threshold if exg_threshold is not None else F.lit(True)
    planes = planes.withColumn("green", gate).withColumn("removed", F.col("raw") & ~F.col("building") & F.col("green"))
    opened = morphology.opened_components(planes.filter("removed").select("r", "c"), height, width)
    comps = morphology.drop_small(opened, min_area)
    if exg_threshold is not None:
        comps = morphology.suppress_low_green(comps, px, roof_exg, roof_area)
    final = comps.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.lit(True).alias("final"))
    return planes.join(final, ["r", "c"], "left").withColumn("final", F.coalesce("final", no))


def _tiles(px: DataFrame, height: int, width: int, tile: float) -> DataFrame:
    rows, cols = math.ceil(height / tile), math.ceil(width / tile)
    return grid.pixels_in_tiles(px, rows, cols, tile)


def _all_tiles(px: DataFrame, height: int, width: int, tile: float) -> DataFrame:
    return grid.tile_grid(px.sparkSession, (0.0, 0.0, float(width), float(height)), tile).select("tile_id")


def tile_label_stats(planes: DataFrame, height: int, width: int, tile: float, threshold: float = 2.0, px_area: float = 1.0) -> DataFrame:
    """Counts and shares by tile; building pixels are not masked by validity."""
    n = lambda c: F.count_if(c)
    valid = F.col("valid")
    got = _tiles(planes, height, width, tile).groupBy("tile_id").agg(
        n(valid).alias("valid_px"), n(valid & F.col("final")).alias("canopy_px"), n(valid & F.col("raw")).alias("_raw"),
        n(F.col("building")).alias("building_px"), n(F.col("raw") & F.col("building")).alias("_gone"),
    )
    pct = lambda c: F.when(F.col("valid_px") > 0, F.col(c) / F.col("valid_px") * 100).otherwise(0.0)
    return got.select(
        "tile_id", F.lit(float(threshold)).alias("threshold_m"), "valid_px", "canopy_px", pct("canopy_px").alias("canopy_pct"), pct("_raw").alias("raw_canopy_pct"),
        "building_px", F.round(F.col("_gone") * px_area, 1).cast("double").alias("removed_area_m2"),
    )


def tile_slope_stats(slopes: DataFrame, height: int, width: int, tile: float) -> DataFrame:
    """Mean, 95th percentile and maximum by tile; a tile without a slope stays, unknown."""
    got = _tiles(slopes.filter("slope_deg IS NOT NULL"), height, width, tile).groupBy("tile_id").agg(
        F.avg("slope_deg").alias("mean_slope_deg"), F.percentile("slope_deg", F.lit(0.95)).alias("p95_slope_deg"), F.max("slope_deg").alias("max_slope_deg")
    )
    return _all_tiles(slopes, height, width, tile).join(got, "tile_id", "left").withColumn("slope_bin", slope_class("mean_slope_deg"))


def slope_summary(stats: DataFrame) -> DataFrame:
    """Figures by slope bin, with its place in the fixed order."""
    place = F.array_position(F.array(*map(F.lit, ("flat", "gentle", "moderate", "steep", "unknown"))), F.col("slope_bin")) - 1
    return stats.groupBy("slope_bin").agg(
        F.count(F.lit(1)).alias("tile_count"), F.avg("raw_canopy_pct").alias("mean_raw_canopy_pct"), F.avg("canopy_pct").alias("mean_final_canopy_pct"), F.sum("removed_area_m2").alias("total_removed_area_m2")
    ).withColumn("place", place.cast("int"))


def city_summary(planes: DataFrame, stats: DataFrame, px_area: float = 1.0) -> DataFrame:
    """One row: areas in square kilometres and the spread of canopy over tiles."""
    km2 = lambda c: F.count_if(c) * F.lit(px_area) / 1e6
    whole = planes.agg(
        km2(F.col("valid")).alias("valid_km2"), km2(F.col("final")).alias("canopy_km2"),
        F.try_divide(F.count_if(F.col("final")).cast("double"), F.count_if(F.col("valid")).cast("double")).alias("_s"), km2(F.col("raw") & F.col("building")).alias("removed_km2"),
    ).select("valid_km2", "canopy_km2", (F.col("_s") * 100).alias("canopy_pct"), "removed_km2")
    spread = stats.agg(
        F.count(F.lit(1)).cast("double").alias("tiles"), F.avg("canopy_pct").alias("tile_mean"), F.median("canopy_pct").alias("tile_median"), F.min("canopy_pct").alias("tile_min"), F.max("canopy_pct").alias("tile_max")
    )
    return whole.crossJoin(spread)  # one row by one row


def satellite_trajectory(composite: DataFrame, *, rehab: bool = False, target: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(series with recovery, fitted times) of composites with ndvi.

    Plain: cover of the whole site, anchored at its least and high mean.  ``rehab``: cover of the
    pixels that were bare at first, anchored at their first mean and the last period's high pixels.
    """
    from ..operators import trajectory

    if rehab:
        series = trajectory.cover_series(composite, trajectory.cleared_footprint(composite))
        anchors = trajectory.first_year_anchors(series, composite)
    else:
        series = trajectory.cover_series(composite)
        anchors = trajectory.range_anchors(series)
    told = trajectory.with_recovery(series, anchors)
    return told, trajectory.recovery_time(told, target=target)


def bridge(fine: DataFrame, satellite: DataFrame, scale: float, *, min_coverage: float = 0.5, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(cells, agreement): fine classes (r, c, cls) by coarse cell against satellite classes (cr, cc, cls).

    Both sides are brought to the common scheme; ``keys`` of the satellite side separate reports.
    """
    from ..functions.classes import COMMON, collapse
    from ..operators import metrics, resample

    coarse = resample.majority(fine, scale, min_coverage=min_coverage).select("cr", "cc", F.col("cls").alias("fine_cls"), "purity", "coverage")
    cells = coarse.join(satellite.select("cr", "cc", *keys, F.col("cls").alias("sat_cls")), ["cr", "cc"])
    pairs = cells.select(*keys, collapse("fine_cls").alias("a"), collapse("sat_cls").alias("b"))
    return cells, metrics.agreement(metrics.confusion(pairs, "a", "b", COMMON, keys), keys)


def validate_cover(labels: DataFrame, cover: DataFrame, site: str = "site", keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Kappa by site and pooled of own classes (cls) against land-cover codes (code) at the same pixels."""
    from ..functions.classes import COVER_TO_COMMON, OWN_TO_COMMON, lookup
    from ..operators import metrics

    both = labels.select(site, *keys, lookup("cls", OWN_TO_COMMON, 0).alias("a")).join(cover.select(site, *keys, lookup("code", COVER_TO_COMMON, 0).alias("b")), [site, *keys])
    return metrics.kappa(both, "a", "b", site)


def training_tiles(labelled: DataFrame, height: int, width: int, tile: int, bands: tuple[str, ...], min_valid: float = 0.6, keys: tuple[str, ...] = ("site", "year")) -> DataFrame:
    """Whole tiles with enough labelled pixels: keys, row, col, tile_id, image (bands x pixels), mask.

    A tile is one group of tile x tile pixels, a fixed size.
    """
    from ..functions.classes import train_id
    from ..functions.indices import reflectance

    px = grid.fixed_tiles(labelled, tile, height, width, "y", "x")
    at = (F.col("y") % tile * tile + F.col("x") % tile).alias("at")
    cell = F.struct(at, train_id("cls").alias("target"), *[reflectance(b).cast("float").alias(b) for b in bands])
    got = px.groupBy(*keys, "tile_row", "tile_col").agg((F.count_if(F.col("cls") != 0) / F.lit(tile * tile)).alias("valid"), F.array_sort(F.collect_list(cell)).alias("px"))
    kept = got.filter((F.col("valid") >= min_valid) & (F.size("px") == tile * tile))
    image = F.flatten(F.array(*[F.col(f"px.{b}") for b in bands]))
    name = F.format_string("%s_%s_%03d_%03d", F.col(keys[0]).cast("string"), F.col(keys[-1]).cast("string"), "tile_row", "tile_col")
    return kept.select(name.alias("tile_id"), *keys, F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), image.alias("image"), F.col("px.target").alias("mask"), "valid")
