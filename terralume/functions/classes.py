"""The class scheme, its thresholds and the rules that assign classes, bins and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .indices import _col

# Class ids with names and colours.
NODATA, BARE, WATER, LOW_VEG, SHRUB, CANOPY, SENESCENT, VEGETATION = range(8)
NAMES = {BARE: "bare", WATER: "water", LOW_VEG: "low_veg", SHRUB: "shrub", CANOPY: "canopy", SENESCENT: "senescent", VEGETATION: "vegetation"}
COLOURS = {
    NODATA: (0, 0, 0), BARE: (170, 120, 70), WATER: (40, 90, 200), LOW_VEG: (160, 220, 110),
    SHRUB: (70, 160, 70), CANOPY: (20, 90, 30), SENESCENT: (210, 180, 60), VEGETATION: (90, 180, 90),
}
#: Classes that both a height label and a spectral label can hold.
COMMON = (VEGETATION, BARE, WATER, SENESCENT)
IGNORE = 255
# Training ids; everything else is IGNORE.
TRAIN_IDS = {BARE: 0, WATER: 1, SENESCENT: 2, VEGETATION: 3}
# Crosswalk to {1 vegetation, 2 bare, 3 water}: own classes, and codes of the land-cover reference.
OWN_TO_COMMON = {VEGETATION: 1, SENESCENT: 1, BARE: 2, WATER: 3}
COVER_TO_COMMON = {10: 1, 20: 1, 30: 1, 40: 1, 90: 1, 95: 1, 100: 1, 50: 2, 60: 2, 70: 2, 80: 3}
#: Scene classes of clear pixels.
CLEAR_SCL = (2, 4, 5, 6, 7)
# Bins by their upper ends, and the tiles that a city's audit draws first.
SLOPE_BINS = (("flat", 5.0), ("gentle", 10.0), ("moderate", 20.0), ("steep", None))
CANOPY_BINS = (("low", 5.0), ("sparse", 20.0), ("medium", 40.0), ("high", 60.0), ("park", None))
#: rank, city (any if null) and the bins that a tile must have in each column; the least rank that fits counts.
FIRST_DRAWN = (
    (0, "wellington", {"slope": ("steep",), "canopy": ("medium", "high", "park")}),
    (1, "auckland", {"building": ("high",)}),
    (2, "christchurch", {"canopy": ("park",)}),
    (3, "tauranga", {"canopy": ("high", "park")}),
    (4, None, {"canopy": ("low",)}),
)
DRAWN_LAST = 5


# Where the rules cut NDVI, NDWI and height in metres.
CUTS = {"vigorous_ndvi": 0.45, "senescent_ndvi": 0.20, "water_ndwi": 0.10, "shrub_m": 0.5, "canopy_m": 3.0}


def gates(ndvi="ndvi", ndwi="ndwi", cuts: dict[str, float] = CUTS) -> dict[str, Column]:
    """valid, vigorous, senescent and water, none of them NULL."""
    nd, nw = _col(ndvi), _col(ndwi)
    sure = lambda c: F.coalesce(c, F.lit(False))
    return {
        "valid": nd.isNotNull(),
        "vigorous": sure(nd >= cuts["vigorous_ndvi"]),
        "senescent": sure((nd >= cuts["senescent_ndvi"]) & (nd < cuts["vigorous_ndvi"])),
        "water": sure((nw >= cuts["water_ndwi"]) & (nd < cuts["vigorous_ndvi"])),
    }


def _structure(height, cuts: dict[str, float]) -> Column:
    h = _col(height)
    return F.when(h >= cuts["canopy_m"], CANOPY).when(h >= cuts["shrub_m"], SHRUB).otherwise(LOW_VEG)


def spectral_label(ndvi="ndvi", ndwi="ndwi", cuts: dict[str, float] = CUTS) -> Column:
    g = gates(ndvi, ndwi, cuts)
    return F.when(~g["valid"], NODATA).when(g["water"], WATER).when(g["vigorous"], VEGETATION).when(g["senescent"], SENESCENT).otherwise(BARE)


def height_spectral_label(height="chm", ndvi="ndvi", ndwi="ndwi", cuts: dict[str, float] = CUTS) -> Column:
    """Vigorous pixels are told apart by height; one without a height is low vegetation."""
    g = gates(ndvi, ndwi, cuts)
    return (
        F.when(~g["valid"], NODATA).when(g["water"], WATER).when(g["vigorous"], _structure(height, cuts)).when(g["senescent"], SENESCENT).otherwise(BARE)
    )


def height_greenness_label(height="chm", exg="exg", threshold: float = 0.0, cuts: dict[str, float] = CUTS) -> Column:
    e = _col(exg)
    return F.when(e.isNull(), NODATA).when(e >= threshold, _structure(height, cuts)).otherwise(BARE)


def lookup(col, mapping: dict[int, int], default: int) -> Column:
    """A constant map: no join, folded into the projection."""
    c = _col(col)
    out = None
    for src, dst in mapping.items():
        out = F.when(c == src, dst) if out is None else out.when(c == src, dst)
    return out.otherwise(default)


def collapse(cls) -> Column:
    """Structural vegetation classes to plain vegetation."""
    c = _col(cls)
    return F.when(c.isin(LOW_VEG, SHRUB, CANOPY), VEGETATION).otherwise(c)


def train_id(cls) -> Column:
    return lookup(cls, TRAIN_IDS, IGNORE)


def class_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, NAMES.get(k, "nodata"), *COLOURS[k]) for k in range(8)]
    return spark.createDataFrame(rows, "cls int, name string, red int, green int, blue int")


def _bins(x: Column, bins, empty: str | None) -> Column:
    out = F.when(x.isNull(), empty) if empty else None
    for name, top in bins[:-1]:
        out = F.when(x < top, name) if out is None else out.when(x < top, name)
    return out.otherwise(bins[-1][0])


def slope_class(deg) -> Column:
    """NULL is unknown; below zero, which no slope is, falls to the last bin."""
    d = _col(deg)
    return F.when(d < 0, SLOPE_BINS[-1][0]).otherwise(_bins(d, SLOPE_BINS, "unknown"))


def canopy_bin(pct) -> Column:
    p = _col(pct)
    return F.when(p < 0, CANOPY_BINS[-1][0]).otherwise(_bins(p, CANOPY_BINS, None))


def building_bin(share) -> Column:
    s = _col(share)
    return F.when(s <= 0, "none").when(s < 0.05, "low").otherwise("high")


def priority(city, canopy, building, slope) -> Column:
    """0 is drawn first: the tiles whose labels carry most risk, by city."""
    have = {"canopy": _col(canopy), "building": _col(building), "slope": _col(slope)}
    out = F.lit(DRAWN_LAST)
    for rank, place, wanted in reversed(FIRST_DRAWN):
        fits = F.lit(True) if place is None else F.lower(_col(city)) == place
        for column, values in wanted.items():
            fits = fits & have[column].isin(*values)
        out = F.when(fits, rank).otherwise(out)
    return out
