"""Classes from a four-pixel scene, gates, missing values and indices."""

import pytest
from pyspark.sql import functions as F

from terralume.functions import classes as C
from terralume.functions import indices as I

SCENE = [(0, 0, 0.40, 0.05, 0.06, 8.0), (0, 1, 0.38, 0.06, 0.07, 0.2), (0, 2, 0.20, 0.18, 0.16, 0.0), (0, 3, 0.05, 0.06, 0.10, 0.0)]


@pytest.fixture(scope="module")
def scene(spark):
    df = spark.createDataFrame(SCENE, "r int, c int, nir double, red double, green double, chm double")
    return df.withColumns({"ndvi": I.ndvi("nir", "red"), "ndwi": I.ndwi("green", "nir")})


def names(df, cls):
    return [C.NAMES.get(r.k) for r in df.select("c", cls.alias("k")).orderBy("c").collect()]


def test_height_and_spectrum(scene):
    assert names(scene, C.height_spectral_label()) == ["canopy", "low_veg", "bare", "water"]


def test_spectrum_only(scene):
    assert names(scene, C.spectral_label()) == ["vegetation", "vegetation", "bare", "water"]


def test_bands_and_missing(spark):
    rows = [(0.30, 0.0, None), (None, None, 5.0), (0.45, 0.5, None), (0.44, 0.10, 1.0), (0.20, None, None), (0.5, 0.0, 0.5), (0.5, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "ndvi double, ndwi double, chm double")
    got = df.select(C.height_spectral_label().alias("k"), C.spectral_label().alias("s")).collect()
    assert [r.k for r in got] == [C.SENESCENT, C.NODATA, C.LOW_VEG, C.WATER, C.SENESCENT, C.SHRUB, C.CANOPY]
    assert [r.s for r in got] == [C.SENESCENT, C.NODATA, C.VEGETATION, C.WATER, C.SENESCENT, C.VEGETATION, C.VEGETATION]


def test_greenness(spark):
    df = spark.createDataFrame([(None, 5.0), (0.1, 5.0), (0.1, None), (-0.1, 9.0), (0.0, 0.7)], "exg double, chm double")
    assert [r.k for r in df.select(C.height_greenness_label().alias("k")).collect()] == [C.NODATA, C.CANOPY, C.LOW_VEG, C.BARE, C.SHRUB]


def test_ratios_have_no_nan(spark):
    df = spark.createDataFrame([(1.0, -1.0), (float("nan"), 1.0), (3.0, 1.0)], "a double, b double")
    got = df.select(I.ratio(I.no_nan("a"), I.no_nan("b")).alias("x")).collect()
    assert [r.x for r in got] == [None, None, 0.5]


def test_harmonise_at_the_cutoff(spark):
    rows = [("2022-01-24 23:59:59", 1500.0), ("2022-01-25 00:00:00", 1500.0), ("2023-01-01 00:00:00", 300.0), ("2023-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "t string, v double").select(I.harmonise("v", F.to_timestamp("t")).alias("v"))
    # greatest skips NULL, so a missing value must not become 0
    assert [r.v for r in df.collect()][:3] == [1500.0, 500.0, 0.0]


def test_collapse_crosswalk_and_bins(spark):
    df = spark.createDataFrame([(5,), (4,), (3,), (1,), (0,)], "k int")
    assert [r.x for r in df.select(C.collapse("k").alias("x")).collect()] == [7, 7, 7, 1, 0]
    assert [r.x for r in df.select(C.train_id("k").alias("x")).collect()] == [255, 255, 255, 0, 255]
    deg = spark.createDataFrame([(None,), (0.0,), (5.0,), (10.0,), (20.0,), (89.0,)], "d double")
    assert [r.x for r in deg.select(C.slope_class("d").alias("x")).collect()] == ["unknown", "flat", "gentle", "moderate", "steep", "steep"]
    share = spark.createDataFrame([(0.0,), (0.049,), (0.05,)], "d double")
    assert [r.x for r in share.select(C.building_bin("d").alias("x")).collect()] == ["none", "low", "high"]


def test_quadkey_and_projection(spark):
    one = spark.range(1)
    r = one.select(I.quadkey(F.lit(116.1), F.lit(-32.55), 9).alias("q"), I.exg(F.lit(0), F.lit(0), F.lit(0)).alias("z")).first()
    assert len(r.q) == 9 and set(r.q) <= set("0123") and r.q[0] == "3" and r.z == 0.0
    x, y = I.mercator(F.lit(10.0), F.lit(50.0))
    lon, lat = I.mercator_inverse(x, y)
    back = one.select(lon.alias("a"), lat.alias("b")).first()
    assert back.a == pytest.approx(10) and back.b == pytest.approx(50)
