"""Fine labels on a coarse grid, agreement and kappa."""

import pytest
from pyspark.sql import functions as F

from terralume.functions import classes as C
from terralume.functions.indices import ndvi, ndwi
from terralume.operators import metrics as M
from terralume.operators import resample as R
from terralume.operators import temporal as T


def fine(spark, low_veg=True):
    rows = []
    for r in range(30):
        for c in range(30):
            k = C.BARE
            if r < 10 and c < 10:
                k = C.CANOPY
            elif r < 10 and c < 20:
                k = C.WATER
            elif low_veg and 10 <= r < 16 and 10 <= c < 20:
                k = C.LOW_VEG
            rows.append((r, c, k))
    return spark.createDataFrame(rows, "r int, c int, cls int")


def test_majority_and_purity(spark):
    got = {(x.cr, x.cc): x for x in R.majority(fine(spark), 10).collect()}
    assert got[0, 0].cls == C.CANOPY and got[0, 0].purity == pytest.approx(1)
    assert got[0, 1].cls == C.WATER
    assert got[1, 1].cls == C.LOW_VEG and got[1, 1].purity == pytest.approx(0.6)


def test_low_coverage_is_no_data(spark):
    rows = [(r, c, C.CANOPY if r < 2 and c < 2 else 0) for r in range(10) for c in range(10)]
    got = R.majority(spark.createDataFrame(rows, "r int, c int, cls int"), 10, min_coverage=0.5).first()
    assert (got.cls, got.purity) == (0, 0.0)


def test_ties_go_to_the_lowest_class(spark):
    rows = [(0, c, 5 if c < 5 else 2) for c in range(10)]
    assert R.majority(spark.createDataFrame(rows, "r int, c int, cls int"), 10).first().cls == 2


def test_agreement(spark):
    ref = [(r, c, {(0, 0): 7, (0, 1): 2, (1, 1): 7}.get((r, c), 1)) for r in range(3) for c in range(3)]
    coarse = R.majority(fine(spark), 10).select("cr", "cc", C.collapse("cls").alias("a"))
    pairs = coarse.join(spark.createDataFrame(ref, "cr int, cc int, b int"), ["cr", "cc"])
    got = M.agreement(M.confusion(pairs, "a", "b", C.COMMON)).first()
    assert (got.overall, got.mean_iou, got.n) == (1.0, 1.0, 9)


def test_end_to_end(spark):
    cells = {(0, 0): (0.40, 0.05, 0.06), (0, 1): (0.05, 0.06, 0.10)}
    rows = [("2023-01-01", r, c, *cells.get((r, c), (0.20, 0.18, 0.16))) for r in range(3) for c in range(3)]
    cube = spark.createDataFrame(rows, "time string, r int, c int, b08 double, b04 double, b03 double")
    sat = T.time_median(cube, ["r", "c"], ["b08", "b04", "b03"]).withColumns({"ndvi": ndvi(), "ndwi": ndwi()})
    sat = sat.select("r", "c", C.spectral_label().alias("sat"))
    coarse = R.majority(fine(spark, False), 10).select(F.col("cr").alias("r"), F.col("cc").alias("c"), "cls")
    both = coarse.join(sat, ["r", "c"]).withColumns({"a": C.collapse("cls"), "b": C.collapse("sat")})
    first = both.filter("r = 0 AND c = 0").first()
    assert (first.cls, first.sat) == (C.CANOPY, C.VEGETATION)
    assert M.agreement(M.confusion(both, "a", "b", C.COMMON)).first().overall == 1.0


def test_weighted_average_and_lookups(spark):
    src = spark.createDataFrame([(0, c, float(c)) for c in range(4)], "r int, c int, v double")
    got = {(x.cr, x.cc): x.v for x in R.average(src, "v", 1.5).collect()}
    assert got[0, 0] == pytest.approx((0 * 1 + 1 * 0.5) / 1.5)
    assert got[0, 1] == pytest.approx((1 * 0.5 + 2 * 1) / 1.5)
    near = {(x.tr, x.tc): x.v for x in R.nearest(src, 1, 4, 0.5, "v").collect()}
    assert len(near) == 16 and near[0, 7] == 3.0
    line = {x.tc: x.v for x in R.bilinear(src, 1, 4, 0.5, "v").collect() if x.tr == 0}
    assert line[1] == pytest.approx(0.25) and line[7] == 3.0


def test_kappa_edges(spark):
    schema = "site string, a int, b int"
    same = spark.createDataFrame([("x", 1, 1)] * 4, schema)
    assert {r.kappa for r in M.kappa(same, "a", "b", "site").collect()} == {None}  # chance is 1
    assert M.kappa(spark.createDataFrame([("x", 0, 1)], schema), "a", "b", "site").count() == 0
    mixed = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("x", 1, 2), ("y", 2, 2), ("y", 1, 1)], schema)
    got = {r.site: r for r in M.kappa(mixed, "a", "b", "site").collect()}
    assert got["y"].kappa == 1.0 and got[None].n == 5 and got[None].overall == pytest.approx(0.8)
    assert got[None].kappa == pytest.approx((0.8 - (3 * 2 + 2 * 3) / 25) / (1 - 12 / 25))


def test_seed_summary_and_corr(spark):
    df = spark.createDataFrame([(s, v) for s, v in enumerate((0.40, 0.35, 0.53))], "seed int, miou double")
    got = M.seed_summary(df, "miou", []).first()
    assert got.miou_mean == pytest.approx(0.426666, abs=1e-5) and got.miou_std == pytest.approx(0.075866, abs=1e-4) and got.miou_seeds == [0.40, 0.35, 0.53]
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 1.0)], "x double, y double")
    assert M.correlation(two, "x", "y").first().r is None
