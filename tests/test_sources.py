"""Configuration, mosaics, sinks, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from terralume.sources import config, rasters, sinks
from terralume.streaming import replay


# Published labels and centroids of the areas.
SITES = {
    "alcoa_huntly": ("Alcoa Huntly bauxite rehab (WA, jarrah forest)", 116.115, -32.56),
    "ranger": ("Ranger uranium mine rehab (NT, Kakadu enclave)", 132.93, -12.68),
    "mt_owen": ("Mt Owen / Ravensworth coal rehab (NSW, Hunter Valley)", 151.115, -32.41),
    "iluka_eneabba": ("Iluka Eneabba mineral sands rehab (WA)", 115.3, -29.8),
    "tauranga_bridge": ("Tauranga (NZ) — co-located LINZ aerial + 1m LiDAR + Sentinel-2", 176.17, -37.7),
}


def test_areas(spark):
    rows = config.aoi_dim(spark).collect()
    assert {r.name: r.label for r in rows} == {k: v[0] for k, v in SITES.items()}
    for r in rows:
        assert ((r.west + r.east) / 2, (r.south + r.north) / 2) == pytest.approx(SITES[r.name][1:], abs=1e-4)
        assert r.west < r.east and r.south < r.north and r.crs == "EPSG:4326" and r.note
    assert {r.track: r.city for r in rows} == {"satellite": None, "bridge": "tauranga"}
    assert config.area("ranger")["mineral"] == "uranium"
    with pytest.raises(KeyError, match="ranger"):
        config.area("Ranger")
    assert config.load_processing().tile_size_m == pytest.approx(153.6)


def test_cities(tmp_path):
    p = tmp_path / "cities.yaml"
    p.write_text("cities:\n  Tauranga: {crs: 'EPSG:2193'}\n")
    assert config.city("TAURANGA", p) == {"crs": "EPSG:2193"}
    with pytest.raises(KeyError, match="tauranga"):
        config.city("oslo", p)


def test_layer_folder():
    assert config.layer_dir("s3://data/", "dsm", "Tauranga") == "s3://data/dsm/tauranga" and config.layer_dir("/d", "cover") == "/d/cover"


def test_slope_report():
    bin_ = lambda name, raw, final: dict(slope_bin=name, tile_count=2, mean_raw_canopy_pct=raw, mean_final_canopy_pct=final)
    told = sinks.slope_report("c", [bin_("flat", 20.0, 10.0), bin_("gentle", 22.0, 11.0), bin_("steep", 80.0, 79.0)])
    assert told.split("## To look at")[1].split() == ["-", "steep"] and "- gentle: 11.00" in told
    assert sinks.slope_report("c", [bin_("flat", 1.0, 1.0)]).split("## To look at")[1].split() == ["-", "none"]


def test_mosaic_first_file_wins(spark, tmp_path):
    for name, v, cols in (("a", 1.0, range(3)), ("b", 2.0, range(2, 5))):
        spark.createDataFrame([(0, c, v) for c in cols], "r int, c int, value double").write.parquet(str(tmp_path / name))
    got = rasters.read_layer(spark, [str(tmp_path / "b"), str(tmp_path / "a")])
    assert {r.c: r.value for r in got.collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 2.0, 4: 2.0}
    with pytest.raises(FileNotFoundError):
        rasters.read_layer(spark, [])


def test_height_pair(spark):
    a = spark.createDataFrame([(0, 0, 5.0), (0, 1, -9999.0), (0, 2, float("nan"))], "r int, c int, value double")
    b = spark.createDataFrame([(0, 0, 2.0), (0, 1, 2.0), (0, 2, 1.0)], "r int, c int, value double")
    g = dict(crs="EPSG:2193", rows=1, cols=3)
    got = rasters.height_pair(a, b, g, g, dsm_nodata=-9999.0)
    assert {r.c: r.chm for r in got.collect()} == {0: 3.0, 1: None, 2: None}
    with pytest.raises(ValueError):
        rasters.height_pair(a, b, g, dict(g, cols=4))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "r int, c int, v double")
    sinks.write_layer(df, str(tmp_path / "layer"), {"res": 1.0})
    back, grid = sinks.read_layer(spark, str(tmp_path / "layer"))
    assert back.count() == 2 and grid == {"res": 1.0}
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["r", "c", "v"]
    comp = df.withColumns({"site": F.lit("s"), "period_start": F.lit("2020-01-01"), "y": F.col("r"), "x": F.col("c")})
    sinks.write_composite(comp, str(tmp_path / "comp"))
    assert spark.read.parquet(str(tmp_path / "comp")).filter("site = 's'").count() == 2
    kap = spark.createDataFrame([("a", 0.5, 0.9, 10), (None, 0.4, 0.8, 12)], "site string, kappa double, overall double, n long")
    doc = json.loads(sinks.validation_json(kap, "cover").first().json)
    assert doc["per_site"]["a"]["kappa"] == 0.5 and doc["pooled"]["n_pixels"] == 12
    (tmp_path / "x.json").write_text("{}")
    assert sinks.bundle({"x.json": str(tmp_path / "x.json"), "y.json": str(tmp_path / "no")}, tmp_path / "out") == {"x.json": True, "y.json": False}
    assert "weak labels" in sinks.tile_report("c", {"tiles": 3.0}, {"crs": "x"})
    t = spark.createDataFrame([("2020-01-01", "0.5", "0.1")], "time string, mean_ndvi string, veg_cover_frac string")
    assert tuple(rasters.trajectory_records(t).first()) == (2020, 0.5, 0.1, None)


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 4 + i % 2, 0.5 + i / 100, 0.2) for i in range(60)]
    df = spark.createDataFrame(rows, "site string, ts timestamp, scl int, b08 double, b04 double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = replay.windowed_cover(replay.read_observations(spark, str(tmp_path / "in"), df.schema), late="100 days")
    replay.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.schema("period_start timestamp, site string, mean_ndvi double, veg_cover_frac double, n long").parquet(str(tmp_path / "out")).count()
    batch = replay.windowed_cover(df).count()
    assert batch == 3 and got <= batch  # windows inside the watermark stay open
