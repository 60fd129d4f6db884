"""Whole chains, the command line and the plans they make."""

import json
import os

import pytest
from pyspark.sql import functions as F

from terralume import cli
from terralume.operators import experiments
from terralume.plans import pipelines, registry, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_trajectories(spark):
    lab = views.labelled(spark, SF)
    for rehab in (False, True):
        series, times = pipelines.satellite_trajectory(lab, rehab=rehab)
        rows = series.collect()
        assert rows and all(r.recovery_fraction is None or 0 <= r.recovery_fraction <= 1 for r in rows)
        assert times.count() == len({r.site for r in rows})


def test_scan_reads_little(spark):
    """The scene-class filter reaches the scan below the harmonisation; unused columns are not read."""
    plan = views.composite(spark, SF, bands=("b04", "b08"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(l_linenumber" in plan
    assert "l_tax" not in plan and "l_discount" not in plan
    assert plan.count("Exchange ") == 1


def test_pseudo_labels_without_imagery_or_buildings(spark):
    rows = [(r, c, 5.0 if r < 6 else None, None) for r in range(12) for c in range(12)]
    px = spark.createDataFrame(rows, "r int, c int, h double, exg double")
    got = pipelines.pseudo_labels(px, 12, 12, exg_threshold=None)
    tally = got.agg(*[F.count_if(k).alias(k) for k in ("valid", "raw", "building", "removed", "final")]).first()
    assert (tally.valid, tally.raw, tally.building, tally.removed) == (72, 72, 0, 72) and tally.final == 68  # corners are opened away
    gated = pipelines.pseudo_labels(px, 12, 12).agg(F.count_if("final").alias("n")).first()
    assert gated.n == 0  # no greenness is not green


def test_tiles_without_valid_pixels(spark):
    px = spark.createDataFrame([(r, c, None if c < 4 else 1.0) for r in range(8) for c in range(8)], "r int, c int, slope_deg double")
    got = {r.tile_id: r for r in pipelines.tile_slope_stats(px, 8, 8, 4.0).collect()}
    assert got["r000c000"].slope_bin == "unknown" and got["r000c001"].slope_bin == "flat" and len(got) == 4
    planes = px.select("r", "c", F.col("slope_deg").isNotNull().alias("valid"), F.lit(True).alias("raw"), F.lit(True).alias("building"), F.lit(False).alias("final"))
    stats = {r.tile_id: r for r in pipelines.tile_label_stats(planes, 8, 8, 4.0).collect()}
    assert (stats["r000c000"].valid_px, stats["r000c000"].canopy_pct, stats["r000c000"].building_px, stats["r000c000"].removed_area_m2) == (0, 0.0, 16, 16.0)


@pytest.mark.parametrize("mode", ["transfer", "self_training"])
def test_command_line(spark, tmp_path, mode):
    from terralume.plans.labels import _train_pixels

    _train_pixels(spark, SF).select("site", "unit", "y", "x", "target", "b03", "b04", "b08").write.parquet(str(tmp_path / "px"))
    cli.main([mode, "--pixels", str(tmp_path / "px"), "--out", str(tmp_path / "out"), "--seeds", "1", "--fractions", "0.5", "--sites", "A", "N"])
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(docs) == (6 if mode == "transfer" else 1)


def test_command_line_composite(spark, tmp_path):
    views.px_obs(spark, SF).write.parquet(str(tmp_path / "obs"))
    cli.main(["composite", "--pixels", str(tmp_path / "obs"), "--out", str(tmp_path / "out"), "--features", "b04", "b08"])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 100


def test_entry_stands_without_the_corpus_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "terralume", tmp_path / "terralume", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_protocol_queries_run_every_fraction_and_seed(spark, monkeypatch):
    train, told = experiments.train, experiments.self_training
    sure = []
    monkeypatch.setattr(experiments, "train", lambda px, features: train(px, features, rounds=1))
    monkeypatch.setattr(experiments, "self_training", lambda *a: sure.append(a[-1]) or told(*a))
    q = registry.queries()
    curve = q["label_efficiency"](spark, SF).collect()
    assert sorted(r.fraction for r in curve) == [0.05, 0.1, 0.25, 1.0] and {len(r.miou_seeds) for r in curve} == {3}
    assert max(r.miou_std for r in curve) > 0
    matrix = q["transfer_matrix"](spark, SF).collect()
    assert len(matrix) == 12 and {len(r.miou_seeds) for r in matrix} == {3}
    rows = q["self_training"](spark, SF).collect()
    assert sorted(r.fraction for r in rows) == [0.05, 0.1, 0.25, 1.0] and sure == [0.8] * 4
