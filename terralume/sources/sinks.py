"""Results to files: partitioned Parquet, CSV, JSON, reports.  Only reports touch the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_composite(df: DataFrame, path: str, partitions: Sequence[str] = ("site", "period_start"), sort: Sequence[str] = ("y", "x")) -> None:
    """Parquet by site and period; sorted pixels let a window read skip row groups."""
    df.repartition(*partitions).sortWithinPartitions(*partitions, *sort).write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_layer(df: DataFrame, path: str, grid: dict, row: str = "r", col: str = "c") -> None:
    """A raster layer, ranged by row and column, with its grid as a one-row table beside it."""
    df.repartitionByRange(row, col).sortWithinPartitions(row, col).write.mode("overwrite").parquet(f"{path}/pixels")
    df.sparkSession.createDataFrame([(json.dumps(grid),)], "grid string").coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")


def read_layer(spark, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/pixels"), json.loads(spark.read.parquet(f"{path}/grid").first()["grid"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_tiles(df: DataFrame, path: str) -> None:
    """tile_id, aoi, year, row, col, image, mask as Parquet with array columns."""
    df.write.mode("overwrite").partitionBy("aoi").parquet(path)


def manifest(tiles: DataFrame) -> DataFrame:
    return tiles.select(F.col("tile_id").alias("id"), "aoi", "year", "row", "col")


def validation_json(kappa: DataFrame, reference: str, scheme: str = "vegetation/bare/water") -> DataFrame:
    """One row, one JSON document: per_site (in order of names) and pooled; 3 decimals."""
    told = F.struct(F.round("kappa", 3).alias("kappa"), F.round("overall", 3).alias("overall_agreement"), F.col("n").alias("n_pixels"))
    sites = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("site").isNotNull(), F.struct(F.col("site"), told)))))
    pooled = F.first(F.when(F.col("site").isNull(), told), ignorenulls=True)
    doc = kappa.agg(sites.alias("per_site"), pooled.alias("pooled"))
    return doc.select(F.to_json(F.struct("per_site", "pooled", F.lit(reference).alias("reference"), F.lit(scheme).alias("scheme"))).alias("json"))


def rows_json(df: DataFrame) -> DataFrame:
    """One JSON document for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_text(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").text(path)


def tile_report(city: str, summary: dict, settings: dict) -> str:
    """Markdown of an audit: settings, city figures, spread over tiles."""
    lines = [f"# Label audit: {city}", "", "These are weak labels, not ground truth.", "", "## Settings", ""]
    lines += [f"- {k}: {v}" for k, v in settings.items()]
    lines += ["", "## City", ""] + [f"- {k}: {v:.4g}" if isinstance(v, float) else f"- {k}: {v}" for k, v in summary.items()]
    return "\n".join(lines) + "\n"


def slope_report(city: str, rows: list[dict], factor: float = 1.5) -> str:
    """Markdown of a slope summary, a section a figure; bins whose kept canopy share is ``factor`` times
    that of the flattest bin, or that lose less than it to the clean-up, are marked."""
    names = [k for k in rows[0] if k != "slope_bin"] if rows else []
    text = [f"# Canopy by slope: {city}"]
    for name in names:
        text += ["", f"## {name.replace('_', ' ')}", ""]
        text += [f"- {r['slope_bin']}: {r[name]:.2f}" if isinstance(r[name], float) else f"- {r['slope_bin']}: {r[name]}" for r in rows]
    lost = lambda r: 1 - r["mean_final_canopy_pct"] / r["mean_raw_canopy_pct"] if r["mean_raw_canopy_pct"] else 0.0
    marked = [r["slope_bin"] for r in rows[1:] if r["mean_final_canopy_pct"] > factor * rows[0]["mean_final_canopy_pct"] and lost(r) <= lost(rows[0])]
    text += ["", "## To look at", "", *(f"- {k}" for k in marked or ["none"])]
    return "\n".join(text) + "\n"


def bundle(files: dict[str, str], out: str | Path) -> dict:
    """Copies the files that exist and writes a manifest of what there is."""
    import shutil

    out = Path(out)
    out.mkdir(parents=True, exist_ok=True)
    there = {name: Path(src).exists() for name, src in files.items()}
    for name, src in files.items():
        if there[name]:
            shutil.copy(src, out / name)
    (out / "manifest.json").write_text(json.dumps({"files": sorted(k for k, v in there.items() if v)}, indent=1))
    return there
