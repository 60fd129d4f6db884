"""Areas, cities and processing parameters from YAML, as records and as small tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent


#: Columns of the table of areas; what a file leaves out is null.
AREA_COLUMNS = {"name": "string", "track": "string", "label": "string", "west": "double", "south": "double", "east": "double", "north": "double", "crs": "string", "city": "string", "mineral": "string", "note": "string"}


@dataclass(frozen=True)
class Processing:
    tile_size_m: float
    block_size_m: float
    buffer_tiles: int
    ratios: tuple[float, float, float]
    chm: dict
    seeds: tuple[int, ...]
    crs: str


def _read(path: str | Path) -> dict:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def _named(entries: dict, name: str, what: str):
    if name not in entries:
        raise KeyError(f"no {what} {name!r}; there are {sorted(entries)}")
    return entries[name]


def area_records(path: str | Path = HERE / "aois.yaml") -> list[dict]:
    """One record an area, keys as in ``AREA_COLUMNS``, in the file's order."""
    out = []
    for name, entry in _read(path)["aois"].items():
        edges = dict(zip(("west", "south", "east", "north"), map(float, entry["bbox"]), strict=True))
        out.append({k: ({"name": name, "crs": "EPSG:4326"} | entry | edges).get(k) for k in AREA_COLUMNS})
    return out


def area(name: str, path: str | Path = HERE / "aois.yaml") -> dict:
    """One record, by exact name."""
    return _named({r["name"]: r for r in area_records(path)}, name, "area")


def city(name: str, path: str | Path) -> dict:
    """A city's settings as written, by name in any case."""
    return _named({k.lower(): v for k, v in _read(path)["cities"].items()}, name.lower(), "city")


def load_data_sources(path: str | Path) -> dict:
    """The layers a site draws on, as written."""
    return _read(path)


@cache
def load_processing(path: str | Path = HERE / "processing.yaml") -> Processing:
    x = _read(path)
    cv = x["spatial_cv"]
    return Processing(x["tile"]["size_px"] * x["tile"]["gsd_m"], cv["block_size_m"], cv["buffer_tiles"], tuple(cv["ratios"]), x["chm"], tuple(x["seeds"]), x["crs"])


def layer_dir(root: str, layer: str, city: str | None = None) -> str:
    """A layer's folder under the data root: a path or URI for Spark's readers."""
    return "/".join([root.rstrip("/"), layer, *([city.lower()] if city else [])])


def aoi_dim(spark: SparkSession, path: str | Path = HERE / "aois.yaml") -> DataFrame:
    """The areas as a table with every column of ``AREA_COLUMNS``."""
    rows = [tuple(r.values()) for r in area_records(path)]
    return spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in AREA_COLUMNS.items()))
