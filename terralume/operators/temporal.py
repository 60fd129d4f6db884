"""Scenes to composites: search, cloud mask, harmonisation, period medians, calendars, endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import CLEAR_SCL
from ..functions.indices import harmonise

#: Bands that a scene is loaded with unless others are asked for.
DEFAULT_BANDS = ("b02", "b03", "b04", "b05", "b06", "b07", "b08", "b11", "scl")
#: Period name -> (date_trunc unit, step of the calendar).
PERIODS = {"annual": ("year", "interval 1 year"), "seasonal": ("quarter", "interval 3 month"), "monthly": ("month", "interval 1 month")}


def _unit(period: str) -> tuple[str, str]:
    if period not in PERIODS:
        raise ValueError(f"period {period!r} is none of {sorted(PERIODS)}")
    return PERIODS[period]


def search_scenes(catalog: DataFrame, bbox: Sequence[float], start: str, end: str, max_cloud: float = 20.0) -> DataFrame:
    """Scenes whose box meets ``bbox``, in [start, end], with less cloud: all pushed to the scan."""
    w, s, e, n = bbox
    return catalog.filter(
        (F.col("cloud_cover") < max_cloud)
        & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
        & (F.col("east") >= w) & (F.col("west") <= e) & (F.col("north") >= s) & (F.col("south") <= n)
    )


def harmonised(obs: DataFrame, bands: Sequence[str], ts: str = "ts", cutoff: str = "2022-01-25", offset: float = 1000.0) -> DataFrame:
    return obs.withColumns({b: harmonise(b, ts, cutoff, offset) for b in bands})


def cloud_masked(obs: DataFrame, keep: Sequence[int] = CLEAR_SCL) -> DataFrame:
    """Clear observations, without the scene class; unchanged if there is none."""
    return obs.filter(F.col("scl").isin(*keep)).drop("scl") if "scl" in obs.columns else obs


def solar_day_mosaic(obs: DataFrame, keys: Sequence[str], bands: Sequence[str], lon: str = "lon", ts: str = "ts") -> DataFrame:
    """One observation for each pixel and solar day: of each band the first scene's valid value."""
    day = F.to_date(F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col(lon) * 240).cast("decimal(18,6)")))
    first = lambda b: F.min_by(b, F.when(F.col(b).isNotNull(), F.col(ts))).alias(b)
    return obs.groupBy(*keys, day.alias("solar_day")).agg(*[first(b) for b in bands])


def period_median(obs: DataFrame, keys: Sequence[str], bands: Sequence[str], period: str = "annual", ts: str = "ts") -> DataFrame:
    """The exact median of each band by pixel and calendar period; one shuffle on (keys, period)."""
    unit, _ = _unit(period)
    return obs.groupBy(*keys, F.date_trunc(unit, ts).alias("period_start")).agg(*[F.median(b).alias(b) for b in bands])


def dense_periods(composite: DataFrame, keys: Sequence[str], period: str, group: Sequence[str] = ()) -> DataFrame:
    """Every period between the first and the last (of ``group``), empty ones with NULL bands."""
    _, step = _unit(period)
    span = composite.groupBy(*group).agg(F.min("period_start").alias("a"), F.max("period_start").alias("b"))
    spine = span.select(*group, F.explode(F.sequence("a", "b", F.expr(step))).alias("period_start"))
    pixels = composite.select(*dict.fromkeys([*group, *keys])).distinct()
    full = pixels.join(spine, list(group)) if group else pixels.crossJoin(F.broadcast(spine))  # a calendar: one row a period
    return full.join(composite, [*dict.fromkeys([*group, *keys]), "period_start"], "left")


def time_median(composite: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    return composite.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands])


def edge_period(composite: DataFrame, group: Sequence[str], last: bool = False, period: str = "period_start") -> DataFrame:
    """The rows of each group's first (or last) period."""
    pick = (F.max if last else F.min)(period).alias(period)
    return composite.join(composite.groupBy(*group).agg(pick), [*group, period], "left_semi")


def gain(composite: DataFrame, keys: Sequence[str], value: str, first: int, last: int, period: str = "period_start", missing: float = -9.0) -> DataFrame:
    """Change of ``value`` between two years by pixel; pixels of one year only, or NULL, get ``missing``."""
    year = F.year(period)
    ends = composite.filter(year.isin(first, last)).groupBy(*keys)
    got = ends.agg(F.max(F.when(year == first, F.col(value))).alias("v0"), F.max(F.when(year == last, F.col(value))).alias("v1"))
    return got.select(*keys, F.coalesce(F.col("v1") - F.col("v0"), F.lit(missing)).alias("gain"))


def fetch(obs: DataFrame, catalog: DataFrame, bbox, start: str, end: str, *, bands: Sequence[str], keys: Sequence[str] = ("site", "y", "x"), period: str = "annual",
          max_cloud: float = 20.0, cutoff: str = "2022-01-25", offset: float = 1000.0) -> DataFrame:
    """Search, load, harmonise, mask, composite - in this order; no scene is an error."""
    scenes = search_scenes(catalog, bbox, start, end, max_cloud).select("scene_id")
    if scenes.isEmpty():
        raise ValueError("no scenes for this area, time and cloud cover")
    picked = obs.join(scenes, "scene_id", "left_semi")
    optical = [b for b in bands if b != "scl"]
    return period_median(cloud_masked(harmonised(picked, optical, cutoff=cutoff, offset=offset)), keys, optical, period)
