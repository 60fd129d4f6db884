"""Strata of tiles and a round-robin draw over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import building_bin, canopy_bin, priority
from .grid import keyed_order


def with_strata(stats: DataFrame) -> DataFrame:
    """Adds the removed share, bins, edge flag, stratum and priority; absent columns get defaults."""
    have = set(stats.columns)
    fill = {"removed_area_m2": F.lit(0.0), "slope_bin": F.lit("unknown"), "city": F.lit("unknown")}
    df = stats.withColumns({k: v for k, v in fill.items() if k not in have})
    most = stats.agg(F.max("valid_px").alias("_most"))
    df = df.crossJoin(F.broadcast(most))  # one row
    df = df.withColumn("removed_ratio", F.when(F.col("valid_px") > 0, F.col("removed_area_m2") / F.col("valid_px")).otherwise(0.0))
    df = df.withColumns({"canopy_bin": canopy_bin("canopy_pct"), "building_bin": building_bin("removed_ratio"), "edge_flag": F.col("valid_px") < 0.9 * F.col("_most")})
    df = df.withColumn("stratum", F.concat_ws("|", "city", "canopy_bin", "building_bin", "slope_bin"))
    return df.withColumn("priority", priority("city", "canopy_bin", "building_bin", "slope_bin")).drop("_most")


def round_robin(strata: DataFrame, n: int, seed: int = 42, key: str = "tile_id") -> DataFrame:
    """n picks: one of each stratum in turn, strata by least priority and name, members by keyed hash.

    Only a stratum's first n members can be drawn, so ranks above n are dropped before the final sort,
    which is a top-n.
    """
    member = Window.partitionBy("stratum").orderBy(keyed_order(seed, F.col(key)), key)
    ranked = strata.withColumn("turn", F.row_number().over(member)).filter(F.col("turn") <= n)
    first = strata.groupBy("stratum").agg(F.min("priority").alias("least"))
    picked = ranked.join(first, "stratum").orderBy("turn", "least", "stratum").limit(n)
    at = F.row_number().over(Window.orderBy("turn", "least", "stratum")) - 1  # n rows
    return picked.withColumn("sample_id", F.format_string("m3_%04d", at)).drop("least")
