"""Exact quantiles of groups of any size: no task holds a group.

Equal values are counted before anything is shuffled; the counted values are range-partitioned by group
and value and written with the number of their range; the counts of the ranges tell in which range a rank
lies; only those ranges are read again, and a running count in them finds the rank's value.  So a task
holds one range, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def quantiles(df: DataFrame, value: str, wanted: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and a column for each of ``wanted`` (name: share from 0 to 1), linear between neighbours.

    Missing values do not count; a group without a value, or an empty table, gives no row.
    """
    spark, keys = df.sparkSession, list(by)
    scratch = Scratch(spark)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.put(counted.repartitionByRange(tasks, *keys, "_v").withColumn("_range", F.spark_partition_id()))

    # a row for each group and range
    in_group = Window.partitionBy(*keys)
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_held"))
    sizes = sizes.withColumns({"_all": F.sum("_held").over(in_group), "_upto": F.sum("_held").over(in_group.orderBy("_range"))})
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("at")) for k, q in wanted.items()]))
    ranks = sizes.select(*keys, "_range", (F.col("_upto") - F.col("_held")).alias("_before"), "_upto", places.alias("_p"))
    ranks = ranks.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_p.at"), F.ceil("_p.at")))))
    ranks = ranks.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_upto")))
    ranks = ranks.groupBy(*keys, "_range", "_before").agg(F.collect_list(F.struct("_p.name", "_p.at", F.col("_rank").alias("rank"))).alias("_ranks"))

    # the values at those ranks: two a quantile
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v"))
    held = _joined(ranged, ranks, [*keys, "_range"]).withColumn("_to", upto)
    at = held.select(*keys, "_v", "_n", "_to", F.explode("_ranks").alias("_p")).filter((F.col("_p.rank") < F.col("_to")) & (F.col("_p.rank") >= F.col("_to") - F.col("_n")))
    ends = at.groupBy(*keys, F.col("_p.name").alias("_name"), F.col("_p.at").alias("_at")).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    up = F.col("_at") - F.floor("_at")
    told = ends.withColumn("_told", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((1 - up) * F.col("_low") + up * F.col("_high")))
    return told.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == k, F.col("_told"))).alias(k) for k in wanted]).filter(F.coalesce(*wanted).isNotNull())


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An equi-join in which null keys are equal."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    rest = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), on).select("l.*", *rest)
