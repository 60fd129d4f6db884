"""Places in an order over all rows, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` with place (from 0, by ``order``, which no two rows may share) and n_rows (of all).

    Rows are range-partitioned by the order and written with the number of their range; a row's place is
    its place in the range and the rows of the ranges before, so a task holds one range.  The one window
    without a partition has a row for each range.  An empty table gives no row.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = Scratch(spark).put(df.repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_held"))
    every = Window.partitionBy()
    before = F.sum("_held").over(Window.orderBy("_range")) - F.col("_held")
    sizes = sizes.select("_range", before.alias("_before"), F.sum("_held").over(every).alias("n_rows"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    # at most a row for each shuffle partition
    told = ranged.withColumn("_inside", inside).join(F.broadcast(sizes), "_range")
    return told.withColumn("place", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")
