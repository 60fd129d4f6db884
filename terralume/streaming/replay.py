"""Composites and cover from a stream: beyond the batch operators, with the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.classes import CLEAR_SCL
from ..functions.indices import ndvi


def read_observations(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_cover(obs: DataFrame, ts: str = "ts", late: str = "30 days", length: str = "30 days", veg_ndvi: float = 0.45, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Mean NDVI and cover by window of clear observations; rows later than ``late`` are dropped.

    Sums and counts are state of one row for each window and key.
    """
    clear = obs.filter(F.col("scl").isin(*CLEAR_SCL)) if "scl" in obs.columns else obs
    nd = clear.withColumn("nd", ndvi("b08", "b04")).withWatermark(ts, late)
    got = nd.groupBy(F.window(ts, length), *keys).agg(F.avg("nd").alias("mean_ndvi"), F.count_if(F.col("nd") >= veg_ndvi).alias("veg"), F.count("nd").alias("n"))
    return got.select(F.col("window.start").alias("period_start"), *keys, "mean_ndvi", F.try_divide(F.col("veg").cast("double"), F.col("n").cast("double")).alias("veg_cover_frac"), "n")


def class_counts(labels: DataFrame, cls: str = "cls", ts: str = "ts", late: str = "30 days", length: str = "30 days") -> DataFrame:
    return labels.withWatermark(ts, late).groupBy(F.window(ts, length), cls).agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes everything there is to Parquet, exactly once, and stops."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
