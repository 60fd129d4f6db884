"""Confusion, agreement, IoU and kappa: one partial-and-final count, then arithmetic on k x k rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, a: str, b: str, ids: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, a_cls, b_cls, n for pairs inside ``ids``; absent pairs have no row."""
    inside = pairs.filter(F.col(a).isin(*ids) & F.col(b).isin(*ids))
    return inside.groupBy(*keys, F.col(a).alias("a_cls"), F.col(b).alias("b_cls")).agg(F.count(F.lit(1)).alias("n"))


def dense(cm: DataFrame, ids: Sequence[int]) -> DataFrame:
    """All k x k pairs, absent ones with 0 (k is the class scheme)."""
    one = cm.sparkSession.createDataFrame([(i,) for i in ids], "a_cls int")
    full = one.crossJoin(F.broadcast(one.withColumnRenamed("a_cls", "b_cls")))
    return full.join(cm, ["a_cls", "b_cls"], "left").select("a_cls", "b_cls", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _sides(cm: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, cls, of_a, of_b, hit: both margins and the diagonal in one pass over the counts."""
    same = F.when(F.col("a_cls") == F.col("b_cls"), F.col("n")).otherwise(F.lit(0))
    side = lambda c, a, b, hit: F.struct(F.col(c).alias("cls"), a.alias("a"), b.alias("b"), hit.alias("hit"))
    zero, n = F.lit(0).cast("long"), F.col("n").cast("long")
    each = cm.select(*keys, F.explode(F.array(side("a_cls", n, zero, same.cast("long")), side("b_cls", zero, n, zero))).alias("s"))
    return each.groupBy(*keys, F.col("s.cls").alias("cls")).agg(F.sum("s.a").alias("of_a"), F.sum("s.b").alias("of_b"), F.sum("s.hit").alias("hit"))


def class_iou(cm: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, cls, hit, iou of each class seen on either side."""
    union = (F.col("of_a") + F.col("of_b") - F.col("hit")).cast("double")
    return _sides(cm, keys).select(*keys, "cls", "hit", "of_a", F.try_divide(F.col("hit").cast("double"), union).alias("iou"))


def agreement(cm: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, overall, mean_iou (classes absent from both sides left out), n."""
    got = class_iou(cm, keys).groupBy(*keys).agg(F.sum("hit").cast("double").alias("same"), F.avg("iou").alias("mean_iou"), F.sum("of_a").alias("n"))
    return got.select(*keys, F.try_divide("same", F.col("n").cast("double")).alias("overall"), "mean_iou", "n")


def kappa(pairs: DataFrame, a: str, b: str, site: str) -> DataFrame:
    """site (NULL: pooled over all pixels, not an average), kappa, overall, n; labels under 1 are ignored."""
    kept = pairs.filter((F.col(a) >= 1) & (F.col(b) >= 1)).select(F.col(site).alias("site"), F.col(a).alias("a_cls"), F.col(b).alias("b_cls"))
    cm = kept.groupingSets([["site", "a_cls", "b_cls"], ["a_cls", "b_cls"]], "site", "a_cls", "b_cls").agg(F.count(F.lit(1)).alias("n"))
    product = F.col("of_a").cast("double") * F.col("of_b").cast("double")
    whole = _sides(cm, ["site"]).groupBy("site").agg(F.sum("of_a").alias("n"), F.sum("hit").cast("double").alias("same"), F.sum(product).alias("chance"))
    size = F.col("n").cast("double")
    got = whole.withColumns({"po": F.try_divide("same", size), "pe": F.try_divide("chance", size * size)})
    return got.select("site", F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")).alias("kappa"), F.col("po").alias("overall"), "n")


def share(mask: Column) -> Column:
    """The share of rows for which ``mask`` holds; NULL does not."""
    return F.avg(F.when(mask, 1.0).otherwise(0.0))


def correlation(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson's r of rows with both values; NULL with two or fewer."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 2, F.corr(x, y)).alias("r"), F.count(F.lit(1)).alias("n"))


def seed_summary(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean and population spread of a score over seeds, with the scores by seed."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seed", value))), lambda s: s[value])
    return df.groupBy(*keys).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_std"), ordered.alias(f"{value}_seeds"))
