"""Class probabilities: softmax, confidence, entropy over passes, pseudo-labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import IGNORE
from ..functions.indices import _col


def softmax(logits) -> Column:
    z = _col(logits)
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def argmax(probs) -> Column:
    """The first largest entry, from 0."""
    p = _col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confidence(probs) -> Column:
    return F.array_max(_col(probs))


def entropy(probs) -> Column:
    """-sum p ln p / ln K, probabilities held to at least 1e-8."""
    p = _col(probs)
    total = F.aggregate(F.transform(p, lambda v: v * F.log(F.greatest(v, F.lit(1e-8)))), F.lit(0.0), lambda a, v: a + v)
    return -total / F.log(F.size(p).cast("double"))


def pseudo_label(probs, threshold: float = 0.8) -> Column:
    return F.when(confidence(probs) < threshold, IGNORE).otherwise(argmax(probs))


def mean_over_passes(passes: DataFrame, keys: list[str], probs: str, classes: int) -> DataFrame:
    """One mean of each class over the passes of a pixel: plain averages, partial before the shuffle."""
    means = F.array(*[F.avg(F.col(probs)[k]) for k in range(classes)])
    return passes.groupBy(*keys).agg(means.alias(probs))


def kept_fraction(df: DataFrame, probs: str, threshold: float = 0.8) -> DataFrame:
    return df.agg(F.avg((confidence(probs) >= threshold).cast("double")).alias("kept"), F.count(F.lit(1)).alias("n"))


def flip(image, height: int, width: int, rows: bool, cols: bool) -> Column:
    """A flat row-major image with rows and/or columns reversed."""
    at = F.sequence(F.lit(0), F.lit(height * width - 1))
    x = _col(image)

    def source(i: Column) -> Column:
        r, c = F.floor(i / width).cast("int"), i % width
        r = height - 1 - r if rows else r
        c = width - 1 - c if cols else c
        return F.get(x, r * width + c)

    return F.transform(at, source)
