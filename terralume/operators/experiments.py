"""Label-efficiency, transfer and self-training protocols.

The models are per-pixel multinomial logistic regressions of ``pyspark.ml``: they stand in for a neural
segmenter and their scores are not comparable with one.  Splits follow keyed hashes, so every engine
draws the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import IGNORE
from .grid import keyed_order
from .metrics import agreement, confusion, seed_summary
from .ranks import placed


def ranked(units: DataFrame, key: str, seed: int) -> DataFrame:
    """``units`` (one row a tile) with their place in the seed's order and their number."""
    return placed(units, [keyed_order(seed, F.col(key)), F.col(key)]).withColumnRenamed("n_rows", "n_units")


def validation_split(units: DataFrame, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """``units`` with is_val: the first share of the fixed order, one at least."""
    r = ranked(units, key, seed)
    n = F.greatest(F.lit(1), F.bround(F.col("n_units") * share).cast("int"))
    return r.withColumn("is_val", F.col("place") < n).drop("place", "n_units")


def nested_subsets(units: DataFrame, key: str, fractions: Sequence[float], seeds: Sequence[int]) -> DataFrame:
    """seed, fraction, key: for each seed the first max(1, round(n x fraction)) units of its order."""
    parts = None
    for seed in seeds:
        r = ranked(units.select(key), key, seed)
        take = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.greatest(F.lit(1), F.bround(F.col("n_units") * f).cast("int")).alias("n")) for f in fractions]))
        got = r.withColumn("t", take).filter(F.col("place") < F.col("t.n")).select(F.lit(seed).alias("seed"), F.col("t.fraction").alias("fraction"), F.col("t.n").alias("n_train"), key)
        parts = got if parts is None else parts.unionByName(got)
    return parts


def self_training_split(units: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """key, role: the first share is labelled, the rest gets pseudo-labels."""
    r = ranked(units, key, seed)
    n = F.greatest(F.lit(1), F.bround(F.col("n_units") * fraction).cast("int"))
    return r.select(key, F.when(F.col("place") < n, "labelled").otherwise("unlabelled").alias("role"))


def assembled(pixels: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(pixels)


def train(pixels: DataFrame, features: Sequence[str], target: str = "target", rounds: int = 20):
    from pyspark.ml.classification import LogisticRegression

    data = assembled(pixels.filter(F.col(target) != IGNORE), features).select("features", F.col(target).cast("double").alias("label"))
    return LogisticRegression(maxIter=rounds, regParam=1e-4, family="multinomial").fit(data)


def predict(model, pixels: DataFrame, features: Sequence[str]) -> DataFrame:
    """``pixels`` with pred and probs."""
    from pyspark.ml.functions import vector_to_array

    got = model.transform(assembled(pixels, features))
    return got.withColumns({"pred": F.col("prediction").cast("int"), "probs": vector_to_array("probability")}).drop("features", "rawPrediction", "probability", "prediction")


def miou(model, pixels: DataFrame, features: Sequence[str], ids: Sequence[int]) -> DataFrame:
    held = predict(model, pixels.filter(F.col("target") != IGNORE), features)
    return agreement(confusion(held, "target", "pred", ids)).select(F.col("mean_iou").alias("miou"))


def transfer_matrix(pixels: DataFrame, sites: Sequence[str], features: Sequence[str], ids: Sequence[int], seeds: Sequence[int] = (0, 1, 2), share: float = 0.7) -> DataFrame:
    """source, target, mIoU mean and spread over seeds; in_sample marks the diagonal, held_out its honest twin.

    A model sees one source site.  Models and scores are small; the loop is over sites and seeds.
    """
    rows = None
    for seed in seeds:
        for src in sites:
            own = pixels.filter(F.col("site") == src)
            part = F.pmod(F.xxhash64(F.lit(seed), "y", "x"), F.lit(1000)) < int(share * 1000)
            model = train(own.filter(part), features)
            for dst in sites:
                target = pixels.filter(F.col("site") == dst)
                sets = [("in_sample", target.filter(part)), ("held_out", target.filter(~part))] if src == dst else [("across", target)]
                for kind, data in sets:
                    got = miou(model, data, features, ids).select(F.lit(src).alias("source"), F.lit(dst).alias("target_site"), F.lit(kind).alias("kind"), F.lit(seed).alias("seed"), "miou")
                    rows = got if rows is None else rows.unionByName(got)
    return seed_summary(rows, "miou", ["source", "target_site", "kind"])


def label_efficiency(pixels: DataFrame, unit: str, features: Sequence[str], ids: Sequence[int], fractions: Sequence[float], seeds: Sequence[int]) -> DataFrame:
    """fraction, n_train, mIoU mean, spread and values by seed on a fixed validation split."""
    units = validation_split(pixels.select(unit).distinct(), unit)
    subsets = nested_subsets(units.filter("NOT is_val"), unit, fractions, seeds)
    val = pixels.join(units.filter("is_val").select(unit), unit, "left_semi")
    rows = None
    for seed in seeds:
        for f in fractions:
            chosen = subsets.filter((F.col("seed") == seed) & (F.col("fraction") == float(f)))
            model = train(pixels.join(chosen.select(unit), unit, "left_semi"), features)
            got = miou(model, val, features, ids).select(F.lit(float(f)).alias("fraction"), F.lit(seed).alias("seed"), "miou")
            rows = got if rows is None else rows.unionByName(got)
    counts = subsets.select("fraction", "n_train").distinct()
    return seed_summary(rows, "miou", ["fraction"]).join(counts, "fraction")


def self_training(pixels: DataFrame, unit: str, features: Sequence[str], ids: Sequence[int], fraction: float, threshold: float = 0.8, seed: int = 0) -> DataFrame:
    """supervised and self-trained mIoU, gain (3 decimals) and the share of pixels kept."""
    units = validation_split(pixels.select(unit).distinct(), unit)
    roles = self_training_split(units.filter("NOT is_val").select(unit), unit, fraction, seed)
    val = pixels.join(units.filter("is_val").select(unit), unit, "left_semi")
    labelled = pixels.join(roles.filter("role = 'labelled'").select(unit), unit, "left_semi")
    rest = pixels.join(roles.filter("role = 'unlabelled'").select(unit), unit, "left_semi")
    base = train(labelled, features)
    sure = F.array_max("probs") >= threshold
    told = predict(base, rest, features).withColumn("target", F.when(sure, F.col("pred")).otherwise(IGNORE))
    both = labelled.select("target", *features).unionByName(told.select("target", *features))
    again = train(both, features)
    kept = told.agg(F.avg((F.col("target") != IGNORE).cast("double")).alias("kept"))
    one = miou(base, val, features, ids).select(F.col("miou").alias("supervised")).crossJoin(miou(again, val, features, ids).select(F.col("miou").alias("self_trained")))
    one = one.crossJoin(kept)  # single rows
    return one.select(F.lit(fraction).alias("fraction"), "supervised", "self_trained", F.round(F.col("self_trained") - F.col("supervised"), 3).alias("gain"), "kept")
