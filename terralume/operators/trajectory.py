"""Cover over time, recovery against anchors, and the fit of a recovery curve."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indices import recovery_fraction
from .quantiles import quantiles
from .temporal import edge_period


def cleared_footprint(composite: DataFrame, most: float = 0.40, keys: Sequence[str] = ("site", "y", "x")) -> DataFrame:
    """Pixels that were bare in the site's first period: ndvi known and below ``most``."""
    return edge_period(composite, ["site"]).filter(F.col("ndvi") < most).select(*keys).distinct()


def cover_series(composite: DataFrame, mask: DataFrame | None = None, veg_ndvi: float = 0.45, keys: Sequence[str] = ("site", "y", "x")) -> DataFrame:
    """site, period_start, mean_ndvi, veg_cover_frac over valid pixels (of the mask, if given)."""
    held = composite.join(mask, list(keys), "left_semi") if mask is not None else composite
    return held.groupBy("site", "period_start").agg(
        F.avg("ndvi").alias("mean_ndvi"), F.try_divide(F.count_if(F.col("ndvi") >= veg_ndvi).cast("double"), F.count("ndvi").cast("double")).alias("veg_cover_frac")
    )


def range_anchors(series: DataFrame, high: float = 0.95) -> DataFrame:
    """site, bare (the least) and reference (a high quantile, linear) of a series."""
    return series.groupBy("site").agg(F.min("mean_ndvi").alias("bare"), F.percentile("mean_ndvi", F.lit(high)).alias("reference"))


def first_year_anchors(series: DataFrame, composite: DataFrame, high: float = 0.90) -> DataFrame:
    """bare: the first period's mean; reference: a high quantile over all pixels of the last period."""
    bare = edge_period(series, ["site"]).select("site", F.col("mean_ndvi").alias("bare"))
    ref = quantiles(edge_period(composite, ["site"], last=True), "ndvi", {"reference": high}, ["site"])
    return bare.join(ref, "site", "left")


def with_recovery(series: DataFrame, anchors: DataFrame, clip: bool = True) -> DataFrame:
    joined = series.join(anchors, "site")
    return joined.withColumn("recovery_fraction", recovery_fraction("mean_ndvi", "bare", "reference", clip))


def mask_share(dense: DataFrame, mask: DataFrame, keys: Sequence[str] = ("site", "y", "x")) -> DataFrame:
    """site, n_pixels of the mask, its share of all pixels of a dense grid, missing ones included."""
    marked = dense.select(*keys).distinct().join(mask.withColumn("_in", F.lit(1)), list(keys), "left")
    return marked.groupBy("site").agg(F.count("_in").alias("n_pixels"), (F.count("_in") / F.count(F.lit(1))).alias("share"))


def fit_logistic(t: np.ndarray, y: np.ndarray, rounds: int = 500) -> tuple[float, float, float] | None:
    """(L, k, t0) of L / (1 + exp(-k (t - t0))) by Levenberg-Marquardt, or None."""
    p = np.array([max(float(y.max()), 1e-6), 0.5, float(np.median(t))])
    curve = lambda q: q[0] / (1 + np.exp(-np.clip(q[1] * (t - q[2]), -50, 50)))
    damp, err = 1e-2, float(((y - curve(p)) ** 2).sum())
    for _ in range(rounds):
        f = curve(p)
        s = f / p[0] if p[0] else np.zeros_like(f)
        slope = p[0] * s * (1 - s)
        jac = np.stack([s, slope * (t - p[2]), -slope * p[1]], 1)
        a = jac.T @ jac
        try:
            step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), jac.T @ (y - f))
        except np.linalg.LinAlgError:
            return None
        new = float(((y - curve(p + step)) ** 2).sum())
        if np.isfinite(new) and new < err:
            small = err - new < 1e-14
            p, err, damp = p + step, new, max(damp / 5, 1e-12)
            if small:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return tuple(map(float, p)) if np.isfinite(p).all() else None


def recovery_time(series: DataFrame, value: str = "recovery_fraction", target: float = 0.8) -> DataFrame:
    """site, L, k, t0, years_to_target: NULL with fewer than four points or no fit.

    A site's series has one row a period, so a group is small.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = pdf.dropna(subset=[value]).sort_values("year")
        out = {"site": pdf["site"].iloc[0], "L": None, "k": None, "t0": None, "years_to_target": None}
        if len(got) >= 4:
            t = (got["year"] - got["year"].iloc[0]).to_numpy(float)
            if (p := fit_logistic(t, got[value].to_numpy(float))) is not None:
                top, k, t0 = p
                out |= {"L": top, "k": k, "t0": t0}
                if 0 < target < top and k:
                    out["years_to_target"] = float(t0 - np.log(top / target - 1) / k)
        return pd.DataFrame([out]).astype({c: float for c in ("L", "k", "t0", "years_to_target")})

    rows = series.select("site", F.year("period_start").alias("year"), F.col(value).cast("double").alias(value))
    return rows.groupBy("site").applyInPandas(one, "site string, L double, k double, t0 double, years_to_target double")
