"""Command line: ``python -m terralume.cli MODE --pixels PATH --out PATH``.

Modes label_efficiency, transfer and self_training run the protocols on a Parquet table of labelled
pixels (site, unit, y, x, target and features) and write their rows as JSON; composite turns
observations (site, y, x, ts, scl and bands) into harmonised period medians.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import experiments, temporal
from .sources import sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="terralume")
    p.add_argument("mode", choices=("label_efficiency", "transfer", "self_training", "composite"))
    p.add_argument("--pixels", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--features", nargs="+", default=["b03", "b04", "b08"])
    p.add_argument("--classes", type=int, default=4)
    p.add_argument("--sites", nargs="*", default=[])
    p.add_argument("--seeds", type=int, default=3)
    p.add_argument("--fractions", type=float, nargs="+", default=[0.05, 0.1, 0.25, 1.0])
    p.add_argument("--threshold", type=float, default=0.8)
    p.add_argument("--period", default="annual", choices=sorted(temporal.PERIODS))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("terralume").getOrCreate()
    px, ids, seeds = spark.read.parquet(a.pixels), range(a.classes), range(a.seeds)
    if a.mode == "composite":
        clear = temporal.cloud_masked(temporal.harmonised(px, a.features))
        sinks.write_composite(temporal.period_median(clear, ["site", "y", "x"], a.features, a.period), a.out)
        return
    if a.mode == "label_efficiency":
        got = experiments.label_efficiency(px, "unit", a.features, ids, a.fractions, seeds)
    elif a.mode == "transfer":
        sites = a.sites or [r.site for r in px.select("site").distinct().orderBy("site").collect()]
        got = experiments.transfer_matrix(px, sites, a.features, ids, seeds)
    else:
        got = None
        for f in a.fractions:
            one = experiments.self_training(px, "unit", a.features, ids, f, a.threshold)
            got = one if got is None else got.unionByName(one)
    sinks.write_text(sinks.rows_json(got), a.out)


if __name__ == "__main__":
    main()
