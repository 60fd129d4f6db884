"""Exact quantiles by ranges, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralume.operators.quantiles import quantiles

WANTED = {"low": 0.0, "q2": 0.02, "mid": 0.5, "q95": 0.95, "high": 1.0}


def test_groups_of_every_kind(spark):
    rng = np.random.default_rng(5)
    held = {"many": rng.normal(size=5000), "ties": rng.integers(0, 3, 4001) / 2, "one": np.array([7.5]), "two": np.array([1.0, 2.0]), None: rng.exponential(size=333)}
    rows = [(k, float(v)) for k, vs in held.items() for v in vs] + [("ties", None), ("nothing", None)]
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, x double"), "x", WANTED, ["g"]).collect()}
    assert set(got) == set(held)
    for k, vs in held.items():
        assert [got[k][n] for n in WANTED] == pytest.approx(np.quantile(vs, list(WANTED.values())), rel=1e-12), k


def test_whole_table_and_empty(spark):
    df = spark.range(1001).select(F.pmod(F.col("id") * 37, F.lit(1001)).alias("x"))
    assert quantiles(df, "x", {"a": 0.25, "b": 0.999}).first().asDict() == pytest.approx({"a": 250.0, "b": 999.0})
    assert quantiles(df.filter("x < 0"), "x", {"a": 0.25}).count() == 0


def test_no_group_in_one_task(spark):
    """A group of many values is cut into ranges: the running count is by group and range."""
    df = spark.range(10_000).select(F.lit("g").alias("g"), F.col("id").alias("x"))
    plan = quantiles(df, "x", {"mid": 0.5}, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "hashpartitioning(g#" in plan and "_range" in plan
