"""Every registered query that has SQL, against DuckDB, on the smallest tables."""

import os

import pytest

import tools_verify
from terralume.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    tools_verify.views(con, SF)
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert tools_verify.rows(df.columns, df.collect()) == tools_verify.rows(rel.columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["site", "year", "cls", "n_px", "mean_ndvi"]


def test_no_quadratic_joins(spark):
    """No plan of the pixel queries joins everything with everything."""
    for name in ("class_area_by_site_year", "tile_label_stats", "kappa_site_pooled", "block_cv_split", "coarse_label_purity"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
