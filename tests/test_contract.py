"""The registered queries, compared with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as contract
from larder.checks import oracle, spark_queries
from tools.check_oracle import compare


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        view = os.path.basename(path).removesuffix(".parquet")
        c.sql(f"CREATE VIEW {view} AS SELECT * FROM '{path}'")
    return c


def test_every_query_has_sql():
    assert set(spark_queries.QUERIES) == set(oracle.statements())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(spark_queries.QUERIES) <= set(contract.queries())


def test_entry(spark):
    advice = contract.entry(spark)
    assert advice.count() == 10


# A spread over all areas; tools/check_oracle.py runs every query.
@pytest.mark.parametrize("name", [
    "bronze_ingest", "sink_append", "quality_counts", "rule_audit", "clean_sales", "clean_stores",
    "lag_features_calendar", "rolling_moments", "build_features", "histogram", "time_split",
    "model_comparison", "optimize_stores", "optimal_inventory_unknown", "dedupe_latest_load",
    "exact_quantile", "corr_matrix", "fit_linear", "orphan_check", "service_z", "accuracy_by_type", "promo_analysis",
])
def test_query_equals_its_sql(spark, connection, name):
    assert compare(spark, connection, name, SF).startswith("equal")
