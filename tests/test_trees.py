import glob
import os

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from larder.checks import spark_queries
from larder.operators import models, trees
from tools.check_oracle import compare

FEATURES = ["x1", "x2", "x3"]
SMALL = {
    "forest": {"numTrees": 7, "maxDepth": 6},
    "boosted": {"maxIter": 6, "maxDepth": 4},
}


@pytest.fixture(scope="module")
def rows(spark):
    x = [(F.col("id") * k % m).cast("double") for k, m in ((1, 17), (3, 11), (7, 29))]
    return spark.range(900).select(
        F.col("id").alias("Store"),
        F.lit("2020-01-01").cast("date").alias("Date"),
        *[c.alias(f) for c, f in zip(x, FEATURES)],
        (100 + 50 * F.sin(x[0]) + x[1] * x[1] + F.col("id") % 5).alias("Sales"),
    )


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_nodes_score_like_the_model(spark, rows, kind):
    model = models.fit(kind, rows, FEATURES, **SMALL[kind])
    nodes = trees.node_table(spark, model, FEATURES)
    keys = ["Store", "Date"]
    by_joins = trees.score_nodes(nodes, rows, FEATURES, trees.depth(model), keys, "by_joins")
    both = models.score(model, rows).join(by_joins, keys)
    assert both.count() == 900
    assert both.filter(F.abs(F.col("prediction") - F.col("by_joins")) > 1e-9).isEmpty()
    expected = {r.feature: r.importance for r in models.importance(spark, model, FEATURES).collect()}
    found = {r.feature: r.importance for r in trees.node_importance(nodes, per_tree=kind == "forest").collect()}
    assert {f: v for f, v in expected.items() if v} == pytest.approx(found)


def test_nodes_form_trees(spark, rows):
    nodes = trees.node_table(spark, models.fit("forest", rows, FEATURES, **SMALL["forest"]), FEATURES)
    assert nodes.filter("node = 0").count() == 7
    assert nodes.agg(F.round(F.sum(F.when(F.col("node") == 0, F.col("weight"))), 9)).first()[0] == 1
    children = nodes.selectExpr("tree", "explode(array(left, right)) AS node").filter("node IS NOT NULL")
    assert children.count() == children.distinct().count() == nodes.filter("node > 0").count()
    assert nodes.filter("feature IS NULL AND (gain IS NOT NULL OR left IS NOT NULL)").isEmpty()


def test_score_of_no_rows_and_of_a_single_leaf(spark, rows):
    flat = models.fit("boosted", rows.withColumn("Sales", F.lit(4.0)), FEATURES, maxIter=2)
    nodes = trees.node_table(spark, flat, FEATURES)
    keys = ["Store", "Date"]
    scored = trees.score_nodes(nodes, rows.limit(3), FEATURES, trees.depth(flat), keys)
    assert [r.prediction for r in scored.collect()] == pytest.approx([4.0] * 3)
    assert trees.score_nodes(nodes, rows.limit(0), FEATURES, 0, keys).collect() == []
    assert trees.node_importance(nodes).collect() == []


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        view = os.path.basename(path).removesuffix(".parquet")
        c.sql(f"CREATE VIEW {view} AS SELECT * FROM '{path}'")
    return c


QUERIES = ["score", "score_horizon", "prediction_table", "coef_importance", "fit_linear_merged", "score_nodes"]


@pytest.mark.parametrize("name", QUERIES)
def test_models_equal_those_of_sql(spark, connection, name):
    assert compare(spark, connection, name, SF).startswith("equal")


@pytest.mark.parametrize("name", ["score", "prediction_table"])
def test_a_model_that_predicts_nothing_is_noticed(spark, connection, name, monkeypatch):
    def nothing(model, df):
        return df.withColumn(model.stages[-1].getPredictionCol(), F.lit(0.0))

    monkeypatch.setattr(spark_queries.models, "score", nothing)
    assert compare(spark, connection, name, SF).startswith("DIFFERENT values")
