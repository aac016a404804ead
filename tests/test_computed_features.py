"""A model's features are computed once, and the forest keeps its rows' nodes from level to level."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from txnrisk.operators import ml
from txnrisk.plans import queries


def test_a_fit_reads_computed_features(spark):
    df = queries._split_features(spark, SF_SMALL)
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()  # every pass went through the windows before
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()


def test_the_forest_keeps_node_ids():
    forest = ml.random_forest_pipeline().getStages()[-1]
    assert forest.getCacheNodeIds() and forest.getNumTrees() == 100 and forest.getMaxDepth() == 10


def test_opened_blocks_take_no_join_of_the_vectors(spark):
    rows = [(i, [float(i % 37), float(i % 11)], [i]) for i in range(407)]
    points = spark.createDataFrame(rows, "a long, _z array<double>, keys array<long>")
    _, opened = ml.nearest_points(points, 5, 1, 32)
    plan = opened.select("a", "_z")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # the bound of the reach, and the blocks' sizes; the vectors went through one more before
    assert opened.groupBy("a", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count() == 0
